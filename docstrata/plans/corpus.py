"""A project corpus derived from the given tables, so that every operator has rows of its own kind.

The relations are plain SQL that Spark and DuckDB both run: marker lines are functions of doc_id. They
grow with documents and embeddings.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

RELATIONS = """
base AS (
  SELECT doc_id, CAST(doc_id % 20 + 20 * CAST(floor(doc_id / 20000) AS BIGINT) AS INT) AS project_id, CAST(floor(doc_id % 20000 / 20) AS BIGINT) AS k, text, lang FROM documents),
artifacts AS (
  SELECT doc_id AS artifact_id, project_id, k,
    concat('note_', lpad(CAST(doc_id AS STRING), 6, '0'), '.txt') AS original_filename, 'txt' AS file_type,
    CASE WHEN k % 13 <> 6 THEN CAST(DATE '2023-01-01' + CAST(k * 9 % 1500 AS INT) AS TIMESTAMP) END AS fs_created,
    CASE WHEN k % 13 <> 6 THEN CAST(DATE '2023-01-03' + CAST(k * 9 % 1500 AS INT) AS TIMESTAMP) END AS fs_modified,
    CAST(DATE '2024-06-01' + CAST(k % 100 AS INT) AS TIMESTAMP) AS ingested_at,
    concat_ws(chr(10), text,
      CASE WHEN k % 3 = 0 THEN concat('Results of Experiment ', CAST(CAST(floor(k / 6) AS BIGINT) AS STRING), ' in Python cost $', CAST(100 + k AS STRING), 'k.') END,
      CASE WHEN k % 4 = 1 THEN concat('Minutes dated ', CAST(DATE '2023-02-01' + CAST(k * 7 % 1400 AS INT) AS STRING), '.') END,
      CASE WHEN k % 5 = 2 THEN concat('Builds on note_', lpad(CAST(doc_id - 20 AS STRING), 6, '0'), '.txt here.') END,
      CASE WHEN k % 5 = 3 THEN concat('As in Protocol alpha ', lpad(CAST(doc_id - 60 AS STRING), 6, '0'), ' we saw.') END,
      CASE WHEN k % 7 = 3 THEN concat('We still need to run control assay batch', CAST(k AS STRING), '.') END,
      CASE WHEN k % 7 = 4 AND k % 2 = 0 THEN 'Finished control assay batch work.' END,
      CASE WHEN k % 9 = 2 THEN concat('Hypothesis H', CAST(CAST(floor(k / 18) AS BIGINT) AS STRING), ' rests on [', CAST(CAST(floor(k / 27) AS BIGINT) AS STRING), '] and 10.1000/x', CAST(k AS STRING), '.') END,
      CASE WHEN k % 7 = 5 OR k % 10 = 9 OR k % 12 = 0 THEN concat('We are waiting on reagent', translate(lpad(CAST(k AS STRING), 6, '0'), '0123456789', 'abcdefghij'), ' shipment', translate(lpad(CAST(k AS STRING), 6, '0'), '0123456789', 'abcdefghij'), '.') END,
      CASE WHEN k % 8 = 6 THEN 'Sent last week.' END,
      CASE WHEN k % 8 = 5 THEN 'Review on March 5, 2023 or last week.' END) AS raw_text
  FROM base),
headings AS (SELECT artifact_id, project_id, concat('Protocol alpha ', lpad(CAST(artifact_id AS STRING), 6, '0')) AS label FROM artifacts WHERE k % 2 = 0),
metadata AS (
  SELECT artifact_id, project_id, 'CreationDate' AS key, 'D:20230115093000' AS value, 0 AS ordinal FROM artifacts WHERE k % 6 = 1
  UNION ALL SELECT artifact_id, project_id, 'ModDate', '2023-05-01 10:00:00', 1 FROM artifacts WHERE k % 6 = 1
  UNION ALL SELECT artifact_id, project_id, 'exif.DateTime', '2022:03:04 05:06:07', 1 FROM artifacts WHERE k % 6 = 2
  UNION ALL SELECT artifact_id, project_id, 'Title', 'untitled', 0 FROM artifacts WHERE k % 6 = 2),
projects AS (SELECT DISTINCT project_id, CAST(project_id % 2 AS INT) AS owner_id, concat('Project ', CAST(project_id AS STRING)) AS name FROM base),
phases AS (SELECT * FROM (VALUES (0, 'Conceptualization & Planning'), (1, 'Execution'), (2, 'Analysis'), (3, 'Reporting & Dissemination')) AS v(phase_id, phase_name)),
classification AS (
  SELECT project_id, CASE WHEN project_id % 4 = 3 THEN 'engineering' WHEN project_id % 4 = 2 THEN 'cooking' ELSE 'research' END AS domain,
    0.3 + (project_id % 5) * 0.15 AS confidence, project_id % 7 = 0 AS confirmed FROM projects WHERE project_id <> 13),
assignments AS (
  SELECT artifact_id, project_id, CAST(k % 3 AS INT) AS phase_id, 0.5 + (k % 5) * 0.1 AS confidence, CASE WHEN k % 10 = 9 THEN 'human' ELSE 'auto' END AS source
  FROM artifacts WHERE k % 3 <> 2 OR project_id % 2 = 0 OR k = 2
  UNION ALL SELECT artifact_id, project_id, 1, 0.6, 'auto' FROM artifacts WHERE k % 12 = 0),
vectors AS (
  SELECT a.artifact_id, a.project_id, e.embedding AS vector, CAST(CASE WHEN e.label % 4 = 3 THEN -1 ELSE e.label * 10 + floor(a.k / 8) END AS INT) AS cluster_id
  FROM (SELECT top - vec_id AS of_id, embedding, label FROM embeddings CROSS JOIN (SELECT max(doc_id) AS top FROM documents) AS t) e JOIN artifacts a ON a.artifact_id = e.of_id),
ledger AS (
  SELECT artifact_id, 'parse' AS stage, CASE WHEN k % 11 = 4 THEN 'skipped' WHEN k % 13 = 5 THEN 'error' ELSE 'done' END AS status, sha2_256(raw_text) AS input_hash, concat('parse ', CAST(k AS STRING)) AS message FROM artifacts WHERE k % 9 <> 8
  UNION ALL SELECT artifact_id, 'extract', CASE WHEN k % 17 = 6 THEN 'error' ELSE 'done' END, CASE WHEN k % 5 = 1 THEN 'old' ELSE sha2_256(raw_text) END, concat('extract ', CAST(k AS STRING)) FROM artifacts WHERE k % 3 <> 2
  UNION ALL SELECT artifact_id, 'embed', 'done', sha2_256(raw_text), 'embed' FROM artifacts WHERE k % 4 = 0 OR project_id % 4 = 1),
feedback AS (
  SELECT artifact_id, project_id, 'current' AS label, CAST(DATE '2024-01-01' AS TIMESTAMP) AS given_at FROM artifacts WHERE k % 10 = 3
  UNION ALL SELECT artifact_id, project_id, 'superseded', CAST(DATE '2024-02-01' AS TIMESTAMP) FROM artifacts WHERE k % 20 = 3),
snapshots AS (
  SELECT artifact_id AS snapshot_id, project_id, concat('summary ', CAST(k AS STRING)) AS summary, CAST(DATE '2024-01-01' + CAST(k * 3 % 50 AS INT) AS TIMESTAMP) AS computed_at FROM artifacts WHERE project_id % 5 <> 4),
versions AS (
  SELECT artifact_id, project_id, v AS version, artifact_id * 10 + v AS version_id, CASE WHEN k % 5 = 0 THEN '' ELSE concat('name-', CAST(artifact_id AS STRING), '-v', CAST(v AS STRING), '.txt') END AS suggested_name, 'Analysis' AS category
  FROM artifacts JOIN (SELECT * FROM (VALUES (1), (2), (3)) AS x(v)) AS n ON v <= 1 + k % 3),
old_gaps AS (
  SELECT project_id, concat('structural:', CAST(p AS STRING)) AS gap_key, CASE WHEN project_id % 3 = 0 THEN 'confirmed' ELSE 'open' END AS status, 0.8 AS confidence FROM projects JOIN (SELECT * FROM (VALUES (0), (3)) AS y(p)) AS q ON true)
"""


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared checkpoint folder. A session on one machine that names no folder gets a temporary
    one; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read again."""
    path = shared_path(df.sparkSession, "derived")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Corpus:
    """The relations as DataFrames, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def relation(self, name: str) -> DataFrame:
        given = ", ".join(f"{t} AS (SELECT * FROM parquet.`{self.sf_dir}/{t}.parquet`)" for t in ("documents", "embeddings"))
        sql = RELATIONS.replace("sha2_256(raw_text)", "sha2(raw_text, 256)")
        return self.spark.sql(f"WITH {given}, {sql} SELECT * FROM {name}")

    @cached_property
    def artifacts(self) -> DataFrame:
        labels = self.relation("headings").groupBy("artifact_id").agg(F.array_sort(F.collect_list("label")).alias("headings"))
        none = F.array().cast("array<string>")
        return self.relation("artifacts").join(labels, "artifact_id", "left").withColumn("headings", F.coalesce("headings", none))

    @cached_property
    def content(self) -> DataFrame:
        return self.relation("artifacts").select("artifact_id", "project_id", "raw_text")
