"""Places of rows within keys, of which one holds most rows."""

from collections import defaultdict

from pyspark.sql import functions as F

from docstrata.operators import gaps, phases
from docstrata.operators.order import numbered
from docstrata.plans.corpus import written

ROWS = [(1 if i % 10 else i % 3 or None, i // 7 % 50 if i % 11 else None, i) for i in range(4000)]
SCHEMA = "project_id int, ingested_at int, artifact_id long"


def places(rows):
    """number of each artifact: by time (unknown first), then id, within its project."""
    own = defaultdict(list)
    for project, at, artifact in rows:
        own[project].append((at is not None, at or 0, artifact))
    return {r[2]: n for some in own.values() for n, r in enumerate(sorted(some), 1)}


def test_numbers_of_a_hot_key(spark):
    seen = []

    def keep(df):
        seen.append(written(df))
        return seen[-1]

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
        got = numbered(df, ["project_id"], ["ingested_at", "artifact_id"], keep)
        assert {r.artifact_id: r.number for r in got.collect()} == places(ROWS) and got.columns == df.columns + ["number"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    largest = seen[0].groupBy("project_id", "_range").count().agg(F.max("count")).first()[0]
    assert largest < len(ROWS) / 2  # no task holds most of the project that has nine tenths of the rows


def test_falling_order_and_no_rows(spark):
    df = spark.createDataFrame(ROWS[:300], SCHEMA)
    got = {r.artifact_id: r.number for r in numbered(df, ["project_id"], [F.desc("artifact_id")], written).collect()}
    assert got == places([(p, -a, a) for p, _, a in ROWS[:300]])
    assert numbered(df.limit(0), ["project_id"], ["artifact_id"], written).collect() == []


def test_batches(spark):
    got = phases.batches(spark.createDataFrame(ROWS, SCHEMA), 8, written).collect()
    want = places(ROWS)
    assert len(got) == len(ROWS) and all(r.batch * 8 + r.batch_index + 1 == want[r.artifact_id] and r.batch_index < 8 for r in got)


def test_later_range_counts_the_pairs(spark):
    """Dates that repeat, artifacts without one, a project of one artifact and one where nothing has a date."""
    rows = [(i, 1 if i < 60 else 2 if i < 80 else 3 if i < 84 else 4) for i in range(85)]
    artifacts = spark.createDataFrame([(a, p) for a, p in rows], "artifact_id long, project_id int")
    days = [(a, None if p == 3 or a % 9 == 4 else f"2024-01-{1 + a * 7 % 20:02d}") for a, p in rows if a % 13]
    dates = spark.createDataFrame(days, "artifact_id long, day string").select("artifact_id", F.to_timestamp("day").alias("ts"))
    sources = artifacts.where("artifact_id % 2 = 0").union(artifacts.where("artifact_id = 4"))
    pairs = gaps.later_artifacts(sources, artifacts, dates).groupBy("artifact_id").agg(F.count("*").alias("n"), F.min("later_ts").alias("ts"))
    want = {(r.artifact_id, r.n, r.ts) for r in pairs.collect()}
    assert {(r.artifact_id, r.n_later, r.first_ts) for r in gaps.later_range(sources, artifacts, dates, written).collect()} == want and want
