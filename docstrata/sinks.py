"""Tables kept by project: partitions of Parquet files, each of which a write replaces as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators.ingest import replace_rows


def _folder(spark: SparkSession, path: str):
    """The file system of path, and path as it knows it."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def exists(spark: SparkSession, path: str) -> bool:
    files, made = _folder(spark, path)
    return files.exists(made)


def write_projects(rows: DataFrame, path: str, projects: DataFrame | None = None) -> None:
    """Replaces the partitions of rows' projects (project_id) in the table at path; others stay.

    Rows are written aside, below path, and take their partitions' places once all tasks are done: a write that fails
    leaves the old rows, and one that is repeated replaces what it wrote. Rows of one project meet in few tasks, so that files
    don't multiply by tasks; a large project is split. projects (project_id) are replaced too if rows has none of
    theirs: their partitions go. rows is read again for that, so it should be a table, not a costly plan."""
    rows.hint("rebalance", "project_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)
    if projects is not None:
        spark = rows.sparkSession
        files, _ = _folder(spark, path)
        stale = projects.select("project_id").distinct().join(rows.select("project_id").distinct().hint("merge"), "project_id", "left_anti")
        for r in stale.toLocalIterator():
            files.delete(_folder(spark, f"{path}/project_id={r.project_id}")[1], True)


def upsert_artifacts(new: DataFrame, keys: DataFrame, path: str, keep: Callable[[DataFrame], DataFrame]) -> None:
    """Replaces the rows of the artifacts in keys (project_id, artifact_id) by those of new in the table at path. Only
    the partitions of their projects are read and written. keep writes a table to the shared folder and reads it again."""
    spark, on = new.sparkSession, ["project_id", "artifact_id"]
    touched = keep(keys.select("project_id").unionByName(new.select("project_id")).distinct())
    old = spark.read.schema(new.schema).parquet(path) if exists(spark, path) else new.limit(0)
    merged = keep(replace_rows(old.select(*new.columns).join(touched.hint("merge"), "project_id", "left_semi"), keys, new, on))
    write_projects(merged, path, touched)
