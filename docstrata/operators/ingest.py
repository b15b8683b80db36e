"""Ingest, structured tables and row replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import RULES


def ingest_merge(existing: DataFrame, seen: DataFrame) -> DataFrame:
    """project_id, content_hash, path and an action (created, updated, unchanged, missing) for files seen
    (project_id, content_hash, path) against the existing index. Of several paths of one hash the last
    one wins, so a second run changes nothing."""
    new = seen.groupBy("project_id", "content_hash").agg(F.max("path").alias("new_path"), F.count("*").alias("copies"))
    old = existing.select("project_id", "content_hash", F.col("path").alias("old_path"))
    action = F.when(F.col("old_path").isNull(), "created").when(F.col("new_path").isNull(), "missing").when(F.col("old_path") == F.col("new_path"), "unchanged").otherwise("updated")
    return old.join(new, ["project_id", "content_hash"], "full_outer").select("project_id", "content_hash", F.coalesce("new_path", "old_path").alias("path"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), action.alias("action"))


def replace_rows(target: DataFrame, keys: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """target without the rows whose key is in keys, and the new rows."""
    return target.join(keys.select(*on).distinct(), on, "left_anti").unionByName(new)


def header_names(cells: DataFrame) -> DataFrame:
    """table_id, pos, name: blank header cells become col_pos, repeated names get _1, _2 and so on."""
    named = cells.withColumn("name", F.when(F.trim(F.coalesce("cell", F.lit(""))) == "", F.concat(F.lit("col_"), F.col("pos"))).otherwise(F.trim("cell")))
    nth = F.row_number().over(W.partitionBy("table_id", "name").orderBy("pos")) - 1
    return named.withColumn("nth", nth).select("table_id", "pos", F.when(F.col("nth") == 0, F.col("name")).otherwise(F.concat_ws("_", "name", "nth")).alias("name"))


def table_text(tables: DataFrame, max_rows: int = RULES.table_rows, max_chars: int = RULES.table_chars) -> DataFrame:
    """artifact_id, raw_text from tables (artifact_id, title, sheet_no, sheet, columns, row_no, cells): the
    title, then for each sheet its name, columns and first rows that aren't blank."""
    blank = F.forall("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) == "")
    rows = tables.where(~blank).withColumn("n", F.row_number().over(W.partitionBy("artifact_id", "sheet_no").orderBy("row_no"))).where(F.col("n") <= max_rows)
    line = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " | ")
    body = rows.groupBy("artifact_id", "sheet_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line")))), lambda s: s["line"]), "\n").alias("body"))
    sheets = tables.groupBy("artifact_id", "sheet_no").agg(F.first("title").alias("title"), F.first("sheet").alias("sheet"), F.first("columns").alias("columns"))
    head = F.concat(F.lit("\nSheet: "), F.col("sheet"))
    head = F.when(F.size("columns") > 0, F.concat(head, F.lit("\nColumns: "), F.array_join("columns", ", "))).otherwise(head)
    part = sheets.join(body, ["artifact_id", "sheet_no"], "left").withColumn("part", F.concat_ws("\n", head, "body"))
    return part.groupBy("artifact_id").agg(F.substring(F.trim(F.concat_ws("\n", F.first("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_no", "part"))), lambda s: s["part"]), "\n"))), 1, max_chars).alias("raw_text"))


def structured_long(tables: DataFrame) -> DataFrame:
    """artifact_id, row_no, key, value of every cell of tables (artifact_id, row_no, record: map)."""
    return tables.select("artifact_id", "row_no", F.explode("record").alias("key", "value"))
