"""Clean names, categories and virtual paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import extension, slugify, stem, suggested_name, virtual_path


def top_entities(mentions: DataFrame, n: int = 3) -> DataFrame:
    """The n entities of each artifact that it mentions most."""
    counts = mentions.groupBy("artifact_id", "kind", "normalized_value").agg(F.count("*").alias("n"))
    order = W.partitionBy("artifact_id").orderBy(F.desc("n"), "kind", "normalized_value")
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def view_projection(artifacts: DataFrame, dates: DataFrame, categories: DataFrame, top: DataFrame, slugs: DataFrame | None = None) -> DataFrame:
    """artifact_id, suggested_name, category, virtual_path. slugs (artifact_id, slug) may name artifacts;
    a slug of fewer than three characters is not used."""
    first = top.where("rank = 1").select("artifact_id", F.col("normalized_value").alias("entity"))
    rows = artifacts.join(dates.select("artifact_id", "ts"), "artifact_id", "left").join(categories, "artifact_id", "left").join(first, "artifact_id", "left")
    own = slugify(stem(F.col("original_filename")))
    if slugs is not None:
        rows = rows.join(slugs.select("artifact_id", slugify(F.col("slug")).alias("given")), "artifact_id", "left")
        good = F.length("given") >= 3
        own, entity = F.when(good, F.col("given")).otherwise(own), F.when(~F.coalesce(good, F.lit(False)), F.col("entity"))
    else:
        entity = F.col("entity")
    name = suggested_name(F.date_format("ts", "yyyy-MM-dd"), own, entity, extension(F.col("original_filename")))
    rows = rows.withColumn("category", F.coalesce("category", F.lit("Uncategorized"))).withColumn("suggested_name", name)
    return rows.select("artifact_id", "project_id", "suggested_name", "category", virtual_path(F.col("category"), F.col("ts"), F.col("suggested_name")).alias("virtual_path"))


def override_names(current: DataFrame, feedback: DataFrame, dates: DataFrame) -> DataFrame:
    """A new human version of each row that feedback (artifact_id, name) renames: the category stays, the
    path follows the name."""
    rows = current.join(feedback.select("artifact_id", F.col("name").alias("human")), "artifact_id").join(dates.select("artifact_id", "ts"), "artifact_id", "left")
    return rows.select("artifact_id", (F.col("version") + 1).alias("version"), F.col("human").alias("suggested_name"), "category", virtual_path(F.col("category"), F.col("ts"), F.col("human")).alias("virtual_path"), F.lit("human").alias("source"))
