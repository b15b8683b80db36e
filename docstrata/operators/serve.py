"""Read models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..joins import sized


def owned(projects: DataFrame, rows: DataFrame, owner: int) -> DataFrame:
    """Rows of the owner's projects."""
    mine = projects.where(F.col("owner_id") == owner).select("project_id")
    return rows.join(mine, "project_id", "left_semi")


def page(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of rows: limit is clamped to 1..200, offset to 0 or more."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))


def page_total(rows: DataFrame) -> DataFrame:
    """total: how many rows there are before a page is cut."""
    return rows.agg(F.count("*").alias("total"))


def project_list(projects: DataFrame, owner: int) -> DataFrame:
    """The owner's projects with their place in the list, by name and id."""
    mine = projects.where(F.col("owner_id") == owner)
    return mine.withColumn("place", F.row_number().over(W.partitionBy("owner_id").orderBy("name", "project_id")))


def browsed(artifacts: DataFrame, labels: DataFrame, assignments: DataFrame, phase_id: int | None = None, label: str | None = None) -> DataFrame:
    """The artifacts that a listing with these filters has."""
    rows = artifacts
    if phase_id is not None:
        rows = rows.join(assignments.where(F.col("phase_id") == phase_id).select("artifact_id"), "artifact_id", "left_semi")
    if label is not None:
        rows = rows.join(labels.where(F.col("label") == label).select("artifact_id"), "artifact_id", "left_semi")
    return rows


def browse(artifacts: DataFrame, dates: DataFrame, labels: DataFrame, assignments: DataFrame, phases: DataFrame, phase_id: int | None = None, label: str | None = None) -> DataFrame:
    """artifact_id, project_id, original_filename, ts, label, phases; filters by phase and label."""
    rows = browsed(artifacts.select("artifact_id", "project_id", "original_filename", "ingested_at"), labels, assignments, phase_id, label)
    named = assignments.join(sized(phases.select("phase_id", "phase_name").distinct()), "phase_id").groupBy("artifact_id").agg(F.array_join(F.array_sort(F.collect_set("phase_name")), ", ").alias("phases"))
    rows = rows.join(dates.select("artifact_id", "ts"), "artifact_id", "left").join(labels.select("artifact_id", "label"), "artifact_id", "left")
    return rows.join(named, "artifact_id", "left").withColumn("phases", F.coalesce("phases", F.lit("")))


def detail(artifacts: DataFrame, mentions: DataFrame, dates: DataFrame, edges: DataFrame) -> DataFrame:
    """artifact_id with its entities, dates by confidence and edges either way, as ordered text."""
    ents = mentions.groupBy("artifact_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "normalized_value"))), "; ").alias("entities"))
    sure = dates.groupBy("artifact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "ordinal", "source"))), lambda s: s["source"]), ", ").alias("dates"))
    links = edges.groupBy("artifact_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "direction", "edge_type", F.col("other_id").cast("string")))), "; ").alias("edges"))
    out = artifacts.select("artifact_id").join(ents, "artifact_id", "left").join(sure, "artifact_id", "left").join(links, "artifact_id", "left")
    return out.select("artifact_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("entities", "dates", "edges")])
