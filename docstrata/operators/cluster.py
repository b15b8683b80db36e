"""Density clustering of document vectors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..config import RULES
from ..functions.vectors import dot, normalized

#: Directions on which vectors are laid out; close vectors lie in the same or in neighbouring cells of each.
DIRECTIONS = 2


def _cell(vector: Column, direction: int, width: float) -> Column:
    """Which cell of that width the vector lies in along a fixed unit direction (signs from a hash)."""
    signs = F.transform(vector, lambda x, i: x * F.when(F.pmod(F.xxhash64(F.lit(direction), i), F.lit(2)) == 0, 1).otherwise(-1))
    along = F.aggregate(signs, F.lit(0.0), lambda s, x: s + x) / F.sqrt(F.size(vector).cast("double"))
    return F.floor(along / width).cast("long")


def close_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """project_id, a, b: ordered pairs of artifacts of a project whose vectors (artifact_id, project_id,
    vector) have at least that cosine similarity. Unit vectors that close differ by at most sqrt(2 - 2 least)
    along any direction, so only vectors in neighbouring cells are compared."""
    width = math.sqrt(max(2 - 2 * least, 1e-6))
    unit = vectors.select("project_id", "artifact_id", normalized(F.col("vector")).alias("u"))
    laid = unit.select("project_id", F.col("artifact_id").alias("a"), F.col("u").alias("x"), *[_cell(F.col("u"), d, width).alias(f"c{d}") for d in range(DIRECTIONS)])
    near = laid.select("project_id", F.col("a").alias("b"), F.col("x").alias("y"), *[F.col(f"c{d}") for d in range(DIRECTIONS)])
    for d in range(DIRECTIONS):
        near = near.withColumn(f"c{d}", F.explode(F.array(*[F.col(f"c{d}") + k for k in (-1, 0, 1)])))
    pairs = laid.join(near.hint("merge"), ["project_id", *[f"c{d}" for d in range(DIRECTIONS)]])
    return pairs.where((F.col("a") != F.col("b")) & (dot(F.col("x"), F.col("y")) >= least)).select("project_id", "a", "b")


def density_clusters(vectors: DataFrame, keep: Callable[[DataFrame], DataFrame], least: float = RULES.cluster_similarity, min_points: int = RULES.cluster_min_points) -> DataFrame:
    """artifact_id, project_id, cluster_id of vectors: a core has at least min_points - 1 close others; cores
    that are close form a cluster, named by its smallest core; another artifact joins the cluster of its
    smallest close core, or is noise (-1). keep writes a table to the shared folder and reads it again."""
    pairs = keep(close_pairs(vectors, least))
    core = keep(pairs.groupBy("project_id", "a").agg(F.count("*").alias("n")).where(F.col("n") >= min_points - 1).select("project_id", F.col("a").alias("id")))
    edges = keep(pairs.join(core.withColumnRenamed("id", "a").hint("merge"), ["project_id", "a"]).join(core.withColumnRenamed("id", "b").hint("merge"), ["project_id", "b"]).select("a", "b"))
    labels = keep(core.select("id", F.col("id").alias("label")))
    while True:  # the smallest label nearby, then the label of the label: distances double each round
        offered = edges.join(labels.withColumnRenamed("id", "b").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("offer"))
        lower = labels.join(offered.withColumnRenamed("a", "id").hint("merge"), "id", "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("offer", "label")).alias("label"))
        of = lower.select(F.col("id").alias("label"), F.col("label").alias("next"))
        after = keep(lower.join(of.hint("merge"), "label").select("id", F.col("next").alias("label"), (F.col("next") != F.col("was")).alias("moved")))
        labels = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    border = pairs.join(labels.withColumnRenamed("id", "b").hint("merge"), "b").groupBy("a").agg(F.min_by("label", "b").alias("border"))
    named = vectors.select("artifact_id", "project_id").join(labels.withColumnRenamed("id", "artifact_id").hint("merge"), "artifact_id", "left").join(border.withColumnRenamed("a", "artifact_id").hint("merge"), "artifact_id", "left")
    return named.select("artifact_id", "project_id", F.coalesce("label", "border", F.lit(-1)).cast("long").alias("cluster_id"))
