"""Places of rows in an order, also where one key holds most of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..joins import sized


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with number: their place, from 1, in the order within their keys; order must tell all rows of a key apart.

    Rows are dealt to ranges of keys and order, so that a key that holds most rows is in many tasks; a row's place is that within its
    range plus the key's rows in the ranges before. keep writes a table to the shared folder and reads it again:
    ranges are drawn from a sample, so they must not be drawn twice."""
    ranged = keep(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    counts = keep(counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before")))
    inside = ranged.withColumn("_place", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)))
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.col("_range") == F.col("_at"))
    return inside.join(sized(counts), same).select(*rows.columns, (F.col("_before") + F.col("_place")).alias("number"))
