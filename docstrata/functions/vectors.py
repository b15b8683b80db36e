"""Vector arithmetic on arrays, in double precision, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def normalized(a: Column) -> Column:
    """a at length one, or as it is if it is 0; its length is made once, not again for each component."""
    return let(norm(a), lambda size: F.transform(a, lambda x: F.when(size == 0, x.cast("double")).otherwise(x.cast("double") / size)))


def mean_pool(df: DataFrame, keys: list[str], vector: str, out: str = "vector") -> DataFrame:
    """Element-wise mean of the vectors of each key, of unit length; partial means meet in the shuffle."""
    parts = df.select(*keys, F.posexplode(vector).alias("_pos", "_x")).groupBy(*keys, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    whole = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"]).alias("_v"))
    return whole.select(*keys, normalized(F.col("_v")).alias(out))


def rounded(a: Column, digits: int = 6) -> Column:
    return F.transform(a, lambda x: F.round(x, digits) + 0.0)
