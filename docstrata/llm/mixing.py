"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source fall into about sqrt(n) blocks. A source's target says how many whole passes
over its blocks it gives, and how many blocks of one more, permuted, pass. A binary tree splits these
exact block quotas among output shards: each node draws, source by source, how many blocks go to its
left half (hypergeometric, so that all source quotas and shard sizes hold exactly). A shard then takes
the next blocks of each source's permuted order, disjoint from other shards', and shuffles locally.
All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WORD, cut, uniform

#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 10_000

#: One hypergeometric draw: how many of n_left taken from n_all are among the n_own of one source.
#: It walks the terms of the distribution upward from 12 deviations below the mode; the terms left
#: out are below double precision. u is uniform in (0, 1).
_DRAW = """
transform(array(named_struct(
  'lo', greatest(0L, s.l - (s.p - q), mode - wide), 'hi', least(q, s.l, mode + wide))),
 r -> transform(array(
   u * aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 't', 0D),
     (a, k) -> named_struct('w', a.w * cast(q - k as double) * cast(s.l - k as double) / cast((k + 1) as double) / cast(greatest(1L, s.p - q - s.l + k + 1) as double), 't', a.t + a.w), a -> a.t)),
   goal -> aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 't', 0D, 'k', cast(null as bigint)),
     (a, k) -> named_struct('w', a.w * cast(q - k as double) * cast(s.l - k as double) / cast((k + 1) as double) / cast(greatest(1L, s.p - q - s.l + k + 1) as double), 't', a.t + a.w,
       'k', coalesce(a.k, if(a.t + a.w >= goal or k = r.hi, k, cast(null as bigint)))), a -> a.k))[0])[0]
"""


def _left_quotas() -> str:
    """SQL for the left child's quotas of a node with columns node and quotas."""
    mode = "greatest(0L, least(q, s.l, cast(floor(cast(q + 1 as double) * (s.l + 1) / (s.p + 2)) as bigint)))"
    wide = "cast(ceil(12 * sqrt(cast(least(q, s.l) as double))) + 20 as bigint)"
    u = "((pmod(xxhash64(seed, node, s.i), 4503599627370496L) + 0.5D) / 4503599627370496D)"
    draw = _DRAW.replace("mode", mode).replace("wide", wide).replace("u *", f"{u} *")
    total = "aggregate(quotas, 0L, (t, q) -> t + q)"
    return f"""aggregate(quotas,
      named_struct('i', 0, 'p', {total}, 'l', cast(floor({total} / 2) as bigint), 'out', cast(array() as array<bigint>)),
      (s, q) -> transform(array({draw}), h -> named_struct('i', s.i + 1, 'p', s.p - q, 'l', s.l - h, 'out', array_append(s.out, h)))[0],
      s -> s.out)"""


def split_quotas(quotas: DataFrame, n_shards: int, seed: int = 7) -> DataFrame:
    """quotas: sid int from 1 without holes, quota bigint. Returns sid, shard, lo, hi: which of the
    source's block draws (from lo, below hi) each of n_shards (a power of two) takes."""
    tree = quotas.agg(F.expr("transform(array_sort(collect_list(struct(sid, quota))), x -> x.quota)").alias("quotas"))
    tree = tree.select(F.lit(1).cast("long").alias("node"), F.lit(seed).alias("seed"), "quotas")
    for _ in range(int(math.log2(n_shards))):
        tree = tree.withColumn("left", F.expr(_left_quotas()))
        tree = tree.select("seed", F.explode(F.expr("array(struct(2 * node as node, left as quotas), struct(2 * node + 1 as node, zip_with(quotas, left, (q, l) -> q - l) as quotas))")).alias("x")).select("x.node", "seed", "x.quotas")
    shares = tree.select((F.col("node") - n_shards).cast("int").alias("shard"), F.posexplode("quotas").alias("pos", "share")).select((F.col("pos") + 1).alias("sid"), "shard", "share")
    before = F.sum("share").over(W.partitionBy("sid").orderBy("shard"))
    return shares.withColumn("hi", before).select("sid", "shard", (F.col("hi") - F.col("share")).alias("lo"), "hi").where("hi > lo")


def source_targets(sizes: DataFrame, limit: float = 3.0) -> DataFrame:
    """sizes: source, size. Returns sid, source, n_docs, source_size, target: weights 1, 2, 3 repeat by
    code point of the source (null last); a target stops at limit times the size, the excess going to
    the others by weight. Solved at once: target = min(cap, level * weight), level from the sources in
    order of cap / weight, of which those before the crossing are capped."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    own = own.withColumn("sid", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    own = own.withColumn("weight", (F.pmod(F.col("sid") - 1, F.lit(3)) + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(limit))
    every, order = W.partitionBy(), W.orderBy(F.col("cap") / F.col("weight"), "sid")
    own = own.withColumn("total", F.sum("source_size").over(every).cast("double"))
    own = own.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    own = own.withColumn("free", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    own = own.withColumn("level", (F.col("total") - F.col("capped")) / F.col("free"))
    # the first source whose cap isn't reached fixes the level for it and all after it
    own = own.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(every)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return own.select("sid", "source", "n_docs", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, n_shards: int = 16, limit: float = 3.0, seed: int = 7) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken, draws.

    size counts words. draws: array of (pass, shard, words, place): what each of n_shards (a power of two)
    that drew the document's block takes of it, place being the order within the shard. taken is the sum
    of its draws' words, at most limit times size; a source's taken words sum to its rounded target. A null text has size 0; a null source is a source
    of its own, the last. Rows that repeat are taken row by row. An empty table gives an empty result.
    The result depends on the rows alone, not on their order or partitions.
    """
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    sources = cut(source_targets(sized, limit))
    hint = "broadcast" if sources.count() <= BROADCAST_SOURCES else "merge"
    known = sources.withColumn("n_blocks", F.ceil(F.sqrt("n_docs")).cast("long")).withColumnRenamed("source", "own")
    rows = sized.join(known.hint(hint), sized["source"].eqNullSafe(known["own"])).drop("own")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("n_blocks")))

    # blocks of a source in permuted order; whole passes first, then blocks up to the target
    blocks = rows.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    order = W.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed + 1), "sid", "block"), "block")
    blocks = blocks.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).withColumn("after", F.sum("words").over(order)).withColumn("n", F.count("*").over(W.partitionBy("sid")))
    goal = F.round("target").cast("long")
    blocks = blocks.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
    blocks = blocks.withColumn("rest", goal - F.col("passes") * F.col("source_size")).withColumn("part", F.greatest(F.lit(0), F.least("words", F.col("rest") - (F.col("after") - F.col("words")))))
    blocks = cut(blocks.select("sid", "block", "rank", "n", "passes", "words", "part"))

    quotas = blocks.groupBy("sid").agg((F.max("passes") * F.max("n") + F.count_if(F.col("part") > 0)).alias("quota"))
    shares = split_quotas(quotas, n_shards, seed).select("sid", "shard", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("draw"))
    drawn = _draws(blocks)
    placed = drawn.join(shares.hint("merge"), ["sid", "draw"]).groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("placed"))

    # of the one block per source that the target cuts, its documents in permuted order
    own = rows.select("doc_id", "sid", "block", "size", "source_size", "target")
    whole = blocks.join(placed.hint("merge"), ["sid", "block"], "left").select("sid", "block", "passes", F.col("part").alias("_part"), (F.col("part") > 0).alias("more"), (F.col("part") < F.col("words")).alias("cut"), "placed")
    own = own.join(whole.hint("merge"), ["sid", "block"])
    inside = W.partitionBy("sid", "block").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "size"), "doc_id", "size")
    easy = own.where(~(F.col("more") & F.col("cut"))).withColumn("extra", F.when(F.col("more"), F.col("size")).otherwise(0).cast("long"))
    hard = own.where(F.col("more") & F.col("cut")).withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("_part") - (F.sum("size").over(inside) - F.col("size")))).cast("long"))
    both = easy.unionByName(hard)
    draws = F.expr(f"filter(transform(coalesce(placed, array()), d -> struct(d.pass as pass, d.shard as shard, if(d.pass < passes, size, extra) as words, xxhash64({seed + 3}, d.shard, d.pass, doc_id) as place)), d -> d.words > 0)")
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda words, d: words + d["words"])
    return both.select("doc_id", "size", "source_size", "target", draws.alias("draws")).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")


def _draws(blocks: DataFrame) -> DataFrame:
    """sid, block, pass, draw: every block once for each pass that takes it, numbered within its source."""
    last = F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)
    passes = F.when(last > 0, F.sequence(F.lit(0).cast("long"), last - 1)).otherwise(F.array().cast("array<bigint>"))
    return blocks.select("sid", "block", "rank", "n", F.explode(passes).alias("pass")).select("sid", "block", "pass", (F.col("pass") * F.col("n") + F.col("rank")).alias("draw"))
