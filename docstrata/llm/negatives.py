"""Hard negatives of anchors by an inverted multi-index, exactly.

Vectors are halved; a small codebook for each half is fitted on a bounded sample, and a pair of codewords is a cell. Rows
are dealt to shards of bounded size by a hash of their id, so no cell or label crowds a task; a shard lays its rows
out by cell, with the radius of each codeword: how far its rows' halves lie from it at most. Anchors visit shards in
chunks of bounded size. In a shard, an anchor's inner product with a row is at most the sum of two half bounds,
codeword plus radius, so a heap over two sorted sequences yields cells by falling bounds. The first pass looks for the
best rows of the anchor's label and stops once the next cell can't hold a better one; the second looks for rows of other
labels inside the score windows that the positives give, and stops once all windows are certified: full with scores
above the next bound, or wholly above it. Shards' findings are merged by ranked windows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, discard

#: Rows that the codebooks are fitted on, codewords of each half.
SAMPLE = 4096
CODEWORDS = 16
#: Rows of a shard and anchors of a chunk: what meets in one task.
SHARD_ROWS = 16_384
CHUNK_ANCHORS = 1024
#: Scaled components are smaller than this, so that scores of up to 2,000 of them are exact in 64 bits.
LARGEST = 1 << 26


def fit_half(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k-means centroids of the rows of x."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(float)
    for _ in range(rounds):
        own = nearest(x, c)
        total, count = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(total, own, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def multi_sequence(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """a[i] + b[j], i, j for all pairs, largest sum first."""
    by_a, by_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap = [(-(a[by_a[0]] + b[by_b[0]]), 0, 0)] if len(a) and len(b) else []
    while heap:
        less, i, j = heapq.heappop(heap)
        yield -less, int(by_a[i]), int(by_b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[by_a[i]] + b[by_b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):  # each pair has one parent
            heapq.heappush(heap, (-(a[by_a[i + 1]] + b[by_b[0]]), i + 1, 0))


class Shard:
    """Rows laid out by cell. x is integer-valued; sums stay exact as doubles where sizes allow it."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        self.half, self.books = books[0].shape[1], books
        parts = x[:, : self.half].astype(float), x[:, self.half :].astype(float)
        codes = [nearest(p, c) for p, c in zip(parts, books)]
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.argsort(cell, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        exact = float(np.abs(x).max(initial=0)) ** 2 * max(1, x.shape[1]) < 1 << 52
        self.x = x[order].astype(float) if exact else x[order]
        self.bounds = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))
        self.radii = []
        for p, c, code in zip(parts, books, codes):
            r = np.full(len(c), -np.inf)  # of a codeword without rows
            np.maximum.at(r, code, np.sqrt(((p - c[code]) ** 2).sum(1)))
            self.radii.append(r)

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.x.dtype == float and float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * len(q) < 1 << 52:
            return (self.x[at] @ q.astype(float)).astype(np.int64)
        return self.x[at].astype(np.int64) @ q.astype(np.int64)

    def visits(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """rows, scores, bound: the rows of a few cells more each time, and what no row that is still to come exceeds."""
        sides = q[: self.half].astype(float), q[self.half :].astype(float)
        a, b = (c @ s + r * np.sqrt((s * s).sum()) if s.any() else np.where(r >= 0, 0.0, -np.inf) for s, c, r in zip(sides, self.books, self.radii))
        slack = 1e-9 * (1 + np.abs(a[np.isfinite(a)]).max(initial=0) + np.abs(b[np.isfinite(b)]).max(initial=0))
        held: list[np.ndarray] = []
        cells, most = 0, 4
        for bound, i, j in multi_sequence(a, b):
            if bound == -np.inf:
                break
            if cells >= most:
                at = np.concatenate(held)
                yield at, self.scores(q, at), bound + slack
                held, cells, most = [], 0, most * 2
            lo, hi = self.bounds[i * len(b) + j : i * len(b) + j + 2]
            if lo < hi:
                held.append(np.arange(lo, hi))
                cells += 1
        if held:
            at = np.concatenate(held)
            yield at, self.scores(q, at), -np.inf


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def best_positives(shard: Shard, anchor: int, label: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the first k rows of the shard with that label."""
    score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at, s, bound in shard.visits(q):
        good = (shard.labels[at] == label) & (shard.ids[at] != anchor)
        score, ids = _best(np.r_[score, s[good]], np.r_[ids, shard.ids[at][good]], k)
        if len(score) == k and score[-1] > bound:
            break
    return score, ids


def best_negatives(shard: Shard, label: int, q: np.ndarray, lows: list[int], highs: list[int], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window low..high of scores, scores and ids of the first k rows of other labels inside it."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in lows]
    for at, s, bound in shard.visits(q):
        other = shard.labels[at] != label
        s, ids = s[other], shard.ids[at][other]
        for n, (low, high) in enumerate(zip(lows, highs)):
            score, own = found[n]
            good = (s <= high) & (s >= (score[-1] if len(score) == k else low))
            if good.any():
                found[n] = _best(np.r_[score, s[good]], np.r_[own, ids[good]], k)
        if all(bound < low or len(f[0]) == k and f[0][-1] > bound for f, low in zip(found, lows)):
            break
    return found


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def usable(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v of rows (vec_id, label, embedding): v holds floor(scale * x) of each component."""
    some = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / scale)
    good = some.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", fine))
    made = good.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * scale).cast("int")).alias("v"))
    return made.groupBy("vec_id").agg(F.max(F.struct("v", "label")).alias("r")).select("vec_id", "r.label", "r.v")


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A row's score with an anchor is the inner product of their scaled, floored components; higher scores come first, ties
    by smaller vec_id. An anchor's positives are its first rows of the same label, itself left out; a positive's negatives the
    first rows of other labels whose score is low to high percent of the positive's. Rows whose vec_id, label or vector is
    null or empty, or that hold a null, non-finite or oversized component (see LARGEST) take no part; nor do rows of another
    width than most rows have (the smaller one, if two are as frequent). Of rows that share a vec_id the one with the largest
    vector and label counts. An anchor without positives, or a positive without negatives, gives no row; so does an empty
    table. Other columns are ignored."""
    spark = rows.sparkSession
    good = cut(usable(rows, scale))
    widths = good.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], RESULT)
    good = good.where(F.size("v") == widths[0]["w"])
    anchors = good.where(is_anchor)
    n, n_anchors = good.count(), anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], RESULT)
    sample = np.array([r["v"] for r in good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()], float)
    half = (sample.shape[1] + 1) // 2
    books = fit_half(sample[:, :half], CODEWORDS), fit_half(sample[:, half:], CODEWORDS)
    shards, chunks = -(-n // SHARD_ROWS), -(-n_anchors // CHUNK_ANCHORS)
    deal = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    stored = good.select("vec_id", "label", "v", deal("shard", shards).alias("shard"), every(chunks).alias("chunk")).groupBy("shard", "chunk")

    def meet(asked: DataFrame, run, schema: str) -> DataFrame:
        """What run gives for each shard and the anchors of each chunk."""
        sent = asked.select("*", every(shards).alias("shard"), deal("chunk", chunks).alias("chunk"))
        return stored.cogroup(sent.groupBy("shard", "chunk")).applyInPandas(run, schema)

    def shard_of(frame: pd.DataFrame) -> Shard:
        return Shard(frame["vec_id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64), _matrix(frame["v"]), books)

    def first(frame: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(frame) and len(asked):
            shard = shard_of(frame)
            for anchor, label, q in zip(asked["vec_id"], asked["label"], _matrix(asked["v"])):
                out += [(anchor, i, s) for s, i in zip(*(x.tolist() for x in best_positives(shard, anchor, label, q, positives)))]
        return pd.DataFrame(out, columns=["vec_id", "positive_id", "score"])

    def second(frame: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(frame) and len(asked):
            shard = shard_of(frame)
            for anchor, label, q, ids, scores in zip(asked["vec_id"], asked["label"], _matrix(asked["v"]), asked["positives"], asked["scores"]):
                lows, highs = [-(-low * int(p) // 100) for p in scores], [high * int(p) // 100 for p in scores]
                for positive, p, (s, own) in zip(ids, scores, best_negatives(shard, label, q, lows, highs, negatives)):
                    out += [(anchor, positive, p, i, x) for x, i in zip(s.tolist(), own.tolist())]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    by = W.partitionBy("vec_id").orderBy(F.desc("score"), "positive_id")
    ranked = meet(anchors, first, "vec_id long, positive_id long, score long").withColumn("place", F.row_number().over(by)).where(F.col("place") <= positives)
    listed = ranked.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "score"))).alias("p"))  # positives rows at most
    known = cut(anchors.join(listed.hint("merge"), "vec_id").select("vec_id", "label", "v", F.col("p.positive_id").alias("positives"), F.col("p.score").alias("scores")))
    rest = meet(known, second, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = cut(rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    discard(known)
    return out


def relabelled(embeddings: DataFrame) -> DataFrame:
    """embeddings whose label is one on, modulo ten, where 7 divides vec_id."""
    return embeddings.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")


ORACLE = """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5),
    n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
