"""Approximate nearest neighbours by largest inner product over balanced posting lists.

Vectors get one more component that gives all of them one length, so the largest inner product is the
smallest distance. A bounded sample fits balanced centroids and a neighbour graph over them; both are
held in memory by every task. Each vector is stored in the list of its nearest centroid and, near a
boundary, in other lists almost as near. A query walks the graph to its nearest centroids and reads the
lists whose distance is within a ratio of the best. Lists and their queries are cut into cells of
bounded size, so a crowded list is many tasks.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, sized

#: Vectors a list holds on average while lists are few; beyond, lists grow with the root of the rows, so that
#: lists and their centroids grow alike: LISTS_PER_ROOT lists for each of the root's rows.
LIST_ROWS = 200
LISTS_PER_ROOT = 4
#: Sampled rows for each list, centroids that are fitted at once, rows of one side that meet in one task.
ROWS_PER_LIST = 8
AT_ONCE = 2048
CELL = 2000
#: Bytes that the centroids may have, since every task holds them; past that, lists get longer instead. Distances that
#: one step holds at a time.
INDEX_BYTES = 32 << 20
DISTANCES = 1 << 22


@dataclass
class ListIndex:
    centroids: np.ndarray  # lists x (dimensions + 1)
    graph: np.ndarray  # lists x degree: near centroids of each
    entries: np.ndarray
    top: float  # the largest squared length
    copies: int = 6
    spread: float = 1.12
    probes: int = 48
    ratio: float = 1.45

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))
        return np.column_stack([x, rest])

    def place(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists of each stored vector: the nearest, and others almost as near that no list taken
        before is nearer to than the vector is."""
        own = [self._place(part) for part in _slices(x, len(self.centroids))]
        return [near[kept] for nears, keeps in own for near, kept in zip(nears, keeps)]

    def _place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidate lists of each vector, nearest first, and which of them are kept."""
        y = self.lift(x)
        d = np.maximum((y * y).sum(1)[:, None] - 2 * y @ self.centroids.T + (self.centroids**2).sum(1), 0)
        k = min(self.copies * 2, d.shape[1])
        near = np.argpartition(d, k - 1, 1)[:, :k]
        far = np.take_along_axis(d, near, 1)
        order = np.argsort(far, 1, kind="stable")
        near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
        kept = far <= self.spread**2 * far[:, :1] + 1e-12
        for j in range(1, k):
            for i in range(j):
                apart = ((self.centroids[near[:, j]] - self.centroids[near[:, i]]) ** 2).sum(1)
                kept[:, j] &= ~kept[:, i] | (apart > 0.3 * far[:, j])
            kept[:, j] &= kept[:, :j].sum(1) < self.copies
        return near, kept

    def search(self, q: np.ndarray, beam: int = 96) -> np.ndarray:
        """Lists for one query by best-first search of the graph, nearest first, pruned by distance ratio."""
        y = np.r_[q, 0.0]
        beam = max(beam, 2 * self.probes)

        def far(i: np.ndarray) -> np.ndarray:
            return ((self.centroids[i] - y) ** 2).sum(1)

        seen = np.zeros(len(self.centroids), bool)
        ids = self.entries
        seen[ids] = True
        dist, open_ = far(ids), np.ones(len(ids), bool)
        while open_.any():
            go = np.flatnonzero(open_)[:8]  # pool is sorted: the nearest that weren't expanded
            open_[go] = False
            new = np.unique(self.graph[ids[go]].ravel())
            new = new[~seen[new]]
            seen[new] = True
            ids, dist, open_ = np.r_[ids, new], np.r_[dist, far(new)], np.r_[open_, np.ones(len(new), bool)]
            order = np.argsort(dist, kind="stable")[:beam]
            ids, dist, open_ = ids[order], dist[order], open_[order]
        order = np.argsort(dist, kind="stable")
        ids, dist = ids[order][: self.probes], dist[order][: self.probes]
        # the lifted query is shorter than the stored vectors: what its distance exceeds that by counts
        gap = np.sqrt(dist)
        return ids[(gap <= self.ratio * gap[0]) | (np.arange(len(ids)) < 4)]


def _slices(x: np.ndarray, width: int) -> list[np.ndarray]:
    """x in parts of so few rows that each with width numbers a row has at most DISTANCES."""
    rows = max(1, min(1024, DISTANCES // max(1, width)))
    return [x[at : at + rows] for at in range(0, len(x), rows)]


def _means(y: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Balanced k-means: a cluster's cost rises with its size, so that crowded regions get more lists."""
    k = max(1, min(k, len(y)))
    if k > AT_ONCE:  # many: first about the root of as many, then each one's share of the rest among its own rows
        coarse = _means(y, math.isqrt(k), rounds, rng)
        own = np.concatenate([((coarse**2).sum(1) - 2 * part @ coarse.T).argmin(1) for part in _slices(y, len(coarse))])
        cells = [y[own == i] for i in range(len(coarse)) if (own == i).any()]
        return np.concatenate([_means(cell, max(1, round(k * len(cell) / len(y))), rounds, rng) for cell in cells])
    c = y[rng.choice(len(y), k, replace=False)]
    for _ in range(rounds):
        weight, count = np.zeros(k), np.zeros(k)
        total = np.zeros_like(c)
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 1024)):
            d = (y[part] ** 2).sum(1)[:, None] - 2 * y[part] @ c.T + (c**2).sum(1)
            own = (d + weight * np.median(d.min(1))).argmin(1)
            np.add.at(total, own, y[part])
            count += np.bincount(own, minlength=k)
            weight = 0.3 * count / max(1.0, count.sum() / k)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], y[rng.choice(len(y), k)])
    return c


def fit_lists(x: np.ndarray, n_lists: int, top: float, rounds: int = 8, degree: int = 24, seed: int = 5) -> ListIndex:
    """Balanced centroids of the sample x, a graph of near centroids, and how many lists a query reads."""
    rng = np.random.default_rng(seed)
    index = ListIndex(np.zeros((0, 0)), np.zeros((0, 0), int), np.zeros(0, int), top)
    c = _means(index.lift(x), n_lists, rounds, rng)
    k = len(c)
    near = []
    for part in _slices(c, k):
        d = (c**2).sum(1) - 2 * part @ c.T
        near.append(np.argsort(d, 1, kind="stable")[:, : min(degree + 1, k)])
    graph = np.concatenate(near)
    extra = rng.integers(0, k, (k, 4))  # a few long links keep the graph in one piece
    index.centroids, index.graph, index.entries = c, np.column_stack([graph, extra]), rng.choice(k, min(k, 16), replace=False)
    calibrate(index, x, rng)
    return index


def calibrate(index: ListIndex, x: np.ndarray, rng: np.random.Generator, k: int = 20, queries: int = 100, target: float = 0.96) -> None:
    """Sets index.probes to the fewest lists that find the target share of the k nearest in the sample.
    Neighbours are farther apart in a sample than in the whole, so the whole does no worse."""
    placed = index.place(x)
    asked, found = rng.choice(len(x), min(queries, len(x)), replace=False), []
    index.probes = len(index.centroids)
    for q in asked:
        score = x @ x[q]
        score[q] = -np.inf
        order = {int(c): at for at, c in enumerate(index.search(x[q]))}
        best = np.argpartition(-score, min(k, len(x) - 1))[:k]
        found += [min(order.get(int(c), len(order)) for c in placed[b]) for b in best if b != q]
    if found:
        index.probes = max(8, 1 + int(np.quantile(found, target, method="higher")))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def sound(vector: Column) -> Column:
    """Not null, not zero, all components present and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_index(vectors: DataFrame, sample_rows: int = 20_000, list_rows: int = LIST_ROWS) -> ListIndex | None:
    """Fits on the vectors whose ids hash lowest: sample_rows of them, or ROWS_PER_LIST for each list if that is
    more, which grows with the root of all rows until centroids have INDEX_BYTES. None without vectors."""
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("top")).first()
    if not facts["n"]:
        return None
    n_lists = max(1, min(facts["n"] // list_rows, LISTS_PER_ROOT * math.isqrt(facts["n"]), INDEX_BYTES // (8 * (facts["width"] + 1))))
    sample_rows = max(sample_rows, ROWS_PER_LIST * n_lists)
    place = F.xxhash64("vec_id")
    bound = vectors.select(place.alias("place")).orderBy("place").limit(sample_rows).agg(F.max("place").alias("m")).first()["m"]
    top = facts["top"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        ids = np.concatenate([b.column(0).to_numpy() for b in parts])
        x = np.concatenate([_matrix(b.column(1)) for b in parts])
        x = x[np.lexsort((x[:, 0], ids))][:sample_rows]
        yield pa.record_batch([pa.array([pickle.dumps(fit_lists(x, n_lists, top))], pa.binary())], ["model"])

    sample = cut(vectors.where(place <= bound).select("vec_id", "embedding"))  # bounded: one task fits it
    return pickle.loads(sample.coalesce(1).mapInArrow(fit, "model binary").first()["model"])


def _routed(vectors: DataFrame, index: ListIndex, queries: bool) -> DataFrame:
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x = _matrix(batch.column(1))
                lists = [index.search(q) for q in x] if queries else index.place(x)
                rows = np.repeat(np.arange(len(x)), [len(own) for own in lists])
                chosen = np.concatenate(lists) if lists else np.zeros(0)
                yield pa.record_batch([pa.array(chosen.astype(np.int32)), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))], ["list", "id", "v"])

    return vectors.mapInArrow(route, "list int, id long, v array<double>")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, sample_rows: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row of vectors (vec_id, embedding)
    for which is_query holds, among all rows of other ids, by inner product in double precision; ties
    go to the smaller vec_id. Rows with a null id, and vectors that are null, zero, of another
    dimension than most, or hold null or non-finite components take no part. Rows that repeat an id
    count once, by the greatest of their vectors. An empty table gives an empty result; other columns are
    ignored."""
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & sound(F.col("embedding")))
    width = good.groupBy(F.size("embedding").alias("d")).agg(F.countDistinct("vec_id").alias("ids")).orderBy(F.desc("ids"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    # one row per id before anything is fitted or the best rows of a list are taken
    good = cut(good.where(F.size("embedding") == width["d"]).groupBy("vec_id").agg(F.max("embedding").alias("embedding")))
    index = fit_index(good, sample_rows)
    stored, asked = cut(_routed(good, index, False)), cut(_routed(good.where(is_query), index, True))

    # how many cells a list's vectors and queries are dealt to; a row for each list
    sides = stored.groupBy("list").agg(F.count("*").alias("n")).join(asked.groupBy("list").agg(F.count("*").alias("m")).hint("shuffle_hash"), "list")
    cells = sides.select("list", F.ceil(F.col("n") / CELL).cast("int").alias("across"), F.ceil(F.col("m") / CELL).cast("int").alias("down"))
    cells = sized(cut(cells), "merge")
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = stored.join(cells, "list").withColumn("i", own("across")).withColumn("j", every("down")).select("list", "i", "j", "id", "v")
    right = asked.join(cells, "list").withColumn("j", own("down")).withColumn("i", every("across")).select("list", "i", "j", "id", "v")

    def match(key, vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(vs) or not len(qs):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        ids, x = vs["id"].to_numpy(), np.stack(vs["v"].to_numpy())
        parts = []
        for at in range(0, len(qs), 256):
            some = qs.iloc[at : at + 256]
            asked, q = some["id"].to_numpy(), np.stack(some["v"].to_numpy())
            rough = q @ x.T
            rough[asked[:, None] == ids] = -np.inf
            # rounding may differ by place: what is as good as the last of k stays for now
            last = np.partition(rough, len(ids) - k, 1)[:, len(ids) - k] if len(ids) > k else np.full(len(q), -np.inf)
            last = np.where(np.isfinite(last), last - 1e-9 * np.maximum(1.0, np.abs(last)), -np.inf)
            row, col = np.nonzero((rough >= last[:, None]) & np.isfinite(rough))
            score = (x[col] * q[row]).sum(1)
            order = np.lexsort((ids[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            first = np.searchsorted(row, np.arange(len(q)))
            best = np.arange(len(row)) - first[row] < k
            parts.append(pd.DataFrame({"query_id": asked[row[best]], "vec_id": ids[col[best]], "score": score[best]}))
        return pd.concat(parts)

    found = left.groupBy("list", "i", "j").cogroup(right.groupBy("list", "i", "j")).applyInPandas(match, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
