"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts come from vectorised numpy inside Spark tasks. One task fits the trees on a
bounded sample of labelled rows (max_rows, a parameter); the fitted trees are flat arrays of a few
kilobytes, which every scoring task walks for all its rows at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut
from .textbatch import chunks, shingles, small_batches, words

#: Byte classes that are counted, each as a share of the text. Every other byte is of class 0.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t\v\f", ".", ",", "!", "?", "|", "#", "$", "%", "&", "*", ";:", "'\"", "()[]{}", "<>", "/\\", "-_", "@~^`+="]
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(CLASSES):
    _CLASS[list(_chars.encode())] = _i + 1
N_CLASSES = len(CLASSES) + 1
N_FEATURES = N_CLASSES + 9


def document_statistics(texts: pa.Array) -> np.ndarray:
    """A row of N_FEATURES numbers for each text; an empty or null text gives zeros."""
    n = len(texts)
    counts = np.zeros(n * N_CLASSES)
    for data, bounds, docs in chunks(texts):
        owner = np.repeat(docs - docs[0], np.diff(bounds))
        found = np.bincount(owner * N_CLASSES + _CLASS[data], minlength=len(docs) * N_CLASSES)
        counts[docs[0] * N_CLASSES : docs[0] * N_CLASSES + len(found)] += found
    counts = counts.reshape(n, N_CLASSES)
    size = counts.sum(1)
    hashes, owner, length = words(texts)
    n_words = np.bincount(owner, minlength=n).astype(float)
    safe, safe_words = np.maximum(size, 1), np.maximum(n_words, 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[new], minlength=n)
    run = np.diff(np.r_[np.flatnonzero(new), len(h)])
    top = np.zeros(n)
    np.maximum.at(top, o[new], run)
    triples = np.array([len(s) for s in shingles(hashes, owner, n, 3)], float)
    more = np.column_stack([
        np.log1p(size), np.log1p(n_words), size / safe_words, distinct / safe_words, top / safe_words,
        np.bincount(owner, same, n) / safe_words, triples / np.maximum(n_words - 2, 1) * (n_words > 0),
        np.bincount(owner, length > 15, n) / safe_words, np.bincount(owner, length == 1, n) / safe_words,
    ])
    return np.column_stack([counts / safe[:, None], more]).astype(np.float32)


@dataclass
class Trees:
    """Complete binary trees of one depth, flat: node i of a tree has children 2 i + 1 and 2 i + 2."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            raw += value[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-raw))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.2, n_bins: int = 64, ridge: float = 1.0, least: int = 5) -> Trees:
    """Boosts the logistic loss; splits are sought in histograms of quantile bins. Without rows, or with
    one class only, the trees are empty and the score is the smoothed share of class 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base, inner, leaves = float(np.log(share / (1 - share))), 2**depth - 1, 2**depth
    features, thresholds, values = [], [], []
    if len(set(y.tolist())) == 2:
        n, n_features = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])).astype(np.float32) for f in range(n_features)]
        binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
        raw = np.full(n, base)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                local = at - first
                gain, where = np.full(width, 1e-9), np.zeros((width, 2), np.int64)
                for f in range(n_features):
                    if not len(edges[f]):
                        continue
                    key = local * n_bins + binned[:, f]
                    sums = [np.cumsum(np.bincount(key, w, width * n_bins).reshape(width, n_bins), 1) for w in (g, h, None)]
                    (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                    score = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    score[(nl < least) | (nt - nl < least)] = -1
                    score[:, len(edges[f]) :] = -1
                    best = score.argmax(1)
                    top = score[np.arange(width), best]
                    better = top > gain
                    gain[better], where[better] = top[better], np.column_stack([np.full(width, f), best])[better]
                for node in range(width):
                    if gain[node] > 1e-9:
                        f, b = where[node]
                        feature[first + node], threshold[first + node] = f, edges[f][b]
                at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
            leaf = at - inner
            value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
            raw += value[leaf]
            features.append(feature)
            thresholds.append(threshold)
            values.append(value)
    shape = (len(features), inner)
    return Trees(base, depth, np.array(features, np.int64).reshape(shape), np.array(thresholds, np.float32).reshape(shape), np.array(values).reshape(len(values), leaves))


def fit_quality(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, max_rows: int = 20_000) -> Trees:
    """Fits on at most max_rows of the labelled rows (doc_id, quality 0 or 1) that may_learn admits, the
    first ones by a hash of doc_id. Rows with null doc_id or quality don't count; an id that repeats counts
    once, with its smaller label and, of texts, the one whose statistics come first."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = (known.where(may_learn) if may_learn is not None else known).withColumn("place", F.xxhash64("doc_id"))
    sample = known.orderBy("place", "doc_id", "quality").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # max_rows at most

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            x = document_statistics(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1), b.column(2), b.column(3)], ["x", "quality", "place", "doc_id"])

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [f for f in frames if len(f)]
        if found:
            rows = pd.concat(found).sort_values(["place", "doc_id", "quality", "x"]).drop_duplicates("doc_id")
            x, y = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), N_FEATURES), rows["quality"].to_numpy(float)
        else:
            x, y = np.zeros((0, N_FEATURES), np.float32), np.zeros(0)
        yield pd.DataFrame({"model": [pickle.dumps(fit_trees(x, y))]})

    # statistics of a bounded sample, written by many tasks: one task fits them; the model is a few kilobytes
    stats = cut(rows.select("text", "quality", "place", "doc_id").mapInArrow(statistics, "x binary, quality int, place long, doc_id long"))
    return pickle.loads(stats.coalesce(1).mapInPandas(fit, "model binary").first()["model"])


def score_quality(docs: DataFrame, trees: Trees, column: str = "score") -> DataFrame:
    """docs (text and any other columns) with one more column, a double: how likely label 1 is. Texts may be
    null. A column of docs that has this name already is replaced."""
    docs = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c != column])
    texts = docs.columns.index("text")
    # columns go by number through Python: names may hold dots
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("score", F.lit(0.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            s = trees.score(document_statistics(b.column(texts)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], b.schema.names)

    return plain.mapInArrow(score, plain.schema).toDF(*docs.columns, column)
