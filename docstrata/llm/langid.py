"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams; a linear layer and a softmax give the
languages' probabilities. Stochastic gradient descent in numpy fits both on a sample of labelled rows
that is bounded for each language; a temperature and a rejection threshold come from rows held back
from it. For prediction the two layers multiply into one table of n-gram scores.
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
from .textbatch import chunks, small_batches

BUCKETS = 1 << 14
GRAMS = (2, 3, 4)
DIMENSIONS = 16
UNKNOWN = "und"

#: Bytes as the n-grams see them: ASCII letters in lower case, other ASCII a blank, the rest as it is.
_SEEN = np.full(256, 32, np.uint8)
_SEEN[97:123] = _SEEN[65:91] = np.arange(97, 123)
_SEEN[128:] = np.arange(128, 256)


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """bucket of every n-gram, bounds and docs, by chunk and n. N-grams of blanks only share a bucket. An
    n-gram lies in one text: the last n - 1 bytes of a text begin none, and the pieces of a long text
    count as one."""
    end, last = np.zeros(0, np.uint32), -1  # the last bytes of the piece before, and its text
    for data, bounds, docs in chunks(texts):
        seen = _SEEN[data].astype(np.uint32)
        goes_on = len(docs) > 0 and docs[0] == last
        before = end if goes_on else end[:0]
        for n in GRAMS:
            part = np.concatenate([before[max(0, len(before) - n + 1) :], seen])
            limits = bounds + (len(part) - len(seen))
            limits[0] = 0
            key = np.zeros(max(0, len(part) - n + 1), np.uint32)
            for k in range(n):
                key = key << np.uint32(8) | part[k : k + len(key)]
            bucket = (key * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - 14)
            counts = np.maximum(np.diff(limits) - n + 1, 0)
            starts = np.concatenate([[0], np.cumsum(counts)])
            own = np.arange(starts[-1]) + np.repeat(limits[:-1] - starts[:-1], counts)
            yield bucket[own].astype(np.int64), starts, docs
        if len(docs):
            end, last = np.concatenate([before, seen[bounds[-2] :]])[-(max(GRAMS) - 1) :], int(docs[-1])


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: the scores that an n-gram adds, at the fitted temperature
    bias: np.ndarray
    reject_below: float

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for bucket, bounds, docs in grams(texts):
            count[docs] += np.diff(bounds)
            for c in range(len(self.languages)):
                sums = np.zeros(len(bucket) + 1)
                np.cumsum(self.table[bucket, c], out=sums[1:])
                total[docs, c] += sums[bounds[1:]] - sums[bounds[:-1]]
        return _softmax(total / np.maximum(count, 1)[:, None] + self.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True)) if z.size else z
    return e / e.sum(1, keepdims=True) if z.size else z


def fit_language(counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 12, batch: int = 32, rate: float = 40.0, target: float = 0.99, seed: int = 1) -> LanguageModel:
    """counts: bucket numbers and their shares of each text. Every tenth row calibrates."""
    languages = sorted(set(labels))
    y = np.array([languages.index(label) for label in labels])
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    held = np.arange(len(y)) % 10 == 9

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows):
            x[i, counts[r][0]] = counts[r][1]
        return x

    learn = np.flatnonzero(~held)
    steps, step = max(1, epochs * -(-len(learn) // batch)), 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(learn), max(1, -(-len(learn) // batch))):
            x, now = dense(rows), rate * (1 - step / steps)
            hidden = x @ embed
            p = _softmax(hidden @ weight + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = p @ weight.T
            weight -= 0.1 * now * hidden.T @ p
            bias -= 0.01 * now * p.sum(0)
            embed -= now * (x.T @ back)
            step += 1
    check = np.flatnonzero(held) if held.any() else learn
    logits = np.concatenate([dense(part) @ embed @ weight + bias for part in np.array_split(check, max(1, len(check) // 64))]) if len(check) else np.zeros((0, len(languages)))

    def loss(scale: float) -> float:
        return float(-np.log(_softmax(logits * scale)[np.arange(len(check)), y[check]] + 1e-12).mean())

    scale = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss) if len(check) else 1.0
    p = _softmax(logits * scale)
    score, right = p.max(1), p.argmax(1) == y[check]
    order = np.argsort(-score)
    precise = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= target)
    reject = float(score[order][precise[-1]]) if len(precise) else 1.0
    return LanguageModel(languages, (embed @ weight * scale).astype(np.float64), (bias * scale).astype(np.float64), reject)


def train_language(docs: DataFrame, may_learn: Column | None = None, per_language: int = 800) -> LanguageModel | None:
    """Fits on about per_language rows of each value of lang, drawn by a hash of doc_id among rows with a lang
    and a letter; the model has a column for each value. None if there is no such row."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.where(may_learn) if may_learn is not None else known
    sizes = docs.where(may_learn if may_learn is not None else F.lit(True)).where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not sizes:
        return None
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["n"])))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.where(place < share[F.col("lang")]).select("text", "lang", F.xxhash64("doc_id", "text").alias("place"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # of the sample only
                found = np.zeros(BUCKETS)
                for bucket, _, _ in grams(b.column(0).slice(i, 1)):
                    found += np.bincount(bucket, minlength=BUCKETS)
                own = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([own.astype(np.int32).tobytes()]), pa.array([(found[own] / found.sum()).astype(np.float32).tobytes()]), b.column(1).slice(i, 1), b.column(2).slice(i, 1)], ["buckets", "shares", "lang", "place"])

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [f for f in frames if len(f)]
        if found:
            rows = pd.concat(found).sort_values(["place", "lang"])
            counts = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(rows["buckets"], rows["shares"])]
            yield pd.DataFrame({"model": [pickle.dumps(fit_language(counts, rows["lang"].tolist()))]})

    stats = cut(sample.mapInArrow(count, "buckets binary, shares binary, lang string, place long"))  # by many tasks
    model = stats.coalesce(1).mapInPandas(fit, "model binary").first()  # bounded sample, one small model
    return pickle.loads(model["model"]) if model else None


def predict_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of docs (doc_id, text).

    lang_pred is `und`, with score 0, where the text is null or has no letter, or nothing was learned;
    rejected marks it and predictions below the calibrated threshold. Other columns are ignored."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            p = model.probabilities(b.column(1))
            letters = b.column(2).to_numpy(zero_copy_only=False)
            best = p.argmax(1)
            lang = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best, letters)]
            score = np.where(letters, p.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(~letters | (score < model.reject_below))], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")
