import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docstrata.llm.quality import CLASSES, N_FEATURES, document_statistics, fit_quality, fit_trees, score_quality
from docstrata.llm.queries import op10_quality


def test_statistics_of_odd_texts():
    x = document_statistics(pa.array(["", None, "a b a b", "É\n\n!!", "w" * 3_000_000, "x " * 800_000]))
    assert x.shape == (6, N_FEATURES) and np.isfinite(x).all() and not x[0].any() and not x[1].any()
    one = document_statistics(pa.array(["a b a b"]))
    assert np.allclose(one[0], x[2])


def plain_statistics(text):
    """The same numbers, one text at a time."""
    data = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    n, size, w = len(words), max(len(data), 1), max(len(words), 1)
    known = [sum(data.count(bytes([c])) for c in chars.encode()) for chars in CLASSES]
    shares = [(len(data) - sum(known)) / size, *[k / size for k in known]]
    runs = {tuple(words[i : i + 3]) for i in range(n - 2)} if n >= 3 else ({tuple(words)} if n else set())
    counts = Counter(words)
    again = sum(a == b for a, b in zip(words, words[1:]))
    more = [math.log1p(len(data)), math.log1p(n), len(data) / w, len(counts) / w, max(counts.values(), default=0) / w, again / w, len(runs) / max(n - 2, 1) * (n > 0), sum(len(x) > 15 for x in words) / w, sum(len(x) == 1 for x in words) / w]
    return [*shares, *more]


def test_statistics_against_plain_ones(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", None, "a", "a b", "A a a b", "É\n\n!!", "w" * 40 + " x", "| | | #$%", "x " * 5000]
    assert np.allclose(document_statistics(pa.array(texts)), [plain_statistics(t) for t in texts], rtol=1e-5, atol=1e-6)


def test_an_id_with_two_labels_or_texts_learns_one(spark, make_docs):
    rows = [(i, "word " * i if i % 2 else "!! " * i) for i in range(1, 60)] + [(7, "!! ! !"), (8, "other text")]
    labels = [(i, i % 2) for i in range(1, 60)] + [(7, 0), (8, 1)]
    fitted = []
    for shuffled in (1, 5):
        docs = make_docs(rows).repartition(shuffled)
        trees = fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int").repartition(shuffled))
        fitted.append((trees.base, trees.feature.tolist(), trees.value.tolist()))
    assert fitted[0] == fitted[1]


def test_trees_learn_and_walk_as_written():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    trees = fit_trees(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95

    def walk(row):
        raw = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            i = 0
            for _ in range(trees.depth):
                i = 2 * i + 1 + int(row[f[i]] > t[i])
            raw += v[i - (2**trees.depth - 1)]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose(trees.score(x[:20]), [walk(r) for r in x[:20]])


def test_one_class_and_no_rows(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None), (None, "c"), (1, "a b")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = score_quality(docs, fit_quality(docs, known)).collect()
        assert len(got) == 4 and all(0 < r.score < 1 for r in got)
    assert score_quality(docs.limit(0), fit_quality(docs, labels)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.98
    assert got[got.quality == 1].predicted.mean() > 0.99
