import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.llm import negatives
from docstrata.llm.negatives import ORACLE, Shard, best_negatives, best_positives, fit_half, hard_negatives, multi_sequence, relabelled

SCHEMA = "vec_id long, label int, embedding array<float>, shard string, score string, v string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def brute(rows, every):
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            own = ([math.floor(256 * float(np.float32(x))) for x in v], label)
            good[i] = max(good.get(i, own), own)
    out = []
    for a, (q, label) in good.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, v)) for i, (v, _) in good.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if good[i][1] == label][:5]:
            inside = [i for i in order if good[i][1] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(inside[:10])]
    return sorted(out)


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, width))
    own = rng.integers(0, 6, n)
    x = (centers[own] + 0.4 * rng.normal(size=(n, width))).astype(np.float32)
    x[::9] = x[0]  # ties
    return [(int(i), int(label), [float(c) for c in row]) for i, label, row in zip(range(n), rng.integers(0, 4, n), x)]


@pytest.mark.parametrize("shard,chunk", [(16_384, 1024), (70, 3)])
def test_against_brute_force(spark, monkeypatch, shard, chunk):
    monkeypatch.setattr(negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(negatives, "CHUNK_ANCHORS", chunk)
    rows = clustered(400, 9, 1)
    rows += [(500, None, rows[0][2]), (600, 1, None), (700, 1, [1.0, None] + [0.0] * 7), (800, 2, [float("nan")] + [0.0] * 8), (900, 2, [float("inf")] + [0.0] * 8), (1000, 3, []), (None, 1, rows[0][2]), rows[20], (40, 3, rows[41][2]), (1100, 2, [0.0] * 9)]
    got = hard_negatives(table(spark, rows), F.col("vec_id") % 20 == 0)
    assert got.dtypes == [(c, t) for c, t in zip(got.columns, ["bigint", "bigint", "int", "bigint", "bigint", "bigint"])]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20) and got.count() > 200


def test_cells_come_by_falling_bounds_and_stop_early():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=7), rng.normal(size=5)
    sums = [s for s, _, _ in multi_sequence(a, b)]
    assert sums == sorted(sums, reverse=True) and len({(i, j) for _, i, j in multi_sequence(a, b)}) == 35
    x = np.floor(256 * np.concatenate([rng.normal(size=(500, 8)) * 0.05 + c for c in np.eye(8)[:6]])).astype(np.int64)
    shard = Shard(np.arange(len(x)), np.arange(len(x)) % 3, x, (fit_half(x[:, :4], 16), fit_half(x[:, 4:], 16)))
    seen = []
    for q in x[::300]:
        for at, s, bound in shard.visits(q):
            rest = np.setdiff1d(np.arange(len(x)), at) if not seen else np.zeros(0, int)
            assert (shard.scores(q, rest) <= bound).all() if len(rest) else True
            seen.append(len(at))
            break
        score, ids = best_positives(shard, -1, 1, q, 5)
        every = sorted(((-int(v @ q), i) for i, v in enumerate(x) if i % 3 == 1))[:5]
        assert [(-int(s), int(i)) for s, i in zip(score, ids)] == every
        lows, highs = [10_000, 60_000], [30_000, 58_000]
        for (s, i), lo, hi in zip(best_negatives(shard, 1, q, lows, highs, 10), lows, highs):
            assert [(-int(t), int(k)) for t, k in zip(s, i)] == sorted((-int(v @ q), n) for n, v in enumerate(x) if n % 3 != 1 and lo <= v @ q <= hi)[:10]
    assert max(seen) < len(x) / 2  # the first cells are a part of the shard


def test_sums_beyond_doubles_are_exact(spark):
    big = float(1 << 17)
    rows = [(i, i % 2, [big - i, big / 3 + i, 1.0 * i]) for i in range(40)]
    got = sorted(tuple(r) for r in hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, low=0, high=100).collect())
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, _, v in rows}
    assert got and all(r[5] == sum(x * y for x, y in zip(ints[r[0]], ints[r[3]])) for r in got)


def test_empty_and_without_anchors(spark):
    rows = clustered(20, 4, 2)
    assert hard_negatives(table(spark, rows).limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives(table(spark, rows), F.col("vec_id") < 0).collect() == []


def test_against_the_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/embeddings.parquet")
    embeddings = duckdb.sql(f"SELECT * FROM '{sf}/embeddings.parquet'")  # noqa: F841  DuckDB reads it by name
    want = sorted(duckdb.sql(ORACLE).fetchall())
    assert sorted(tuple(r) for r in hard_negatives(relabelled(docs), F.col("vec_id") % 100 == 0).collect()) == want and want
