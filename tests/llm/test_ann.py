import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.llm import ann
from docstrata.llm.ann import nearest
from docstrata.llm.queries import op7_nearest

SCHEMA = "vec_id long, embedding array<float>, list int, id string, v int"


def brute(rows, every, k):
    dim = 3
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = set()
    for q, x in good.items():
        if q % every == 0:
            ranked = sorted((-float(np.dot(x, y)), i) for i, y in good.items() if i != q)[:k]
            out |= {(q, r + 1, i) for r, (_, i) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("cell", [2000, 16])
def test_small_tables_are_exact(spark, monkeypatch, cell):
    monkeypatch.setattr(ann, "CELL", cell)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=3) * rng.integers(1, 4)]) for i in range(90)]
    rows += [(100 + i, [1.0, 2.0, 3.0]) for i in range(40)]  # ties
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [float("inf"), 1.0, 1.0]), (205, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (206, [])]
    rows.append(rows[5])
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    got = nearest(df, F.col("vec_id") % 5 == 0, 7).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == brute(rows, 5, 7) and len(got) == len(brute(rows, 5, 7))


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, "", 1), (20, [0.5, 0.5], 1, "", 1), (3, [0.0, 2.0], 1, "", 1)], SCHEMA)
    got = nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.5)]
    assert nearest(df.limit(0), F.lit(True)).collect() == [] and nearest(df.where("vec_id = 0"), F.lit(True)).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    got = op7_nearest(spark, sf).toPandas()
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(t.embedding).astype(float), t.vec_id.to_numpy()
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = set(ids[np.argsort(-score)[:20]])
        own = got[got.query_id == q]
        assert sorted(own["rank"]) == list(range(1, 21))
        hit, total = hit + len(best & set(own.vec_id)), total + 20
    assert hit / total >= 0.9


def test_every_row_repeats(spark):
    rng = np.random.default_rng(1)
    once = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    rows = once * 2 + [(77, [9.0, 9.0, 9.0])] * 40
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    got = nearest(df, F.col("vec_id") % 5 == 0, 7).collect()
    want = brute(rows, 5, 7)
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == want and len(got) == len(want)
    other = df.union(spark.createDataFrame([(3, [50.0, 50.0, 50.0], 1, "x", 2)], SCHEMA))  # the greatest vector of id 3 counts
    best = {r.vec_id for r in nearest(other, F.col("vec_id") == 77, 1).collect()}
    assert best == {3}


def test_many_lists_are_fitted_in_two_steps(monkeypatch):
    monkeypatch.setattr(ann, "AT_ONCE", 20)
    x = np.random.default_rng(2).normal(size=(3000, 4))
    index = ann.fit_lists(x, 120, float((x * x).sum(1).max()))
    sizes = np.bincount([int(own[0]) for own in index.place(x)], minlength=len(index.centroids))
    assert 100 <= len(index.centroids) <= 140 and sizes.max() < 8 * sizes.mean() and (sizes > 0).mean() > 0.9
    assert index.graph.max() < len(index.centroids)


def test_more_rows_than_lists_of_one_size(spark, monkeypatch):
    """Past the bound lists grow with the root of the rows, and all rows are still indexed."""
    monkeypatch.setattr(ann, "LIST_ROWS", 2)
    monkeypatch.setattr(ann, "LISTS_PER_ROOT", 1)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(400)]
    index = ann.fit_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), sample_rows=10, list_rows=2)
    assert len(index.centroids) == 20
    got = nearest(spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA), F.col("vec_id") % 20 == 0, 5).collect()
    want = brute(rows, 20, 5)
    assert len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i in want}) >= 0.9 * len(want)


@pytest.mark.parametrize("lists", [7, 150])
def test_small_steps_place_alike(monkeypatch, lists):
    """Lists of a vector don't depend on how many vectors are placed at a time, and follow the rule row by row."""
    x = np.random.default_rng(6).normal(size=(1500, 5))
    index = ann.fit_lists(x, lists, float((x * x).sum(1).max()))
    whole = [list(own) for own in index.place(x)]
    monkeypatch.setattr(ann, "DISTANCES", 3 * len(index.centroids))
    assert [list(own) for own in index.place(x)] == whole
    c = index.centroids
    for y, got in zip(index.lift(x), whole):
        d = ((c - y) ** 2).sum(1)
        near, kept = np.argsort(d)[: 2 * index.copies], []
        for i in near:
            if len(kept) < index.copies and d[i] <= index.spread**2 * d[near[0]] + 1e-12 and all(((c[i] - c[o]) ** 2).sum() > 0.3 * d[i] for o in kept):
                kept.append(i)
        assert got == kept


def test_centroids_have_a_bound(spark, monkeypatch):
    """Past the bound of the centroids' bytes lists get longer; all rows are still indexed and found."""
    monkeypatch.setattr(ann, "LIST_ROWS", 2)
    monkeypatch.setattr(ann, "INDEX_BYTES", 10 * 8 * 4)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(300)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    assert len(ann.fit_index(df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), list_rows=2).centroids) == 10
    want = brute(rows, 20, 5)
    got = {(r.query_id, r.vec_id) for r in nearest(df, F.col("vec_id") % 20 == 0, 5).collect()}
    assert len(got & {(q, i) for q, _, i in want}) >= 0.9 * len(want)
