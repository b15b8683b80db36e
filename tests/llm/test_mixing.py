import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docstrata.llm import mixing
from docstrata.llm.mixing import mix_sources, split_quotas


def fill(sizes):
    """Targets by reshared excess, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def check(rows, got):
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    of = {i: s for i, _, s in rows}
    want = fill(sizes)
    for r in got:
        assert r.source_size == sizes[of[r.doc_id]] and abs(r.target - want[of[r.doc_id]]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        assert sum(d.words for d in r.draws) == r.taken
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_targets_and_words(make_docs, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = [(i, "w " * (i % 37), "hot" if i % 3 else f"s{i % 11}") for i in range(400)]
    rows += [(1000, None, "s1"), (1001, "", None), (1002, "a b c", None), (1003, None, "void"), (1004, "x\ty z", "é")]
    docs = make_docs(rows)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    check(rows, got)
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_taken_comes_from_the_tree(make_docs):
    """What a query without draws reads still depends on the shards' draws."""
    plan = mix_sources(make_docs([(i, "a b c", f"s{i % 3}") for i in range(30)])).drop("draws")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") >= 4


def test_repeated_rows_one_source_and_empty(make_docs):
    got = mix_sources(make_docs([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")])).collect()
    assert sum(r.taken for r in got) == 5 and len(got) == 3
    assert mix_sources(make_docs([(1, "a", "s")]).limit(0)).collect() == []


def test_tree_keeps_quotas_and_shard_sizes(spark):
    quotas = {i + 1: q for i, q in enumerate([5, 0, 1000, 37, 1, 412])}
    got = split_quotas(spark.createDataFrame(list(quotas.items()), "sid int, quota long"), 8).collect()
    by_shard = defaultdict(int)
    for sid, quota in quotas.items():
        mine = sorted((r.lo, r.hi) for r in got if r.sid == sid)
        assert sum(b - a for a, b in mine) == quota and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))
    for r in got:
        by_shard[r.shard] += r.hi - r.lo
    assert max(by_shard.values()) - min(by_shard.values()) <= 1


def test_tree_draws_are_hypergeometric(spark):
    lefts = []
    for seed in range(12):
        rows = split_quotas(spark.createDataFrame([(1, 400), (2, 800), (3, 50)], "sid int, quota long"), 2, seed).where("shard = 0").collect()
        lefts.append({r.sid: r.hi - r.lo for r in rows})
    mean = sum(x[1] for x in lefts) / len(lefts)
    assert 190 < mean < 210 and len({x[1] for x in lefts}) > 4 and all(150 < x[1] < 250 for x in lefts)
