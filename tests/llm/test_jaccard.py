import random
import re

import pytest
from pyspark.sql import functions as F

from docstrata.llm import common, jaccard
from docstrata.llm.components import connected_components, extend_components
from docstrata.llm.jaccard import jaccard_components


def brute(rows, num=90, n=3):
    sets = {}
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    grams = {}
    for i in ids:
        for g in sets[i]:
            grams.setdefault(g, []).append(i)
    seen = set()
    for i in ids:
        for j in {j for g in sets[i] for j in grams[g] if j > i} - seen:
            both = len(sets[i] & sets[j])
            if 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def copies(seed, n_base=12, n=220):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    bases = [[word() for _ in range(rng.choice([3, 12, 13, 30, 60, 200]))] for _ in range(n_base)]
    passage, rows = [word() for _ in range(40)], []
    for i in range(n):
        w = list(bases[0] if i % 3 == 0 else rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(w) // 20])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.2:
            w = w[: max(1, int(len(w) * rng.uniform(0.88, 1)))]
        if rng.random() < 0.2:
            w += passage
        rows.append((i * 7 % 1009, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(make_docs, monkeypatch, seed):
    if seed == 3:
        monkeypatch.setattr(jaccard, "BLOCK", 8)
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(jaccard, "RANGE_GRAMS", 60)  # many ranges, and frequent n-grams that pass them by
    rows = copies(seed) + [(2000, None), (2001, ""), (2002, " \n"), (2003, "A b"), (2004, "a B"), (2005, "x"), (2006, "q r s " * 40_000), (2007, "q r s " * 40_001)]
    got = jaccard_components(make_docs(rows)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_repeated_rows_null_ids_and_empty(make_docs):
    text = " ".join(f"w{i}" for i in range(50))
    got = jaccard_components(make_docs([(5, text), (5, text), (None, text), (9, text + " more"), (None, None)])).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, 48, 5), (5, 48, 5), (None, 48, None), (9, 49, 5), (None, 0, None)], key=str)
    assert jaccard_components(make_docs([(1, "a")]).limit(0)).collect() == []


def test_one_id_with_two_texts(make_docs):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    got = jaccard_components(make_docs([(5, a), (5, b), (3, a + " more"), (9, b + " more"), (9, b + " more")])).collect()
    assert sorted(map(tuple, got)) == [(3, 59, 3), (5, 58, 3), (5, 58, 5), (9, 59, 5), (9, 59, 5)]


def test_stragglers_of_a_cluster(make_docs):
    """Copies of one text that differ in more and more words: near the threshold on both sides."""
    rng, rows = random.Random(9), []
    base = [f"w{i}" for i in range(150)]
    for i in range(400):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(0, 8)):
            w[at] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    assert sorted(tuple(r) for r in jaccard_components(make_docs(rows)).collect()) == brute(rows)
    assert sorted(tuple(r) for r in jaccard_components(make_docs(rows), n=5, threshold=0.8).collect()) == brute(rows, 80, 5)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 450), (450, 499), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[500] == got[499] == 450


@pytest.mark.parametrize("most", [0, 1 << 24])
def test_components_extended_are_those_of_all_links(spark, monkeypatch, most):
    monkeypatch.setattr("docstrata.llm.common.BROADCAST_BYTES", most)  # by shuffle, by broadcast
    rng = random.Random(3)
    first = [(a, a + 1) for a in range(100, 140)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(80)]
    more = [(rng.randrange(400), rng.randrange(400)) for _ in range(60)] + [(900, 901), (901, 100), (7, 7)]
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    pairs = lambda df: sorted(tuple(r) for r in df.select("node", "component").collect())
    known = connected_components(frame(first))
    assert pairs(extend_components(known, frame(more))) == pairs(connected_components(frame(first + more)))
    assert pairs(extend_components(known, frame(first))) == pairs(known)
    empty = connected_components(frame([]))
    assert pairs(extend_components(empty, frame(more))) == pairs(connected_components(frame(more)))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in jaccard_components(docs).select(F.col("doc_id"), "n_shingles", "component_id").collect()) == brute(rows)
