import hashlib
import random

import numpy as np
import pytest

from docstrata.llm import suffixes
from docstrata.llm.suffixes import common_prefixes, remove_repeats, suffix_array


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for r, (_, b) in enumerate(texts):
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], []).append((r, s))
    masks = [np.ones(len(b), bool) for _, b in texts]
    for places in seen.values():
        if len(places) > 1:
            for r, s in places:
                masks[r][s : s + length] = False
    out = []
    for (i, b), keep in zip(texts, masks):
        gone = np.r_[False, ~keep]
        kept = np.frombuffer(b, np.uint8)[keep].tobytes()
        out.append((i, len(b), int((~keep).sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs, length, k):
    rows = remove_repeats(docs, length, k).collect()
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows], key=str)


def test_suffix_array_and_prefixes():
    rng = random.Random(0)
    for alphabet in ("a", "ab", "abcdefgh"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))).encode() for _ in range(8)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        order, _ = suffix_array(data, len(data) + 1)
        raw = data.tobytes()
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(np.r_[0, sizes[:-1]])
        got = common_prefixes(data, order, starts, sizes, 50)
        for at in range(1, len(raw)):
            a, b = raw[order[at - 1] :], raw[order[at] :]
            want = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert got[at] == min(want, 50)


@pytest.mark.parametrize("cell", [1500, 12])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(make_docs, monkeypatch, cell, seed):
    monkeypatch.setattr(suffixes, "CELL", cell)
    if seed == 2:
        monkeypatch.setattr("docstrata.llm.common.BROADCAST_BYTES", 0)
        monkeypatch.setattr(suffixes, "CHUNK", 500)
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefé \n") for _ in range(n))
    passages, rows = [text(rng.randint(30, 90)) for _ in range(5)], []
    for i in range(120):
        body = text(rng.randint(0, 150))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            p = rng.choice(passages[:1] * 4 + passages)
            cut = rng.randint(0, len(p) // 2)
            body += p[cut:] + text(rng.randint(0, 60))
        rows.append((i, body))
    rows += [(500, "ab" * 400), (501, "x" * 700), (502, None), (503, ""), (504, rows[3][1]), (504, rows[3][1]), (None, rows[5][1]), (None, None), (505, passages[0]), (506, "".join(rows[k][1] for k in (9, 10, 11)) * 3)]
    assert run(make_docs(rows), 40, 10) == brute(rows, 40)


def test_production_length_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = run(docs, 400, 100)
    assert got == brute(rows, 400) and any(r[2] for r in got)


def test_empty_table_and_no_repeats(make_docs):
    assert run(make_docs([(1, "a")]).limit(0), 40, 10) == []
    assert run(make_docs([(1, "abc" * 5), (2, None)]), 40, 10) == brute([(1, "abc" * 5), (2, None)], 40)
