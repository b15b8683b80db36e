import hashlib

import numpy as np

from docstrata.llm.exact_dedup import CountingQuotientFilter as Cqf, exact_dedup


def test_filter_is_lossless_and_merges():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    keys = np.concatenate([keys, keys[:700], keys[:30]])
    parts = [Cqf.from_bytes(Cqf.build(x).to_bytes()) for x in np.array_split(keys, 7)] + [Cqf.build(keys[:0])]
    merged = Cqf.merge(parts)
    want, counts = np.unique(keys, return_counts=True)
    assert (merged.fingerprints() == want).all() and (merged.counts == counts).all()
    assert merged.count(int(keys[0])) == 3 and merged.count(5) == 0
    small = Cqf.from_bytes(Cqf.build(np.array([0, 2**64 - 1, 0], np.uint64)).to_bytes())
    assert small.fingerprints().tolist() == [0, 2**64 - 1] and small.counts.tolist() == [2, 1]


def brute(rows):
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(text or "", []).append(doc_id)
    return sorted((i, max(texts[t or ""]), len(texts[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_against_brute_force(make_docs):
    rows = [(i, "hot copy") for i in range(100)] + [(200, None), (201, ""), (202, " "), (203, "Hot copy"), (204, "é" * 200_000), (205, "é" * 200_000)] + [(300 + i, f"t{i % 40}") for i in range(60)]
    got = exact_dedup(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_repeated_rows_nulls_and_empty(make_docs):
    got = exact_dedup(make_docs([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, None)])).collect()
    assert sum(r.kept for r in got if r.text_sha256 == hashlib.sha256(b"a").hexdigest()) == 1
    assert {r.keep_id for r in got if r.group_size == 3} == {1}
    assert exact_dedup(make_docs([(1, "a")]).limit(0)).collect() == []
