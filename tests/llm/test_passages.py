import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from docstrata.llm import passages
from docstrata.llm.passages import COVER, LAST, ORACLE, PERIOD, anchors, parts, remove_passages


def brute(rows, length):
    """doc_id, n_words, n_removed, sha of each row: all windows in a dictionary."""
    docs = [(LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in docs:
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            least[key] = min(i, least.get(key, i))
    out = []
    for (own, _), (i, w) in zip(rows, docs):
        gone = {k for s in range(len(w) - length + 1) if least[tuple(w[s : s + length])] < i for k in range(s, s + length)}
        out.append((own, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed):
    """Passages of several lengths at all places, near and exact copies, blanks of every kind."""
    rng = random.Random(seed)
    word = lambda: rng.choice("a b c dd éé f g ß x1 yy zz".split(" ")) + str(rng.randrange(40))
    shared = [[word() for _ in range(n)] for n in (12, 13, 14, 20, 45)]
    rows = []
    for i in range(60):
        body = [word() for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            at = rng.randrange(len(body) + 1)
            body[at:at] = p[rng.randrange(3) :]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "\t ", "\x0b", "\x0c\r"]) for w in body)))
    rows += [(100 + k, rows[7][1]) for k in range(5)] + [(200, None), (201, ""), (202, " \n"), (None, rows[3][1]), (None, None), (9, rows[9][1]), (3, rows[8][1])]
    return rows


@pytest.mark.parametrize("length", [7, 13, 17])
def test_against_brute_force(make_docs, length):
    rows = rows_of(length)
    got = remove_passages(make_docs(rows), length).collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == brute(rows, length)
    assert any(0 < r.n_removed < r.n_words for r in got) and all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_long_texts_are_read_in_parts(make_docs, monkeypatch):
    monkeypatch.setattr(passages, "CHUNK", 200)
    rows = rows_of(2)
    long = " ".join(t for _, t in rows[:40] if t)
    rows += [(300, long + " " + "q" * 5000), (301, "new start " + long), (302, "q" * 5000)]
    hashes = [np.concatenate([p[0][max(0, 12 if p[3][0] else 0) :] for p in parts(pa.array([t]), 12)]) for t in (long, "x " + long) if t]
    assert (hashes[0] == hashes[1][1:]).all()
    # workers import the module anew: the parts of one process are compared here, whole texts below
    for text in (long, rows[-2][1]):
        small = sorted(zip(*[np.concatenate(x).tolist() for x in zip(*anchors(pa.array([text]), 13))]))
        monkeypatch.setattr(passages, "CHUNK", 1 << 18)
        assert small == sorted(zip(*[np.concatenate(x).tolist() for x in zip(*anchors(pa.array([text]), 13))]))
        monkeypatch.setattr(passages, "CHUNK", 200)
    monkeypatch.setattr(passages, "CHUNK", 1 << 18)
    rows += [(400, "v " * 200_000 + long), (401, "w " * 200_000 + long)]
    got = remove_passages(make_docs(rows)).collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == brute(rows, 13)


def test_equal_windows_share_an_anchor():
    """Wherever two equal windows start, an anchor lies at the same place in both."""
    for a in range(PERIOD):
        for b in range(PERIOD):
            assert any((a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER for d in range(PERIOD))


def test_a_passage_of_very_many_documents(make_docs):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"own{i} {passage} tail{i}") for i in range(3000)]
    got = {r.doc_id: r for r in remove_passages(make_docs(rows)).collect()}
    assert got[0].n_removed == 0 and {got[i].n_removed for i in range(1, 3000)} == {20} and got[7].kept == b"own7 tail7"


def test_empty_table_and_sql(make_docs, sf):
    rows = [(i, t) for i, t in rows_of(5) if i is not None]
    assert remove_passages(make_docs(rows).limit(0)).collect() == []
    documents = make_docs(rows, extra=False).toPandas()  # noqa: F841  DuckDB reads it by name
    want = sorted(duckdb.sql(ORACLE).fetchall())
    assert sorted(tuple(r)[:4] for r in remove_passages(make_docs(rows)).collect()) == want
    assert sorted(want, key=str) == brute(rows, 13)
    with pytest.raises(ValueError):
        remove_passages(make_docs(rows), 5)
