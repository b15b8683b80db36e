import random
import re
import zlib
from collections import Counter

import pytest

from docstrata.llm import spelling
from docstrata.llm.spelling import near_words, roots, spelling_forms


def near(a, b):
    """Exactly one letter inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(around[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def table(got):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect())


def rows_of(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéßÀz") for _ in range(rng.randrange(4, 11))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = base[int(rng.random() ** 2 * len(base))]
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", w[at] * 2, rng.choice("abcÀ")]) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words)))
    return rows + [(300, None), (301, ""), (302, "1 2 - Þ÷Ø"), (None, rows[0][1]), (5, rows[5][1]), (303, "abcde" * 20_000), (304, ("xAbcde1" * 3000))]


@pytest.mark.parametrize("crowd", [64, 1])
def test_against_brute_force(make_docs, monkeypatch, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    rows = rows_of(crowd)
    got = table(spelling_forms(make_docs(rows)))
    assert got == brute(rows) and sum(r[1] is not None for r in got) > 20


def test_near_words_of_one_signature_crowd(spark):
    """Words that all share most letters: every pair at distance one is found, none else."""
    rng = random.Random(3)
    words = sorted({"".join(rng.sample("abcdef", 6))[: rng.randrange(5, 7)] for _ in range(600)} | {"aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "baaaa"})
    got = {tuple(r) for r in near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)} and len(got) > 100


def test_roots_of_a_long_chain(spark):
    forms = [(f"w{i:03}", f"w{i + 1:03}" if i < 40 else None) for i in range(41)]
    assert {r.root for r in roots(spark.createDataFrame(forms, "word string, form string")).collect()} == {"w040"}


def test_empty_table(make_docs):
    assert spelling_forms(make_docs([(1, "hello hello hello")]).limit(0)).collect() == []
    assert table(spelling_forms(make_docs([(1, None), (2, "hi")]))) == []
