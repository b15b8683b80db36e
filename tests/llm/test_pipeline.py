import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from docstrata.llm.common import table

from .test_jaccard import brute
from .test_mixing import fill


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = table(spark, sf, "documents"), []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((before.collect(), docs.collect()))
        if i < 4:
            assert docs.columns == before.columns
    return out


def test_stages_against_brute_force(spark, sf, stages):
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    before, after = stages[0]
    kept = {r.doc_id for r in after}
    wrong = [i for i, q in labels.items() if (i in kept) != (q == 1)]
    assert len(wrong) <= 0.05 * len(labels)

    before, after = stages[1]
    best = {}
    for r in before:
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(best.values())

    before, after = stages[2]
    want = {c for _, _, c in brute([(r.doc_id, r.text) for r in before], 80, 5)}
    assert sorted(r.doc_id for r in after) == sorted(want)

    before, after = stages[3]
    sizes, taken, rows = defaultdict(int), defaultdict(int), {r.doc_id: r for r in before}
    for r in before:
        sizes[r.source] += words(r.text)
    for r in after:
        assert r == rows[r.doc_id]
        taken[r.source] += words(r.text)
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    most = max(words(r.text) for r in before)
    assert all(abs(taken[s] - t) <= most / 2 + 1 for s, t in fill(sizes).items())

    before, after = stages[4]
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coded = {t: tokenizer.encode(t, add_special_tokens=False).ids for t in {r.text or "" for r in before}}
    assert sorted((r.doc_id, r.n_tokens, r.ids, r.text) for r in after) == sorted((r.doc_id, len(coded[r.text or ""]), coded[r.text or ""], r.text or "") for r in before)


def test_run_gives_what_the_stages_give(spark, sf, stages):
    digest = lambda rows: Counter((r.doc_id, hashlib.sha256(str(r.ids).encode()).hexdigest()) for r in rows)
    assert digest(pipeline.run(spark, sf).collect()) == digest(stages[-1][1])


def test_odd_rows(spark, sf, make_docs):
    rows = [(1, None), (2, ""), (3, "same text here"), (3, "same text here"), (4, "same text here"), (None, "x y"), (None, "x y"), (5, "a b c d e f g")]
    docs = make_docs(rows)
    got = pipeline.exact(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "x y"), (2, ""), (4, "same text here"), (5, "a b c d e f g")]
    again = pipeline.exact(spark, make_docs([(3, "t"), (3, "t"), (1, "t")]), sf).collect()
    assert [r.doc_id for r in again] == [3]
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == []
    near = pipeline.near(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in near) == [(0, "x y"), (0, "x y"), (1, ""), (2, ""), (3, "same text here"), (3, "same text here"), (5, "a b c d e f g")]
    mixed = [(r.doc_id or 0, r.text) for r in pipeline.mix(spark, docs, sf).collect()]
    assert all(1 <= mixed.count((i, t)) for i, t in ((1, None), (2, ""))) and set(mixed) <= {(i or 0, t) for i, t in rows}
    coded = pipeline.tokens(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in coded) == sorted((i or 0, t or "") for i, t in rows)
    good = table(spark, sf, "documents").limit(1).collect()[0].text
    kept = pipeline.quality(spark, make_docs([(1, good), (2, good), (2, good), (None, good)]), sf).collect()
    assert len({(r.doc_id, r.text) for r in kept}) in (0, 3)


def test_columns_with_clashing_and_odd_names(spark, sf, make_docs):
    docs = make_docs([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")])
    names = ["same_id", "same_sha", "quality_score", "mixed_id", "drawn", "mix_shard", "mix_place", "a.b", "draws"]
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(i))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and all(r[n] == i for r in out.collect() for i, n in enumerate(names))
    assert {r.doc_id for r in pipeline.exact(spark, docs, sf).collect()} == {2, 3}
    assert {r.doc_id for r in pipeline.near(spark, docs, sf).collect()} == {1, 3}
