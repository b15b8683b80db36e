import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docstrata.llm import langid
from docstrata.llm.langid import BUCKETS, grams, predict_language, train_language
from docstrata.llm.queries import op4_language


def test_grams_do_not_cross_chunks_or_depend_on_neighbours():
    alone = [b.tolist() for b, _, _ in grams(pa.array(["hello wörld"]))]
    assert all(0 <= x < BUCKETS for b in alone for x in b)
    assert list(grams(pa.array([], pa.string()))) == []


def test_nulls_empty_and_long_texts(spark, make_docs):
    rows = [(i, "the and of ing tion " * 20 if i % 2 else "der und ung keit ein " * 20) for i in range(200)]
    docs = make_docs(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").when(F.col("doc_id") < 190, "de"))
    model = train_language(docs)
    odd = make_docs([(1, None), (2, ""), (3, "123 --"), (4, "und keit ein " * 300_000), (None, "the of ing"), (4, "der ung")])
    got = {(r.doc_id, r.lang_pred) for r in predict_language(odd, model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "de"), (None, "en")}
    assert predict_language(odd.limit(0), model).count() == 0
    assert train_language(docs.limit(0)) is None
    assert {r.lang_pred for r in predict_language(odd, None).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars")
    got = op4_language(spark, sf).join(docs, "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.995 and got.score.between(0, 1).all()
    sure = got[~got.rejected]
    assert (sure.lang == sure.lang_pred).mean() > 0.995


def per_text(texts, i):
    """The buckets of text i by n, in order."""
    out = {}
    for at, (bucket, bounds, docs) in enumerate(grams(pa.array(texts, pa.string()))):
        for d, a, b in zip(docs, bounds[:-1], bounds[1:]):
            if d == i:
                out.setdefault(at % 3, []).extend(bucket[a:b].tolist())
    return out


def test_a_text_beside_different_neighbours(monkeypatch):
    alone = per_text(["wörter"], 0)
    assert [len(alone[k]) for k in range(3)] == [6, 5, 4]  # 7 bytes
    for beside in (["wörter", "the end"], ["wörter", "und keit"], ["", "wörter", None, "x"], ["a", "wörter"]):
        assert per_text(beside, beside.index("wörter")) == alone
    assert [len(per_text(["ab", "cdef"], 0).get(k, [])) for k in range(3)] == [1, 0, 0]
    table = np.random.default_rng(0).normal(size=(BUCKETS, 2))
    model = langid.LanguageModel(["de", "en"], table, np.zeros(2), 0.5)
    own = model.probabilities(pa.array(["ab"]))[0]
    assert all(np.allclose(model.probabilities(pa.array(["ab", other]))[0], own) for other in ("the end", "zz", ""))
    assert np.allclose(own, langid._softmax(table[per_text(["ab"], 0)[0]])[0])


def test_pieces_of_a_long_text_count_as_one(monkeypatch):
    text = "und der wörter keit " * 40
    whole, cut = per_text([text, "x"], 0), langid.chunks
    monkeypatch.setattr(langid, "chunks", lambda texts: cut(texts, 50))
    assert per_text([text, "x"], 0) == whole and per_text(["x", text, text], 1) == whole
