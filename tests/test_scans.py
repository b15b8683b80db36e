"""Patterns with a look at their start, texts read once, and the words of promises that texts hold."""

import pytest
from pyspark.sql import functions as F

from docstrata.functions import text as T, vectors as V
from docstrata.functions.dates import DATE_PHRASE, DATE_SEARCH
from docstrata.functions.vocabulary import ENTITY_RULES, ENTITY_STARTS, PROMISES, TOOLS
from docstrata.operators import extract, gaps, graph, serve
from docstrata.plans import queries as plans

DATES = "2024-03-12, on March 12, 2024, Sept. 3 2021; 3 MAY 2020 recent LAST week recently, May 5 upcoming Year 12 days ago x2019 1999. yesterday TOMORROW this month coming week éjan next  week Past year TODAY toda"
MARKS = "Still needed: we need to do: TBD, to be determined, yet to be confirmed; have yet to be determined. Waiting for, waiting ON it, pending. Next  step : NEXT STEPS: remain\nto  be to-do: todo : unpending future work remains to be confirmed xtbd"
NAMES = " ".join(TOOLS + [t.upper() for t in TOOLS]) + " Experiment #4 trial A run-2 RUN 3. hypothesis h1 $ 3,000k $4.5 M 12 USD 3.5 dollars (Miller et al., 2020) 10.1234/ab.c [3] x10.1234/y pythons (Li 2001)"


def test_guarded_patterns_match_as_the_plain_ones(spark):
    for text, plain, guarded in [(DATES, DATE_PHRASE, DATE_SEARCH)] + [(NAMES, p, f"{ENTITY_STARTS[p]}(?:{p})") for _, p, _ in ENTITY_RULES]:
        row = spark.range(1).select(T.find_spans(F.lit(text), plain).alias("a"), T.find_spans(F.lit(text), guarded).alias("b")).first()
        assert row.a == row.b and row.a


def test_any_promise_marker_is_found_by_the_one_look(spark):
    spans = F.concat(*[T.find_spans(F.lit(MARKS), "(?i)" + p) for p in PROMISES])
    found = sorted((s.start, s.end, s.value) for s in spark.range(1).select(spans.alias("s")).first().s)
    rows = spark.createDataFrame([(i, 1, f"ab {v}") for i, (_, _, v) in enumerate(found)] + [(99, 1, "unpending, bewaiting on, toda be")], "artifact_id long, project_id int, raw_text string")
    # each marker on its own is a candidate, and so is none of the rest
    assert {r.artifact_id for r in gaps.promise_candidates(rows).collect()} == set(range(len(found))) and len(found) >= len(PROMISES)


def test_texts_are_searched_once(spark):
    """Explode's own filter would search each text again, and again for its null test."""
    content = spark.createDataFrame([(1, 1, "Run 2 on 2024-03-12, still pending")], "artifact_id long, project_id int, raw_text string")
    anchors = spark.createDataFrame([(1, None)], "artifact_id long, ts timestamp")
    for made, looks in ((extract.content_dates(content, anchors), 1), (extract.entity_mentions(content), len(ENTITY_RULES)), (gaps.promise_candidates(content), len(PROMISES))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == looks


def test_promises_are_cut_in_their_own_row(spark):
    """No text is read again, or dealt out, to cut the sentences of its markers."""
    rows = [(1, 1, MARKS), (2, 1, "Still pending here. Some other words that are long enough. " * 4 + "We need to go; still need it\n\nTBD"), (3, 1, "none"), (4, 2, ""), (5, 2, None), (6, 2, "pending")]
    content = spark.createDataFrame(rows, "artifact_id long, project_id int, raw_text string")
    made = gaps.promise_candidates(content)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    # against spans merged by windows
    spans = content.select("artifact_id", F.explode(F.concat(*[T.find_spans(F.col("raw_text"), "(?i)" + p) for p in PROMISES])).alias("s")).select("artifact_id", "s.start", "s.end")
    merged = gaps.merge_spans(spans, ["artifact_id"]).join(content, "artifact_id").withColumn("b", T.sentence_bounds(F.col("raw_text"), F.col("start"), F.col("end")))
    want = {}
    for r in merged.orderBy("artifact_id", "start").collect():
        text = r.raw_text[r.b.start : r.b.end].strip(" ")
        want.setdefault((r.artifact_id, " ".join(text.split()).lower()), (r.b.start, text))
    got = sorted((r.artifact_id, r.start, r.evidence) for r in made.collect())
    assert got == sorted((a, *v) for (a, _), v in want.items()) and len(got) >= 4


def test_the_length_of_a_vector_is_made_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>").select(V.normalized(F.col("v")).alias("u"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert [r.u for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]


def test_a_total_of_a_listing_needs_no_joined_columns(spark, monkeypatch):
    """The browse total is counted on the filtered artifacts alone."""
    monkeypatch.setattr(serve, "browse", lambda *a, **b: pytest.fail("a total joins the columns of a page"))
    assert {r.listing for r in plans.QUERIES["page_totals"](spark, "/root/testdata/sf0.001").collect()} == {"browse", "timeline", "gaps"}


def test_held_keys_against_plain_search(spark, monkeypatch):
    monkeypatch.setattr(graph, "TEXTS_OF_PART", 3)
    monkeypatch.setattr(graph, "KEYS_OF_PART", 2)
    keys = [(1, w) for w in ("batch", "atch", "control", "cont", "zzzz")] + [(2, "batch"), (4, "batch")]
    texts = [(p, 10 * p + i, t) for p in (1, 2, 3) for i, t in enumerate(["a batch", "control batches", "xcontx", "none", "", "zzz zzzz", "con trol", "éatch"])]
    got = graph.held_keys(spark.createDataFrame(texts, "project_id int, src long, text string"), spark.createDataFrame(keys, "project_id int, key string"))
    want = {(p, s): sorted(k for q, k in keys if q == p and k in t) for p, s, t in texts}
    assert {(r.project_id, r.src): r.held for r in got.collect()} == {k: v for k, v in want.items() if v}
