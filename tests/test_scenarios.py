"""Hand-built cases with known results."""

import datetime as dt

from pyspark.sql import functions as F

from docstrata.functions import text as T
from docstrata.operators import cluster, direction, extract, gaps, graph
from docstrata.plans.corpus import written
from docstrata.sources.files import discover, parse_documents
from docstrata.streaming.ingest import placements, stream_events, stream_files, stream_ingest, stream_placements, stream_timeline


def day(text):
    return dt.datetime.fromisoformat(text)


def test_drift(spark):
    names = ["x1", "x2", "x3", "e", "y1", "y2", "y3"]
    days = ["2023-01-01", "2023-01-03", "2023-01-05", "2023-02-01", "2024-05-20", "2024-05-25", "2024-06-01"]
    ids = {n: i for i, n in enumerate(names)}
    vec = spark.createDataFrame([(ids[n], 1, [1.0 if n[0] in "xe" else -1.0, 0.1], 0 if n[0] in "xe" else 1) for n in names], "artifact_id long, project_id int, vector array<double>, cluster_id int")
    dates = spark.createDataFrame([(ids[n], 1, day(d)) for n, d in zip(names, days)], "artifact_id long, project_id int, ts timestamp")
    edges = spark.createDataFrame([(ids["y3"], ids["y1"]), (ids["y3"], ids["e"])], "src long, dst long")
    got = {r.artifact_id: r.label for r in direction.direction_labels(vec, dates, edges).collect()}
    assert got[ids["x1"]] == "superseded" and got[ids["e"]] == "unclear" and got[ids["y1"]] == "current"


def test_filename_reference(spark):
    rows = [(1, 1, "experiment_log.txt", "nothing", []), (2, 1, "analysis.txt", "See Experiment_Log.txt, and myexperiment_log.txt too.", [])]
    df = spark.createDataFrame(rows, "artifact_id long, project_id int, original_filename string, raw_text string, labels array<string>")
    found = graph.reference_scan(df.select("artifact_id", "project_id", "raw_text"), graph.match_keys(df))
    dates = spark.createDataFrame([(1, day("2024-01-01")), (2, day("2024-06-01"))], "artifact_id long, ts timestamp")
    (r,) = graph.orient(found, dates).collect()
    assert (r.src, r.dst, r.edge_type, r.confidence, r.start) == (2, 1, "builds_on", 0.9, 4)


def test_references_in_odd_places(spark):
    names = {1: "(draft) plan one.txt", 2: "über_alles.txt", 3: "note_0001.txt", 4: "x.txt"}
    texts = {5: "see (Draft) Plan One.txt; ÜBER_ALLES.TXT!", 6: "énote_0001.txt note_0001.txté note_0001.txt", 7: "xnote_0001.txt _note_0001.txt note_0001.txt2", 8: "plan one.txt"}
    rows = [(i, 1, n, "", []) for i, n in names.items()] + [(i, 1, f"text number {i}", t, []) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "artifact_id long, project_id int, original_filename string, raw_text string, labels array<string>")
    found = graph.reference_scan(df.select("artifact_id", "project_id", "raw_text"), graph.match_keys(df)).collect()
    assert sorted((r.src, r.dst, r.start) for r in found) == [(5, 1, 4), (5, 2, 26), (6, 3, 30)]
    assert graph.reference_scan(df.select("artifact_id", "project_id", "raw_text"), graph.match_keys(df.limit(0))).collect() == []


def test_text_functions(spark):
    row = spark.range(1).select(
        T.file_type(F.lit("a.b.TXT")).alias("a"), T.file_type(F.lit(".bashrc")).alias("b"), T.slugify(F.lit(" My File! ")).alias("c"), T.normalize_cost(F.lit("$1,200.5k")).alias("d"),
        T.find_spans(F.lit("é run 1, Run 2"), r"(?i)run \d").alias("e"), F.size(T.chunk_words(F.lit(""))).alias("f"), T.extension(F.lit("x.tar.GZ")).alias("g"),
    ).first()
    assert row[:4] == ("txt", "unknown", "my-file", "1200500.00") and row.f == 0 and row.g == ".gz"
    assert [(s.value, s.start, s.end) for s in row.e] == [("run 1", 2, 7), ("Run 2", 9, 14)]


def test_costs_are_printed_by_their_exact_value(spark):
    given = ["$ 170.125", "$0.375", "$2.675", "$1.005k", "$ 12345678901234567890", "$ 170.116", "$5M", "$" + "9" * 400, "$", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, value string")
    got = [r.n for r in df.select("i", T.normalize_cost(F.col("value")).alias("n")).orderBy("i").collect()]
    assert got == ["170.12", "0.38", "2.67", f"{1.005 * 1e3:.2f}", "12345678901234567168.00", "170.12", "5000000.00", "inf", "$", None]


def test_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / ".git").mkdir(parents=True)
    (root / ".git" / "x.txt").write_text("hidden")
    (root / "a.txt").write_text("hello")
    (root / "t.csv").write_bytes("n,n,\n1,2,\xe9\n".encode("latin-1"))
    (root / "p.pdf").write_bytes(b"%PDF")
    (root / "bad.xyz").write_text("boom")

    def boom(content, path):
        raise ValueError("no")

    rows = {r.path.rsplit("/", 1)[-1]: r for r in parse_documents(discover(spark, str(root)), {"xyz": boom}).collect()}
    assert set(rows) == {"a.txt", "t.csv", "p.pdf", "bad.xyz"} and rows["a.txt"].raw_text == "hello"
    assert rows["t.csv"].tables[0].columns == ["n", "n_1", "col_2"] and rows["t.csv"].tables[0].rows[0]["col_2"] == "é"
    assert rows["p.pdf"].status == "unsupported" and rows["bad.xyz"].error == "ValueError: no"


def test_stream_ingest_keeps_each_content_once(spark, tmp_path):
    root, target = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    for batch in (["a"], ["a", "b"]):
        for i, text in enumerate(batch):
            (root / f"{len(batch)}{i}.txt").write_text(text)
        stream_ingest(stream_files(spark, str(root)), target, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_stream_timeline(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    source = str(tmp_path / "e")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(source)
    events = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    q = stream_timeline(events).writeStream.format("memory").queryName("tl").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tl").agg(F.sum("events")).first()[0] == spark.read.parquet(source).count()


def test_stream_extracts_and_places(spark, tmp_path):
    root, target = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    (root / "a.txt").write_text("Experiment 7 in Python. Minutes dated 2023-02-01.")
    stream_events(stream_files(spark, str(root)), target, str(tmp_path / "cp")).awaitTermination()
    (root / "b.txt").write_text("No dates here.")
    stream_events(stream_files(spark, str(root)), target, str(tmp_path / "cp")).awaitTermination()
    kinds = {(r.kind, r.normalized_value) for r in spark.read.parquet(f"{target}/mentions").collect()}
    assert kinds == {("experiment", "experiment 7"), ("tool", "python")}
    placed = spark.read.parquet(f"{target}/events").where("source = 'placement:content'").collect()
    assert [(r.event_date.date().isoformat(), r.description) for r in placed] == [("2023-02-01", "a.txt — 2023-02-01")]
    q = stream_placements(placements(spark, target)).writeStream.format("memory").queryName("pl").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("pl").agg(F.sum("events")).first()[0] == 2


def test_density_clusters(spark):
    import math

    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    angles = {1: 0, 2: 5, 3: 10, 4: 15, 5: 22, 10: 90, 11: 95, 12: 100, 20: 200, 21: 203}
    rows = [(i, 1, at(a)) for i, a in angles.items()] + [(100 + i, 2, at(a)) for i, a in angles.items()]
    df = spark.createDataFrame(rows, "artifact_id long, project_id int, vector array<double>")
    got = {r.artifact_id: r.cluster_id for r in cluster.density_clusters(df, written, least=math.cos(math.radians(8)), min_points=3).collect()}
    want = {1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 10: 11, 11: 11, 12: 11, 20: -1, 21: -1}
    assert got == want | {100 + i: c + 100 if c > 0 else -1 for i, c in want.items()}


def test_promises(spark):
    content = spark.createDataFrame([(1, 1, "Still need to calibrate sensors."), (2, 1, "We recalibrated the sensors."), (3, 1, "TBD: order resin."), (4, 2, "TBD: alone here.")], "artifact_id long, project_id int, raw_text string")
    dates = spark.createDataFrame([(1, day("2024-01-01")), (2, day("2024-02-01"))], "artifact_id long, ts timestamp")
    promises = gaps.promise_candidates(content)
    got = {r.artifact_id: (round(r.best, 3), r.fulfilled) for r in gaps.fulfillment(promises, content, dates).collect()}
    assert got == {1: (1.0, True), 3: (0.0, False), 4: (0.0, False)}
    found = {r.evidence: r.confidence for r in gaps.promised_gaps(promises, content, content, dates).collect()}
    assert found == {"3": 0.35, "4": 0.55}


def test_balanced_json(spark):
    texts = ['{"a": 1}', "so: [1, [2]] and [3]", '```JSON\n{"a": "}"}\n```', 'x {"a": "\\"}"} y', "[1, 2", "{'a'}", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.extract_json(F.col("t")).alias("j"))
    assert [r.j for r in df.collect()] == ['{"a": 1}', "[1, [2]]", '{"a": "}"}', '{"a": "\\"}"}', None, None, None, None]


def test_cells(spark):
    row = spark.sql("SELECT DATE '2024-01-02' AS d, TIMESTAMP '2024-01-02 03:04:05' AS t, TIMESTAMP '2024-01-02 03:04:05.5' AS u, CAST(1.50 AS DECIMAL(5, 2)) AS n, 'x' AS s")
    got = row.select(*[T.json_safe(F.col(c), k).alias(c) for c, k in row.dtypes]).first()
    assert tuple(got) == ("2024-01-02", "2024-01-02T03:04:05", "2024-01-02T03:04:05.500000", 1.5, "x")


def test_joins_are_broadcast_up_to_a_counted_size(spark, monkeypatch):
    from docstrata import joins

    plan = lambda: spark.range(9).join(joins.sized(spark.range(5)), "id")._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 20)
    assert "strategy=merge" in plan() and "strategy=broadcast" not in plan()


def test_content_dates_are_joined_and_resolved(spark):
    """Parts of one date with commas or blanks between, abbreviations, vague words; lists of dates are no date."""
    cases = {
        "our 5 March, 2023 plan": ("2023-03-05", 0.85), "on March 12\n2024.": ("2024-03-12", 0.85), "Mar. 3, 2022 it was": ("2022-03-03", 0.85), "by 7 Sept 2021": ("2021-09-07", 0.85),
        "in March, 2020": ("2020-03-01", 0.85), "12 April ran": ("2024-04-12", 0.85), "recently, March 5, 2023": ("2023-03-05", 0.6), "recently we": None, "2023-01-02, 2023-02-03": None,
        "in 1999": ("1999-01-01", 0.45), "last week": ("2024-04-24", 0.6), "3 days ago": ("2024-04-28", 0.6), "year 3021": None, "May 40, 2020": None, "": None,
    }
    content = spark.createDataFrame([(i, 1, t) for i, t in enumerate(cases)] + [(99, 1, None)], "artifact_id long, project_id int, raw_text string")
    anchors = content.select("artifact_id", F.lit("2024-05-01").cast("timestamp").alias("ts"))
    got = {r.artifact_id: (r.ts.date().isoformat(), r.confidence) for r in extract.content_dates(content, anchors).collect()}
    assert {t: got.get(i) for i, t in enumerate(cases)} == cases


def test_overlaps_by_a_sweep(spark):
    import random

    rng = random.Random(2)
    span = lambda: (rng.randrange(4), *(lambda s: (s, s + rng.randrange(6)))(rng.randrange(60)))
    a, b = [(*span(), i) for i in range(200)] + [(None, 1, 2, 900), (9, 5, 8, 901)], [span() for _ in range(30)] + [(None, 1, 2)]
    got = extract.suppress_overlaps(spark.createDataFrame(a, "artifact_id long, start long, end long, k int"), spark.createDataFrame(b, "artifact_id long, start long, end long"))
    want = {k for i, s, e, k in a if i is None or not any(i == j and s < f and t < e for j, t, f in b)}
    assert {r.k for r in got.collect()} == want and 0 < len(want) < 202
    many = spark.range(100_000).select(F.lit(1).cast("long").alias("artifact_id"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 2).alias("end"))
    assert extract.suppress_overlaps(many, many.where("start % 2 = 0")).count() == 50_000


def test_many_matches_in_one_text(spark):
    text = "Run 12 é " * 40_000
    spans = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(F.explode(T.find_spans(F.col("t"), r"Run \d+")).alias("s"))
    assert tuple(spans.agg(F.count("*"), F.sum("s.start"), F.max("s.end")).first()) == (40_000, sum(9 * i for i in range(40_000)), 9 * 39_999 + 6)


def test_references_of_many_shapes(spark):
    """Thousands of titles of any shape, parts of a project, longest match first."""
    titles = [f"{'x' * (i % 50 + 1)} {'-' * (i % 7)}plan {i}" for i in range(3000)]
    rows = [(i, 1, f"file {i} name", "", [t]) for i, t in enumerate(titles)] + [(10_000 + i, 1, f"text {i} here", f"see {titles[i]}! {titles[i]}0 and file {i} name2, File {i} Name", []) for i in range(0, 3000, 100)]
    df = spark.createDataFrame(rows, "artifact_id long, project_id int, original_filename string, raw_text string, labels array<string>")
    try:
        graph.TEXTS_OF_PART, graph.KEYS_OF_PART = 10, 700
        found = graph.reference_scan(df.select("artifact_id", "project_id", "raw_text"), graph.match_keys(df)).collect()
    finally:
        graph.TEXTS_OF_PART, graph.KEYS_OF_PART = 500, 50_000
    want = {(10_000 + i, i) for i in range(0, 3000, 100)}
    # a title with another digit behind it is another title, if there is one
    more = {(10_000 + i, titles.index(titles[i] + "0")) for i in range(0, 3000, 100) if titles[i] + "0" in titles}
    assert {(r.src, r.dst) for r in found} == want | more and {r.confidence for r in found} == {0.9} | ({0.75} if more else set())


def test_multisets_follow_changes(spark):
    from docstrata.operators import state

    df = lambda rows: spark.createDataFrame(rows, "project_id int, line string")
    old, gone, new = [(1, "a"), (1, "a"), (1, "b"), (2, "c")], [(1, "a"), (2, "c")], [(1, "z"), (3, "y")]
    held = state.multiset(df(old), ["project_id"], F.col("line"))
    changed = state.merged_multisets([held, state.multiset(df(gone), ["project_id"], F.col("line"), -1), state.multiset(df(new), ["project_id"], F.col("line"))], ["project_id"])
    whole = state.multiset(df([(1, "z"), (1, "b"), (1, "a"), (3, "y")]), ["project_id"], F.col("line"))
    prints = lambda m: sorted(tuple(r) for r in state.multiset_fingerprint(m, ["project_id"]).collect())
    assert prints(changed) == prints(whole) != prints(held)


def test_domain_feedback(spark):
    from docstrata.operators import state

    known = spark.createDataFrame([(1, "research", 0.9, False), (2, "generic", 0.0, False), (3, "research", 0.8, False), (4, "research", 0.7, False)], "project_id int, domain string, confidence double, confirmed boolean")
    given = [(1, None, day("2024-01-02")), (2, "engineering", day("2024-01-01")), (2, "research", day("2024-01-03")), (2, None, day("2024-01-04")), (3, "cooking", day("2024-01-01")), (9, "research", day("2024-01-01"))]
    out = state.apply_domain_feedback(known, spark.createDataFrame(given, "project_id int, domain string, at timestamp"), spark.createDataFrame([("research",), ("engineering",)], "domain string"))
    assert sorted((r.project_id, r.domain, r.confirmed) for r in out.collect()) == [(1, "research", True), (2, "research", True), (3, "research", False), (4, "research", False)]


def test_large_csv_files_in_pieces(spark, tmp_path, monkeypatch):
    from docstrata.sources import files

    body = "a,b,a\n" + "".join(f'{i},"x\n{i}",é\n' for i in range(20_000)) + "1,2,3,4\nlast\n"
    given = [("utf8.csv", body.encode()), ("latin.csv", body.encode("latin-1")), ("empty.csv", b""), ("head.csv", b"a,b"), ("none.csv", None)]
    got = files.csv_rows(spark.createDataFrame(given, "path string, content binary")).collect()
    for name in ("utf8.csv", "latin.csv"):
        own = sorted((r.row_no, tuple(r.cells)) for r in got if r.path == name)
        assert own[5] == (6, ("5", "x\n5", "é")) and len(own) == 20_001 and own[-1] == (20_002, ("last", "", ""))
    assert {r.path for r in got} == {"utf8.csv", "latin.csv"} and got[0].columns == ["a", "b", "a_1"]
    (tmp_path / "one.csv").write_text("n,n,\n1,2,3\n")
    assert files.read_csv(spark, str(tmp_path / "one.csv")).first().asDict() == {"n": "1", "n_1": "2", "col_2": "3"}
