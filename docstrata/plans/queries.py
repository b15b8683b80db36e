"""The registered queries: operators applied to the derived corpus, and DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import sinks
from ..functions import dates as D, text as T, vectors as V
from ..functions.vocabulary import SECTIONS
from ..joins import sized
from ..operators import cluster, direction, embed, extract, gaps, graph, hierarchy, ingest, judge, phases, report, serve, state, view
from ..sources import files, records
from ..streaming import ingest as stream
from . import runner
from .corpus import Corpus, shared_path, written
from .oracles import dot, oracle, spans, squeeze

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, recursive: str = ""):
    """Registers fn(corpus) under its name; sql is the select behind the shared relations and those in recursive."""

    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: fn(derived(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = oracle(sql, recursive)
        return fn

    return register


def kept(method):
    """Writes what a method derives to the shared folder, once for each corpus: dates, mentions, edges and
    labels feed many queries, and a plan that starts at a written table stays small."""

    @wraps(method)
    def get(self) -> DataFrame:
        if method.__name__ not in self.held:
            self.held[method.__name__] = written(method(self))
        return self.held[method.__name__]

    return get


def derived(spark: SparkSession, sf_dir: str) -> Derived:
    """One Derived for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CORPORA:
        _CORPORA.clear()  # of a folder that is no longer asked for
        _CORPORA[key] = Derived(spark, sf_dir)
    return _CORPORA[key]


def forget() -> None:
    """Lets go of what was derived so far; tables in the shared folder stay until it is cleared."""
    _CORPORA.clear()


_CORPORA: dict[tuple[str, str], Derived] = {}


class Derived(Corpus):
    """What operators derive from the corpus."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        self.held: dict[str, DataFrame] = {}

    @kept
    def vectors(self) -> DataFrame:
        return self.relation("vectors")

    @kept
    def projects(self) -> DataFrame:
        return self.relation("projects")

    def listed(self) -> DataFrame:
        """The artifacts without their headings, whose join many plans don't need."""
        return self.relation("artifacts")

    @kept
    def dates(self) -> DataFrame:
        return extract.resolved_dates(self.artifacts, self.content, self.relation("metadata"))

    @kept
    def chosen(self) -> DataFrame:
        return extract.chosen_dates(self.dates())

    @kept
    def mentions(self) -> DataFrame:
        return extract.entity_mentions(self.content)

    def keys(self) -> DataFrame:
        return graph.match_keys(self.artifacts.withColumn("labels", F.col("headings")))

    @kept
    def refs(self) -> DataFrame:
        return graph.reference_scan(self.content, self.keys())

    @kept
    def edges(self) -> DataFrame:
        chosen = self.chosen()
        return graph.assemble_edges(graph.orient(self.refs(), chosen), graph.entity_chain(self.mentions(), chosen))

    @kept
    def clusters(self) -> DataFrame:
        return hierarchy.hierarchical_clusters(self.vectors().drop("cluster_id"), written)

    @kept
    def members(self) -> DataFrame:
        chosen, vectors = self.chosen(), self.vectors()
        return direction.current_members(vectors, direction.cluster_profile(vectors, chosen), chosen)

    def confirmed(self) -> DataFrame:
        return self.relation("feedback").groupBy("artifact_id").agg(F.first("project_id").alias("project_id"), F.max_by("label", "given_at").alias("label"))

    @kept
    def labels(self) -> DataFrame:
        return direction.direction_labels(self.vectors(), self.chosen(), self.edges(), self.confirmed())

    @kept
    def coverage(self) -> DataFrame:
        known = self.relation("phases").select("phase_id", "phase_name", F.lit("research").alias("domain"), F.col("phase_id").alias("ordinal"))
        every = phases.project_phases(self.relation("projects").select("project_id", F.lit("research").alias("template_domain")), known)
        return phases.phase_coverage(every.select("project_id", "phase_id", "phase_name"), self.relation("assignments"))

    def structural(self) -> DataFrame:
        totals = self.listed().groupBy("project_id").agg(F.count("*").alias("artifacts_total"))
        return gaps.structural_gaps(self.coverage(), totals)

    @kept
    def promises(self) -> DataFrame:
        return gaps.promise_candidates(self.content)

    @kept
    def promised(self) -> DataFrame:
        return gaps.promised_gaps(self.promises(), self.content, self.listed(), self.chosen())

    def versions(self) -> DataFrame:
        return state.current_version(state.version_chain(self.relation("versions")))

    @kept
    def names(self) -> DataFrame:
        v = self.versions().select("artifact_id", "suggested_name")
        return self.listed().join(v.hint("merge"), "artifact_id", "left").select("artifact_id", T.clean_name(F.col("suggested_name"), F.col("original_filename")).alias("name"))

    @kept
    def events(self) -> DataFrame:
        return report.timeline(self.dates(), self.listed())

    def categories(self) -> DataFrame:
        named = self.relation("phases").withColumn("ordinal", F.col("phase_id"))
        return phases.choose_category(self.relation("assignments"), named)

    @kept
    def view(self) -> DataFrame:
        return view.view_projection(self.artifacts, self.chosen(), self.categories(), view.top_entities(self.mentions()))

    def open_gaps(self) -> DataFrame:
        drafts = self.structural().unionByName(self.promised())
        return drafts.withColumn("status", F.when(F.col("project_id") % 3 == 0, "dismissed").otherwise("open"))


OPEN_GAPS = "(SELECT *, CASE WHEN project_id % 3 = 0 THEN 'dismissed' ELSE 'open' END AS status FROM drafts)"
r6 = lambda c, a: F.round(c, 6).alias(a)
DAY = "strftime({}, '%Y-%m-%d')"


# sources and ingest


@query("SELECT artifact_id, sha256(raw_text) AS content_hash FROM artifacts")
def content_hash(c):
    return c.content.select("artifact_id", F.sha2("raw_text", 256).alias("content_hash"))


@query(r"SELECT url, coalesce(nullif(lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '[^.]\.([^.]*)$', 1)), ''), 'unknown') AS file_type FROM (SELECT regexp_replace(url, '^[a-z]+://[^/]*', '') AS url FROM pages)")
def file_type(c):
    url = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    return c.table("pages").select(url.alias("url"), T.file_type(F.regexp_extract(url, "([^/]*)$", 1)).alias("file_type"))


SEEN = "(SELECT project_id, sha256(text) AS content_hash, concat('in/', lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS path, k FROM base)"


@query(f"""SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.content_hash, n.content_hash) AS content_hash, coalesce(n.path, o.path) AS path, coalesce(n.copies, 0) AS copies,
  CASE WHEN o.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'missing' WHEN o.path = n.path THEN 'unchanged' ELSE 'updated' END AS action
  FROM (SELECT project_id, content_hash, max(CASE WHEN k % 5 = 1 THEN 'old/x' ELSE path END) AS path FROM {SEEN} WHERE k % 3 <> 2 GROUP BY 1, 2) o
  FULL JOIN (SELECT project_id, content_hash, max(path) AS path, count(*) AS copies FROM {SEEN} WHERE k % 7 <> 6 GROUP BY 1, 2) n USING (project_id, content_hash)""")  # fmt: skip
def ingest_dedupe(c):
    seen = c.relation("base").select("project_id", "k", F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("in/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"))
    old = seen.where("k % 3 <> 2").withColumn("path", F.when(F.col("k") % 5 == 1, "old/x").otherwise(F.col("path"))).groupBy("project_id", "content_hash").agg(F.max("path").alias("path"))
    return ingest.ingest_merge(old, seen.where("k % 7 <> 6"))


@query("SELECT artifact_id, CASE WHEN k % 4 = 0 THEN 'pdf' WHEN k % 4 = 1 THEN 'md' ELSE 'txt' END AS file_type, CASE WHEN k % 4 = 0 THEN 'unsupported' ELSE 'parsed' END AS status, CASE WHEN k % 4 = 0 THEN NULL ELSE length(raw_text) END AS chars FROM artifacts")
def parse_dispatch(c):
    kind = F.when(F.col("k") % 4 == 0, "pdf").when(F.col("k") % 4 == 1, "md").otherwise("txt")
    given = c.artifacts.select(F.col("artifact_id").cast("string").alias("path"), F.to_binary("raw_text", F.lit("utf-8")).alias("content"), kind.alias("file_type"))
    parsed = files.parse_documents(given).select("path", "status", F.length("raw_text").alias("chars"))
    return given.select("path", "file_type").join(parsed.hint("merge"), "path").select(F.col("path").cast("long").alias("artifact_id"), "file_type", "status", "chars")


@query("""SELECT concat('cust', o_custkey) AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no, unnest(['key', 'col_1', 'key_1', 'late']) AS key, unnest([CAST(o_orderkey AS VARCHAR), concat('a "', o_orderpriority, '", b'), o_orderstatus, '']) AS value FROM orders""")
def csv_rows(c):
    """A CSV file for each customer, with quoted cells, a blank and a repeated column name, and short records."""
    o = c.table("orders")
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(',"a ""'), "o_orderpriority", F.lit('"", b",'), "o_orderstatus")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda s: s["line"]), "\r\n")
    made = o.groupBy("o_custkey").agg(F.concat(F.lit("key, ,key,late\r\n"), body).alias("text"))
    rows = files.csv_rows(made.select(F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("path"), F.to_binary("text", F.lit("utf-8")).alias("content")))
    return rows.select("path", "row_no", F.explode(F.arrays_zip(F.col("columns").alias("key"), F.col("cells").alias("value"))).alias("x")).select("path", "row_no", "x.key", "x.value")


TURNS = "(SELECT concat('deck', conv_id) AS path, turn, concat(CASE WHEN turn % 3 = 2 THEN '' ELSE role END) AS role, CASE WHEN turn % 3 = 1 THEN '  ' ELSE text END AS text FROM conversations)"


def _turns(c):
    t = c.table("conversations")
    return t.select(F.concat(F.lit("deck"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").cast("int").alias("turn"), F.when(F.col("turn") % 3 == 2, "").otherwise(F.col("role")).alias("role"), F.when(F.col("turn") % 3 == 1, "  ").otherwise(F.col("text")).alias("text"))


@query(f"SELECT path, string_agg(CASE WHEN trim(text) <> '' THEN text END, chr(10) || chr(10) ORDER BY turn) AS raw_text, count(*) AS page_count, count(*) FILTER (trim(text) <> '') = 0 AS likely_scanned FROM {TURNS} GROUP BY path")
def page_records(c):
    return records.page_records(_turns(c).withColumnRenamed("turn", "page"))


@query(f"""SELECT path, string_agg(CASE WHEN trim(role) <> '' OR trim(text) <> '' THEN concat('[Slide ', turn, ']', chr(10), CASE WHEN trim(role) = '' THEN text WHEN trim(text) = '' THEN role ELSE concat(role, chr(10), text) END) END, chr(10) || chr(10) ORDER BY turn) AS raw_text,
  count(*) AS slide_count, string_agg(coalesce(nullif(role, ''), '-'), ',' ORDER BY turn) AS titles FROM {TURNS} GROUP BY path""")
def slide_records(c):
    slides = _turns(c).select("path", F.col("turn").alias("slide"), F.nullif("role", F.lit("")).alias("title"), F.array("role", "text").alias("texts"))
    titles = F.array_join(F.transform("slide_titles", lambda t: F.coalesce(t, F.lit("-"))), ",").alias("titles")
    return records.slide_records(slides).select("path", "raw_text", "slide_count", titles)


@query(f"SELECT path, string_agg(CASE WHEN trim(text) <> '' THEN text END, chr(10) ORDER BY turn) AS raw_text, coalesce(string_agg(text, '|' ORDER BY turn) FILTER (trim(text) <> '' AND role = 'user'), '') AS headings FROM {TURNS} GROUP BY path")
def paragraph_records(c):
    paragraphs = _turns(c).select("path", F.col("turn").alias("place"), "text", F.when(F.col("role") == "user", "Heading 1").otherwise("Normal").alias("style"))
    return records.paragraph_records(paragraphs).withColumn("headings", F.array_join("headings", "|"))


@query("SELECT concat('cust', o_custkey) AS path, concat('page_', 1 + o_custkey % 2, '_table_1') AS source, o_orderkey + 1 AS row, unnest(['status', 'col_1', 'status_1']) AS key, unnest([o_orderstatus, o_orderpriority, 'x']) AS value FROM orders")
def page_tables(c):
    o = c.table("orders").select(F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("path"), (1 + F.col("o_custkey") % 2).alias("page"), F.lit(1).alias("table"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    at = ["path", "page", "table"]
    head = o.select(*at).distinct().select(*at, F.lit(0).cast("long").alias("row"), F.posexplode(F.array(F.lit("status"), F.lit(" "), F.lit("status"))).alias("col", "value"))
    body = o.select(*at, (F.col("o_orderkey") + 1).alias("row"), F.posexplode(F.array("o_orderstatus", "o_orderpriority", F.lit("x"), F.lit("beyond"))).alias("col", "value"))
    return records.page_tables(head.unionByName(body)).select("path", "source", "row", F.explode("record").alias("key", "value"))


@query("SELECT url AS path, unnest(['width', 'height', 'format', 'exif.Image Make']) AS key, unnest([CAST(page_id % 640 AS VARCHAR), CAST(length(html) AS VARCHAR), 'JPEG', concat('maker ', page_id % 7)]) AS value FROM pages")
def image_records(c):
    p = c.table("pages")
    images = p.select(F.col("url").alias("path"), (F.col("page_id") % 640).alias("width"), F.length("html").alias("height"), F.lit("JPEG").alias("format"))
    tags = p.select(F.col("url").alias("path"), F.explode(F.create_map(F.lit("Image Make"), F.concat(F.lit("maker "), (F.col("page_id") % 7).cast("string")), F.lit("Thumbnail Size"), F.lit("1"))).alias("tag", "value"))
    return records.image_records(images, tags)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS DOUBLE) AS price, o_orderstatus AS status FROM orders")
def json_safe(c):
    o = c.table("orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(15,2)").alias("price"), F.col("o_orderstatus").alias("status"))
    return o.select("o_orderkey", *[T.json_safe(F.col(n), t).alias(n) for n, t in o.dtypes[1:]])


@query("""SELECT table_id, pos, CASE WHEN nth = 0 THEN name ELSE concat(name, '_', nth) END AS name FROM (SELECT table_id, pos, name, row_number() OVER (PARTITION BY table_id, name ORDER BY pos) - 1 AS nth FROM (
  SELECT o_orderkey AS table_id, pos, CASE WHEN trim(cell) = '' THEN concat('col_', pos) ELSE trim(cell) END AS name FROM (SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority, '', o_orderstatus, ' ']) AS cell, unnest([0, 1, 2, 3, 4]) AS pos FROM orders)))""")
def header_dedupe(c):
    cells = F.array("o_orderstatus", "o_orderpriority", F.lit(""), F.col("o_orderstatus"), F.lit(" "))
    return ingest.header_names(c.table("orders").select(F.col("o_orderkey").alias("table_id"), F.posexplode(cells).alias("pos", "cell")))


def _sheets(c):
    o = c.table("orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(F.col("o_custkey").alias("artifact_id"), F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("title"), (F.col("o_orderkey") % 2).alias("sheet_no"), F.concat(F.lit("s"), (F.col("o_orderkey") % 2).cast("string")).alias("sheet"), F.array(F.lit("status"), F.lit("day")).alias("columns"), F.col("o_orderkey").alias("row_no"), F.array(F.col("o_orderstatus"), day).alias("cells"))


@query("""SELECT artifact_id, concat(title, chr(10), string_agg(concat(chr(10), 'Sheet: s', sheet_no, chr(10), 'Columns: status, day', chr(10), body), chr(10) ORDER BY sheet_no)) AS raw_text FROM (
  SELECT o_custkey AS artifact_id, concat('customer ', o_custkey) AS title, o_orderkey % 2 AS sheet_no, string_agg(concat(o_orderstatus, ' | ', strftime(o_orderdate, '%Y-%m-%d')), chr(10) ORDER BY o_orderkey) AS body FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 50 GROUP BY ALL) GROUP BY artifact_id, title""")
def table_text(c):
    return ingest.table_text(_sheets(c))


@query("SELECT o_custkey AS artifact_id, o_orderkey AS row_no, unnest(['status', 'priority']) AS key, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders")
def structured_long(c):
    record = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    return ingest.structured_long(c.table("orders").select(F.col("o_custkey").alias("artifact_id"), F.col("o_orderkey").alias("row_no"), record.alias("record")))


@query("SELECT artifact_id, version, suggested_name FROM versions WHERE artifact_id % 7 <> 1 UNION ALL SELECT artifact_id, 9, 'replaced' FROM artifacts WHERE artifact_id % 7 = 1 AND artifact_id % 2 = 0")
def replace_rows(c):
    old = c.relation("versions").select("artifact_id", F.col("version").cast("int").alias("version"), "suggested_name")
    keys = c.artifacts.where("artifact_id % 7 = 1")
    new = keys.where("artifact_id % 2 = 0").select("artifact_id", F.lit(9).alias("version"), F.lit("replaced").alias("suggested_name"))
    return ingest.replace_rows(old, keys, new, ["artifact_id"])


# text functions


@query("SELECT artifact_id, kind, value, start, \"end\", confidence, context, normalized_value FROM mentions")
def entity_mentions(c):
    return c.mentions().drop("project_id").withColumn("start", F.col("start").cast("long"))


_NER = r"\b(?:Results|Experiment|Minutes|Review)\b"


@query(f"""SELECT artifact_id, CASE value WHEN 'Minutes' THEN 'person' ELSE 'group' END AS kind, value, lower(value) AS normalized_value, start, CASE value WHEN 'Minutes' THEN 0.75 ELSE 0.65 END AS confidence,
  substring(raw_text, greatest(start - 40, 0) + 1, least(start + length(value) + 40, length(raw_text)) - greatest(start - 40, 0)) AS context FROM ({spans(_NER, "artifacts", "artifact_id, raw_text")}) s
  WHERE value <> 'Review' AND NOT EXISTS (SELECT 1 FROM mentions m WHERE m.artifact_id = s.artifact_id AND m.start < s.start + length(s.value) AND s.start < m."end")""")
def model_mentions(c):
    """Spans as a model might give them: one kind of them lies in a rule's match, one has an unknown label."""
    found = c.content.select("artifact_id", F.explode(T.find_spans(F.col("raw_text"), _NER)).alias("s")).select("artifact_id", "s.*")
    label = F.when(F.col("value") == "Minutes", "PERSON").when(F.col("value") == "Review", "GPE").otherwise("ORG")
    made = extract.model_mentions(c.content, found.withColumn("label", label), c.mentions())
    return made.drop("project_id", "end").withColumn("start", F.col("start").cast("long"))


@query("SELECT artifact_id, value, start FROM m1 WHERE kind = 'experiment'")
def find_spans(c):
    rows = c.content.select("artifact_id", F.explode(T.find_spans(F.col("raw_text"), r"(?i)\b(?:Experiment|Trial|Run)\s+#?[A-Za-z0-9][\w-]*")).alias("s"))
    return rows.select("artifact_id", F.regexp_replace("s.value", r"\.+$", "").alias("value"), F.col("s.start").cast("long").alias("start"))


@query("SELECT project_id, kind, normalized_value, arg_min(value, artifact_id * 1000000 + start) AS value, count(*) AS mentions, count(DISTINCT artifact_id) AS artifacts FROM mentions GROUP BY 1, 2, 3")
def entities(c):
    return extract.entities(c.mentions())


@query("SELECT value, normalized_value FROM m2 WHERE kind = 'cost'")
def normalize_cost(c):
    return c.mentions().where("kind = 'cost'").select("value", T.normalize_cost(F.col("value")).alias("normalized_value"))


@query("SELECT artifact_id, kind, start FROM mentions m WHERE kind <> 'tool' AND NOT EXISTS (SELECT 1 FROM mentions t WHERE t.kind = 'tool' AND t.artifact_id = m.artifact_id AND m.start < t.\"end\" + 8 AND t.start < m.\"end\")")
def span_overlap(c):
    m = c.mentions().select("artifact_id", "kind", F.col("start").cast("long").alias("start"), "end")
    return extract.suppress_overlaps(m.where("kind <> 'tool'"), m.where("kind = 'tool'").withColumn("end", F.col("end") + 8)).drop("end")


@query(f"""SELECT artifact_id, ordinal, text, len(string_split(text, ' ')) AS token_count FROM (SELECT artifact_id, i AS ordinal, array_to_string(w[i * 340 + 1:i * 340 + 400], ' ') AS text FROM (
  SELECT artifact_id, w, unnest(range(0, CAST(ceil(greatest(0, len(w) - 400) / 340.0) AS BIGINT) + 1)) AS i FROM (SELECT artifact_id, string_split({squeeze("raw_text")}, ' ') AS w FROM artifacts)))""")
def chunks(c):
    return embed.chunks(c.content).drop("project_id")


@query("SELECT artifact_id, text AS label FROM (SELECT artifact_id, label AS text FROM headings UNION ALL SELECT artifact_id, original_filename FROM artifacts WHERE k % 3 = 0)")
def structure_labels(c):
    none = F.lit(None).cast("array<string>")
    sheets = F.when(F.col("k") % 3 == 0, F.array("original_filename", F.lit(None).cast("string")))
    return c.artifacts.select("artifact_id", F.explode(T.structure_labels(F.col("headings"), sheets, none)).alias("label"))


@query(f"SELECT a.artifact_id, concat(original_filename, CASE WHEN h.label IS NOT NULL THEN concat(' | headings: ', h.label) ELSE '' END, CASE WHEN {squeeze('raw_text')} <> '' THEN concat(' | \"', substring({squeeze('raw_text')}, 1, 200), '\"') ELSE '' END) AS line FROM artifacts a LEFT JOIN headings h USING (artifact_id)")
def signal_line(c):
    return c.artifacts.select("artifact_id", T.signal_line(F.col("original_filename"), F.col("headings"), F.col("raw_text")).alias("line"))


@query(f"""SELECT a.artifact_id, concat(original_filename, CASE WHEN c.ts IS NOT NULL THEN concat(' | date: ', strftime(c.ts, '%Y-%m-%d')) ELSE '' END, CASE WHEN h.label IS NOT NULL THEN concat(' | headings: ', h.label) ELSE '' END, CASE WHEN e.named IS NOT NULL THEN concat(' | entities: ', e.named) ELSE '' END,
  CASE WHEN {squeeze('raw_text')} <> '' THEN concat(' | "', substring({squeeze('raw_text')}, 1, 200), '"') ELSE '' END) AS line FROM artifacts a LEFT JOIN headings h USING (artifact_id) LEFT JOIN chosen c ON c.artifact_id = a.artifact_id LEFT JOIN (SELECT artifact_id, string_agg(normalized_value, ', ' ORDER BY rank) AS named FROM top_own GROUP BY 1) e ON e.artifact_id = a.artifact_id""")
def signal_line_dated(c):
    top = view.top_entities(c.mentions()).groupBy("artifact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "normalized_value"))), lambda s: s["normalized_value"]).alias("named"))
    rows = c.artifacts.join(c.chosen().select("artifact_id", "ts").hint("merge"), "artifact_id", "left").join(top.hint("merge"), "artifact_id", "left")
    return rows.select("artifact_id", T.signal_line(F.col("original_filename"), F.col("headings"), F.col("raw_text"), day=F.col("ts"), entities=F.col("named")).alias("line"))


@query("SELECT artifact_id, phase_id, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM assignments")
def confidence_band(c):
    return c.relation("assignments").select("artifact_id", "phase_id", T.confidence_band(F.col("confidence")).alias("band"))


@query("SELECT artifact_id, name FROM names")
def clean_name(c):
    return c.names()


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def slugify(c):
    return c.table("documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query("SELECT artifact_id, suggested_name FROM views")
def suggested_name(c):
    return c.view().select("artifact_id", "suggested_name")


@query("SELECT artifact_id, virtual_path FROM views")
def virtual_path(c):
    return c.view().select("artifact_id", "virtual_path")


@query("SELECT artifact_id, start, \"end\" FROM merged")
def merge_spans(c):
    from ..functions.vocabulary import PROMISES

    found = F.concat(*[T.find_spans(F.col("raw_text"), "(?i)" + p) for p in PROMISES])
    spans = c.content.select("artifact_id", F.explode(found).alias("s")).select("artifact_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))
    return gaps.merge_spans(spans, ["artifact_id"])


@query("SELECT a.vec_id, round({} / (sqrt({}) * sqrt({})), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1".format(dot("a.embedding", "b.embedding"), dot("a.embedding", "a.embedding"), dot("b.embedding", "b.embedding")))
def cosine(c):
    e = c.table("embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", r6(V.cosine(F.col("embedding"), F.col("other")), "cosine"))


@query(f"SELECT label, i - 1 AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2)")
def mean_pool(c):
    return V.mean_pool(c.table("embeddings"), ["label"], "embedding").select("label", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("SELECT event_id, round(greatest(0.0, least(1.0, 1 - (epoch_us(m) - epoch_us(ts)) / 86400e6 / 90)), 6) AS decay FROM events_table, (SELECT max(ts) AS m FROM events_table)".replace("events_table", "main.events"))
def recency_decay(c):
    e = c.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.agg(F.max("ts").alias("m"))
    return e.join(F.broadcast(last)).select("event_id", r6(D.recency_decay(F.col("ts"), F.col("m")), "decay"))


# dates


@query("SELECT artifact_id, ts, confidence, evidence FROM meta")
def doc_meta_dates(c):
    return extract.doc_meta_dates(c.relation("metadata")).select("artifact_id", "ts", "confidence", "evidence")


@query("SELECT m.artifact_id, m.key, meta.ts FROM metadata m LEFT JOIN meta ON meta.artifact_id = m.artifact_id AND meta.evidence = concat(m.key, '=', m.value)")
def meta_timestamp(c):
    return c.relation("metadata").select("artifact_id", "key", D.meta_timestamp(F.col("value")).alias("ts"))


@query("SELECT artifact_id, ts, confidence, evidence FROM content_kept")
def content_dates(c):
    known = extract.fs_dates(c.artifacts).unionByName(extract.doc_meta_dates(c.relation("metadata")))
    return extract.content_dates(c.content, extract.date_anchor(known)).select("artifact_id", "ts", "confidence", "evidence")


@query("SELECT artifact_id, ts, source, confidence, evidence FROM resolved")
def date_candidates(c):
    return c.dates().select("artifact_id", "ts", "source", "confidence", "evidence")


@query("SELECT artifact_id, ts, source, evidence FROM anchors")
def date_anchor(c):
    known = extract.fs_dates(c.artifacts).unionByName(extract.doc_meta_dates(c.relation("metadata")))
    return extract.date_anchor(known).select("artifact_id", "ts", "source", "evidence")


@query("SELECT artifact_id, ts, source, confidence FROM chosen")
def chosen_date(c):
    return c.chosen().select("artifact_id", "ts", "source", "confidence")


@query("SELECT artifact_id, ts, source, evidence, is_chosen FROM resolved")
def resolved_dates(c):
    return c.dates().select("artifact_id", "ts", "source", "evidence", "is_chosen")


# timeline and joins


@query("SELECT project_id, artifact_id, event_date, source, description, confidence FROM events")
def timeline(c):
    return c.events()


@query("SELECT e.artifact_id, event_date, source, n.name FROM events e JOIN names n USING (artifact_id) WHERE project_id = 3 ORDER BY event_date, e.artifact_id, source, description LIMIT 50 OFFSET 10")
def timeline_page(c):
    rows = c.events().where("project_id = 3").join(c.names(), "artifact_id")
    return serve.page(rows, ["event_date", "artifact_id", "source", "description"], 50, 10).select("artifact_id", "event_date", "source", "name")


@query("SELECT project_id, earliest, latest, days FROM span")
def timeline_span(c):
    return report.timeline_span(c.events())


@query("SELECT project_id, rn AS rank, r.artifact_id, concat('- ', strftime(event_date, '%Y-%m-%d'), ' — ', name, ' (confidence ', printf('%.2f', confidence), ')') AS line FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY event_date DESC, artifact_id) AS rn FROM events WHERE source LIKE 'placement:%') r JOIN names n USING (artifact_id) WHERE rn <= 10")
def recent_activity(c):
    return report.recent_activity(c.events(), c.names())


@query("SELECT a.artifact_id, a.original_filename, c.ts, h.label AS heading FROM artifacts a LEFT JOIN chosen c ON c.artifact_id = a.artifact_id AND c.source = 'content' LEFT JOIN headings h ON h.artifact_id = a.artifact_id")
def artifact_base(c):
    said = c.chosen().where("source = 'content'").select("artifact_id", "ts")
    return c.artifacts.join(said, "artifact_id", "left").select("artifact_id", "original_filename", "ts", F.get("headings", F.lit(0)).alias("heading"))


@query("SELECT a.artifact_id, a.project_id FROM artifacts a JOIN projects p USING (project_id) WHERE owner_id = 1")
def owner_scope(c):
    return serve.owned(c.relation("projects"), c.artifacts.select("artifact_id", "project_id"), 1)


@query("SELECT project_id, name, place FROM (SELECT *, row_number() OVER (ORDER BY name, project_id) AS place FROM projects WHERE owner_id = 1)")
def project_list(c):
    return serve.project_list(c.relation("projects"), 1).select("project_id", "name", F.col("place").cast("long").alias("place"))


@query("""SELECT 'browse' AS listing, count(*) AS total FROM artifacts a JOIN labels l USING (artifact_id) WHERE l.label = 'current' AND a.artifact_id IN (SELECT artifact_id FROM assignments WHERE phase_id = 1)
  UNION ALL SELECT 'timeline', count(*) FROM events WHERE project_id = 3 UNION ALL SELECT 'gaps', count(*) FROM (SELECT *, CASE WHEN project_id % 3 = 0 THEN 'dismissed' ELSE 'open' END AS status FROM drafts) WHERE status = 'open'""")
def page_totals(c):
    listed = serve.browsed(c.artifacts.select("artifact_id"), c.labels(), c.relation("assignments"), phase_id=1, label="current")  # a total needs no columns
    listings = {"browse": listed, "timeline": c.events().where("project_id = 3"), "gaps": c.open_gaps().where("status = 'open'")}
    totals = [serve.page_total(rows).select(F.lit(name).alias("listing"), "total") for name, rows in listings.items()]
    return totals[0].unionByName(totals[1]).unionByName(totals[2])


BROWSE = """SELECT a.artifact_id, a.original_filename, c.ts, l.label, coalesce(p.phases, '') AS phases FROM artifacts a LEFT JOIN chosen c USING (artifact_id) LEFT JOIN labels l USING (artifact_id)
  LEFT JOIN (SELECT artifact_id, string_agg(DISTINCT phase_name, ', ' ORDER BY phase_name) AS phases FROM assignments JOIN phases USING (phase_id) GROUP BY 1) p USING (artifact_id)"""


def _browse(c, **filters):
    rows = serve.browse(c.artifacts, c.chosen(), c.labels(), c.relation("assignments"), c.relation("phases"), **filters)
    return rows.select("artifact_id", "original_filename", "ts", "label", "phases", "ingested_at")


@query(BROWSE + " WHERE l.label = 'current' AND a.artifact_id IN (SELECT artifact_id FROM assignments WHERE phase_id = 1)")
def browse_filtered(c):
    return _browse(c, phase_id=1, label="current").drop("ingested_at")


@query(BROWSE + " ORDER BY ingested_at, a.artifact_id LIMIT 50 OFFSET 20")
def browse_page(c):
    return serve.page(_browse(c), ["ingested_at", "artifact_id"], 50, 20).drop("ingested_at")


@query("""SELECT a.artifact_id, coalesce(e.entities, '') AS entities, coalesce(d.dates, '') AS dates, coalesce(x.edges, '') AS edges FROM artifacts a
  LEFT JOIN (SELECT artifact_id, string_agg(DISTINCT concat(kind, ':', normalized_value), '; ' ORDER BY concat(kind, ':', normalized_value)) AS entities FROM mentions GROUP BY 1) e USING (artifact_id)
  LEFT JOIN (SELECT artifact_id, string_agg(source, ', ' ORDER BY confidence DESC, ordinal, source) AS dates FROM resolved GROUP BY 1) d USING (artifact_id)
  LEFT JOIN (SELECT id, string_agg(e, '; ' ORDER BY e) AS edges FROM (SELECT src AS id, concat('outgoing ', edge_type, ' ', dst) AS e FROM edges UNION ALL SELECT dst, concat('incoming ', edge_type, ' ', src) FROM edges) GROUP BY 1) x ON x.id = a.artifact_id""")
def artifact_detail(c):
    return serve.detail(c.artifacts, c.mentions(), c.dates(), graph.both_ways(c.edges()))


# phases


@query("SELECT p.project_id, t.phase_id, t.ordinal, t.phase_name FROM projects p JOIN templates t ON t.domain = CASE WHEN p.project_id % 4 = 3 THEN 'engineering' ELSE 'research' END")
def phase_templates(c):
    domains = c.relation("projects").select("project_id", F.when(F.col("project_id") % 4 == 3, "engineering").otherwise("research").alias("template_domain"))
    return phases.project_phases(domains, phases.phase_templates(c.spark)).drop("domain")


@query("SELECT DISTINCT domain FROM classification WHERE domain <> 'generic'")
def candidate_domains(c):
    return phases.candidate_domains(c.relation("classification"))


@query("SELECT project_id, template_domain FROM domains")
def template_domain(c):
    return phases.template_domain(c.relation("classification"), phases.phase_templates(c.spark))


@query("SELECT project_id, phase_id, phase_name, artifacts FROM coverage")
def phase_coverage(c):
    return c.coverage()


@query("SELECT a.project_id, a.artifact_id, n.name, p.phase_name, CAST(a.confidence AS DOUBLE) AS confidence, a.source FROM assignments a JOIN phases p USING (phase_id) JOIN names n ON n.artifact_id = a.artifact_id WHERE a.project_id = 3 ORDER BY a.confidence DESC, a.artifact_id, p.phase_name LIMIT 50 OFFSET 5")
def phase_page(c):
    """A page of a project's assignments, the surest first."""
    rows = c.relation("assignments").where("project_id = 3").withColumn("confidence", F.col("confidence").cast("double"))
    return phases.assignments_page(rows, c.relation("phases"), c.names(), 50, 5)


@query("SELECT artifact_id, category FROM categories")
def choose_category(c):
    return c.categories()


@query("""SELECT artifact_id, phase_id, confidence, source FROM assignments WHERE source = 'human' UNION ALL
  SELECT artifact_id, phase_id, 0.75, 'auto' FROM (SELECT artifact_id, CAST((k + 1) % 3 AS INT) AS phase_id FROM artifacts WHERE k % 2 = 1) n WHERE NOT EXISTS (SELECT 1 FROM assignments h WHERE h.source = 'human' AND h.artifact_id = n.artifact_id AND h.phase_id = n.phase_id)""")
def phase_assignments_merge(c):
    proposed = c.artifacts.where("k % 2 = 1").select("artifact_id", ((F.col("k") + 1) % 3).cast("int").alias("phase_id"), F.lit(0.75).alias("confidence"))
    existing = c.relation("assignments").withColumn("confidence", F.col("confidence").cast("double"))
    return phases.merge_assignments(existing, proposed)


@query("SELECT project_id, rn AS rank, kind, normalized_value, n FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, kind, normalized_value) AS rn FROM (SELECT project_id, kind, normalized_value, count(*) AS n FROM mentions GROUP BY ALL)) WHERE rn <= 20")
def top_entities_project(c):
    from pyspark.sql import Window as W

    e = extract.entities(c.mentions()).select("project_id", "kind", "normalized_value", F.col("mentions").alias("n"))
    rank = F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("n"), "kind", "normalized_value"))
    return e.withColumn("rank", rank).where("rank <= 20")


@query("SELECT artifact_id, rank, kind, normalized_value, n FROM top_own")
def top_entities_artifact(c):
    return view.top_entities(c.mentions())


LINE = f"concat(original_filename, CASE WHEN label IS NOT NULL THEN concat(' | headings: ', label) ELSE '' END, CASE WHEN {squeeze('raw_text')} <> '' THEN concat(' | \"', substring({squeeze('raw_text')}, 1, 200), '\"') ELSE '' END)"


@query(f"""SELECT project_id, concat(a, CASE WHEN e IS NULL THEN '' ELSE concat(chr(10), e) END) AS prompt FROM (SELECT project_id, string_agg(line, chr(10) ORDER BY rn) AS a FROM (SELECT a.project_id, {LINE} AS line, row_number() OVER (PARTITION BY a.project_id ORDER BY ingested_at, a.artifact_id) AS rn FROM artifacts a LEFT JOIN headings h USING (artifact_id)) WHERE rn <= 40 GROUP BY 1)
  LEFT JOIN (SELECT project_id, string_agg(concat(kind, ': ', normalized_value, ' (', n, 'x)'), chr(10) ORDER BY rn) AS e FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, kind, normalized_value) AS rn FROM (SELECT project_id, kind, normalized_value, count(*) AS n FROM mentions GROUP BY ALL)) WHERE rn <= 20 GROUP BY 1) USING (project_id)""")
def domain_prompt_inputs(c):
    return phases.domain_inputs(c.artifacts, extract.entities(c.mentions()))


@query("SELECT artifact_id, CAST(floor((rn - 1) / 5) AS INT) AS batch, CAST((rn - 1) % 5 AS INT) AS batch_index FROM (SELECT artifact_id, row_number() OVER (PARTITION BY project_id ORDER BY ingested_at, artifact_id) AS rn FROM artifacts)")
def judge_batches(c):
    return phases.batches(c.artifacts.select("project_id", "artifact_id", "ingested_at"), 5, written).select("artifact_id", "batch", "batch_index")


def _replies(c):
    """Replies as a model might give them: a list, fenced, in prose, with entries that must be dropped."""
    first = F.concat(F.lit('[{"index": 0, "phase": "analysis ", "confidence": '), ((F.col("k") % 5) / 2).cast("string"), F.lit('}, {"index": 9, "phase": "Analysis", "confidence": 0.5}, {"index": 1, "phase": "Unknown", "confidence": 0.5}]'))
    reply = F.when(F.col("k") % 3 == 0, first).when(F.col("k") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), first, F.lit("\n```"))).when(F.col("k") % 2 == 0, 'Well: {"a": "} {\\" ]", "b": [1]} or {"c": 2}').otherwise("I can't say.")
    return c.artifacts.select("project_id", F.col("k").alias("batch"), reply.alias("response"))


@query("SELECT project_id, k AS batch, 0 AS batch_index, 'Analysis' AS phase_name, greatest(0.0, least(1.0, (k % 5) / 2.0)) AS confidence FROM artifacts WHERE k % 3 <> 2")
def judge_parse(c):
    return judge.parse_assignments(_replies(c), c.relation("phases"))


@query("""SELECT project_id, k AS batch, CASE WHEN k % 3 <> 2 THEN concat('[{"index": 0, "phase": "analysis ", "confidence": ', printf('%.1f', (k % 5) / 2.0), '}, {"index": 9, "phase": "Analysis", "confidence": 0.5}, {"index": 1, "phase": "Unknown", "confidence": 0.5}]')
  WHEN k % 2 = 0 THEN '{"a": "} {\\" ]", "b": [1]}' END AS json FROM artifacts""")
def extract_json(c):
    return _replies(c).select("project_id", "batch", T.extract_json(F.col("response")).alias("json"))


@query("""SELECT project_id, batch, least(1.0, 0.1 * n) AS confidence, CASE WHEN n >= 3 THEN 'research' ELSE 'generic' END AS domain FROM (
  SELECT project_id, CAST(floor((rn - 1) / 5) AS INT) AS batch, count(*) AS n FROM (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY ingested_at, artifact_id) AS rn FROM artifacts) GROUP BY 1, 2)""")
def judge_surface(c):
    """Batches of artifacts through a stand-in for a model, a function on the batches of a task, and its replies parsed."""

    def model(frames):
        for frame in frames:
            named = ["research" if n >= 3 else "cooking" for n in frame["n"]]
            frame["response"] = [f'Sure: {{"domain": "{d}", "confidence": {0.1 * n:.1f}}}' for d, n in zip(named, frame["n"])]
            yield frame

    asked = phases.batches(c.artifacts.select("project_id", "artifact_id", "ingested_at"), 5, written).groupBy("project_id", "batch").agg(F.count("*").alias("n"))
    replies = judge.judge(asked, model)
    parsed = judge.parse_domains(replies.select(F.struct("project_id", "batch", "n").alias("project_id"), "response"), phases.phase_templates(c.spark).select("domain"))
    return parsed.select("project_id.project_id", "project_id.batch", F.round(F.least(F.lit(1.0), F.col("project_id.n") * 0.1), 6).alias("confidence"), "domain")


@query("SELECT artifact_id, CASE WHEN k % 4 IN (0, 1) THEN 'research' ELSE 'generic' END AS domain, CASE WHEN k % 4 = 0 THEN least(1.0, k % 10 * 0.2) WHEN k % 4 = 1 THEN 0.5 ELSE 0.0 END AS confidence FROM artifacts")
def judge_domain(c):
    k = F.col("k")
    reply = F.when(k % 4 == 0, F.concat(F.lit('{"domain": "research", "confidence": '), F.format_string("%.1f", k % 10 * 0.2), F.lit("}"))).when(k % 4 == 1, 'Here: {"domain": "research", "confidence": 0.5, "rationale": "{x"} ok').when(k % 4 == 2, '{"domain": "cooking", "confidence": 0.9}').otherwise('{"domain": "research"}')
    given = c.artifacts.select(F.col("artifact_id").alias("project_id"), reply.alias("response"))
    return judge.parse_domains(given, phases.phase_templates(c.spark).select("domain")).withColumnRenamed("project_id", "artifact_id")


@query("SELECT artifact_id, 0 AS batch_index, k % 2 = 0 AS fulfilled, least(1.0, k % 5 * 0.4) AS confidence FROM artifacts WHERE k % 3 <> 2 UNION ALL SELECT artifact_id, 2, true, 0.25 FROM artifacts WHERE k % 3 = 0")
def judge_promises(c):
    k = F.col("k")
    one = F.concat(F.lit('{"candidate_index": 0, "fulfilled": '), F.when(k % 2 == 0, "true").otherwise("false"), F.lit(', "confidence": '), F.format_string("%.1f", k % 5 * 0.4), F.lit("}"))
    more = F.lit(', {"candidate_index": 2, "fulfilled": true, "confidence": 0.25}, {"candidate_index": 8, "fulfilled": true, "confidence": 1}, {"candidate_index": 3, "fulfilled": true}, {"candidate_index": 4, "confidence": 0.3}')
    reply = F.when(k % 3 == 0, F.concat(F.lit('{"judgments": ['), one, more, F.lit("]}"))).when(k % 3 == 1, F.concat(F.lit('```json\n{"judgments": ['), one, F.lit("]}\n```"))).otherwise('{"judgments": "none"}')
    return judge.parse_promises(c.artifacts.select("artifact_id", reply.alias("response")))


@query("SELECT artifact_id, 1 AS batch_index, concat('note-', k) AS slug FROM artifacts WHERE k % 2 = 0")
def judge_names(c):
    reply = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"names": [{"artifact_index": 1, "slug": " Note '), F.col("k").cast("string"), F.lit('!"}, {"artifact_index": 0, "slug": "a"}, {"artifact_index": 7, "slug": "seven"}]}'))).otherwise("no names")
    return judge.parse_names(c.artifacts.select("artifact_id", reply.alias("response")))


@query("""SELECT p.project_id, p.description, p.evidence, CASE WHEN l.artifact_id IS NULL THEN 0.55 WHEN v.sure IS NULL THEN 0.35 ELSE least(0.65, v.sure) END AS confidence
  FROM promised p LEFT JOIN (SELECT DISTINCT artifact_id FROM later) l ON CAST(l.artifact_id AS VARCHAR) = p.evidence
  LEFT JOIN (SELECT CAST(artifact_id AS VARCHAR) AS id, k % 3 = 0 AS done, k % 4 * 0.25 AS sure FROM artifacts WHERE k % 5 <> 4) v ON v.id = p.evidence WHERE l.artifact_id IS NULL OR v.done IS NULL OR NOT v.done""")
def promised_gaps_judged(c):
    verdicts = c.promises().select("artifact_id", "start").join(c.artifacts.where("k % 5 <> 4").select("artifact_id", "k").hint("merge"), "artifact_id")
    verdicts = verdicts.select("artifact_id", "start", (F.col("k") % 3 == 0).alias("fulfilled"), (F.col("k") % 4 * 0.25).alias("confidence"))
    return gaps.promised_gaps(c.promises(), c.content, c.artifacts, c.chosen(), verdicts).select("project_id", "description", "evidence", "confidence")


# graph


@query("SELECT project_id, key, dst, kind FROM match_keys")
def match_keys(c):
    return c.keys()


@query("SELECT src, dst, kind, confidence, start, evidence FROM refs")
def reference_scan(c):
    return c.refs().drop("project_id").withColumn("start", F.col("start").cast("long"))


@query("SELECT src, dst, edge_type, confidence FROM oriented")
def reference_edges(c):
    return graph.orient(c.refs(), c.chosen()).select("src", "dst", "edge_type", "confidence")


@query("SELECT src, dst, evidence FROM chain")
def entity_chain(c):
    return graph.entity_chain(c.mentions(), c.chosen()).select("src", "dst", "evidence")


@query("SELECT src, dst, edge_type, confidence FROM edges", name="best_edge")
def best_edge(c):
    return c.edges().select("src", "dst", "edge_type", "confidence")


@query("SELECT project_id, src, dst, edge_type, confidence, evidence FROM edges")
def relationship_edges(c):
    return c.edges()


@query("SELECT dst, array_to_string(list_sort(list(DISTINCT src)), ',') AS sources FROM edges GROUP BY 1")
def incoming_refs(c):
    return graph.incoming(c.edges()).select("dst", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query("SELECT src AS artifact_id, dst AS other_id, 'outgoing' AS direction, edge_type, confidence FROM edges UNION ALL SELECT dst, src, 'incoming', edge_type, confidence FROM edges")
def edges_both_ways(c):
    return graph.both_ways(c.edges())


# embeddings and direction


@query(f"SELECT artifact_id, i AS ordinal, 'hash' AS model, 'hash' AS model_version, 64 AS dim, 1.0 AS norm FROM (SELECT artifact_id, unnest(range(0, CAST(ceil(greatest(0, len(w) - 400) / 340.0) AS BIGINT) + 1)) AS i FROM (SELECT artifact_id, string_split({squeeze('raw_text')}, ' ') AS w FROM artifacts))")
def chunk_embeddings(c):
    made = embed.embed_texts(embed.chunks(c.content))
    return made.select("artifact_id", F.col("ordinal").cast("long").alias("ordinal"), "model", "model_version", "dim", F.round(V.norm(F.col("vector")), 3).alias("norm"))


def _clusters(c):
    return cluster.density_clusters(c.relation("vectors").drop("cluster_id"), written, least=0.2, min_points=3)


@query(f"""SELECT v.artifact_id, v.project_id, CAST(coalesce(CASE WHEN b.artifact_id IS NOT NULL THEN (SELECT min(r.b) FROM reach r WHERE r.a = v.artifact_id) ELSE (SELECT min(r.b) FROM reach r WHERE r.a = (SELECT min(n.b) FROM close_pairs n JOIN cores k ON k.artifact_id = n.b WHERE n.a = v.artifact_id)) END, -1) AS BIGINT) AS cluster_id
  FROM vectors v LEFT JOIN cores b ON b.artifact_id = v.artifact_id""", recursive=f"""
  close_pairs AS (SELECT x.artifact_id AS a, y.artifact_id AS b FROM vectors x JOIN vectors y ON x.project_id = y.project_id AND x.artifact_id <> y.artifact_id WHERE {dot('x.vector', 'y.vector')} / sqrt({dot('x.vector', 'x.vector')}) / sqrt({dot('y.vector', 'y.vector')}) >= 0.2),
  cores AS (SELECT a AS artifact_id FROM close_pairs GROUP BY 1 HAVING count(*) >= 2),
  reach AS (SELECT artifact_id AS a, artifact_id AS b FROM cores UNION SELECT r.a, p.b FROM reach r JOIN close_pairs p ON p.a = r.b JOIN cores k ON k.artifact_id = p.b)""")
def density_clusters(c):
    return _clusters(c)


@query()
def hierarchical_clusters(c):
    """No SQL expresses the choice of stable clusters; tests hold it against a plain version."""
    return c.clusters()


@query()
def direction_clustered(c):
    """Labels by the clusters that the vectors themselves form."""
    vectors = written(c.vectors().drop("cluster_id").join(c.clusters().drop("project_id").hint("merge"), "artifact_id"))  # read five times
    made = direction.direction_labels(vectors, c.chosen(), c.edges(), c.confirmed())
    return made.select("artifact_id", "label", r6(F.col("confidence"), "confidence"), "confirmed")


def _pooling(c):
    v = c.relation("vectors").select("artifact_id", "vector")
    both = v.unionByName(v.select("artifact_id", F.reverse("vector").alias("vector")))
    return embed.doc_embeddings(c.content, both, v, most=300)


@query(f"""SELECT artifact_id, i - 1 AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY artifact_id)), 6) AS x FROM (
  SELECT v.artifact_id, unnest(range(1, len(vector) + 1)) AS i, unnest(CASE WHEN len(string_split({squeeze("raw_text")}, ' ')) <= 300 THEN CAST(vector AS DOUBLE[]) ELSE list_transform(list_zip(CAST(vector AS DOUBLE[]), list_reverse(CAST(vector AS DOUBLE[]))), lambda z: (z[1] + z[2]) / 2) END) AS x
  FROM vectors v JOIN artifacts a USING (artifact_id))""")
def doc_pooling(c):
    return _pooling(c).select("artifact_id", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("SELECT project_id, cluster_id, members, last_active, recent FROM profile")
def cluster_profile(c):
    return direction.cluster_profile(c.relation("vectors"), c.chosen()).drop("latest")


@query("SELECT project_id, i - 1 AS pos, round(x, 6) AS x FROM (SELECT project_id, unnest(centroid) AS x, unnest(range(1, len(centroid) + 1)) AS i FROM centroid)")
def direction_centroid(c):
    return direction.centroids(c.members()).select("project_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("SELECT artifact_id, round(signal_a, 6) AS signal_a FROM sig_a")
def signal_a(c):
    m = c.members()
    return direction.signal_a(m, direction.centroids(m)).select("artifact_id", r6(F.col("signal_a"), "signal_a"))


@query("SELECT artifact_id, round(signal_a, 6) AS signal_a FROM sig_small")
def signal_a_small(c):
    return direction.signal_a_small(c.relation("vectors"), c.chosen()).select("artifact_id", r6(F.col("signal_a"), "signal_a"))


@query("SELECT artifact_id, round(signal_b, 6) AS signal_b, last_ref FROM sig_b")
def signal_b(c):
    return direction.signal_b(c.relation("vectors"), c.edges(), c.chosen()).select("artifact_id", r6(F.col("signal_b"), "signal_b"), "last_ref")


@query("SELECT artifact_id, label, round(confidence, 6) AS confidence, confirmed FROM labels")
def direction_labels(c):
    return c.labels().select("artifact_id", "label", r6(F.col("confidence"), "confidence"), "confirmed")


@query("SELECT artifact_id, project_id, rn FROM (SELECT l.artifact_id, l.project_id, row_number() OVER (PARTITION BY l.project_id ORDER BY ts DESC NULLS LAST, l.artifact_id) AS rn FROM labels l LEFT JOIN chosen c USING (artifact_id) WHERE label = 'current') WHERE rn <= 8")
def direction_inputs(c):
    return direction.direction_inputs(c.labels(), c.chosen()).select("artifact_id", "project_id", F.col("rn").cast("long").alias("rn"))


DIRECTION_SNAPSHOT = """SELECT p.project_id, CASE WHEN l.listed IS NULL THEN 'Not enough dated, recent activity to synthesize a direction summary.' ELSE concat('Current direction inferred from recent activity as of ', strftime(d.latest, '%Y-%m-%d'), ': ', l.listed) END AS summary
  FROM (SELECT DISTINCT project_id FROM vectors) p LEFT JOIN (SELECT project_id, string_agg(name, ', ' ORDER BY rn) AS listed FROM (SELECT m.project_id, n.name, row_number() OVER (PARTITION BY m.project_id ORDER BY ts DESC NULLS LAST, m.artifact_id) AS rn FROM member m JOIN names n USING (artifact_id) WHERE m.recent) WHERE rn <= 5 GROUP BY 1) l USING (project_id) LEFT JOIN last_date d ON d.project_id = p.project_id"""


@query(DIRECTION_SNAPSHOT)
def direction_snapshot(c):
    return direction.direction_snapshot(c.members(), c.chosen(), c.names())


@query("SELECT project_id, arg_max(snapshot_id, epoch_us(computed_at) * 1000 + snapshot_id // 20) AS snapshot_id, arg_max(summary, epoch_us(computed_at) * 1000 + snapshot_id // 20) AS summary, max(computed_at) AS computed_at FROM snapshots GROUP BY 1")
def latest_snapshot(c):
    return direction.latest_snapshot(c.relation("snapshots"))


@query("SELECT s.project_id, s.summary, coalesce(l.n, 0) AS labelled, coalesce(l.current, 0) AS current FROM (SELECT project_id, arg_max(summary, epoch_us(computed_at) * 1000 + snapshot_id // 20) AS summary FROM snapshots GROUP BY 1) s LEFT JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (label = 'current') AS current FROM labels GROUP BY 1) l USING (project_id)")
def direction_overview(c):
    counts = c.labels().groupBy("project_id").agg(F.count("*").alias("labelled"), F.count_if(F.col("label") == "current").alias("current"))
    return direction.latest_snapshot(c.relation("snapshots")).select("project_id", "summary").join(counts, "project_id", "left").na.fill(0, ["labelled", "current"])


@query("""SELECT l.project_id, s.summary, l.artifact_id, n.name, l.label, round(l.confidence, 6) AS confidence FROM labels l JOIN names n USING (artifact_id)
  LEFT JOIN (SELECT project_id, arg_max(summary, epoch_us(computed_at) * 1000 + snapshot_id // 20) AS summary FROM snapshots GROUP BY 1) s ON s.project_id = l.project_id
  WHERE l.project_id = 3 ORDER BY l.artifact_id DESC LIMIT 50 OFFSET 5""")
def direction_page(c):
    """A project's latest summary with a page of its labels, the newest artifacts first."""
    return direction.direction_page(c.labels().where("project_id = 3"), direction.latest_snapshot(c.relation("snapshots")), c.names(), 50, 5).withColumn("confidence", F.round("confidence", 6))


# gaps


@query("SELECT project_id, phase_id, description, evidence, confidence FROM structural")
def structural_gaps(c):
    return c.structural().drop("type")


@query("SELECT artifact_id, start, evidence FROM promises")
def promise_candidates(c):
    return c.promises().select("artifact_id", F.col("start").cast("long").alias("start"), "evidence")


@query("SELECT artifact_id, later_id, later_ts FROM later")
def later_artifacts(c):
    return gaps.later_artifacts(c.promises(), c.artifacts, c.chosen()).drop("project_id")


@query("SELECT artifact_id, count(*) AS n_later, min(later_ts) AS first_ts FROM later GROUP BY 1")
def later_range(c):
    return gaps.later_range(c.promises(), c.artifacts, c.chosen(), written)


@query(f"SELECT l.artifact_id, l.later_id, rn AS rank, substring({squeeze('raw_text')}, 1, 300) AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY later_ts, later_id) AS rn FROM later WHERE later_ts IS NOT NULL) l JOIN artifacts a ON a.artifact_id = l.later_id WHERE rn <= 5")
def later_excerpts(c):
    return gaps.later_excerpts(c.promises(), c.content, c.artifacts, c.chosen(), written)


@query("SELECT artifact_id, start, round(best, 6) AS best, fulfilled FROM fulfilled")
def fulfillment(c):
    return gaps.fulfillment(c.promises(), c.content, c.chosen()).select("artifact_id", F.col("start").cast("long").alias("start"), r6(F.col("best"), "best"), "fulfilled")


@query("SELECT project_id, description, evidence, confidence FROM promised")
def promised_gaps(c):
    return c.promised().select("project_id", "description", "evidence", "confidence")


@query("SELECT project_id, type, phase_id, description, confidence FROM drafts")
def gap_drafts(c):
    return c.structural().unionByName(c.promised()).drop("evidence")


GAP_KEY = f"CASE WHEN type = 'structural' THEN concat('structural:', phase_id) ELSE concat('promised:', lower({squeeze('description')})) END"


@query(f"""SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.gap_key, n.gap_key) AS gap_key, coalesce(o.status, 'open') AS status,
  CASE WHEN o.status IS NULL THEN 'insert' WHEN o.status <> 'open' THEN 'preserve' WHEN n.c IS NULL THEN 'delete' ELSE 'update' END AS action, CASE WHEN o.status <> 'open' THEN o.confidence ELSE coalesce(n.c, o.confidence) END AS confidence
  FROM old_gaps o FULL JOIN (SELECT project_id, {GAP_KEY} AS gap_key, max(confidence) AS c FROM drafts GROUP BY 1, 2) n ON o.project_id = n.project_id AND o.gap_key = n.gap_key""")
def gap_reconcile(c):
    old = c.relation("old_gaps").withColumn("confidence", F.col("confidence").cast("double"))
    return gaps.reconcile(c.structural().unionByName(c.promised()), old)


@query(f"SELECT project_id, type, phase_name, description, confidence, row_number() OVER (PARTITION BY project_id ORDER BY confidence DESC, description) AS place FROM {OPEN_GAPS} LEFT JOIN phases USING (phase_id) WHERE status = 'open'")
def gaps_list(c):
    return gaps.list_gaps(c.open_gaps(), c.relation("phases"), status="open").select("project_id", "type", "phase_name", "description", "confidence", F.col("place").cast("long").alias("place"))


# view and report


@query("SELECT artifact_id, suggested_name, category, virtual_path FROM views")
def view_projection(c):
    return c.view().drop("project_id")


@query("""SELECT artifact_id, category, suggested_name, concat(category, '/', coalesce(strftime(ts, '%Y-%m'), 'undated'), '/', suggested_name) AS virtual_path FROM (
  SELECT s.artifact_id, s.category, s.ts, CASE WHEN k % 3 = 1 THEN concat(coalesce(strftime(s.ts, '%Y-%m-%d') || '_', ''), 'note-', k, '.txt') ELSE v.suggested_name END AS suggested_name
  FROM slugs s JOIN views v USING (artifact_id) JOIN artifacts a ON a.artifact_id = s.artifact_id)""")
def view_judged(c):
    """Names from replies of a model for a third of the artifacts; for another third its slug is too short to be used."""
    reply = F.when(F.col("k") % 3 == 1, F.concat(F.lit('{"names": [{"artifact_index": 0, "slug": "Note '), F.col("k").cast("string"), F.lit('!"}]}'))).when(F.col("k") % 3 == 2, '{"names": [{"artifact_index": 0, "slug": "a"}]}').otherwise("none")
    slugs = judge.parse_names(c.artifacts.select("artifact_id", reply.alias("response"))).select("artifact_id", "slug")
    return view.view_projection(c.artifacts, c.chosen(), c.categories(), view.top_entities(c.mentions()), slugs).drop("project_id")


@query("SELECT v.artifact_id, v.version + 1 AS version, concat('kept-', v.artifact_id, '.txt') AS suggested_name, concat(category, '/', coalesce(strftime(ts, '%Y-%m'), 'undated'), '/kept-', v.artifact_id, '.txt') AS virtual_path, 'human' AS source FROM current_versions v LEFT JOIN chosen c USING (artifact_id) WHERE v.artifact_id % 9 = 2")
def name_override(c):
    named = c.artifacts.where("artifact_id % 9 = 2").select("artifact_id", F.concat(F.lit("kept-"), F.col("artifact_id").cast("string"), F.lit(".txt")).alias("name"))
    return view.override_names(c.versions(), named, c.chosen()).drop("category")


@query("SELECT artifact_id, version, superseded_by FROM (SELECT *, lead(version_id) OVER (PARTITION BY artifact_id ORDER BY version) AS superseded_by FROM versions)")
def version_chain(c):
    return state.version_chain(c.relation("versions")).select("artifact_id", "version", "superseded_by")


@query("SELECT artifact_id, version, suggested_name FROM current_versions")
def current_projection(c):
    return c.versions().select("artifact_id", "version", "suggested_name")


OVERVIEW = """SELECT p.project_id, concat(CASE WHEN c.domain IS NULL THEN '- **Domain:** not yet classified.' ELSE concat('- **Domain:** ', c.domain, ' (confidence ', printf('%.2f', CAST(c.confidence AS DOUBLE)), ')', CASE WHEN c.confirmed THEN ' (confirmed)' ELSE '' END) END, chr(10),
  CASE WHEN d.template_domain IS NULL THEN '- **Phase model:** not yet selected.' ELSE concat('- **Phase model:** ', d.template_domain, ' — ', m.model) END, chr(10), '- **Artifacts:** ', t.n, chr(10), '- **Timeline span:** ', strftime(s.earliest, '%Y-%m-%d'), ' to ', strftime(s.latest, '%Y-%m-%d'), ' (', s.days, ' days)') AS content
  FROM projects p LEFT JOIN classification c USING (project_id) LEFT JOIN domains d ON d.project_id = p.project_id LEFT JOIN (SELECT domain, string_agg(phase_name, ' → ' ORDER BY ordinal) AS model FROM templates GROUP BY 1) m ON m.domain = d.template_domain JOIN totals t ON t.project_id = p.project_id JOIN span s ON s.project_id = p.project_id"""


def _overview(c):
    known = phases.phase_templates(c.spark)
    classification = c.relation("classification").withColumn("confidence", F.col("confidence").cast("double"))
    domains = phases.template_domain(classification, known)
    return report.overview(c.projects(), classification, domains, phases.project_phases(domains, known), c.listed(), report.timeline_span(c.events()))


@query(OVERVIEW)
def report_overview(c):
    return _overview(c)


GAPS_SECTION = f"""SELECT project_id, concat_ws(chr(10) || chr(10), '**Structural:**' || chr(10) || string_agg(line, chr(10) ORDER BY confidence DESC, description) FILTER (type = 'structural'), '**Promised, unfulfilled:**' || chr(10) || string_agg(line, chr(10) ORDER BY confidence DESC, description) FILTER (type <> 'structural')) AS content
  FROM (SELECT *, concat('- ', description, ' (confidence ', printf('%.2f', CAST(confidence AS DOUBLE)), ')') AS line FROM {OPEN_GAPS} WHERE status = 'open') GROUP BY 1"""
STALE_SECTION = "SELECT project_id, string_agg(concat('- ', name, ' — superseded (confidence ', printf('%.2f', confidence), ')'), chr(10) ORDER BY confidence DESC, l.artifact_id) AS content FROM labels l JOIN names n USING (artifact_id) WHERE label = 'superseded' GROUP BY 1"


@query(STALE_SECTION)
def stale_artifacts(c):
    return report.stale_section(c.labels(), c.names())


SNAPSHOT = "(SELECT project_id, arg_max(summary, epoch_us(computed_at) * 1000 + snapshot_id // 20) AS summary FROM snapshots GROUP BY 1)"
DIRECTION_SECTION = f"""SELECT p.project_id, CASE WHEN s.summary IS NULL THEN 'Direction has not yet been inferred for this project.' WHEN l.listed IS NULL THEN s.summary ELSE concat(s.summary, chr(10), chr(10), 'Artifacts currently part of this direction:', chr(10), l.listed) END AS content
  FROM projects p LEFT JOIN {SNAPSHOT} s USING (project_id) LEFT JOIN (SELECT project_id, string_agg(concat('- ', name), chr(10) ORDER BY rn) AS listed FROM (SELECT l.project_id, l.artifact_id, row_number() OVER (PARTITION BY l.project_id ORDER BY ts DESC NULLS LAST, l.artifact_id) AS rn FROM labels l LEFT JOIN chosen c USING (artifact_id) WHERE label = 'current') JOIN names USING (artifact_id) WHERE rn <= 8 GROUP BY 1) l ON l.project_id = p.project_id"""
ACTIVITY_SECTION = """SELECT p.project_id, coalesce(a.content, 'No timeline activity recorded yet.') AS content FROM projects p LEFT JOIN (SELECT project_id, string_agg(concat('- ', strftime(event_date, '%Y-%m-%d'), ' — ', name, ' (confidence ', printf('%.2f', confidence), ')'), chr(10) ORDER BY rn) AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY event_date DESC, artifact_id) AS rn FROM events WHERE source LIKE 'placement:%') r JOIN names n USING (artifact_id) WHERE rn <= 10 GROUP BY 1) a USING (project_id)"""


def _snapshots(c):
    return direction.latest_snapshot(c.relation("snapshots"))


@query(DIRECTION_SECTION)
def report_direction(c):
    return report.direction_section(c.relation("projects"), _snapshots(c), direction.direction_inputs(c.labels(), c.chosen()), c.names())


@query("SELECT s.project_id, CASE WHEN p.summary IS NULL OR s.project_id % 3 <> 0 THEN s.content ELSE concat('Told of ', s.project_id) END AS content FROM (" + DIRECTION_SECTION + f") s LEFT JOIN {SNAPSHOT} p USING (project_id)")
def report_direction_told(c):
    reply = F.when(F.col("project_id") % 3 == 0, F.concat(F.lit('{"narrative": " Told of '), F.col("project_id").cast("string"), F.lit(' "}'))).otherwise('{"narrative": ""}')
    told = judge.parse_narrative(c.relation("projects").select("project_id", reply.alias("response")))
    return report.direction_section(c.relation("projects"), _snapshots(c), direction.direction_inputs(c.labels(), c.chosen()), c.names(), told)


@query(ACTIVITY_SECTION)
def report_activity(c):
    return report.activity_section(c.relation("projects"), report.recent_activity(c.events(), c.names()))


def _renderers(c):
    """What renders each section of the projects given."""
    of = lambda rows, only: rows.join(only.hint("merge"), "project_id", "left_semi")
    projects = lambda only: of(c.projects(), only)
    return {
        "overview": lambda only: of(_overview(c), only),
        "current_direction": lambda only: report.direction_section(projects(only), _snapshots(c), direction.direction_inputs(of(c.labels(), only), c.chosen()), c.names()),
        "recent_activity": lambda only: report.activity_section(projects(only), report.recent_activity(of(c.events(), only), c.names())),
        "open_gaps": lambda only: report.open_gaps_section(of(c.open_gaps(), only)),
        "stale_artifacts": lambda only: report.stale_section(of(c.labels(), only), c.names()),
    }


def _sections(c):
    """Each section is written by itself: one plan of all five is more than the driver should hold."""
    every = c.projects().select("project_id")
    parts = [written(render(every).select("project_id", F.lit(name).alias("section"), "content")) for name, render in _renderers(c).items()]
    return reduce(DataFrame.unionByName, parts)


SECTIONS_SQL = f"(SELECT *, 'overview' AS section FROM ({OVERVIEW}) UNION ALL SELECT *, 'current_direction' FROM ({DIRECTION_SECTION}) UNION ALL SELECT *, 'recent_activity' FROM ({ACTIVITY_SECTION}) UNION ALL SELECT *, 'open_gaps' FROM ({GAPS_SECTION}) UNION ALL SELECT *, 'stale_artifacts' FROM ({STALE_SECTION}))"


@query(f"SELECT project_id, section, content FROM {SECTIONS_SQL}")
def report_sections(c):
    return _sections(c)


def _section_prints(c):
    """project_id, section, fingerprint of what each section is made from, without rendering any."""
    cols = lambda *names: F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in names])
    dated = c.labels().join(c.chosen().select("artifact_id", "ts").hint("merge"), "artifact_id", "left")
    inputs = {
        "overview": c.events().select("project_id", cols("artifact_id", "event_date").alias("line")).unionByName(c.relation("classification").select("project_id", cols("domain", "confidence", "confirmed").alias("line"))),
        "current_direction": dated.where("label = 'current'").select("project_id", cols("artifact_id", "ts").alias("line")).unionByName(c.relation("snapshots").select("project_id", cols("snapshot_id", "summary").alias("line"))),
        "recent_activity": c.events().select("project_id", cols("artifact_id", "event_date", "source", "confidence").alias("line")),
        "open_gaps": c.open_gaps().select("project_id", cols("type", "description", "confidence", "status").alias("line")),
        "stale_artifacts": c.labels().where("label = 'superseded'").select("project_id", cols("artifact_id", "confidence").alias("line")),
    }
    parts = [state.fingerprint(rows, ["project_id"], F.col("line")).withColumn("section", F.lit(name)) for name, rows in inputs.items()]
    return written(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]))


@query(f"""SELECT n.project_id, n.section, CASE WHEN n.project_id % 4 = 1 THEN 'new' WHEN n.project_id % 4 = 2 THEN 'rendered' ELSE 'carried' END AS action, CASE WHEN n.project_id % 4 IN (1, 2) THEN n.content ELSE 'as it was' END AS content FROM {SECTIONS_SQL} n""")
def report_regen(c):
    prints = _section_prints(c)
    old = prints.where("project_id % 4 <> 1").withColumn("fingerprint", F.when(F.col("project_id") % 4 == 2, "other").otherwise(F.col("fingerprint"))).withColumn("content", F.lit("as it was"))
    shown = _sections(c).select("project_id", "section")  # a section without lines isn't there
    return report.regenerate(old, prints, _renderers(c), written).join(shown.hint("merge"), ["project_id", "section"], "left_semi")


_TITLES = ", ".join(f"({i}, '{name}', '{title}')" for i, (name, title) in enumerate(SECTIONS))


@query(f"""SELECT p.project_id, concat('# Project Report — ', p.name, chr(10), '_Version 1, generated 2024-07-01 00:00 UTC_', chr(10), chr(10), b.body, chr(10)) AS markdown
  FROM projects p JOIN (SELECT project_id, string_agg(concat('## ', title, chr(10), coalesce(content, 'No data.')), chr(10) || chr(10) ORDER BY nth) AS body FROM (SELECT p.project_id, t.nth, t.title, s.content FROM projects p CROSS JOIN (VALUES {_TITLES}) AS t(nth, section, title) LEFT JOIN {SECTIONS_SQL} s ON s.project_id = p.project_id AND s.section = t.section) GROUP BY 1) b USING (project_id)""")
def report_markdown(c):
    return report.compose(c.projects(), _sections(c), F.lit(1), F.lit("2024-07-01").cast("timestamp"))


@query(f"SELECT s.project_id, CAST(1 + s.project_id % 3 AS INT) AS version, s.section FROM {SECTIONS_SQL} s")
def current_report(c):
    kept = c.relation("projects").select("project_id", F.explode(F.sequence(F.lit(1), (1 + F.col("project_id") % 3).cast("int"))).alias("version"))
    return report.current_version(written(kept), _sections(c)).select("project_id", "version", "section")


# incremental processing


def _hashed(c):
    return c.artifacts.withColumn("input_hash", F.sha2("raw_text", 256))


@query("SELECT a.artifact_id FROM artifacts a WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.artifact_id = a.artifact_id AND stage = 'extract' AND status = 'done' AND input_hash = sha256(a.raw_text))")
def pending_artifacts(c):
    return state.pending(_hashed(c), c.relation("ledger"), "extract").select("artifact_id")


@query("SELECT artifact_id, sha256(concat_ws(':', sha256(raw_text), 'rules', 'v1')) AS extract_hash, sha256(concat_ws(':', sha256(raw_text), 'model', '400', '60')) AS embed_hash FROM artifacts")
def input_hashes(c):
    h = F.sha2("raw_text", 256)
    return c.artifacts.select("artifact_id", state.input_hash(h, F.lit("rules"), F.lit("v1")).alias("extract_hash"), state.input_hash(h, F.lit("model"), F.lit("400"), F.lit("60")).alias("embed_hash"))


PRINT = "SELECT project_id, sha256(concat('v1', chr(10), string_agg(h, chr(10) ORDER BY b))) AS fingerprint FROM (SELECT project_id, substr(md5(line), 1, 2) AS b, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM ({}) GROUP BY 1, 2) GROUP BY 1"


@query(PRINT.format("SELECT project_id, concat_ws('|', lpad(CAST(artifact_id AS VARCHAR), 9, '0'), strftime(ts, '%Y-%m-%d')) AS line FROM chosen"))
def corpus_fingerprint(c):
    line = F.concat_ws("|", F.lpad(F.col("artifact_id").cast("string"), 9, "0"), F.date_format("ts", "yyyy-MM-dd"))
    return state.fingerprint(c.chosen(), ["project_id"], line)


_INPUTS = {
    "timeline": "SELECT project_id, concat_ws('|', artifact_id, source, strftime(ts, '%Y-%m-%d'), evidence, is_chosen) AS line FROM resolved",
    "phases": "SELECT project_id, concat_ws('|', artifact_id, sha256(raw_text)) AS line FROM artifacts UNION ALL SELECT project_id, concat_ws('|', kind, normalized_value, count(*)) FROM mentions GROUP BY project_id, kind, normalized_value",
    "graph": "SELECT a.project_id, concat_ws('|', a.artifact_id, original_filename, h.label, strftime(c.ts, '%Y-%m-%d')) AS line FROM artifacts a LEFT JOIN headings h USING (artifact_id) LEFT JOIN chosen c ON c.artifact_id = a.artifact_id UNION ALL SELECT DISTINCT project_id, concat_ws('|', kind, normalized_value, artifact_id) FROM mentions WHERE kind IN ('experiment', 'hypothesis', 'citation')",
    "direction": "SELECT v.project_id, concat_ws('|', v.artifact_id, v.cluster_id, strftime(c.ts, '%Y-%m-%d')) AS line FROM vectors v LEFT JOIN chosen c USING (artifact_id) UNION ALL SELECT project_id, concat_ws('|', src, dst, edge_type) FROM edges",
    "gaps": "SELECT project_id, concat_ws('|', artifact_id, phase_id) AS line FROM assignments UNION ALL SELECT project_id, concat_ws('|', artifact_id, start, evidence) FROM promises UNION ALL SELECT project_id, concat_ws('|', artifact_id, strftime(ts, '%Y-%m-%d')) FROM chosen",
    "view": "SELECT a.project_id, concat_ws('|', a.artifact_id, original_filename, strftime(c.ts, '%Y-%m-%d'), g.category, t.normalized_value) AS line FROM artifacts a LEFT JOIN chosen c USING (artifact_id) LEFT JOIN categories g ON g.artifact_id = a.artifact_id LEFT JOIN top_own t ON t.artifact_id = a.artifact_id AND t.rank = 1",
}


@query(" UNION ALL ".join(f"SELECT *, '{name}' AS stage FROM ({PRINT.format(lines)})" for name, lines in _INPUTS.items()))
def stage_inputs(c):
    """project_id, stage, fingerprint of what each analysis stage reads; extract and embed have hashes by artifact."""
    line = lambda *parts: F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]).alias("line")
    day, col = F.date_format("ts", "yyyy-MM-dd"), F.col
    dates, mentions = c.chosen().select("artifact_id", "ts").hint("merge"), c.mentions()
    dated = c.artifacts.join(dates, "artifact_id", "left")
    first = view.top_entities(mentions).where("rank = 1").select("artifact_id", "normalized_value").hint("merge")
    rows = {
        "timeline": [c.dates().select("project_id", line("artifact_id", "source", day, "evidence", "is_chosen"))],
        "phases": [c.content.select("project_id", line("artifact_id", F.sha2("raw_text", 256))), extract.entities(mentions).select("project_id", line("kind", "normalized_value", "mentions"))],
        "graph": [dated.select("project_id", line("artifact_id", "original_filename", F.get("headings", F.lit(0)), day)), mentions.where(col("kind").isin("experiment", "hypothesis", "citation")).select("project_id", line("kind", "normalized_value", "artifact_id")).distinct()],
        "direction": [c.relation("vectors").join(dates, "artifact_id", "left").select("project_id", line("artifact_id", "cluster_id", day)), c.edges().select("project_id", line("src", "dst", "edge_type"))],
        "gaps": [c.relation("assignments").select("project_id", line("artifact_id", "phase_id")), c.promises().select("project_id", line("artifact_id", "start", "evidence")), c.chosen().select("project_id", line("artifact_id", day))],
        "view": [dated.join(c.categories().hint("merge"), "artifact_id", "left").join(first, "artifact_id", "left").select("project_id", line("artifact_id", "original_filename", day, "category", "normalized_value"))],
    }
    prints = [state.fingerprint(reduce(DataFrame.unionByName, parts), ["project_id"], col("line")).withColumn("stage", F.lit(name)) for name, parts in rows.items()]
    return reduce(DataFrame.unionByName, prints)


_SUMS = ", '|', ".join(f"CAST(sum(CAST(concat('0x', substr(h, {8 * i + 1}, 8)) AS BIGINT)) AS BIGINT)" for i in range(8))


@query(f"SELECT project_id, sha256(concat('v1|', count(*), '|', {_SUMS})) AS fingerprint FROM (SELECT project_id, sha256(concat_ws('|', artifact_id, strftime(ts, '%Y-%m-%d'))) AS h FROM chosen) GROUP BY 1")
def incremental_fingerprint(c):
    """Fingerprints of the chosen dates from those of an earlier state, in which every seventh artifact had another date and
    some weren't there, and the lines that changed; the rest of the table isn't read again."""
    line = F.concat_ws("|", F.col("artifact_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("line")
    now, key = c.chosen(), ["project_id"]
    changed, before = F.col("artifact_id") % 7 == 1, F.col("ts") - F.expr("interval 1 day")
    was = now.where("artifact_id % 11 <> 3").withColumn("ts", F.when(changed, before).otherwise(F.col("ts")))
    held = written(state.multiset(was, key, line))
    gone = state.multiset(was.where(changed), key, line, -1)
    new = state.multiset(now.where(changed | (F.col("artifact_id") % 11 == 3)), key, line)
    return state.multiset_fingerprint(state.merged_multisets([held, gone, new], key), key)


@query("SELECT project_id, bool_and(coalesce(l.input_hash = sha256(a.raw_text), false)) AS up_to_date FROM artifacts a LEFT JOIN (SELECT * FROM ledger WHERE stage = 'embed' AND status = 'done') l USING (artifact_id) GROUP BY 1")
def project_up_to_date(c):
    return state.up_to_date(_hashed(c), c.relation("ledger"), "embed")


@query("SELECT project_id, stage, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS error, greatest(0, any_value(n) - count(*)) AS pending FROM ledger JOIN artifacts USING (artifact_id) JOIN totals USING (project_id) GROUP BY 1, 2")
def stage_progress(c):
    return state.stage_progress(c.artifacts, c.relation("ledger"))


@query("""SELECT artifact_id, CASE WHEN bool_or(stage = 'parse' AND status = 'skipped') THEN 'unsupported' WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(stage = 'embed' AND status = 'done') THEN 'embedded'
  WHEN bool_or(stage = 'extract' AND status = 'done') THEN 'extracted' WHEN bool_or(stage = 'parse' AND status = 'done') THEN 'parsed' ELSE 'pending' END AS state FROM artifacts LEFT JOIN ledger USING (artifact_id) GROUP BY 1""")
def processing_state(c):
    return state.processing_state(c.artifacts, c.relation("ledger")).drop("project_id")


@query("SELECT artifact_id, arg_min(message, concat(status, stage)) AS note, min(status) AS status FROM ledger WHERE status <> 'done' GROUP BY 1")
def processing_note(c):
    return state.processing_note(c.relation("ledger"))


@query("SELECT coalesce(a.artifact_id, f.artifact_id) AS artifact_id, coalesce(f.label, a.label) AS label, CASE WHEN f.label IS NULL THEN 'auto' ELSE 'human' END AS source FROM labels0 a FULL JOIN latest_feedback f USING (artifact_id)")
def apply_feedback(c):
    auto = direction.direction_labels(c.relation("vectors"), c.chosen(), c.edges()).select("artifact_id", "label")
    return state.apply_feedback(auto, c.relation("feedback").withColumnRenamed("given_at", "at"), ["artifact_id"], "label")


@query("""SELECT o.project_id, o.gap_key, CASE WHEN o.project_id % 2 = 1 THEN 'dismissed' WHEN o.project_id % 4 = 2 AND o.gap_key LIKE '%0' THEN 'confirmed' ELSE o.status END AS status,
  CASE WHEN o.project_id % 2 = 1 OR o.project_id % 4 = 2 AND o.gap_key LIKE '%0' THEN 'human' ELSE 'auto' END AS source FROM old_gaps o""")
def feedback_gaps(c):
    """Gaps after users set their status, some twice; feedback on gaps that aren't there is refused."""
    return state.apply_feedback(c.relation("old_gaps").select("project_id", "gap_key", "status"), _gap_feedback(c), ["project_id", "gap_key"], "status", known_only=True)


def _gap_feedback(c):
    gaps_ = c.relation("old_gaps")
    at = lambda day: F.lit(day).cast("timestamp").alias("at")
    first = gaps_.where("project_id % 2 = 1 or project_id % 4 = 2 and gap_key like '%0'").select("project_id", "gap_key", F.lit("confirmed").alias("status"), at("2024-01-01"))
    second = gaps_.where("project_id % 2 = 1").select("project_id", "gap_key", F.lit("dismissed").alias("status"), at("2024-02-01"))
    absent = c.relation("projects").select("project_id", F.lit("structural:77").alias("gap_key"), F.lit("confirmed").alias("status"), at("2024-01-01"))
    return first.unionByName(second).unionByName(absent)


@query("""SELECT project_id, CASE WHEN project_id % 5 = 1 THEN 'engineering' ELSE domain END AS domain, CAST(confidence AS DOUBLE) AS confidence, confirmed OR project_id % 5 IN (1, 2) AS confirmed FROM classification""")
def feedback_domains(c):
    """Domains after users confirmed some and set others; domains without phases are refused."""
    named = F.when(F.col("project_id") % 5 == 1, "engineering").when(F.col("project_id") % 5 == 3, "cooking")
    given = c.relation("projects").where("project_id % 5 in (1, 2, 3)").select("project_id", named.alias("domain"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    known = c.relation("classification").withColumn("confidence", F.col("confidence").cast("double"))
    return state.apply_domain_feedback(known, given, phases.phase_templates(c.spark).select("domain"))


@query(f"""SELECT 'entity_mention' AS decision_type, concat(artifact_id, ':', start) AS target_id, concat(kind, '=', normalized_value) AS new_value, 'system' AS actor, concat('matched by the rule of ', kind) AS rationale FROM mentions
  UNION ALL SELECT 'direction_label', CAST(artifact_id AS VARCHAR), label, CASE WHEN confirmed THEN 'user' ELSE 'system' END, CASE WHEN confirmed THEN 'confirmed by a user' ELSE concat('signals: ', CASE WHEN signal_a IS NULL THEN 'none' ELSE 'drift' END, ', ', CASE WHEN signal_b IS NULL THEN 'none' ELSE 'citations' END) END FROM labels
  UNION ALL SELECT 'direction_snapshot', CAST(project_id AS VARCHAR), summary, 'system', 'recent members of the direction' FROM ({DIRECTION_SNAPSHOT})
  UNION ALL SELECT 'domain_classification', CAST(project_id AS VARCHAR), domain, CASE WHEN confirmed THEN 'user' ELSE 'system' END, CASE WHEN confirmed THEN 'confirmed by a user' ELSE concat('classified with confidence ', printf('%.2f', CAST(confidence AS DOUBLE))) END FROM classification
  UNION ALL SELECT 'phase_assignment', concat(artifact_id, ':', phase_id), CAST(phase_id AS VARCHAR), CASE WHEN source = 'human' THEN 'user' ELSE 'system' END, concat('assigned with confidence ', printf('%.2f', CAST(confidence AS DOUBLE))) FROM assignments
  UNION ALL SELECT 'view_projection_name', CAST(artifact_id AS VARCHAR), suggested_name, 'system', concat('named by date, file name and entity in ', category) FROM views
  UNION ALL SELECT 'gap_promised_unfulfilled', evidence, description, 'system', CASE WHEN confidence > 0.5 THEN 'nothing later in the project' ELSE 'no later text fulfils it' END FROM promised
  UNION ALL SELECT 'gap_status', concat(project_id, '/', gap_key), 'dismissed', 'user', 'status set by a user' FROM old_gaps WHERE project_id % 2 = 1
  UNION ALL SELECT 'gap_status', concat(project_id, '/', gap_key), 'confirmed', 'user', 'status set by a user' FROM old_gaps WHERE project_id % 4 = 2 AND gap_key LIKE '%0'""")
def decision_ledger(c):
    """A row for every decision but the chosen dates, which decision_audit has."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    col, by = F.col, lambda human: F.when(human, "user").otherwise("system")
    labels, snapshot = c.labels(), direction.direction_snapshot(c.members(), c.chosen(), c.names())
    signals = text("signals: ", F.when(col("signal_a").isNull(), "none").otherwise("drift"), ", ", F.when(col("signal_b").isNull(), "none").otherwise("citations"))
    classified = F.when(col("confirmed"), "confirmed by a user").otherwise(F.format_string("classified with confidence %.2f", col("confidence").cast("double")))
    statuses = feedback_gaps(c).where("source = 'human'")
    kinds = [
        ("entity_mention", c.mentions(), text(col("artifact_id"), ":", col("start")), text(col("kind"), "=", col("normalized_value")), "system", text("matched by the rule of ", col("kind"))),
        ("direction_label", labels, col("artifact_id"), col("label"), by(col("confirmed")), F.when(col("confirmed"), "confirmed by a user").otherwise(signals)),
        ("direction_snapshot", snapshot, col("project_id"), col("summary"), "system", F.lit("recent members of the direction")),
        ("domain_classification", c.relation("classification"), col("project_id"), col("domain"), by(col("confirmed")), classified),
        ("phase_assignment", c.relation("assignments"), text(col("artifact_id"), ":", col("phase_id")), col("phase_id"), by(col("source") == "human"), F.format_string("assigned with confidence %.2f", col("confidence").cast("double"))),
        ("view_projection_name", c.view(), col("artifact_id"), col("suggested_name"), "system", text("named by date, file name and entity in ", col("category"))),
        ("gap_promised_unfulfilled", c.promised(), col("evidence"), col("description"), "system", F.when(col("confidence") > 0.5, "nothing later in the project").otherwise("no later text fulfils it")),
        ("gap_status", statuses, text(col("project_id"), "/", col("gap_key")), col("status"), "user", F.lit("status set by a user")),
    ]
    return reduce(DataFrame.unionByName, [state.audit(rows, kind, target, value, why, actor) for kind, rows, target, value, actor, why in kinds])


@query("SELECT 'chosen_date' AS decision_type, CAST(artifact_id AS VARCHAR) AS target_id, strftime(ts, '%Y-%m-%d') AS new_value, 'system' AS actor, concat('chosen via signal precedence: ', source, ' (confidence=', printf('%.2f', CAST(confidence AS DOUBLE)), ')', CASE WHEN anchor IS NOT NULL THEN concat('; relative content reference anchored to ', strftime(anchor, '%Y-%m-%dT%H:%M:%S'), '+00:00') ELSE '' END) AS rationale FROM chosen")
def decision_audit(c):
    why = F.format_string("chosen via signal precedence: %s (confidence=%.2f)", "source", "confidence")
    anchored = F.concat(F.lit("; relative content reference anchored to "), F.date_format("anchor", "yyyy-MM-dd'T'HH:mm:ssxxx"))
    why = F.concat(why, F.coalesce(anchored, F.lit("")))
    return state.audit(c.chosen(), "chosen_date", F.col("artifact_id"), F.date_format("ts", "yyyy-MM-dd"), why)


@query("SELECT artifact_id, NOT contains(raw_text, 'Minutes') AS ok, CASE WHEN NOT contains(raw_text, 'Minutes') THEN substring(raw_text, 1, 20) END AS value, CASE WHEN contains(raw_text, 'Minutes') THEN 'ValueError: no minutes' END AS error FROM artifacts")
def error_isolation(c):
    def handler(text: str) -> str:
        if "Minutes" in text:
            raise ValueError("no minutes")
        return text[:20]

    return state.isolate_errors(c.content.select("artifact_id", "raw_text"), handler, "raw_text").drop("raw_text")


# the run of all stages

_LINES = {
    "parse": "SELECT project_id, concat_ws('|', artifact_id, sha256(raw_text)) AS line FROM artifacts",
    "extract": "SELECT project_id, concat_ws('|', artifact_id, start, kind, normalized_value) AS line FROM mentions",
    "timeline": "SELECT project_id, concat_ws('|', artifact_id, strftime(event_date, '%Y-%m-%d'), source) AS line FROM events",
    "phases": "SELECT project_id, concat_ws('|', artifact_id, phase_id) AS line FROM assignments",
    "graph": "SELECT project_id, concat_ws('|', src, dst, edge_type) AS line FROM edges",
    "direction": "SELECT project_id, concat_ws('|', artifact_id, label) AS line FROM labels",
    "gaps": "SELECT project_id, concat_ws('|', type, description) AS line FROM drafts",
    "view": "SELECT project_id, concat_ws('|', artifact_id, suggested_name) AS line FROM views",
    "report": f"SELECT project_id, concat_ws('|', section, sha256(content)) AS line FROM {SECTIONS_SQL}",
}
_PLACES = {"ingest": 0, "parse": 1, "extract": 2, "embed": 3, "timeline": 4, "phases": 5, "graph": 6, "direction": 7, "gaps": 8, "view": 9, "report": 10}


@query(" UNION ALL ".join(f"""SELECT n.project_id, '{name}' AS stage, {_PLACES[name]} AS place, n.rows, p.fingerprint, CASE WHEN n.project_id % 2 = 0 AND '{name}' = 'phases' THEN 'skip' ELSE 'run' END AS action
  FROM (SELECT project_id, count(*) AS rows FROM ({line}) GROUP BY 1) n JOIN ({PRINT.format(line)}) p USING (project_id)""" for name, line in _LINES.items()))  # fmt: skip
def stage_run(c):
    """All stages that have no binary input, against a last run that has seen some projects' phases."""
    line = lambda *parts: F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]).alias("line")
    of = lambda rows, *parts: lambda: rows().select("project_id", line(*parts))
    stages = {
        "parse": of(lambda: c.content, "artifact_id", F.sha2("raw_text", 256)),
        "extract": of(c.mentions, "artifact_id", "start", "kind", "normalized_value"),
        "timeline": of(c.events, "artifact_id", F.date_format("event_date", "yyyy-MM-dd"), "source"),
        "phases": of(lambda: c.relation("assignments"), "artifact_id", "phase_id"),
        "graph": of(c.edges, "src", "dst", "edge_type"),
        "direction": of(c.labels, "artifact_id", "label"),
        "gaps": of(lambda: c.structural().unionByName(c.promised()), "type", "description"),
        "view": of(c.view, "artifact_id", "suggested_name"),
        "report": of(lambda: _sections(c), "section", F.sha2("content", 256)),
    }
    seen = state.fingerprint(stages["phases"](), ["project_id"], F.col("line")).where("project_id % 2 = 0").withColumn("stage", F.lit("phases"))
    return runner.run_stages(stages, seen, written)


_STEPS = {"parse": "count(*) FROM artifacts", "extract": "count(*) FROM mentions", "entities": "count(DISTINCT concat(kind, '|', normalized_value)) FROM mentions"}


@query(" UNION ALL ".join(f"SELECT project_id, '{name}' AS stage, CASE WHEN project_id % 3 = 0 THEN 'done' ELSE 'skip' END AS status, {rows.replace(' FROM', ' AS rows FROM')} GROUP BY 1" for name, rows in _STEPS.items()))
def pipeline_run(c):
    """A second run after a third of the projects got one more artifact; the first run wrote what it skips."""
    root = shared_path(c.spark, "steps")
    of = lambda name: c.spark.read.parquet(f"{root}/{name}")
    line = lambda *parts: F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]).alias("line")
    only = lambda rows, projects: rows.join(sized(projects), "project_id", "left_semi")

    def steps(content):
        return [
            runner.Step("parse", lambda: content.select("project_id", line("artifact_id", F.sha2("raw_text", 256))), lambda p: only(content, p)),
            runner.Step("extract", lambda: of("parse").select("project_id", line("artifact_id", F.sha2("raw_text", 256))), lambda p: extract.entity_mentions(only(of("parse"), p))),
            runner.Step("entities", lambda: of("extract").select("project_id", line("artifact_id", "start", "kind", "normalized_value")), lambda p: extract.entities(only(of("extract"), p))),
        ]

    late = written(c.artifacts.where("project_id % 3 = 0 and k = 0").select("artifact_id"))
    runner.run_steps(c.spark, steps(c.content.join(sized(late), "artifact_id", "left_anti")), root, written)
    second = runner.run_steps(c.spark, steps(c.content), root, written)
    counts = [of(name).groupBy("project_id").agg(F.count("*").alias("rows")).withColumn("stage", F.lit(name)) for name in _STEPS]
    return second.select("project_id", "stage", "status").join(counts[0].unionByName(counts[1]).unionByName(counts[2]).hint("merge"), ["project_id", "stage"])


@query("SELECT project_id, artifact_id, version, suggested_name FROM versions WHERE project_id % 2 = 0 AND artifact_id % 7 <> 1 OR project_id % 2 = 1 UNION ALL SELECT project_id, artifact_id, 9, 'replaced' FROM artifacts WHERE project_id % 2 = 0 AND artifact_id % 7 = 1 AND k % 2 = 0")
def upsert_artifacts(c):
    """A table of versions by project in which some artifacts' rows were replaced in half of the projects."""
    path = shared_path(c.spark, "versions")
    sinks.write_projects(c.relation("versions").select("project_id", "artifact_id", F.col("version").cast("int").alias("version"), "suggested_name"), path)
    keys = c.artifacts.where("project_id % 2 = 0 and artifact_id % 7 = 1")
    new = keys.where("k % 2 = 0").select("project_id", "artifact_id", F.lit(9).alias("version"), F.lit("replaced").alias("suggested_name"))
    sinks.upsert_artifacts(new, keys.select("project_id", "artifact_id"), path, written)
    return c.spark.read.parquet(path)


# streams


@query("SELECT DISTINCT CAST(doc_id % 20 AS INT) AS project_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def stream_ingest(c):
    """documents as a stream of files, each content of a project ingested once."""
    docs = c.table("documents")
    read = c.spark.readStream.schema(docs.schema).parquet(f"{c.sf_dir}/documents.parque[t]")  # a pattern, since streams take no path of one file
    body = F.coalesce("text", F.lit(""))
    made = read.select(F.col("doc_id").cast("string").alias("path"), F.to_binary(body, F.lit("utf-8")).alias("content"), F.lit(None).cast("timestamp").alias("fs_modified"), F.octet_length(body).cast("long").alias("size_bytes"), F.sha2(body, 256).alias("content_hash"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("original_filename"), F.lit("txt").alias("file_type"), (F.col("doc_id") % 20).cast("int").alias("project_id"))
    target = shared_path(c.spark, "ingest")
    stream.stream_ingest(made, target, shared_path(c.spark, "ingest-state"), F.col("project_id")).awaitTermination()
    return c.spark.read.parquet(target).select("project_id", "content_hash")


@query("SELECT CAST(date_trunc('day', CAST(ts AS TIMESTAMP)) AS TIMESTAMP) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM main.events GROUP BY 1, 2")
def stream_timeline(c):
    """Events as a stream, counted by day and type; the last micro-batch's windows are all of them."""
    events = c.table("events")
    read = c.spark.readStream.schema(events.schema).parquet(f"{c.sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    target = shared_path(c.spark, "timeline")
    run = stream.stream_timeline(read).writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target))
    run.option("checkpointLocation", shared_path(c.spark, "timeline-state")).trigger(availableNow=True).start().awaitTermination()
    return c.spark.read.parquet(target).withColumn("total", F.round("total", 4))
