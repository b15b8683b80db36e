"""The reference graph: which artifact names, cites or continues which."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import RULES

if TYPE_CHECKING:
    import ahocorasick

#: Texts that one task reads with an automaton, and keys that one automaton holds.
TEXTS_OF_PART = 500
KEYS_OF_PART = 50_000


def match_keys(artifacts: DataFrame) -> DataFrame:
    """project_id, key, dst, kind: lower-cased filenames and titles of artifacts (artifact_id, project_id,
    original_filename, labels) by which exactly one artifact of the project is known."""
    names = artifacts.select("project_id", "artifact_id", F.col("original_filename").alias("key"), F.lit("filename").alias("kind"))
    titles = artifacts.select("project_id", "artifact_id", F.explode("labels").alias("key"), F.lit("title").alias("kind"))
    keys = names.unionByName(titles).withColumn("key", F.lower(F.trim("key"))).where(F.length("key") >= RULES.min_key_chars)
    own = keys.groupBy("project_id", "key").agg(F.countDistinct("artifact_id").alias("owners"), F.min("artifact_id").alias("dst"), F.min("kind").alias("kind"))
    return own.where("owners = 1").drop("owners")


def _automaton(keys: list[tuple[str, int, str]]) -> ahocorasick.Automaton:
    """Goto and failure links over the characters of keys (key, dst, kind)."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for key, dst, kind in keys:
        made.add_word(key, (len(key), dst, kind))
    made.make_automaton()
    return made


def _lower(text: str) -> str:
    """text in lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


_HIT = "project_id int, src long, dst long, kind string, start int, end int, evidence string"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits of the texts in rows sorted by project and part, keys before texts. At any time one part's
    keys are held as an automaton; texts stream through it."""
    at, keys, machine = None, [], None
    for batch in batches:
        hits: list[tuple] = []
        for project, part, key, dst, kind, src, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (project, part) != at:
                at, keys, machine = (project, part), [], None
            if key is not None:
                keys.append((key, dst, kind))
                continue
            if not keys:
                continue
            machine = machine or _automaton(keys)
            low = _lower(text)
            for last, (size, dst, kind) in machine.iter(low):
                start, end = last + 1 - size, last + 1
                if not (start and _is_word(low[start - 1])) and not (end < len(low) and _is_word(low[end])):
                    hits.append((project, src, dst, kind, start, end, text[max(0, start - RULES.context_radius) : end + RULES.context_radius]))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        columns = zip(*hits) if hits else [()] * len(kinds)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["project_id", "src", "dst", "kind", "start", "end", "evidence"])


def _leftmost_longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of hits sorted by text, start and falling end, those that begin where the one taken before has ended."""
    src, to = None, 0
    for batch in batches:
        keep = []
        for own, start, end in zip(*(batch.column(i).to_pylist() for i in (1, 4, 5))):
            if own != src:
                src, to = own, 0
            keep.append(start >= to)
            to = end if keep[-1] else to
        yield batch.filter(pa.array(keep, pa.bool_()))


def _dealt(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (project_id, key and more) and texts (project_id, src, text), dealt to parts of TEXTS_OF_PART texts and KEYS_OF_PART keys
    of a project: each text meets each key of its project in one part. Rows of a part stand together, keys first."""
    many = texts.groupBy("project_id").agg(F.ceil(F.count("*") / TEXTS_OF_PART).alias("n_texts"))
    some = keys.groupBy("project_id").agg(F.ceil(F.count("*") / KEYS_OF_PART).alias("n_keys"))
    sizes = many.join(some.hint("merge"), "project_id")  # a row for each project that has both
    rows = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.col(k))
    part = lambda i, j: F.concat_ws("-", i.cast("string"), j.cast("string")).alias("part")
    more = [c for c in keys.columns if c not in ("project_id", "key")]
    known = keys.join(sizes.hint("merge"), "project_id").withColumn("i", F.explode(rows("n_texts")))
    known = known.select("project_id", part(F.col("i"), deal("key", "n_keys")), "key", *more)
    read = texts.join(sizes.hint("merge"), "project_id").withColumn("j", F.explode(rows("n_keys")))
    read = read.select("project_id", part(deal("src", "n_texts"), F.col("j")), "src", "text")
    return known.unionByName(read, allowMissingColumns=True).repartition("project_id", "part").sortWithinPartitions("project_id", "part", F.col("key").asc_nulls_last())


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys that each text holds, of rows as _walk reads them."""
    import ahocorasick

    at, keys, machine = None, [], None
    for batch in batches:
        out: list[tuple] = []
        for project, part, key, src, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (project, part) != at:
                at, keys, machine = (project, part), [], None
            if key is not None:
                keys.append(key)
                continue
            if not keys:
                continue
            if machine is None:
                machine = ahocorasick.Automaton()
                for k in keys:
                    machine.add_word(k, k)
                machine.make_automaton()
            found = {k for _, k in machine.iter(text)}
            if found:
                out.append((project, src, list(found)))
        columns = zip(*out) if out else [()] * 3
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), pa.list_(pa.string())])], ["project_id", "src", "held"])


def held_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """project_id, src, held: the sorted keys (project_id, key) that each text (project_id, src, text) of their project holds, also
    inside longer words; texts without any are left out. Keys and texts meet as in reference_scan."""
    found = _dealt(texts, keys).mapInArrow(_held, "project_id int, src long, held array<string>")
    return found.groupBy("project_id", "src").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held"))


def reference_scan(content: DataFrame, keys: DataFrame) -> DataFrame:
    """src, dst, kind, confidence, start, evidence: the best mention of each artifact in each text.

    An Aho-Corasick automaton of a project's keys reads each of its texts once. Projects are dealt to parts of
    TEXTS_OF_PART texts and KEYS_OF_PART keys; a part's rows, keys first, stream through one task, which holds its automaton and one
    text at a time. A match must stand between characters that are no word characters; matches go left to
    right, the longest at a place."""
    texts = content.where("raw_text <> ''").select("project_id", F.col("artifact_id").alias("src"), F.col("raw_text").alias("text"))
    both = _dealt(texts, keys.select("project_id", "key", "dst", "kind"))
    hits = both.mapInArrow(_walk, _HIT).repartition("src").sortWithinPartitions("src", "start", F.desc("end"))
    taken = hits.mapInArrow(_leftmost_longest, _HIT).where("src <> dst")
    scored = taken.withColumn("confidence", F.when(F.col("kind") == "filename", RULES.filename_confidence).otherwise(RULES.title_confidence))
    best = scored.withColumn("rn", F.row_number().over(W.partitionBy("src", "dst").orderBy(F.desc("confidence"), "start"))).where("rn = 1")
    return best.select("project_id", "src", "dst", "kind", "confidence", "start", "evidence")


def orient(edges: DataFrame, dates: DataFrame) -> DataFrame:
    """edges with edge_type: builds_on where both dates are known and the source is later, else references."""
    a, b = dates.select(F.col("artifact_id").alias("src"), F.col("ts").alias("sd")), dates.select(F.col("artifact_id").alias("dst"), F.col("ts").alias("dd"))
    joined = edges.join(a.hint("merge"), "src", "left").join(b.hint("merge"), "dst", "left")
    return joined.withColumn("edge_type", F.when(F.col("sd") > F.col("dd"), "builds_on").otherwise("references")).drop("sd", "dd")


def entity_chain(mentions: DataFrame, dates: DataFrame) -> DataFrame:
    """src, dst, confidence, evidence: of each experiment, hypothesis or citation in few artifacts, a later
    dated artifact points to the one before. Equal dates give no edge."""
    key = ["project_id", "kind", "normalized_value"]
    per = mentions.where(F.col("kind").isin("experiment", "hypothesis", "citation")).groupBy(*key, "artifact_id").agg(F.min_by("context", "start").alias("context"))
    # rare entities only, and before any join: this bounds the rows of a key
    few = per.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n").between(2, RULES.max_entity_artifacts)).drop("n")
    dated = per.join(few.hint("merge"), key).join(dates.select("artifact_id", "ts").hint("merge"), "artifact_id")
    w = W.partitionBy(*key).orderBy("ts", "artifact_id")
    chained = dated.withColumn("dst", F.lag("artifact_id").over(w)).withColumn("before", F.lag("ts").over(w)).withColumn("old", F.lag("context").over(w))
    evidence = F.coalesce(F.nullif("context", F.lit("")), "old")
    return chained.where("dst is not null and ts > before").select("project_id", F.col("artifact_id").alias("src"), "dst", F.lit(RULES.entity_confidence).alias("confidence"), evidence.alias("evidence"))


def assemble_edges(textual: DataFrame, chained: DataFrame) -> DataFrame:
    """One edge per pair, the surest, textual before chained; weak ones and self edges are left out."""
    a = textual.select("project_id", "src", "dst", "edge_type", "confidence", "evidence", F.lit(0).alias("rank"), "start")
    b = chained.select("project_id", "src", "dst", F.lit("mentioned_by").alias("edge_type"), "confidence", "evidence", F.lit(1).alias("rank"), F.lit(0).alias("start"))
    order = W.partitionBy("src", "dst").orderBy(F.desc("confidence"), "rank", "start", "evidence")
    best = a.unionByName(b).where("src <> dst").withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return best.where(F.col("confidence") >= RULES.edge_floor).select("project_id", "src", "dst", "edge_type", "confidence", "evidence")


def incoming(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("sources"))


def both_ways(edges: DataFrame) -> DataFrame:
    """artifact_id, other_id, direction, edge_type, confidence: every edge from either end."""
    out = edges.select(F.col("src").alias("artifact_id"), F.col("dst").alias("other_id"), F.lit("outgoing").alias("direction"), "edge_type", "confidence")
    back = edges.select(F.col("dst").alias("artifact_id"), F.col("src").alias("other_id"), F.lit("incoming").alias("direction"), "edge_type", "confidence")
    return out.unionByName(back)
