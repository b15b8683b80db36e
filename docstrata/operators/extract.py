"""Entities and dates of artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import RULES
from ..functions.dates import DATE_GAP, DATE_SEARCH, meta_kind, meta_timestamp, resolve_phrase
from ..functions.text import context_window, exploded, find_spans, let, merge_adjacent, normalize_value
from ..functions.vocabulary import ENTITY_RULES, ENTITY_STARTS, MODEL_LABELS, TOOLS


def entity_mentions(content: DataFrame, rules: list[tuple[str, str, float]] = ENTITY_RULES) -> DataFrame:
    """artifact_id, project_id, kind, value, normalized_value, start, end, context, confidence of every
    rule match in content (artifact_id, project_id, raw_text). Rules don't suppress each other; dots at
    the end of a match aren't part of it; texts that are null or empty give nothing."""

    def matches(kind: str, pattern: str, confidence: float) -> Column:
        started = f"{ENTITY_STARTS[pattern]}(?:{pattern})" if pattern in ENTITY_STARTS else pattern
        spans = find_spans(F.col("raw_text"), started)
        if pattern == ENTITY_RULES[0][1]:  # plain words cost less than a pattern of as many alternatives
            named = let(F.lower("raw_text"), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(t)) for t in TOOLS]))
            spans = F.when(named, spans).otherwise(F.array().cast("array<struct<value:string,start:int,end:int>>"))
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), s.alias("span")))

    found = [matches(*rule) for rule in rules]
    rows = exploded(content.where(F.col("raw_text") != ""), ["artifact_id", "project_id", "raw_text"], F.concat(*found), "m")
    value = F.regexp_replace("m.span.value", r"\.+$", "")
    start = F.col("m.span.start")
    end = start + F.length(value)
    return rows.select(
        "artifact_id", "project_id", F.col("m.kind").alias("kind"), value.alias("value"), normalize_value(F.col("m.kind"), value).alias("normalized_value"),
        start.alias("start"), end.alias("end"), context_window(F.col("raw_text"), start, end).alias("context"), F.col("m.confidence").alias("confidence"),
    )


def suppress_overlaps(spans: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows of spans (artifact_id, start, end) that overlap no row of taken of the same artifact. A sweep: spans stand at
    their ends among the starts of taken, and one is free if nothing that starts before its end reaches beyond its start."""
    key = lambda df: F.col("artifact_id").cast("long").alias("_a")
    own = spans.select(key(spans), F.col("end").cast("long").alias("_at"), F.lit(0).alias("_taken"), F.lit(None).cast("long").alias("_end"), F.struct(*[F.col(f"`{c}`") for c in spans.columns]).alias("_row"))
    t = taken.where("artifact_id is not null and start is not null").select(key(taken), F.col("start").cast("long").alias("_at"), F.lit(1).alias("_taken"), F.col("end").cast("long").alias("_end"))
    before = W.partitionBy("_a").orderBy("_at", "_taken").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = own.unionByName(t, allowMissingColumns=True).withColumn("_reach", F.max("_end").over(before))
    return swept.where((F.col("_taken") == 0) & F.coalesce(F.col("_reach") <= F.col("_row.start"), F.lit(True))).select("_row.*")


def entities(mentions: DataFrame) -> DataFrame:
    """One row per project, kind and normalized value; value is its first spelling."""
    first = F.min_by("value", F.struct("artifact_id", "start")).alias("value")
    return mentions.groupBy("project_id", "kind", "normalized_value").agg(first, F.count("*").alias("mentions"), F.countDistinct("artifact_id").alias("artifacts"))


def model_mentions(content: DataFrame, spans: DataFrame, ruled: DataFrame) -> DataFrame:
    """Mentions that a language model found: spans (artifact_id, start, end, label) that overlap none of the rules'
    mentions (ruled: artifact_id, start, end) and whose label is known; columns as entity_mentions gives them."""
    known = spans.where(F.col("label").isin(*MODEL_LABELS)).select("artifact_id", "start", "end", "label")
    free = suppress_overlaps(known, ruled).join(content.where("raw_text is not null").hint("merge"), "artifact_id")
    of = lambda at: F.coalesce(*[F.when(F.col("label") == label, F.lit(m[at])) for label, m in MODEL_LABELS.items()])
    value = F.substring(F.col("raw_text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return free.select(
        "artifact_id", "project_id", of(0).alias("kind"), value.alias("value"), normalize_value(of(0), value).alias("normalized_value"),
        "start", "end", context_window(F.col("raw_text"), F.col("start"), F.col("end")).alias("context"), of(1).alias("confidence"),
    )


_CANDIDATE = ["artifact_id", "project_id", "ts", "source", "confidence", "evidence", "ordinal", "anchor"]


def fs_dates(artifacts: DataFrame) -> DataFrame:
    """Candidates from the file system: created, then modified."""
    rows = artifacts.select("artifact_id", "project_id", F.explode(F.array(
        F.struct(F.col("fs_created").alias("ts"), F.lit(RULES.fs_created_confidence).alias("confidence"), F.lit("Artifact.fs_created").alias("evidence"), F.lit(0).cast("long").alias("ordinal")),
        F.struct(F.col("fs_modified").alias("ts"), F.lit(RULES.fs_modified_confidence).alias("confidence"), F.lit("Artifact.fs_modified").alias("evidence"), F.lit(1).cast("long").alias("ordinal")),
    )).alias("c"))
    return rows.select("artifact_id", "project_id", "c.*").withColumn("source", F.lit("filesystem")).where("ts is not null").withColumn("anchor", F.lit(None).cast("timestamp")).select(*_CANDIDATE)


def doc_meta_dates(metadata: DataFrame) -> DataFrame:
    """Candidates from metadata (artifact_id, project_id, key, value, ordinal)."""
    kind = meta_kind(F.col("key"))
    exif = F.col("key").startswith("exif.") & F.lower("key").rlike("date")
    confidence = F.when(exif | (kind == "created"), RULES.meta_created_confidence).when(kind == "modified", RULES.meta_modified_confidence)
    rows = metadata.select("artifact_id", "project_id", meta_timestamp(F.col("value")).alias("ts"), F.lit("doc_meta").alias("source"), confidence.alias("confidence"), F.concat_ws("=", "key", "value").alias("evidence"), (F.col("ordinal") + 10).cast("long").alias("ordinal"))
    return rows.where("ts is not null and confidence is not null").withColumn("anchor", F.lit(None).cast("timestamp")).select(*_CANDIDATE)


def _best(candidates: DataFrame) -> DataFrame:
    rank = F.when(F.col("source") == "content", 3).when(F.col("source") == "doc_meta", 2).otherwise(1)
    order = W.partitionBy("artifact_id").orderBy(rank.desc(), F.desc("confidence"), "ordinal")
    return candidates.withColumn("rn", F.row_number().over(order))


def date_anchor(candidates: DataFrame) -> DataFrame:
    """The best candidate of each artifact that isn't from its content: relative phrases count from it."""
    return _best(candidates.where("source <> 'content'")).where("rn = 1").drop("rn")


def content_dates(content: DataFrame, anchors: DataFrame) -> DataFrame:
    """Candidates from date phrases in the text, parts of one date joined; phrases that can't be resolved are left
    out. anchor is the date that a relative phrase counts from."""
    rows = exploded(content.where(F.col("raw_text") != ""), ["artifact_id", "project_id"], merge_adjacent(F.col("raw_text"), find_spans(F.col("raw_text"), DATE_SEARCH), DATE_GAP), "s")
    rows = rows.join(anchors.select("artifact_id", F.col("ts").alias("anchor")).hint("merge"), "artifact_id", "left")
    rows = rows.withColumn("r", resolve_phrase(F.col("s.value"), F.col("anchor"))).where("r.ts is not null")
    return rows.select("artifact_id", "project_id", F.col("r.ts").alias("ts"), F.lit("content").alias("source"), F.col("r.confidence").alias("confidence"), F.col("s.value").alias("evidence"), (F.col("s.start") + 1000).cast("long").alias("ordinal"), F.when(F.col("r.relative"), F.col("anchor")).alias("anchor"))


def resolved_dates(artifacts: DataFrame, content: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """All date candidates of each artifact, of which exactly one is_chosen: the signal's rank comes first,
    then confidence, then the order of the candidates."""
    known = fs_dates(artifacts)
    if metadata is not None:
        known = known.unionByName(doc_meta_dates(metadata))
    every = known.unionByName(content_dates(content, date_anchor(known)))
    return _best(every).withColumn("is_chosen", F.col("rn") == 1).drop("rn")


def chosen_dates(dates: DataFrame) -> DataFrame:
    return dates.where("is_chosen").select("artifact_id", "project_id", "ts", "source", "confidence", "evidence", "anchor")


