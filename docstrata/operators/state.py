"""Incremental processing: stage ledger, fingerprints, feedback, audit."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def pending(artifacts: DataFrame, ledger: DataFrame, stage: str, hashed: str = "input_hash", done: tuple[str, ...] = ("done",)) -> DataFrame:
    """Artifacts that have no ledger row of the stage with a finished status and an equal input hash."""
    ready = ledger.where((F.col("stage") == stage) & F.col("status").isin(*done)).select("artifact_id", F.col("input_hash").alias("_h"))
    return artifacts.join(ready, (artifacts["artifact_id"] == ready["artifact_id"]) & artifacts[hashed].eqNullSafe(F.col("_h")), "left_anti")


def input_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def fingerprint(rows: DataFrame, keys: list[str], line: Column, version: str = "v1") -> DataFrame:
    """A SHA-256 of all lines of each key behind a version line, in any order of rows: lines are dealt to 256
    blocks by their hash, a block's sorted lines are hashed, and the blocks' hashes in order are hashed."""
    lined = rows.withColumn("_line", line).where("_line is not null").withColumn("_block", F.substring(F.md5("_line"), 1, 2))
    blocks = lined.groupBy(*keys, "_block").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_line")), "\n"), 256).alias("_hash"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("_block", "_hash"))), lambda b: b["_hash"])
    return blocks.groupBy(*keys).agg(F.sha2(F.concat_ws("\n", F.lit(version), F.array_join(joined, "\n")), 256).alias("fingerprint"))


_LANES = 8


def multiset(rows: DataFrame, keys: list[str], line: Column, sign: int = 1) -> DataFrame:
    """keys, n, lanes: how many lines a key has, and the sums of their SHA-256 in eight lanes of 32 bits. Sums of parts
    add up to the sum of the whole, in any order; sign -1 takes lines away."""
    lined = rows.withColumn("_h", F.sha2(line, 256)).where("_h is not null")
    lane = lambda i: F.sum(F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long") * sign)
    return lined.groupBy(*keys).agg((F.count("*") * sign).alias("n"), F.array(*[lane(i) for i in range(_LANES)]).alias("lanes"))


def merged_multisets(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The multiset of all parts: that of a table and of what changed since, without reading the table's rows. Keys that
    have no line left are gone."""
    every = reduce(DataFrame.unionByName, parts)
    summed = every.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("lanes")[i]) for i in range(_LANES)]).alias("lanes"))
    return summed.where("n <> 0")


def multiset_fingerprint(held: DataFrame, keys: list[str], version: str = "v1") -> DataFrame:
    """A SHA-256 of each key's multiset."""
    return held.select(*keys, F.sha2(F.concat_ws("|", F.lit(version), F.col("n").cast("string"), F.array_join(F.col("lanes").cast("array<string>"), "|")), 256).alias("fingerprint"))


def up_to_date(artifacts: DataFrame, ledger: DataFrame, stage: str) -> DataFrame:
    """project_id, up_to_date: whether every artifact is done at its expected input_hash."""
    done = ledger.where((F.col("stage") == stage) & (F.col("status") == "done")).select("artifact_id", F.col("input_hash").alias("_h"))
    joined = artifacts.join(done, "artifact_id", "left")
    return joined.groupBy("project_id").agg(F.bool_and(F.coalesce(F.col("_h") == F.col("input_hash"), F.lit(False))).alias("up_to_date"))


def stage_progress(artifacts: DataFrame, ledger: DataFrame) -> DataFrame:
    """project_id, stage, done, skipped, error, pending."""
    total = artifacts.groupBy("project_id").agg(F.count("*").alias("total"))
    rows = ledger.join(artifacts.select("artifact_id", "project_id"), "artifact_id")
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    by = rows.groupBy("project_id", "stage").agg(count("done"), count("skipped"), count("error")).join(total, "project_id")
    return by.select("project_id", "stage", "done", "skipped", "error", F.greatest(F.lit(0), F.col("total") - F.col("done") - F.col("skipped") - F.col("error")).alias("pending"))


def processing_state(artifacts: DataFrame, ledger: DataFrame) -> DataFrame:
    """State of each artifact from its ledger: error, unsupported (parse skipped), or the last stage done."""
    has = lambda stage, status: F.coalesce(F.bool_or((F.col("stage") == stage) & (F.col("status") == status)), F.lit(False))
    facts = ledger.groupBy("artifact_id").agg(F.bool_or(F.col("status") == "error").alias("bad"), has("parse", "skipped").alias("skip"), has("embed", "done").alias("e"), has("extract", "done").alias("x"), has("parse", "done").alias("p"))
    state = F.when(F.col("skip"), "unsupported").when(F.col("bad"), "error").when(F.col("e"), "embedded").when(F.col("x"), "extracted").when(F.col("p"), "parsed").otherwise("pending")
    return artifacts.select("artifact_id", "project_id").join(facts, "artifact_id", "left").select("artifact_id", "project_id", state.alias("state"))


def processing_note(ledger: DataFrame) -> DataFrame:
    """The message of each artifact's problem; errors come before skipped stages."""
    bad = ledger.where(F.col("status").isin("error", "skipped"))
    return bad.groupBy("artifact_id").agg(F.min_by("message", F.struct("status", "stage")).alias("note"), F.min("status").alias("status"))


def apply_feedback(automatic: DataFrame, feedback: DataFrame, key: list[str], value: str, known_only: bool = False) -> DataFrame:
    """Rows of automatic with the latest feedback (key, value, at) in place of their value; source says
    whose it is. Feedback on keys that automatic lacks is kept too, unless known_only."""
    last = feedback.groupBy(*key).agg(F.max_by(value, "at").alias("_human"))
    joined = automatic.join(last, key, "left" if known_only else "full_outer")
    return joined.select(*key, F.coalesce("_human", value).alias(value), F.when(F.col("_human").isNotNull(), "human").otherwise("auto").alias("source"))


def apply_domain_feedback(classification: DataFrame, feedback: DataFrame, domains: DataFrame) -> DataFrame:
    """classification (project_id, domain, confidence, confirmed) after the latest feedback (project_id, domain, at): each
    confirms; one that names a domain of domains (domain) also sets it. Feedback that names another, or of a project
    that isn't classified, is refused."""
    valid = domains.select(F.col("domain").alias("_d")).distinct()
    given = feedback.join(valid.hint("merge"), F.col("domain") == F.col("_d"), "left").where("domain is null or _d is not null")
    last = given.groupBy("project_id").agg(F.max("at").alias("_at"), F.max_by("_d", F.when(F.col("_d").isNotNull(), F.col("at"))).alias("_set"))
    joined = classification.join(last.hint("merge"), "project_id", "left")
    return joined.select("project_id", F.coalesce("_set", "domain").alias("domain"), "confidence", (F.col("confirmed") | F.col("_at").isNotNull()).alias("confirmed"))


def audit(df: DataFrame, decision: str, target: Column, new_value: Column, rationale: Column, actor: str = "system") -> DataFrame:
    """One ledger row per decision."""
    return df.select(F.lit(decision).alias("decision_type"), target.cast("string").alias("target_id"), new_value.cast("string").alias("new_value"), F.lit(actor).alias("actor"), rationale.alias("rationale"))


def version_chain(versions: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Each version with the id of the one that supersedes it; the last has none."""
    return versions.withColumn("superseded_by", F.lead("version_id").over(W.partitionBy(key).orderBy("version")))


def current_version(versions: DataFrame, key: str = "artifact_id") -> DataFrame:
    return versions.where("superseded_by is null").withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc("version"), "version_id"))).where("rn = 1").drop("rn")


def isolate_errors(df: DataFrame, fn, column: str, message_chars: int = 2000) -> DataFrame:
    """df with ok, value and error: fn(text) -> text runs on column; a row that raises doesn't stop others."""
    @F.pandas_udf("ok boolean, value string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                rows.append((True, fn(text), None))
            except Exception as e:  # whatever a handler raises is that row's status
                rows.append((False, None, f"{type(e).__name__}: {e}"[:message_chars]))
        return pd.DataFrame(rows, columns=["ok", "value", "error"])

    return df.withColumn("_r", run(F.col(column))).select(*df.columns, "_r.ok", "_r.value", "_r.error")
