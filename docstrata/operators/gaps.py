"""Gaps: phases without artifacts, and promises that nothing later fulfils."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import RULES
from ..functions.text import exploded, find_spans, let, running, sentence_bounds, snippet, squeeze
from ..functions.vocabulary import PROMISES, PROMISE_STEMS, STOPWORDS
from ..joins import sized
from .graph import held_keys
from .order import numbered

_FEW = RULES.gap_few_threshold


def structural_gaps(coverage: DataFrame, totals: DataFrame) -> DataFrame:
    """Gaps of phases with too few artifacts; totals: project_id, artifacts_total. The wordings are fixed values."""
    rows = coverage.where(F.col("artifacts") < _FEW).join(totals, "project_id")
    n, name = F.col("artifacts").cast("string"), F.col("phase_name")
    none = F.concat(F.lit("No artifacts detected for the '"), name, F.lit("' phase."))
    few = F.concat(F.lit("Only "), n, F.lit(" artifact(s) detected for the '"), name, F.lit(f"' phase (expected at least {_FEW})."))
    evidence = F.concat(n, F.lit(" of "), F.col("artifacts_total").cast("string"), F.lit(" project artifact(s) mapped to phase '"), name, F.lit(f"' via PhaseAssignment (threshold: {_FEW})."))
    empty = F.col("artifacts") == 0
    return rows.select("project_id", F.lit("structural").alias("type"), "phase_id", F.when(empty, none).otherwise(few).alias("description"), evidence.alias("evidence"), F.when(empty, RULES.gap_zero_confidence).otherwise(RULES.gap_few_confidence).alias("confidence"))


def merge_spans(spans: DataFrame, keys: list[str], gap: int = RULES.promise_merge_gap) -> DataFrame:
    """keys, start, end: spans that start within gap of the end so far are one."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _merged(spans: Column, gap: int = RULES.promise_merge_gap) -> Column:
    """spans of one text (array of start, end) as merge_spans merges them."""

    def islands(sorted_: Column, reach: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: (i == 0) | (F.get(sorted_, i)["start"] > F.get(reach, i - 1) + gap))
        last = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(sorted_)) - 1
        return let(firsts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(sorted_, i)["start"].alias("start"), F.get(reach, last(at, k)).alias("end"))))

    def merged(sorted_: Column) -> Column:
        return let(running(F.transform(sorted_, lambda s: s["end"]), F.greatest), lambda reach: islands(sorted_, reach))

    return let(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), merged)


def promise_candidates(content: DataFrame) -> DataFrame:
    """artifact_id, project_id, start, evidence: the sentence of each promise marker, each text once. A text is read in its own row:
    markers are sought and merged, and their sentences cut, before anything is dealt out."""
    none = F.array().cast("array<struct<value:string,start:int,end:int>>")
    holds = lambda low, stems: reduce(Column.__or__, [F.contains(low, F.lit(s)) for s in stems])
    text = F.col("raw_text")
    # plain words cost less than patterns
    marked = lambda low: F.concat(*[F.when(holds(low, stems), find_spans(text, "(?i)" + p)).otherwise(none) for p, stems in zip(PROMISES, PROMISE_STEMS)])
    cut = lambda b: F.struct(b["start"].alias("start"), F.trim(F.substring(text, b["start"] + 1, b["end"] - b["start"])).alias("evidence"))
    sentences = lambda spans: F.transform(_merged(spans), lambda s: let(sentence_bounds(text, s["start"], s["end"]), cut))
    found = let(let(F.lower(text), marked), lambda spans: F.when(F.size(spans) > 0, sentences(spans)))
    rows = exploded(content, ["artifact_id", "project_id"], found, "s").select("artifact_id", "project_id", "s.start", "s.evidence")
    first = W.partitionBy("artifact_id", "norm").orderBy("start")
    return rows.withColumn("norm", F.lower(squeeze(F.col("evidence")))).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "norm")


def later_artifacts(sources: DataFrame, artifacts: DataFrame, dates: DataFrame) -> DataFrame:
    """artifact_id, later_id, later_ts: for each source the artifacts of its project with a later date; all
    others if the source has none. All pairs are the result; later_range gives their number and start."""
    src = sources.select("artifact_id", "project_id").distinct().join(dates.select("artifact_id", F.col("ts").alias("own")), "artifact_id", "left")
    other = artifacts.select(F.col("artifact_id").alias("later_id"), F.col("project_id").alias("_p")).join(dates.select(F.col("artifact_id").alias("later_id"), F.col("ts").alias("later_ts")), "later_id", "left")
    later = (F.col("project_id") == F.col("_p")) & (F.col("artifact_id") != F.col("later_id")) & (F.col("own").isNull() | (F.col("later_ts") > F.col("own")))
    return src.join(other, later).select("artifact_id", "project_id", "later_id", "later_ts")


def significant_tokens(text: Column) -> Column:
    return F.array_distinct(F.array_except(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)), F.array(*map(F.lit, STOPWORDS))))


def fulfillment(promises: DataFrame, content: DataFrame, dates: DataFrame) -> DataFrame:
    """promises with best and fulfilled: the largest share of a promise's significant words that one later
    text holds, also inside longer words.

    An automaton of the words of a project's promises reads each of its texts once. Texts that hold the same words of
    promises count as one, with the last of their dates, so that promises meet kinds of texts, not texts."""
    src = promises.select("artifact_id", "project_id", "start", significant_tokens(F.col("evidence")).alias("tokens")).where(F.size("tokens") > 0)
    src = src.join(dates.select("artifact_id", F.col("ts").alias("own")).hint("merge"), "artifact_id", "left")
    wanted = src.select("project_id", F.explode("tokens").alias("token")).distinct()
    held = held_keys(content.where("raw_text <> ''").select("project_id", F.col("artifact_id").alias("src"), F.lower("raw_text").alias("text")), wanted.withColumnRenamed("token", "key"))
    held = held.select("project_id", F.col("src").alias("later_id"), "held")
    dated = held.join(dates.select(F.col("artifact_id").alias("later_id"), F.col("ts").alias("later_ts")).hint("merge"), "later_id", "left")
    kinds = dated.groupBy("project_id", "held").agg(F.max("later_ts").alias("last"), F.min("later_id").alias("first_id"), F.max("later_id").alias("last_id"))
    sides = src.withColumn("token", F.explode("tokens")).join(kinds.withColumn("token", F.explode("held")).hint("merge"), ["project_id", "token"])
    # a dated promise is not later than itself; for an undated one any other text counts
    later = F.when(F.col("own").isNull(), (F.col("first_id") != F.col("artifact_id")) | (F.col("last_id") != F.col("artifact_id"))).otherwise(F.col("last") > F.col("own"))
    share = F.size(F.array_intersect("tokens", "held")) / F.size("tokens")
    scored = sides.where(later).groupBy("artifact_id", "start").agg(F.max(share).alias("best"))
    out = promises.join(scored.hint("merge"), ["artifact_id", "start"], "left")
    return out.withColumn("best", F.coalesce("best", F.lit(0.0))).withColumn("fulfilled", F.col("best") >= RULES.promise_overlap)


def _by_date(artifacts: DataFrame, dates: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """project_id, artifact_id, ts, number of the dated artifacts, numbered by date within their project."""
    dated = artifacts.select("project_id", "artifact_id").join(dates.select("artifact_id", "ts").hint("merge"), "artifact_id").where("ts is not null")
    return keep(numbered(dated, ["project_id"], ["ts", "artifact_id"], keep))


def _passed(sources: DataFrame, placed: DataFrame) -> DataFrame:
    """artifact_id, project_id, own, passed of each source: its date and the last number of that date; null without a date."""
    last = placed.groupBy("project_id", F.col("ts").alias("own")).agg(F.max("number").alias("passed"))
    own = sources.select("artifact_id", "project_id").distinct().join(placed.select("artifact_id", F.col("ts").alias("own")).hint("merge"), "artifact_id", "left")
    return own.join(last.hint("merge"), ["project_id", "own"], "left")


def later_excerpts(promises: DataFrame, content: DataFrame, artifacts: DataFrame, dates: DataFrame, keep: Callable[[DataFrame], DataFrame], n: int = 5, chars: int = 300) -> DataFrame:
    """The n soonest later texts of each promising artifact, shortened: the dated artifacts of a project are
    numbered by date, and a source takes the n numbers after those not later than it."""
    placed = _by_date(artifacts, dates, keep)
    next_ = _passed(promises, placed).withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("number", F.coalesce("passed", F.lit(0)) + F.col("rank"))
    near = next_.join(placed.select("project_id", "number", F.col("artifact_id").alias("later_id")).hint("merge"), ["project_id", "number"])
    texts = content.select(F.col("artifact_id").alias("later_id"), snippet(F.col("raw_text"), chars).alias("excerpt"))
    return near.join(texts.hint("merge"), "later_id").select("artifact_id", "later_id", F.col("rank").cast("long").alias("rank"), "excerpt")


def later_range(sources: DataFrame, artifacts: DataFrame, dates: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """artifact_id, n_later, first_ts: how many artifacts later_artifacts pairs each source with, and the first of their
    dates (null if none has one), without making the pairs; sources with none are left out."""
    placed = _by_date(artifacts, dates, keep)
    totals = artifacts.groupBy("project_id").agg(F.count("*").alias("n")).join(placed.groupBy("project_id").agg(F.max("number").alias("last")).hint("merge"), "project_id", "left")
    own = _passed(sources, placed).join(sized(keep(totals)), "project_id")
    n = F.when(F.col("own").isNull(), F.col("n") - 1).otherwise(F.col("last") - F.col("passed"))
    own = own.select("artifact_id", "project_id", n.alias("n_later"), (F.coalesce("passed", F.lit(0)) + 1).alias("number")).where("n_later > 0")
    first = placed.select("project_id", "number", F.col("ts").alias("first_ts"))
    return own.join(first.hint("merge"), ["project_id", "number"], "left").select("artifact_id", "n_later", "first_ts")


def has_later(sources: DataFrame, artifacts: DataFrame, dates: DataFrame) -> DataFrame:
    """artifact_id of the sources (artifact_id, project_id) after which the project has another artifact: one of
    a later date, any other one if the source has no date."""
    last = artifacts.select("artifact_id", "project_id").join(dates.select("artifact_id", "ts").hint("merge"), "artifact_id", "left").groupBy("project_id").agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    own = sources.select("artifact_id", "project_id").distinct().join(dates.select("artifact_id", F.col("ts").alias("own")).hint("merge"), "artifact_id", "left")
    later = F.when(F.col("own").isNull(), F.col("n") > 1).otherwise(F.col("last") > F.col("own"))
    return own.join(last.hint("merge"), "project_id").where(later).select("artifact_id")


def promised_gaps(promises: DataFrame, content: DataFrame, artifacts: DataFrame, dates: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Gaps of promises that nothing fulfils. verdicts (artifact_id, start, fulfilled, confidence) may
    settle the rest; without one a promise keeps a low confidence."""
    any_later = has_later(promises, artifacts, dates).withColumn("later", F.lit(True))
    rows = fulfillment(promises, content, dates).where("not fulfilled").join(any_later.hint("merge"), "artifact_id", "left")
    if verdicts is not None:
        given = verdicts.select("artifact_id", "start", F.col("fulfilled").alias("done"), F.col("confidence").alias("sure"))
        rows = rows.drop("fulfilled").join(given.hint("merge"), ["artifact_id", "start"], "left").where("later is null or done is null or not done")
        judged = F.when(F.col("sure").isNotNull(), F.least(F.lit(RULES.promise_judged_cap), F.col("sure")))
    else:
        judged = F.lit(None).cast("double")
    confidence = F.when(F.col("later").isNull(), RULES.promise_no_later_confidence).otherwise(F.coalesce(judged, F.lit(RULES.promise_unjudged_confidence)))
    return rows.select("project_id", F.lit("promised_unfulfilled").alias("type"), F.lit(None).cast("int").alias("phase_id"), F.col("evidence").alias("description"), F.col("artifact_id").cast("string").alias("evidence"), confidence.alias("confidence"))


def gap_key() -> Column:
    return F.when(F.col("type") == "structural", F.concat(F.lit("structural:"), F.col("phase_id"))).otherwise(F.concat(F.lit("promised:"), F.lower(squeeze(F.col("description")))))


def reconcile(drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """project_id, gap_key, action, status, confidence: new gaps are inserted open, open ones updated,
    reviewed ones preserved; open ones that no draft repeats are deleted."""
    new = drafts.withColumn("gap_key", gap_key()).groupBy("project_id", "gap_key").agg(F.max("confidence").alias("new"))
    old = existing.select("project_id", "gap_key", "status", F.col("confidence").alias("old"))
    reviewed = F.col("status") != "open"
    action = F.when(F.col("status").isNull(), "insert").when(reviewed, "preserve").when(F.col("new").isNull(), "delete").otherwise("update")
    confidence = F.when(reviewed, F.col("old")).otherwise(F.coalesce("new", "old"))
    return old.join(new, ["project_id", "gap_key"], "full_outer").select("project_id", "gap_key", action.alias("action"), F.coalesce("status", F.lit("open")).alias("status"), confidence.alias("confidence"))


def list_gaps(gaps: DataFrame, phases: DataFrame, status: str | None = None, type_: str | None = None) -> DataFrame:
    """gaps with the phase's name and their place in a listing, surest first; each filter given applies."""
    rows = gaps.where(F.col("status") == status) if status else gaps
    rows = rows.where(F.col("type") == type_) if type_ else rows
    place = F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("confidence"), "description"))
    return rows.join(sized(phases.select("phase_id", "phase_name").distinct()), "phase_id", "left").withColumn("place", place)
