"""Phase templates, domains and assignments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..config import RULES
from ..functions.text import signal_line
from ..functions.vocabulary import PHASES
from ..joins import sized
from .order import numbered
from .serve import page


def phase_templates(spark: SparkSession) -> DataFrame:
    """phase_id, domain, ordinal, phase_name."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PHASES)], "phase_id int, domain string, ordinal int, phase_name string")


def candidate_domains(templates: DataFrame) -> DataFrame:
    return templates.where("domain <> 'generic'").select("domain").distinct()


def template_domain(classification: DataFrame, templates: DataFrame, least: float = RULES.template_min_confidence) -> DataFrame:
    """project_id, template_domain: the project's domain if it is sure enough and has phases, else generic."""
    known = sized(templates.select(F.col("domain").alias("_d")).distinct())
    joined = classification.join(known, F.col("domain") == F.col("_d"), "left")
    return joined.select("project_id", F.when((F.col("confidence") >= least) & F.col("_d").isNotNull(), F.col("domain")).otherwise("generic").alias("template_domain"))


def project_phases(domains: DataFrame, templates: DataFrame) -> DataFrame:
    """The phases of each project's template."""
    return domains.join(sized(templates), domains["template_domain"] == templates["domain"]).select("project_id", "phase_id", "domain", "ordinal", "phase_name")


def phase_coverage(phases: DataFrame, assignments: DataFrame) -> DataFrame:
    """phases (project_id, phase_id, phase_name) with how many artifacts each has, 0 included."""
    counts = assignments.groupBy("project_id", "phase_id").agg(F.countDistinct("artifact_id").alias("n"))
    return phases.join(counts.hint("merge"), ["project_id", "phase_id"], "left").select("project_id", "phase_id", "phase_name", F.coalesce("n", F.lit(0)).cast("long").alias("artifacts"))


def choose_category(assignments: DataFrame, phases: DataFrame) -> DataFrame:
    """The phase of each artifact with the most confidence; then human ones, the earliest phase and the
    largest id come first."""
    order = W.partitionBy("artifact_id").orderBy(F.desc("confidence"), (F.col("source") == "human").desc(), "ordinal", F.desc("phase_id"))
    named = assignments.join(sized(phases.select("phase_id", "phase_name", "ordinal").distinct()), "phase_id")
    return named.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("artifact_id", F.col("phase_name").alias("category"))


def merge_assignments(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Human rows of existing, and proposed rows of pairs that no human row has; automatic rows go."""
    human = existing.where("source = 'human'")
    new = proposed.join(human.select("artifact_id", "phase_id"), ["artifact_id", "phase_id"], "left_anti")
    return human.select("artifact_id", "phase_id", "confidence", "source").unionByName(new.select("artifact_id", "phase_id", "confidence", F.lit("auto").alias("source")))


def domain_inputs(artifacts: DataFrame, entities: DataFrame, most: int = 40, top: int = 20) -> DataFrame:
    """project_id, prompt: signal lines of the first artifacts and the entities mentioned most."""
    first = artifacts.withColumn("rn", F.row_number().over(W.partitionBy("project_id").orderBy("ingested_at", "artifact_id"))).where(F.col("rn") <= most)
    line = signal_line(F.col("original_filename"), F.col("headings"), F.col("raw_text"))
    ordered = lambda line: F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))), lambda s: s["line"])
    heads = first.groupBy("project_id").agg(ordered(line).alias("a"))
    best = entities.withColumn("rn", F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("mentions"), "kind", "normalized_value"))).where(F.col("rn") <= top)
    named = best.groupBy("project_id").agg(ordered(F.format_string("%s: %s (%dx)", "kind", "normalized_value", "mentions")).alias("e"))
    none = F.array().cast("array<string>")
    return heads.join(named, "project_id", "left").select("project_id", F.array_join(F.concat("a", F.coalesce("e", none)), "\n").alias("prompt"))


def batches(items: DataFrame, size: int, keep: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ("project_id",), order: tuple[str, ...] = ("ingested_at", "artifact_id")) -> DataFrame:
    """items with batch and batch_index: consecutive slices of size rows of each key; order tells its rows apart. keep
    writes a table to the shared folder and reads it again."""
    at = F.col("number") - 1
    placed = numbered(items, list(keys), list(order), keep)
    return placed.withColumn("batch", F.floor(at / size).cast("int")).withColumn("batch_index", (at % size).cast("int")).drop("number")


def assignments_page(assignments: DataFrame, phases: DataFrame, names: DataFrame, limit: int, offset: int) -> DataFrame:
    """project_id, artifact_id, name, phase_name, confidence, source: a page of assignments, the surest first."""
    rows = assignments.join(sized(phases.select("phase_id", "phase_name").distinct()), "phase_id")
    cut = page(rows, [F.desc("confidence"), "artifact_id", "phase_name"], limit, offset)
    return cut.join(names.hint("merge"), "artifact_id").select("project_id", "artifact_id", "name", "phase_name", "confidence", "source")
