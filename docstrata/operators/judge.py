"""Judgments: replies of a pluggable model, parsed and checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import extract_json, slugify
from ..joins import sized


def judge(batches: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """batches with the column response that fn adds; fn sees the batches of one task."""
    return batches.mapInPandas(fn, ", ".join(f"`{n}` {t}" for n, t in batches.dtypes) + ", response string")


def parse_assignments(responses: DataFrame, known: DataFrame, batch_size: int = 5) -> DataFrame:
    """project_id, batch, batch_index, phase_name, confidence from replies of the form
    [{"index", "phase", "confidence"}]: confidences are clamped to 0..1, phases matched without case to
    known (phase_name), entries with another index, phase or no number left out."""
    schema = "array<struct<index: int, phase: string, confidence: double>>"
    rows = responses.select("project_id", "batch", F.explode(F.from_json(extract_json(F.col("response")), schema)).alias("x"))
    rows = rows.where(F.col("x.index").between(0, batch_size - 1) & F.col("x.confidence").isNotNull())
    names = sized(known.select("phase_name", F.lower("phase_name").alias("_n")).distinct())
    joined = rows.join(names, F.lower(F.trim("x.phase")) == F.col("_n"))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "x.confidence"))
    return joined.select("project_id", "batch", F.col("x.index").alias("batch_index"), "phase_name", clamped.alias("confidence")).distinct()


def parse_domains(responses: DataFrame, candidates: DataFrame) -> DataFrame:
    """project_id, domain, confidence of replies (project_id, response) of the form {"domain", "confidence"}:
    generic, with 0, where there is no JSON, no number or a domain that isn't in candidates (domain)."""
    read = F.from_json(extract_json(F.col("response")), "domain string, confidence double")
    rows = responses.select("project_id", read.alias("x"))
    known = sized(candidates.select(F.col("domain").alias("_d")).distinct())
    joined = rows.join(known, F.col("x.domain") == F.col("_d"), "left")
    good = F.col("_d").isNotNull() & F.col("x.confidence").isNotNull()
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "x.confidence"))
    return joined.select("project_id", F.when(good, F.col("_d")).otherwise("generic").alias("domain"), F.when(good, clamped).otherwise(0.0).alias("confidence"))


def _entries(responses: DataFrame, field: str, entry: str, index: str, batch_size: int) -> DataFrame:
    """responses (keys and response) with x, the last valid entry of each index of the list in field."""
    keys = [c for c in responses.columns if c != "response"]
    read = F.from_json(extract_json(F.col("response")), f"{field} array<struct<{entry}>>")
    rows = responses.select(*keys, F.posexplode(read[field]).alias("nth", "x")).where(F.col(f"x.{index}").between(0, batch_size - 1))
    return rows.select(*keys, "nth", F.col(f"x.{index}").alias("batch_index"), "x")


def parse_promises(responses: DataFrame, batch_size: int = 8) -> DataFrame:
    """keys, batch_index, fulfilled, confidence of replies of the form {"judgments": [{"candidate_index",
    "fulfilled", "confidence"}]}: entries of another index, without a boolean or number are left out, the
    last of an index counts, confidences are clamped to 0..1."""
    keys = [c for c in responses.columns if c != "response"]
    rows = _entries(responses, "judgments", "candidate_index: int, fulfilled: boolean, confidence: double", "candidate_index", batch_size)
    rows = rows.where(F.col("x.fulfilled").isNotNull() & F.col("x.confidence").isNotNull())
    last = rows.groupBy(*keys, "batch_index").agg(F.max_by("x", "nth").alias("x"))
    return last.select(*keys, "batch_index", "x.fulfilled", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "x.confidence")).alias("confidence"))


def parse_names(responses: DataFrame, batch_size: int = 5, least_chars: int = 3) -> DataFrame:
    """keys, batch_index, slug of replies of the form {"names": [{"artifact_index", "slug"}]}: slugs are
    normalised, those that get too short and entries of another index are left out."""
    keys = [c for c in responses.columns if c != "response"]
    rows = _entries(responses, "names", "artifact_index: int, slug: string", "artifact_index", batch_size)
    rows = rows.withColumn("slug", slugify(F.coalesce("x.slug", F.lit("")))).where(F.length("slug") >= least_chars)
    return rows.groupBy(*keys, "batch_index").agg(F.max_by("slug", "nth").alias("slug"))


def parse_narrative(responses: DataFrame) -> DataFrame:
    """keys, narrative of replies of the form {"narrative": text}; null where there is none."""
    keys = [c for c in responses.columns if c != "response"]
    read = F.from_json(extract_json(F.col("response")), "narrative string")["narrative"]
    return responses.select(*keys, F.nullif(F.trim(read), F.lit("")).alias("narrative"))
