"""Dates in metadata and text as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import RULES
from .text import let

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: Month names and their abbreviations; a dot may follow these.
MONTH = rf"(?:{MONTHS}|(?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)\.?)"
RELATIVE = r"(?i)\b(?:yesterday|today|tomorrow|(?:last|next|past|coming|upcoming|this) (?:week|month|year)|\d+ (?:days?|weeks?|months?|years?) ago)\b"
EXPLICIT = rf"\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b{MONTH} \d{{1,2}}, \d{{4}}\b|\b\d{{1,2}} {MONTH} \d{{4}}\b|\b{MONTH} \d{{1,2}}\b|\b{MONTH},? \d{{4}}\b|\b\d{{1,2}} (?:{MONTHS})\b"
#: A word that dates vaguely: it tells nothing alone, and what follows it counts as relative.
VAGUE = r"(?i:\brecent(?:ly)?\b)"
#: Dates in text, or parts of them: explicit phrases, vague words, relative phrases, bare years.
DATE_PHRASE = rf"{EXPLICIT}|{VAGUE}|\b(?:19|20)\d{{2}}\b|{RELATIVE}"
#: DATE_PHRASE behind a look at how its phrases start: at most words none of its alternatives is tried,
#: and at most characters not even whether a word starts there.
DATE_SEARCH = rf"(?=[0-9JFMASONDrytlnpcuRYTLPCU])\b(?=[0-9JFMASOND]|(?i:recent|yesterday|today|tomorrow|(?:last|next|past|coming|upcoming|this) ))(?:{DATE_PHRASE})"
#: What may stand between the parts of one date: March 12, 2024.
DATE_GAP = r"^[,\s]{0,3}$"


def meta_timestamp(value: Column) -> Column:
    """PDF (D:YYYYMMDDHHmmSS, parts may be missing), EXIF (YYYY:MM:DD HH:MM:SS) or ISO 8601; else null."""
    pdf = r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?"
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(value, pdf, i), F.lit("")).cast("int"), F.lit(default))
    made = F.try_make_timestamp(part(1, 0), part(2, 1), part(3, 1), part(4, 0), part(5, 0), part(6, 0))
    exif = F.try_to_timestamp(value, F.lit("yyyy:MM:dd HH:mm:ss"))
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(value))
    return F.when(value.rlike(pdf), made).otherwise(F.coalesce(exif, iso))


def meta_kind(key: Column) -> Column:
    """created or modified by what the key contains; created is tested first."""
    low = F.lower(key)
    created = F.contains(low, F.lit("created")) | F.contains(low, F.lit("creationdate"))
    modified = F.contains(low, F.lit("modified")) | F.contains(low, F.lit("moddate"))
    return F.when(created, "created").when(modified, "modified")


def resolve_phrase(phrase: Column, anchor: Column) -> Column:
    """struct<ts, confidence, relative> of a date phrase. Relative ones count from the anchor; a month and
    day without a year is the last such day before it. Commas, the number of blanks, dots of abbreviations and leading
    vague words don't matter; these make a phrase relative. Years outside the plausible range give null, as do
    phrases that are several dates."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(phrase, r"(?<=\p{L})\.|,", " "), r"\s+", " "))
    stripped = F.regexp_replace(F.regexp_replace(flat, "^(?:" + VAGUE + " )+", ""), r"\bSept\b", "Sep")
    parts = F.struct(stripped.alias("body"), F.lower(stripped).alias("low"), flat.rlike("^" + VAGUE + " ").alias("vague"))
    return let(parts, lambda p: _resolved(p["body"], p["low"], p["vague"], anchor))


def _resolved(body: Column, low: Column, vague: Column, anchor: Column) -> Column:
    fmt = lambda f, text=body: F.coalesce(F.try_to_timestamp(text, F.lit(f)), F.try_to_timestamp(text, F.lit(f.replace("MMMM", "MMM"))))
    dated = F.concat(body, F.lit(" "), F.year(anchor).cast("string"))
    day_month = F.coalesce(fmt("MMMM d yyyy", dated), fmt("d MMMM yyyy", dated))
    recent = F.when(day_month > anchor, day_month - F.expr("interval 1 year")).otherwise(day_month)
    n = F.regexp_extract(low, r"^(\d+) ", 1).try_cast("int")
    unit = F.regexp_extract(low, r"(day|week|month|year)", 1)
    sign = F.when(low.rlike("^(last|past)"), -1).when(low.rlike("^(next|coming|upcoming)"), 1).when(low.rlike("^this"), 0)
    count = F.when(low == "yesterday", -1).when(low == "today", 0).when(low == "tomorrow", 1).when(low.rlike("ago$"), -n).otherwise(sign)
    days = F.when(unit == "week", count * 7).when(unit.isin("month", "year"), 0).otherwise(count)
    months = F.when(unit == "month", count).when(unit == "year", count * 12).otherwise(0)
    moved = anchor + F.make_interval(months=months, days=days)
    relative = body.rlike("^(?:" + RELATIVE + ")$")
    year = body.rlike(r"^\d{4}$")
    bare = F.try_make_timestamp(body.try_cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    explicit = F.coalesce(fmt("yyyy-MM-dd"), fmt("MMMM d yyyy"), fmt("d MMMM yyyy"), fmt("MMMM yyyy"), recent)
    ts = F.when(year, bare).when(relative, moved).otherwise(explicit)
    ts = F.when(F.year(ts).between(RULES.least_year, RULES.most_year), ts)
    confidence = F.when(year & ~vague, RULES.content_year_confidence).when(relative | vague, RULES.content_relative_confidence).otherwise(RULES.content_explicit_confidence)
    return F.struct(ts.alias("ts"), confidence.alias("confidence"), F.coalesce((relative | vague) & ~year, F.lit(False)).alias("relative"))


def recency_decay(day: Column, latest: Column, window: int = RULES.recency_window_days) -> Column:
    """1 at the latest date, falling to 0 over window days; 0 if either is null."""
    days = (F.unix_micros(latest) - F.unix_micros(day)) / F.lit(86400e6)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - days / window)), F.lit(0.0))
