"""Text functions as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..config import RULES


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """The running totals of an int array under both (a sum, a maximum): each round joins to every place the one a stride before it,
    and the stride doubles, so n values take log2(n) passes."""

    def join(totals: Column, stride: Column) -> Column:
        moved = F.transform(totals, lambda x, i: F.when(i >= stride, both(x, F.get(totals, i - stride))).otherwise(x))
        return F.when(stride < F.size(totals), moved).otherwise(totals)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30)]), values, join)


def prefix_sums(values: Column) -> Column:
    """The running totals of an int array."""
    return running(values, lambda a, b: a + b)


def find_spans(text: Column, pattern: str) -> Column:
    """All non-overlapping matches of pattern, left to right, as array<struct<value, start, end>>; offsets
    count characters. Offsets are running totals of the lengths of the matches and of the pieces between them."""
    none = F.array().cast("array<struct<value:string,start:int,end:int>>")

    def placed(matches: Column) -> Column:
        steps = F.zip_with(matches, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda m, gap: F.length(gap) + F.length(m))
        spans = let(prefix_sums(steps), lambda ends: F.zip_with(matches, ends, lambda m, end: F.struct(m.alias("value"), (end - F.length(m)).alias("start"), end.alias("end"))))
        return F.when(F.size(matches) > 0, spans).otherwise(none)

    return F.coalesce(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed), none)


def exploded(rows: DataFrame, keys: list[str], values: Column, name: str) -> DataFrame:
    """keys and name, a row for each struct in values. Spark adds a filter on what explode is given, which makes a costly array
    again for that filter; it adds none to explode_outer, whose rows of empty arrays go here."""
    return rows.select(*keys, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def merge_adjacent(text: Column, spans: Column, gap: str) -> Column:
    """spans of text, those between which gap matches all there is joined to one; gap is a whole pattern."""

    def merged(found: Column) -> Column:
        between = lambda i: F.substring(text, F.get(found, i - 1)["end"] + 1, F.get(found, i)["start"] - F.get(found, i - 1)["end"])
        firsts = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | ~F.rlike(between(i), F.lit(gap)))

        def islands(at: Column) -> Column:
            start = lambda i: F.get(found, i)["start"]
            end = lambda k: F.get(found, F.coalesce(F.get(at, k + 1), F.size(found)) - 1)["end"]
            one = lambda i, k: F.struct(F.substring(text, start(i) + 1, end(k) - start(i)).alias("value"), start(i).alias("start"), end(k).alias("end"))
            return F.transform(at, one)

        return F.when(F.size(found) > 1, let(firsts, islands)).otherwise(found)

    return let(spans, merged)


def context_window(text: Column, start: Column, end: Column, radius: int = RULES.context_radius) -> Column:
    """The text from radius characters before start to radius after end."""
    lo = F.greatest(start - radius, F.lit(0))
    return F.substring(text, lo + 1, F.least(end + radius, F.length(text)) - lo)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, n: int) -> Column:
    return F.substring(squeeze(text), 1, n)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stem(filename: Column) -> Column:
    return F.regexp_extract(filename, r"^(\.*[^.].*?)(\.[^.]*)?$|^(\.*)$", 1)


def extension(filename: Column) -> Column:
    """Lower-cased last suffix with its dot, or empty; leading dots start no suffix."""
    return F.lower(F.regexp_extract(filename, r"^\.*[^.].*?(\.[^.]*)$", 1))


def file_type(filename: Column) -> Column:
    suffix = F.regexp_replace(extension(filename), r"^\.", "")
    return F.when(suffix == "", "unknown").otherwise(suffix)


def two_places(number: Column) -> Column:
    """A double as C and Python print %.2f: all its digits, rounded by its exact value, a tie to the even digit. Spark's own
    format rounds the shortest decimal that stands for it, ties up, and fills what that lacks with zeros."""

    @F.pandas_udf("string")
    def printed(x: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else f"{v:.2f}" for v in x], dtype=object)

    return printed(number)


def normalize_cost(value: Column) -> Column:
    """Amounts as %.2f with k and m applied; text without a number in lower case."""
    number = F.regexp_replace(value, "[^0-9.]", "").try_cast("double")
    scale = F.when(value.rlike(r"[kK]\b"), 1e3).when(value.rlike(r"[mM]\b"), 1e6).otherwise(1.0)
    return F.when(number.isNull(), squeeze(F.lower(value))).otherwise(two_places(number * scale))


def normalize_value(kind: Column, value: Column) -> Column:
    return F.when(kind == "cost", normalize_cost(value)).otherwise(F.lower(squeeze(value)))


def words(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    flat = squeeze(text)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def chunk_words(text: Column, size: int = RULES.chunk_size, overlap: int = RULES.chunk_overlap) -> Column:
    """Windows of size words that overlap; the last is the first that reaches the end."""
    step = max(1, size - overlap)
    w = words(text)
    last = F.ceil(F.greatest(F.lit(0), F.size(w) - size) / step).cast("int")
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", F.slice(w, i * step + 1, F.lit(size)))))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.4, "medium").otherwise("low")


def clean_name(suggested: Column, original: Column) -> Column:
    return F.coalesce(F.nullif(suggested, F.lit("")), original)


def signal_line(filename: Column, headings: Column, text: Column, n: int = 200, day: Column | None = None, entities: Column | None = None) -> Column:
    """filename | date: d | headings: a, b | entities: x, y | "snippet", without the parts that are empty."""
    heads = F.when(F.size(headings) > 0, F.concat(F.lit("headings: "), F.array_join(headings, ", ")))
    short = snippet(text, n)
    dated = F.concat(F.lit("date: "), F.date_format(day, "yyyy-MM-dd")) if day is not None else F.lit(None).cast("string")
    named = F.when(F.size(entities) > 0, F.concat(F.lit("entities: "), F.array_join(entities, ", "))) if entities is not None else F.lit(None).cast("string")
    return F.concat_ws(" | ", filename, dated, heads, named, F.when(short != "", F.concat(F.lit('"'), short, F.lit('"'))))


def structure_labels(headings: Column, sheets: Column, slides: Column) -> Column:
    """Headings, sheet names and slide titles in this order; missing titles are left out."""
    none = F.array().cast("array<string>")
    return F.array_compact(F.flatten(F.array(F.coalesce(headings, none), F.coalesce(sheets, none), F.coalesce(slides, none))))


def suggested_name(day: Column, slug: Column, entity: Column, ext: Column, most: int = RULES.name_chars) -> Column:
    """day_slug.ext of at most that many characters; the entity is added unless the slug has it."""
    base = F.when(slug == "", "artifact").otherwise(slug)
    tag = slugify(F.coalesce(entity, F.lit("")))
    full = F.when((tag != "") & ~F.contains(base, tag), F.concat_ws("-", base, tag)).otherwise(base)
    prefix = F.coalesce(F.concat(day, F.lit("_")), F.lit(""))
    room = F.greatest(F.lit(1), F.lit(most) - F.length(prefix) - F.length(ext))
    cut = F.regexp_replace(F.substring(full, F.lit(1), room), "^-+|-+$", "")
    return F.concat(prefix, F.when(cut == "", "artifact").otherwise(cut), ext)


def virtual_path(category: Column, day: Column, name: Column) -> Column:
    month = F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("undated"))
    return F.concat_ws("/", *[F.regexp_replace(p, "/", "-") for p in (category, month, name)])


def sentence_bounds(text: Column, start: Column, end: Column, radius: int = RULES.promise_radius) -> Column:
    """struct<start, end>: out to the nearest sentence end or blank line, radius characters at most; leading
    white space is left off."""
    lo, hi = F.greatest(start - radius, F.lit(0)), F.least(end + radius, F.length(text))
    before, after = F.substring(text, lo + 1, start - lo), F.substring(text, end + 1, hi - end)
    # a blank line counts from its first character
    back = F.length(F.regexp_extract(before, r"(?s)^(.*(?:[.!?]|\n(?=\n)))", 1))
    left = lo + back
    head = F.regexp_extract(after, r"(?s)^(.*?(?:[.!?]|\n(?=\n)))", 1)
    right = F.when(head != "", end + F.length(head)).otherwise(hi)
    body = F.substring(text, left + 1, end - left)
    left = left + F.length(body) - F.length(F.regexp_replace(body, r"^\s+", ""))
    return F.struct(left.alias("start"), right.alias("end"))


def balanced_span(text: Column) -> Column:
    """From the first bracket, curly or square, to the one that closes it; brackets in quoted strings don't
    count. Null if nothing closes it."""
    at = F.regexp_instr(text, F.lit(r"[{\[]"))
    rest = F.substring(text, at, F.length(text))
    first = F.substring(rest, 1, 1)
    last = F.when(first == "{", "}").otherwise("]")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        quote = (c == '"') & ~s["escaped"]
        depth = s["depth"] + F.when(s["quoted"], 0).when(c == first, 1).when(c == last, -1).otherwise(0)
        closes = ~s["quoted"] & (c == last) & (depth == 0)
        moved = F.struct(depth.alias("depth"), (s["quoted"] != quote).alias("quoted"), (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"), (s["seen"] + 1).alias("seen"), F.when(closes, s["seen"] + 1).otherwise(0).alias("end"))
        return F.when(s["end"] > 0, s).otherwise(moved)

    size = F.aggregate(F.split(rest, ""), zero, step, lambda s: s["end"])
    return F.when((at > 0) & (size > 0), F.substring(rest, F.lit(1), size))


def extract_json(text: Column) -> Column:
    """JSON text of a reply: all of it, the first fenced block, or the first balanced span of brackets."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    bare = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(bare(text)), valid(bare(fenced)), valid(balanced_span(text)))


def json_safe(value: Column, kind: str) -> Column:
    """A cell of a Spark type as JSON can hold it: dates and timestamps as ISO 8601, decimals as double."""
    if kind == "date":
        return F.date_format(value, "yyyy-MM-dd")
    if kind.startswith("timestamp"):
        micros = F.when(F.pmod(F.unix_micros(value.cast("timestamp")), F.lit(1_000_000)) != 0, F.date_format(value, ".SSSSSS")).otherwise("")
        return F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), micros)
    return value.cast("double") if kind.startswith("decimal") else value
