"""Parse records from extracted parts.

A codec (not built here) yields parts: pages, slides, paragraphs, table cells, tags. These functions shape
parts of many files into one record per file: path, raw_text and what the file is made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ingest import header_names


def _joined(number: str, value: Column, separator: str) -> Column:
    """The values that aren't null, in order of number; null if there are none."""
    listed = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(number).alias("at"), value.alias("v")))))
    return F.when(F.size(listed) > 0, F.array_join(F.transform(listed, lambda s: s["v"]), separator))


def page_records(pages: DataFrame) -> DataFrame:
    """path, raw_text, page_count, likely_scanned of pages (path, page, text): pages with text, a blank line
    between them; a file without any is likely a scan."""
    text = F.when(F.trim("text") != "", F.col("text"))
    out = pages.groupBy("path").agg(_joined("page", text, "\n\n").alias("raw_text"), F.count("*").alias("page_count"))
    return out.withColumn("likely_scanned", F.col("raw_text").isNull())


def slide_records(slides: DataFrame) -> DataFrame:
    """path, raw_text, slide_count, slide_titles of slides (path, slide, title, texts: array): texts with
    a mark in front of each slide that has any; titles in order, null ones too."""
    parts = F.filter("texts", lambda t: F.trim(t) != "")
    body = F.when(F.size(parts) > 0, F.concat(F.lit("[Slide "), F.col("slide"), F.lit("]\n"), F.array_join(parts, "\n")))
    titles = F.transform(F.array_sort(F.collect_list(F.struct("slide", "title"))), lambda s: s["title"])
    return slides.groupBy("path").agg(_joined("slide", body, "\n\n").alias("raw_text"), F.count("*").alias("slide_count"), titles.alias("slide_titles"))


def paragraph_records(paragraphs: DataFrame) -> DataFrame:
    """path, raw_text, headings of paragraphs (path, place, text, style): those with text, line by line; headings
    are of a style whose name starts with Heading."""
    text = F.when(F.trim("text") != "", F.col("text"))
    heads = F.array_sort(F.collect_list(F.when(text.isNotNull() & F.col("style").startswith("Heading"), F.struct(F.col("place").alias("at"), F.col("text").alias("v")))))
    return paragraphs.groupBy("path").agg(_joined("place", text, "\n").alias("raw_text"), F.transform(heads, lambda s: s["v"]).alias("headings"))


def page_tables(cells: DataFrame) -> DataFrame:
    """path, source, row, record of cells (path, page, table, row, col, value): row 0 is the header; a table is
    named by its page and number; cells beyond the header are left out."""
    named = cells.withColumn("source", F.concat_ws("_", F.lit("page"), "page", F.lit("table"), "table")).drop("page", "table")
    key = F.to_json(F.struct("path", "source"))
    head = header_names(named.where("row = 0").select(key.alias("table_id"), F.col("col").alias("pos"), F.col("value").alias("cell")))
    body = named.where("row > 0").withColumn("table_id", key).join(head.withColumnRenamed("pos", "col").hint("merge"), ["table_id", "col"])
    pairs = F.array_sort(F.collect_list(F.struct("name", "value")))
    return body.groupBy("path", "source", "row").agg(F.map_from_entries(pairs).alias("record"))


def image_records(images: DataFrame, tags: DataFrame) -> DataFrame:
    """path, key, value of images (path, width, height, format) and their EXIF tags (path, tag, value):
    thumbnails are left out, tags get the prefix exif."""
    own = images.select("path", F.explode(F.create_map(F.lit("width"), F.col("width").cast("string"), F.lit("height"), F.col("height").cast("string"), F.lit("format"), F.col("format"))).alias("key", "value"))
    exif = tags.where(~F.contains(F.col("tag"), F.lit("Thumbnail"))).select("path", F.concat(F.lit("exif."), F.col("tag")).alias("key"), "value")
    return own.unionByName(exif)
