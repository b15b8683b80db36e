"""Files as DataFrames: discovery, hashing, and parse handlers by extension."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import file_type

#: What every handler returns, besides the path: text, structure, metadata and tables as JSON-like columns.
RECORD = "path string, status string, raw_text string, headings array<string>, metadata map<string,string>, tables array<struct<source:string, columns:array<string>, rows:array<map<string,string>>>>, parser string, error string"
ERROR_CHARS = 2000
#: Bytes decoded and records passed on at a time.
CSV_BYTES = 1 << 20
CSV_ROWS = 4096


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, content, size_bytes, fs_modified, content_hash, original_filename, file_type of the files below
    root. Paths with a part that starts with a dot, __pycache__ or node_modules are left out; Spark's
    readers also hide names that start with an underscore."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_replace("path", "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    rows = rows.where(~below.rlike(r"(^|/)(\.[^/]*|__pycache__|node_modules)(/|$)"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return rows.select("path", "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("fs_modified"), F.sha2("content", 256).alias("content_hash"), name.alias("original_filename"), file_type(name).alias("file_type"))


def parse_text(content: bytes, path: str) -> dict:
    """UTF-8 with replacement; an empty file has no text. Markdown headings are structure."""
    text = content.decode("utf-8", "replace")
    heads = [line.lstrip("#").strip() for line in text.split("\n") if path.endswith((".md", ".markdown")) and line.startswith("#")]
    return {"raw_text": text or None, "headings": heads, "metadata": {}, "tables": []}


def unique_names(header: list[str]) -> list[str]:
    """Blank cells become col_i; repeated names get _1, _2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for i, cell in enumerate(header):
        name = (cell or "").strip() or f"col_{i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}_{n}" if n else name)
    return out


def csv_lines(content: bytes) -> Iterator[list[str]]:
    """The records of a CSV file, decoded as they are read: UTF-8, and Latin-1 if that fails anywhere."""
    try:
        decoder = codecs.getincrementaldecoder("utf-8")()
        for at in range(0, len(content), CSV_BYTES):
            decoder.decode(content[at : at + CSV_BYTES], at + CSV_BYTES >= len(content))
        encoding = "utf-8"
    except UnicodeDecodeError:
        encoding = "latin-1"
    yield from csv.reader(io.TextIOWrapper(io.BytesIO(content), encoding, newline=""))


def parse_csv(content: bytes, path: str) -> dict:
    """All cells as text; rows with more cells than the header are left out. For tables of any size use csv_rows, which
    gives rows instead of one record for the file."""
    lines = csv_lines(content)
    columns = unique_names(next(lines, []))
    records = [dict(zip(columns, r + [""] * (len(columns) - len(r)))) for r in lines if len(r) <= len(columns)]
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    body = [" | ".join(r.values()) for r in records if any(v.strip() for v in r.values())][:50]
    lines = [path.rsplit("/", 1)[-1], "", f"Sheet: {name}", "Columns: " + ", ".join(columns), *body]
    return {"raw_text": "\n".join(lines)[:20_000] if columns else None, "headings": [], "metadata": {}, "tables": [{"source": name, "columns": columns, "rows": records}] if columns else []}


def csv_rows(files: DataFrame) -> DataFrame:
    """path, row_no (from 1), columns, cells of the records of files (path, content), CSV with a header: cells as text, as
    many as there are columns; rows with more cells are left out, an empty file has none. Records leave the
    worker CSV_ROWS at a time, so besides the file's bytes its memory doesn't grow with the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                lines = csv_lines(content.as_py() or b"")
                columns, number = unique_names(next(lines, [])), 0
                while rows := list(islice(lines, CSV_ROWS)):
                    numbers = [n for n, r in enumerate(rows, number + 1) if len(r) <= len(columns)]
                    cells = [r + [""] * (len(columns) - len(r)) for r in rows if len(r) <= len(columns)]
                    number += len(rows)
                    n, texts = len(cells), pa.list_(pa.string())
                    yield pa.record_batch([pa.array([path.as_py()] * n, pa.string()), pa.array(numbers, pa.int64()), pa.array([columns] * n, texts), pa.array(cells, texts)], ["path", "row_no", "columns", "cells"])

    return files.select("path", "content").mapInArrow(run, "path string, row_no long, columns array<string>, cells array<string>")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One large CSV file as a table of text columns, which Spark splits among its tasks: records end at line ends.
    Columns are named as csv_rows names them."""
    head = spark.read.text(path).limit(1).collect()
    names = unique_names(next(csv.reader([head[0].value]), [])) if head else []
    table = spark.read.option("header", True).option("enforceSchema", True)
    return table.schema(", ".join(f"`{n}` string" for n in names)).csv(path) if names else spark.createDataFrame([], "path string")


HANDLERS: dict[str, Callable[[bytes, str], dict]] = {"txt": parse_text, "md": parse_text, "markdown": parse_text, "csv": parse_csv}


def parse_documents(files: DataFrame, handlers: dict[str, Callable[[bytes, str], dict]] | None = None) -> DataFrame:
    """A RECORD row for each of files (path, content, file_type). Types without a handler are skipped with
    status unsupported; a handler that raises gives status error and the start of its message."""
    known = HANDLERS | (handlers or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content, kind in zip(frame["path"], frame["content"], frame["file_type"]):
                row = {"path": path, "status": "parsed", "raw_text": None, "headings": [], "metadata": {}, "tables": [], "parser": kind, "error": None}
                try:
                    row |= known[kind](bytes(content), path)
                except Exception as e:  # a bad file must not stop the others
                    row |= {"status": "error", "error": f"{type(e).__name__}: {e}"[:ERROR_CHARS]}
                out.append(row)
            yield pd.DataFrame(out, columns=["path", "status", "raw_text", "headings", "metadata", "tables", "parser", "error"])

    supported = files.where(F.col("file_type").isin(*known)).select("path", "content", "file_type")
    rest = files.where(~F.col("file_type").isin(*known)).select("path", F.lit("unsupported").alias("status"))
    return supported.mapInPandas(run, RECORD).unionByName(rest, allowMissingColumns=True)
