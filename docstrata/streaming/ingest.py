"""Incremental ingest and timeline with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import file_type
from ..operators.extract import entity_mentions, resolved_dates
from ..operators.report import timeline
from ..sources.files import parse_documents


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """New files of folder as they arrive, with their content hash."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return rows.select("path", "content", F.col("modificationTime").alias("fs_modified"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"), name.alias("original_filename"), file_type(name).alias("file_type"))


def stream_ingest(files: DataFrame, target: str, checkpoint: str, project_id: int | Column = 0) -> StreamingQuery:
    """Appends each content of files once, under one of its paths, to the Parquet table at target. The project and hash of what
    was seen are keyed state, kept by RocksDB: a micro-batch reads the state of its own keys, never the target,
    so what it costs doesn't grow with what was ingested before."""
    files.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    once = files.withColumn("project_id", project_id if isinstance(project_id, Column) else F.lit(project_id)).dropDuplicates(["project_id", "content_hash"])
    rows = once.select("project_id", "content_hash", "path", "original_filename", "file_type", "size_bytes", "fs_modified", "content")
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_events(files: DataFrame, target: str, checkpoint: str, project_id: int = 0) -> StreamingQuery:
    """Parses, extracts and places each micro-batch of files: mentions, resolved dates and timeline events of the
    batch's new texts are written below target, each batch to its own folder, so that a batch that is run
    again replaces what it wrote. An artifact is known by its content hash."""

    def write(batch: DataFrame, batch_id: int) -> None:
        once = batch.dropDuplicates(["content_hash"])
        parsed = parse_documents(once.select("path", "content", "file_type")).select("path", "raw_text")
        ids = once.select("path", F.xxhash64("content_hash").alias("artifact_id"), F.lit(project_id).alias("project_id"), "original_filename", F.lit(None).cast("timestamp").alias("fs_created"), "fs_modified")
        ids.join(parsed.hint("merge"), "path").write.mode("overwrite").parquet(f"{target}/artifacts/batch={batch_id}")
        artifacts = batch.sparkSession.read.parquet(f"{target}/artifacts/batch={batch_id}")
        content = artifacts.select("artifact_id", "project_id", "raw_text")
        dates = resolved_dates(artifacts, content)
        for name, rows in (("mentions", entity_mentions(content)), ("dates", dates), ("events", timeline(dates, artifacts))):
            rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def placements(spark: SparkSession, folder: str) -> DataFrame:
    """The timeline events that stream_events wrote to folder, as a stream."""
    schema = "project_id int, artifact_id long, event_date timestamp, source string, description string, confidence double"
    return spark.readStream.schema(schema).parquet(f"{folder}/events/*")


def stream_placements(events: DataFrame, delay: str = "30 days", width: str = "30 days") -> DataFrame:
    """Placement events of a stream (project_id, event_date, source) by project and tumbling window."""
    placed = events.where(F.col("source").startswith("placement:")).withWatermark("event_date", delay)
    counts = placed.groupBy(F.window("event_date", width).alias("w"), "project_id").agg(F.count("*").alias("events"))
    return counts.select("project_id", F.col("w.start").alias("start"), "events")


def stream_timeline(events: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts and value sums of events (ts, event_type, value) by type and tumbling window; events later than delay are
    dropped, and a window is final once the watermark passes it."""
    late = events.withWatermark("ts", delay)
    return late.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")
