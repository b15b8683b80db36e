"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space, as every contract of this subpackage means it.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. A session on one machine that
    names none gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it back: lineage ends, sizes are known."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.written_to = path
    return read


def discard(*written: DataFrame) -> None:
    """Deletes the files of tables that cut returned and that no later plan reads."""
    for df in written:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets the driver forget plans that nothing refers to, so that executors delete their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uniform(*cols: Column) -> Column:
    """A double in (0, 1) that depends on cols only."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


#: Tables up to this many bytes, as JSON, are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def sized(small: DataFrame, kind: str = "shuffle_hash") -> DataFrame:
    """A written table, with the hint to broadcast it if its counted bytes allow that."""
    held = small.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(small) if held <= BROADCAST_BYTES else small.hint(kind)
