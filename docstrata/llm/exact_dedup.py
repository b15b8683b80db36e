"""Exact deduplication with counting quotient filters.

Every partition turns the 64-bit fingerprints of its texts into counting quotient filters, one for
each range of quotients. Filters of one range meet in one task and merge by their sorted remainders,
without loss. Fingerprints that were counted more than once send their texts to byte verification,
which groups on the bytes of the text itself; all others are known to be unique.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, partitions

#: Fingerprints held before a partition emits its filters.
BUILD_ROWS = 1 << 21


class CountingQuotientFilter:
    """Fingerprints split into a quotient (an implied place) and a stored remainder.

    runs: how many remainders each quotient holds; remainders: sorted within their run;
    counts: how often each was added. Nothing is lost: (quotient, remainder) is the fingerprint.
    """

    def __init__(self, first: int, q_bits: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.first, self.q_bits, self.runs, self.remainders, self.counts = first, q_bits, runs, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """Of uint64 fingerprints, in any order, repeated or not."""
        if counts is None:
            keys, counts = np.unique(fingerprints, return_counts=True)
        else:
            order = np.argsort(fingerprints, kind="stable")
            sorted_keys = fingerprints[order]
            starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(order) else np.zeros(0, int)
            keys, counts = sorted_keys[starts], (np.add.reduceat(counts[order], starts) if len(order) else counts)
        q_bits = min(62, max(1, int(np.ceil(np.log2(max(len(keys), 1) / 0.75)))))
        # quotients count from the first one: a filter of a narrow range stays small
        spread = int(keys[-1] - keys[0]) + 1 if len(keys) else 1
        r_bits = max(0, spread.bit_length() - q_bits)
        first = int(keys[0]) >> r_bits if len(keys) else 0
        quotient = (keys >> np.uint64(r_bits)).astype(np.uint64) - np.uint64(first)
        runs = np.bincount(quotient.astype(np.int64)) if len(keys) else np.zeros(0, np.int64)
        return cls(first, r_bits, runs.astype(np.uint32), keys & np.uint64((1 << r_bits) - 1), counts.astype(np.int64))

    def fingerprints(self) -> np.ndarray:
        """The distinct fingerprints, in order."""
        quotient = np.repeat(np.arange(len(self.runs), dtype=np.uint64) + np.uint64(self.first), self.runs)
        return (quotient << np.uint64(self.q_bits)) | self.remainders

    def to_bytes(self) -> bytes:
        more = np.flatnonzero(self.counts > 1)  # counters only where they say anything
        head = np.array([self.first, self.q_bits, len(self.runs), len(self.remainders), len(more)], np.uint64)
        width = max(1, (self.q_bits + 7) // 8)
        packed = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        return head.tobytes() + self.runs.tobytes() + packed + more.astype(np.uint32).tobytes() + self.counts[more].tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        first, bits, n_runs, n, n_more = (int(x) for x in np.frombuffer(data, np.uint64, 5))
        at, width = 40, max(1, (bits + 7) // 8)
        runs = np.frombuffer(data, np.uint32, n_runs, at)
        at += 4 * n_runs
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        counts = np.ones(n, np.int64)
        counts[np.frombuffer(data, np.uint32, n_more, at)] = np.frombuffer(data, np.int64, n_more, at + 4 * n_more)
        return cls(first, bits, runs, wide.view("<u8").ravel(), counts)

    @classmethod
    def merge(cls, filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Adds up the counts of equal fingerprints; the inputs are sorted, so a stable sort merges their runs."""
        parts = list(filters)
        if not parts:
            return cls.build(np.zeros(0, np.uint64))
        return cls.build(np.concatenate([p.fingerprints() for p in parts]), np.concatenate([p.counts for p in parts]))

    def count(self, fingerprint: int) -> int:
        keys = self.fingerprints()
        at = int(np.searchsorted(keys, np.uint64(fingerprint)))
        return int(self.counts[at]) if at < len(keys) and int(keys[at]) == fingerprint else 0


def _build_filters(shard_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            shard = (keys >> np.uint64(64 - shard_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            parts = [CountingQuotientFilter.build(keys[a:b]).to_bytes() for a, b in zip(cuts[:-1], cuts[1:])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]], pa.int64()), pa.array(parts, pa.binary())], ["shard", "filter"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= BUILD_ROWS:
                yield flush()
        if held:
            yield flush()

    return build


def _merge_filters(key, group: pd.DataFrame) -> pd.DataFrame:
    merged = CountingQuotientFilter.merge(map(CountingQuotientFilter.from_bytes, group["filter"]))
    more = merged.counts > 1
    return pd.DataFrame({"fp": merged.fingerprints()[more].view(np.int64), "times": merged.counts[more]})


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """fp, times of every fingerprint in the one bigint column given that occurs more than once."""
    shard_bits = max(4, (4 * partitions(fingerprints.sparkSession) - 1).bit_length())
    filters = fingerprints.mapInArrow(_build_filters(shard_bits), "shard long, filter binary")
    return filters.groupBy("shard").applyInPandas(_merge_filters, "fp long, times long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the largest
    doc_id stays, a null doc_id last; of rows that repeat both, exactly one is kept. An empty table
    gives an empty result; other columns of docs are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("fp", F.xxhash64("text"))
    narrow = cut(base.select("doc_id", "fp", F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("rid")))
    # the size of a table made in Python isn't known to Spark: written out, and joined by hint
    repeated = cut(repeated_fingerprints(narrow.select("fp")).select("fp"))
    routed = base.select("fp", "text").join(repeated.hint("shuffle_hash"), "fp", "left_semi")
    # grouping on other keys than the join's makes Spark pre-aggregate: a large group leaves few rows
    verified = routed.groupBy("text").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("text").alias("fp"), F.sha2("text", 256).alias("sha"), "n")
    keeper = narrow.groupBy("fp", "sha").agg(F.max(F.struct("doc_id", "rid")).alias("keep"))
    groups = cut(verified.join(keeper.hint("merge"), ["fp", "sha"]).select("fp", "sha", "n", F.col("keep.doc_id").alias("keep_id"), F.col("keep.rid").alias("keep_rid")))
    out = narrow.join(groups.hint("merge"), ["fp", "sha"], "left")
    alone = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
