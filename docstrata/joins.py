"""Join hints that follow from counted sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Bytes, as JSON, up to which the smaller side of a join is broadcast.
BROADCAST_BYTES = 8 << 20


def sized(small: DataFrame, kind: str = "merge") -> DataFrame:
    """small with the hint to broadcast it if its counted bytes allow that, else with another."""
    held = small.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(small) if held <= BROADCAST_BYTES else small.hint(kind)
