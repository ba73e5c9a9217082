"""Size checks that gate every explicit broadcast.

A side is broadcast only when the optimizer's size estimate (from file sizes
or literal row counts, no scan) times a decompression safety factor is under
the limit. Otherwise nothing is hinted: Catalyst plans a shuffle join and AQE
may still switch it to a broadcast at run time, on measured shuffle sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BYTES = 64 * 1024 * 1024
# parquet/zstd on disk vs UnsafeRow in memory: be pessimistic
SAFETY_FACTOR = 5


def estimated_bytes(df: DataFrame) -> int | None:
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # pragma: no cover - non-JVM (Connect) sessions
        return None


def fits_broadcast(df: DataFrame, max_bytes: int = DEFAULT_MAX_BYTES) -> bool:
    est = estimated_bytes(df)
    return est is not None and est * SAFETY_FACTOR <= max_bytes


def maybe_broadcast(df: DataFrame, max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` when its checked size allows, else ``df`` unchanged."""
    return F.broadcast(df) if fits_broadcast(df, max_bytes) else df
