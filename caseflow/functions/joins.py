"""Size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest small side we broadcast after checking its size.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 << 20


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows and ``max_bytes`` bytes
    (8 a column and the lengths of strings), else ``df`` unchanged (the join then
    shuffles and AQE can still split skew).  The check runs a job on ``df``, so
    pass small, already materialised frames (vocabularies, written aggregates)."""
    text = [F.coalesce(F.octet_length(c.name), F.lit(0)) for c in df.schema if isinstance(c.dataType, T.StringType)]
    size = sum(text, F.lit(8 * len(df.columns)))
    got = df.limit(max_rows + 1).select(size.alias("b")).agg(F.count("b").alias("n"), F.sum("b").alias("b")).first()
    return F.broadcast(df) if got["n"] <= max_rows and (got["b"] or 0) <= max_bytes else df
