"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions.storage import written  # noqa: F401  (for the operators)
from caseflow.session import configure

# Rows handed to one Python call are cut so that their texts hold about this
# many characters; one longer text makes a call of its own.
CHARS_PER_CALL = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(batches, text_col: str, chars: int = CHARS_PER_CALL):
    """Arrow batches joined or cut (whole rows) to about ``chars`` bytes of text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def joined():
        whole = pa.Table.from_batches(held).combine_chunks()
        return whole.to_batches()[0]

    held, have = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text_col)), 0).to_numpy(zero_copy_only=False),
                         dtype="int64")
        at = done = 0
        while at < b.num_rows:
            end = int(np.searchsorted(size, done + chars - have, side="right"))
            if end == at and not held:
                end = at + 1        # one text of more than ``chars``
            if end > at:
                held.append(b.slice(at, end - at))
                have += int(size[end - 1]) - done
                done = int(size[end - 1])
                at = end
            if at < b.num_rows:
                yield joined()
                held, have = [], 0
    if held:
        yield joined()
    del held
    pa.default_memory_pool().release_unused()


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across its tasks, until an
    operator asks for one of another name: one operator's memories at a time."""
    held = sys.modules.setdefault("_caseflow_worker_state", types.ModuleType("_caseflow_worker_state")).__dict__
    if held.get("name") != name:
        held["name"], held["cache"] = name, {}
    return held["cache"]


def lower_ascii(c):
    """A-Z lower-cased, all else untouched. ``lower`` does the same on ASCII texts
    and is faster than ``translate``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def one_row(rows: DataFrame, key: Column) -> DataFrame:
    """One of the rows of each ``key``, all columns: that with the smallest hash of its
    columns. Combines before its shuffle."""
    hashed = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind]
    held = rows.select(key.alias("k"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
                       F.xxhash64(*hashed).alias("h"))
    return held.groupBy("k").agg(F.min_by("row", "h").alias("row")).select("row.*")
