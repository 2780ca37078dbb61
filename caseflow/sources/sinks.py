"""Persisted logs and datasets, result tables.

All writes go to a shared folder (the caller's path, or the cluster's
``spark.checkpoint.dir`` for the caches) — never a machine-local temp folder.
A cache is written aside and published by a manifest, so what a failed write left
is never taken for it.
"""

from __future__ import annotations

import hashlib
import json
import os
from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions.published import current, files_key, new_folder, publish, read_published
from caseflow.session import ensure_checkpoint_dir


def cache_root(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "caseflow-cache")


def _cache_folder(spark: SparkSession, kind: str, name: str, root: Optional[str], sources, params: Optional[dict]) -> str:
    """The folder of a cached table: its key is made of the source files (names,
    lengths, times) and the parameters it was built with."""
    key = json.dumps([files_key(spark, sources) if sources else None, params], sort_keys=True, default=str)
    return "/".join([(root or cache_root(spark)).rstrip("/"), kind, name, hashlib.sha256(key.encode()).hexdigest()[:32]])


def _cached(spark: SparkSession, folder: str, build: Callable[[str], None], refresh: bool) -> DataFrame:
    """The table published in ``folder``; without one (or to ``refresh`` it) ``build``
    writes it to a new folder, which is published once the write has succeeded."""
    manifest = current(spark, folder)
    if refresh or manifest is None:
        data = new_folder(folder)
        build(data)
        publish(spark, folder, (manifest or {}) | {"data": data[len(folder) + 1:]})
    return read_published(spark, folder)


def cached_log(spark: SparkSession, name: str, build: Callable[[], DataFrame],
               root: Optional[str] = None, refresh: bool = False, sources=(), params: Optional[dict] = None) -> DataFrame:
    """Memoise a prepared log under ``root/logs/name``; later calls read it back.
    A change of the files below ``sources`` or of ``params`` builds it anew, and so
    does a call after a build that failed."""
    folder = _cache_folder(spark, "logs", name, root, sources, params)
    return _cached(spark, folder, lambda path: build().write.parquet(path), refresh)


def cached_dataset(spark: SparkSession, name: str, splits: Optional[dict] = None,
                   root: Optional[str] = None, refresh: bool = False, sources=(), params: Optional[dict] = None) -> DataFrame:
    """Store a built dataset per split (partitioned by ``split``) and read it
    back; ``refresh`` rebuilds, as do changed ``sources`` or ``params``.  Returns the
    stored table (filter on ``split``)."""

    def build(path: str) -> None:
        if splits is None:
            raise ValueError(f"dataset {name!r} is not cached and no splits were given")
        parts = [df.withColumn("split", F.lit(k)) for k, df in splits.items()]
        allp = parts[0]
        for p in parts[1:]:
            allp = allp.unionByName(p, allowMissingColumns=True)
        allp.write.partitionBy("split").parquet(path)

    return _cached(spark, _cache_folder(spark, "datasets", name, root, sources, params), build, refresh)


# Of text formats: a header, and timestamps to the microsecond.
_TEXT = {"header": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a result table (transition / prediction table, metrics)."""
    df.write.mode(mode).format(fmt).options(**_TEXT).save(path)


def save_csv(df: DataFrame, path: Optional[str], array_col: Optional[str] = None) -> None:
    """Optional CSV output; an array column is written as a JSON list; no path -> no-op."""
    if not path:
        return
    out = df.withColumn(array_col, F.to_json(F.col(array_col))) if array_col else df
    out.write.mode("overwrite").options(**_TEXT).csv(path)


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows (e.g. per-class confidence rows of a run) to an existing table."""
    df.write.mode("append").format(fmt).options(**_TEXT).save(path)
