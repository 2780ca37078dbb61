"""Folders whose content is written aside first and published by a manifest last.

A manifest is a small JSON file ``_published/v<number>.json`` that names the data it
stands for. Readers take the newest one, so they see either all of a version or
nothing of it: a job that fails half-way leaves files that no manifest names. One
writer at a time; a writer that finds its version published already fails.
"""

from __future__ import annotations

import json
import uuid
from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDER = "_published"


def _path(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _newest(spark: SparkSession, folder: str) -> int:
    p, fs = _path(spark, f"{folder}/{_FOLDER}")
    if not fs.exists(p):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)


def _file(folder: str, version: int) -> str:
    return f"{folder}/{_FOLDER}/v{version:012d}.json"


def current(spark: SparkSession, folder: str) -> Optional[dict]:
    """The newest manifest with its ``version``, or None."""
    version = _newest(spark, folder)
    if not version:
        return None
    text = spark.read.text(_file(folder, version), wholetext=True).first()["value"]
    return json.loads(text) | {"version": version}


def publish(spark: SparkSession, folder: str, manifest: dict) -> int:
    """Publish ``manifest`` as the next version after ``manifest['version']`` (0: none)."""
    version = manifest.get("version", 0) + 1
    final, fs = _path(spark, _file(folder, version))
    aside, _ = _path(spark, f"{folder}/{_FOLDER}/.{uuid.uuid4().hex}")
    if fs.exists(final):
        raise RuntimeError(f"version {version} of {folder} was published by another writer")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "version"}).encode()))
    out.close()
    if not fs.rename(aside, final):
        raise RuntimeError(f"version {version} of {folder} could not be published")
    return version


def new_folder(folder: str) -> str:
    """A folder below ``folder`` that no other write uses."""
    return f"{folder}/data/{uuid.uuid4().hex}"


def files_key(spark: SparkSession, paths) -> str:
    """A digest of names, lengths and times of the files below ``paths``; the files are
    listed by Spark and not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
             .select("path", "length", "modificationTime"))
    got = files.agg(F.count("path").alias("n"), F.sum("length").alias("bytes"),
                    F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("x")).first()
    return f"{got['n']}-{got['bytes']}-{got['x']}"


def read_published(spark: SparkSession, folder: str) -> Optional[DataFrame]:
    """The table that the newest manifest of ``folder`` names (key ``data``), or None."""
    manifest = current(spark, folder)
    return None if manifest is None else spark.read.parquet(f"{folder}/{manifest['data']}")
