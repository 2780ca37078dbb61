"""A stored table with a primary key, merged batch by batch (last write wins).

Rows live in hash buckets of the key. A merge reads and rewrites only the buckets
that its batch touches, into a new folder, and publishes the new version at once:
readers see the table before or after a batch, never between. The batches that a
version holds are named in its manifest, so a batch that is merged again, as after
a failure, changes nothing.
"""

from __future__ import annotations

from typing import Iterable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions.published import current, new_folder, publish


class StoredTable:
    """``path``: its folder; ``keys``: the primary key (null is a value); ``buckets``:
    fixed when the first batch is merged, choose it so that a bucket fits a task."""

    def __init__(self, spark: SparkSession, path: str, keys: Iterable[str] = ("run_id", "step"), buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _read(self, schema: T.StructType, folders) -> Optional[DataFrame]:
        folders = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*folders) if folders else None

    def read(self) -> Optional[DataFrame]:
        """The newest version, or None before the first batch."""
        manifest = current(self.spark, self.path)
        if manifest is None:
            return None
        schema = T.StructType.fromJson(manifest["schema"])
        found = self._read(schema, manifest["buckets"].values())
        return found if found is not None else self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, batch_id: str, order: Iterable[str]) -> bool:
        """Put the rows of ``batch`` in; of equal keys the largest ``order`` of the batch
        wins, and it over what is stored.  Columns that only one side has are null on
        the other.  False: the batch is in already."""
        manifest = current(self.spark, self.path) or {"buckets": {}, "batches": [], "of": self.buckets}
        if batch_id in manifest["batches"]:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(manifest["of"]))
        touched = [str(r[0]) for r in batch.select(bucket.alias("b")).distinct().collect()]     # at most ``of`` numbers
        rows = batch.withColumn("__order", F.struct(F.lit(1), *[F.col(c) for c in order]))
        kept = self._read(T.StructType.fromJson(manifest["schema"]) if manifest["buckets"] else T.StructType(),
                          [manifest["buckets"][b] for b in touched if b in manifest["buckets"]])
        others = [c for c in dict.fromkeys([*(kept.columns if kept is not None else []), *batch.columns])
                  if c not in self.keys]
        if kept is not None:
            stored = F.struct(F.lit(0), *[F.lit(None).cast(batch.schema[c].dataType).alias(c) for c in order])
            rows = rows.unionByName(kept.withColumn("__order", stored), allowMissingColumns=True)
        merged = (rows.groupBy(*self.keys)
                  .agg(F.max_by(F.struct(*[F.col(c) for c in others]), "__order").alias("__last"))
                  .select(*self.keys, *[F.col("__last")[c].alias(c) for c in others]))
        schema = merged.schema
        if manifest["buckets"]:     # columns that no touched bucket holds stay known
            known = T.StructType.fromJson(manifest["schema"])
            schema = T.StructType([*schema.fields, *[f for f in known.fields if f.name not in schema.names]])
        folder = new_folder(self.path)
        if touched:
            merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        at = folder[len(self.path) + 1:]
        publish(self.spark, self.path, manifest | {
            "schema": schema.jsonValue(), "batches": [*manifest["batches"], batch_id],
            "buckets": manifest["buckets"] | {b: f"{at}/bucket={b}" for b in touched}})
        return True
