"""Tables written to the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from caseflow.session import ensure_checkpoint_dir


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder and read
    back: its rows are fixed from then on (a plan that uses them twice sees the
    same rows), and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in the file system that Spark finds it in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
