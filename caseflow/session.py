"""Session construction and the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the engine depends on: UTC wall clock for all timestamp arithmetic,
# adaptive execution (runtime coalescing, skew-join splitting, broadcast
# conversion from measured sizes), Arrow batches of few rows (whole documents
# pass through them: a batch of long texts stays a few megabytes).
_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume to an existing session."""
    for k, v in _RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def get_spark(master: str | None = None, app: str = "caseflow",
              shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Build (or reuse) a session with the engine settings applied.

    ``master`` is only set when given (a cluster submit supplies its own).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("CASEFLOW_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in _RUNTIME_CONF.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local master without one gets a folder of its own (tests); on a
    cluster the folder must be named, as executors do not share local disks.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        d = sc.getConf().get("spark.checkpoint.dir", None)
        if not d:
            if not is_local(sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            d = tempfile.mkdtemp(prefix="caseflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (``local``, ``local[n]``; a
    ``local-cluster`` has executors of its own)."""
    return master == "local" or master.startswith("local[")
