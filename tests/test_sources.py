"""Sources: log reading, XES column mapping, run-table loading and unions."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from caseflow.sources import experiments as X
from caseflow.sources.logs import benchmark_params, from_xes_columns, load_log, read_log
from conftest import SF001


def test_read_log_parquet_csv_missing(spark):
    root = tempfile.mkdtemp(prefix="cf-src-", dir="/tmp")
    df = spark.createDataFrame([("c", "A", dt.datetime(2024, 1, 1), 1)], "case string, act string, t timestamp, seq long")
    df.write.parquet(os.path.join(root, "p", "log.parquet"))
    df.write.option("header", "true").csv(os.path.join(root, "c", "log.csv"))
    assert read_log(spark, os.path.join(root, "p")).count() == 1
    assert read_log(spark, os.path.join(root, "c")).count() == 1
    with pytest.raises(ValueError):
        read_log(spark, os.path.join(root, "missing"))
    assert read_log(spark, "file://" + os.path.join(root, "p") + "/").count() == 1


def test_xes_columns_and_amount_coalesce(spark):
    raw = spark.createDataFrame(
        [("c1", "A", dt.datetime(2024, 1, 1), "r1", "start", None, 5.0, 1)],
        "`case:concept:name` string, `concept:name` string, `time:timestamp` timestamp, `org:resource` string, "
        "`lifecycle:transition` string, `case:AMOUNT_REQ` double, `case:RequestedAmount` double, seq long")
    df, spec = from_xes_columns(raw, lifecycle=True)
    r = df.first()
    assert (r.case_id, r.activity, r.resource, r.lifecycle, r.amount) == ("c1", "A", "r1", "start", 5.0)
    assert spec.resource == "resource" and spec.amount == "amount" and spec.lifecycle == "lifecycle"
    assert benchmark_params("BPI12")["max_days"] == 32.28 and benchmark_params("unknown") == {}


def test_runs_with_inferred_schema_and_multiple_projects(spark):
    stored = X.runs_from_orders(spark, SF001)
    flat = X.flatten_runs(stored)        # schema inferred over all records
    assert "duration_sec" in flat.columns and "_runtime" not in flat.columns
    assert not any(c.startswith(("_", "gradients/")) for c in flat.columns)
    known = X.flatten_runs(stored, X.RUN_SCHEMAS)
    a = sorted(flat.select("id", "duration_sec").collect())
    b = sorted(known.select("id", "duration_sec").collect())
    assert a == b

    def missing():
        raise FileNotFoundError("no such project")

    both, left_out = X.load_multiple({"p1": known.limit(3), "p2": known.limit(2).drop("lr"), "p3": missing,
                                      "p4": lambda: spark.read.parquet("/tmp/no such project")})
    assert left_out == ["p3", "p4"]
    assert both.count() == 5 and both.filter(F.col("lr").isNull()).count() >= 2
    with pytest.raises(FileNotFoundError):
        X.load_multiple({"p3": missing}, skip_missing=False)

    def broken():
        raise OSError("storage fault")

    with pytest.raises(OSError):
        X.load_multiple({"p1": known, "p3": broken})


def test_a_cluster_must_name_its_shared_folder():
    from caseflow.session import ensure_checkpoint_dir, is_local

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
    assert is_local("local[8]") and is_local("local") and not is_local("local-cluster[3,2,3000]")


def test_history_inferred_schema_matches_known(spark):
    raw = X.upsert_history(X.history_from_lineitem(spark, SF001), X.HISTORY_INGEST).select("run_id", "step", "metrics")
    a = X.flatten_history(raw)
    b = X.flatten_history(raw, X.HISTORY_SCHEMA)
    assert "_step" not in a.columns
    assert sorted(a.select("run_id", "step", "val_loss").collect()) == sorted(b.select("run_id", "step", "val_loss").collect())
