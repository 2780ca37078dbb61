"""Sinks (S4, S5, S11-S13) and the streaming transition counter."""

import os
import tempfile

from pyspark.sql import functions as F

from caseflow.sources import sinks
from caseflow.sources.logs import load_log
from conftest import SF001


def test_cached_log_and_dataset(spark):
    root = tempfile.mkdtemp(prefix="cf-sink-", dir="/tmp")
    calls = []

    def build():
        calls.append(1)
        return load_log(spark, "events_by_user", SF001)[0]

    a = sinks.cached_log(spark, "ev", build, root=root)
    b = sinks.cached_log(spark, "ev", build, root=root)
    assert len(calls) == 1 and a.count() == b.count() > 0
    df = a.limit(50)
    ds = sinks.cached_dataset(spark, "d", {"train": df, "test": df.limit(10)}, root=root)
    assert {r.split: r["count"] for r in ds.groupBy("split").count().collect()} == {"train": 50, "test": 10}
    again = sinks.cached_dataset(spark, "d", None, root=root)
    assert again.count() == 60


def test_csv_and_append(spark):
    root = tempfile.mkdtemp(prefix="cf-sink-", dir="/tmp")
    df = spark.createDataFrame([(["a", "b"], 2)], "prefix array<string>, count long")
    sinks.save_csv(df, os.path.join(root, "p"), array_col="prefix")
    back = spark.read.option("header", "true").csv(os.path.join(root, "p")).collect()
    assert back[0]["prefix"] == '["a","b"]'
    sinks.save_csv(df, None)   # no-op
    t = os.path.join(root, "conf")
    sinks.write_table(df, t)
    sinks.append_rows(df, t)
    assert spark.read.parquet(t).count() == 2


def test_streaming_counts_equal_batch(spark):
    """Events written as three time-ordered files, streamed one file per trigger;
    a far-future sentinel event advances the watermark so every case closes."""
    import datetime as dt

    from caseflow.functions.ordered import case_frame
    from caseflow.spec import EOS
    from caseflow.streaming.transitions import read_transition_counts, start_transition_counter

    log, spec = load_log(spark, "events_by_user", SF001)
    src = tempfile.mkdtemp(prefix="cf-stream-", dir="/tmp")
    ev = log.select("case_id", "activity", "ts", "seq")
    bounds = list(ev.selectExpr("percentile_approx(ts, array(0.33, 0.66)) AS b").first()["b"])
    parts = [ev.filter(F.col("ts") <= bounds[0]),
             ev.filter((F.col("ts") > bounds[0]) & (F.col("ts") <= bounds[1])),
             ev.filter(F.col("ts") > bounds[1])]
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
    sentinel = spark.createDataFrame([("__sentinel__", "x", dt.datetime(2030, 1, 1), -1)],
                                     "case_id string, activity string, ts timestamp, seq long")
    sentinel.coalesce(1).write.parquet(os.path.join(src, "part9"))

    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(src, "part*")))
    out = tempfile.mkdtemp(prefix="cf-stream-out-", dir="/tmp")
    ckpt = tempfile.mkdtemp(prefix="cf-stream-ckpt-", dir="/tmp")
    q = start_transition_counter(stream, spec, out, ckpt, watermark="0 seconds", case_gap_ms=1)
    try:
        q.processAllAvailable()
        # one more trigger lets the advanced watermark time the cases out
        spark.createDataFrame([("__sentinel2__", "x", dt.datetime(2030, 1, 2), -2)], ev.schema) \
             .coalesce(1).write.parquet(os.path.join(src, "part99"))
        q.processAllAvailable()
    finally:
        q.stop()
    got = (read_transition_counts(spark, out)
           .filter(~F.col("current_activity").isin("x") & ~F.col("next_activity").isin("x")))
    fr = case_frame(log, spec, ["activity"])
    batch = (fr.groupBy(F.col("activity").alias("current_activity"),
                        F.coalesce(F.col("next_activity"), F.lit(EOS)).alias("next_activity"))
               .agg(F.count(F.lit(1)).alias("count")))
    assert sorted(got.collect()) == sorted(batch.collect())
