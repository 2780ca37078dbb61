"""The skew-safe paths give exactly the plain results."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseflow.functions.ordered import case_frame
from caseflow.functions.rank import global_row_number, kth_smallest
from caseflow.plans.baseline_run import baseline_run
from caseflow.sources.logs import ADAPTER_PARAMS, load_log
from conftest import SF001, SF01


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_hot_case_split_equals_plain_window(spark):
    log, spec = load_log(spark, "events_by_user", SF001)
    cols = [spec.case, "seq", "next_activity", "next_seq", "case_start_us", "case_end_us", "case_n", "last"]
    plain = case_frame(log, spec, ["activity", "seq"], bounds=True, last_flag="last", hot_case_rows=10**9)
    hot = case_frame(log, spec, ["activity", "seq"], bounds=True, last_flag="last", hot_case_rows=5)
    assert _rows(plain, cols) == _rows(hot, cols)
    # and against a direct lead()
    w = Window.partitionBy(spec.case).orderBy(*spec.order_by)
    direct = log.withColumn("next_seq", F.lead("seq").over(w))
    assert _rows(direct, [spec.case, "seq", "next_seq"]) == _rows(hot, [spec.case, "seq", "next_seq"])


def test_baseline_same_with_hot_cases(spark):
    log, spec = load_log(spark, "events_by_user", SF001)
    a = baseline_run(log, spec, ADAPTER_PARAMS["events_by_user"])["metrics"].collect()
    b = baseline_run(log, spec, ADAPTER_PARAMS["events_by_user"], hot_case_rows=7)["metrics"].collect()
    assert sorted(a) == sorted(b)


def test_kth_smallest_exact(spark):
    rnd = random.Random(7)
    vals = [rnd.randint(0, 500) for _ in range(5000)]   # many ties
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    s = sorted(vals)
    for k in (0, 1, 2500, 3999, 4999):
        assert kth_smallest(df, "v", k=k) == s[k]
    # tiny bracket forces the narrowing loop
    assert kth_smallest(df, "v", k=1234, max_bracket=10) == s[1234]


def test_global_row_number(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = global_row_number(df, [F.col("a").desc(), F.col("b")], "rn", partitions=7).collect()
    expect = {r: i + 1 for i, r in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])))}
    assert all(expect[(r.a, r.b)] == r.rn for r in got)


def test_partition_count_invariance(spark):
    import __spark_entry__ as E
    q = E.queries()["prefix_stats_events_by_user_day"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = sorted(q(spark, SF001).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = sorted(q(spark, SF001).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b


def test_plans_have_no_single_partition_exchange_or_python(spark):
    log, spec = load_log(spark, "events_by_user", SF01)
    fr = case_frame(log, spec, ["activity"], bounds=True)
    plan = fr._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_positions_and_bounded_prefixes_with_hot_cases(spark):
    from caseflow.operators import prefixes as X
    log, spec = load_log(spark, "events_by_user", SF001)
    plain = case_frame(log, spec, position="pos", hot_case_rows=10**9)
    hot = case_frame(log, spec, position="pos", hot_case_rows=4)
    assert _rows(plain, [spec.case, "seq", "pos"]) == _rows(hot, [spec.case, "seq", "pos"])
    a = X.pairs_of_log(log, spec, max_len=3).groupBy("prefix", "next_activity").count().collect()
    b = X.pairs_of_log(log, spec, max_len=3, hot_case_rows=4).groupBy("prefix", "next_activity").count().collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_early_stop_replay_hot_runs_and_loop(spark):
    """V14 equals a plain Python replay of the loop, with and without chunked runs."""
    import random as _r
    from caseflow.operators.evaluate import early_stop_replay
    rnd = _r.Random(11)
    rows = []
    for run in range(25):
        loss = 1.0
        for step in range(rnd.randint(1, 40)):
            loss = loss + rnd.uniform(-0.1, 0.06)
            rows.append((f"r{run}", step, None if rnd.random() < 0.05 else round(loss, 4)))
    df = spark.createDataFrame(rows, "run_id string, step long, val_loss double")

    def loop(run_rows, patience, min_delta):
        best, counter, saved, stop = float("inf"), 0, None, None
        seen = []
        for step, l in sorted(run_rows):
            if l is None:
                continue
            seen.append(l)
            if l < best - min_delta:
                saved, counter = step, 0
            else:
                counter += 1
                if counter >= patience:
                    stop = step
                    best = min(best, l)
                    break
            best = min(best, l)
        return saved, stop, min(seen) if seen else None

    by_run = {}
    for run, step, l in rows:
        by_run.setdefault(run, []).append((step, l))
    for T in (10**9, 3):
        got = {r.run_id: (r.saved_step, r.stop_step, r.best_loss)
               for r in early_stop_replay(df, patience=3, min_delta=0.01, hot_case_rows=T).collect()}
        for run, rr in by_run.items():
            exp = loop(rr, 3, 0.01)
            if exp[2] is None:
                assert run not in got
                continue
            assert got[run] == exp, (T, run, got[run], exp)


def test_encoded_split_single_event_shuffle(spark):
    """Prepare, dedupe and the split's case window share one partitioning: no
    exchange between the persisted prepared log and the lead() window, and the
    vocabulary join is a broadcast."""
    from caseflow.plans.nep_data import encoded_split
    log, spec = load_log(spark, "events_by_user", SF01)
    es = encoded_split(log, spec, ADAPTER_PARAMS["events_by_user"])
    plan = es.train._jdf.queryExecution().executedPlan().toString()
    top = plan[plan.index("Window [lead"):plan.index("InMemoryTableScan")]
    assert "Exchange" not in top
    assert "BroadcastHashJoin" in top and "SortMergeJoin" not in top


def test_bursts_are_split_and_equal_the_plain_window(spark):
    """100,000 events in a minute and one a year later: no chunk holds much more than
    the threshold, and the windows equal the plain ones."""
    from caseflow.functions.ordered import CHUNK, hot_cases, with_chunks
    from caseflow.spec import LogSpec
    spec = LogSpec(case="c", activity="a", ts="ts", order=("seq",))
    us = F.when(F.col("id") == 100_000, F.lit(31_536_000_000_000)).otherwise(F.col("id") * 600)
    df = spark.range(100_001).select(F.lit("x").alias("c"), (F.col("id") % 7).cast("string").alias("a"),
                                     F.timestamp_micros(us).alias("ts"), F.col("id").alias("seq"))
    df = df.unionByName(spark.range(50).select(F.lit("y").alias("c"), F.lit("b").alias("a"),
                                               F.timestamp_micros(F.col("id")).alias("ts"), F.col("id").alias("seq")))
    hot = hot_cases(df, spec, 1000)
    sizes = [r["count"] for r in with_chunks(df, spec, hot).filter("c = 'x'").groupBy(CHUNK).count().collect()]
    assert sum(sizes) == 100_001 and max(sizes) < 2000 and len(sizes) > 80
    cols = ["c", "seq", "next_a", "next_seq", "case_n", "case_end_us", "pos", "last"]
    got = [case_frame(df, spec, ["a", "seq"], bounds=True, last_flag="last", position="pos", hot_case_rows=T)
           for T in (1000, 10**9)]
    assert got[0].select(cols).exceptAll(got[1].select(cols)).count() == 0
    assert got[0].count() == got[1].count()


def _cached_forms(spark, df):
    yield df.persist()
    yield df.checkpoint()
    from caseflow.functions.storage import written
    yield written(df)


def test_global_row_number_at_size(spark):
    """600,000 distinct keys behind a shuffle, cached, checkpointed and written: every
    number once, in order."""
    base = (spark.range(900_000).select((F.xxhash64("id") % 600_000).alias("k")).distinct()
            .select(F.sha2(F.col("k").cast("string"), 256).alias("k")))
    for df in _cached_forms(spark, base):
        n = df.count()
        rn = global_row_number(df, [F.col("k")], "rn", partitions=16)
        agg = rn.agg(F.countDistinct("rn").alias("d"), F.min("rn").alias("lo"), F.max("rn").alias("hi")).first()
        assert n > 500_000 and (agg.d, agg.lo, agg.hi) == (n, 1, n)
        sample = rn.orderBy("k").limit(1000).collect()
        assert [r.rn for r in sample] == list(range(1, 1001))


def test_vocabulary_and_prefix_ids_at_size(spark):
    from caseflow.operators import prefixes as X
    from caseflow.plans.nep_data import encoded_split
    from caseflow.spec import LogSpec
    spec = LogSpec(case="case_id", activity="activity", ts="ts", order=("seq",))
    log = spark.range(1_600_000).select((F.col("id") / 4).cast("long").cast("string").alias("case_id"),
                                        F.md5((F.xxhash64("id") % 700_000).cast("string")).alias("activity"),
                                        F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"), F.col("id").alias("seq"))
    es = encoded_split(log, spec, {"test_size": 0.2})
    v = es.vocab.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d"), F.max("id").alias("hi")).first()
    assert v.n > 500_000 and v.n == v.d == v.hi + 1
    es.prepared.unpersist()
    pairs = X.pairs_of_log(log, spec, max_len=2).persist()
    stats, nd = X.prefix_outputs(pairs)
    s = stats.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("prefix_id").alias("d"), F.max("prefix_id").alias("hi")).first()
    assert s.n > 500_000 and s.n == s.d == s.hi
    assert nd.agg(F.sum("next_count")).first()[0] == pairs.count()
    pairs.unpersist()


def test_group_rank_and_quantiles_at_size(spark):
    from caseflow.functions.rank import group_average_rank, group_quantiles
    df = spark.range(1_000_000).select(F.when(F.col("id") < 900_000, "big").otherwise("small").alias("g"),
                                       (F.xxhash64("id") % 600_000).cast("double").alias("v")).persist()
    r = group_average_rank(df, ["g"], "v", "r")
    w = Window.partitionBy("g").orderBy("v")
    plain = df.withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy("g", "v")) - 1) / 2.0)
    assert r.exceptAll(plain).count() == 0 and r.count() == 1_000_000
    q = {(x.g, x.q): x.value for x in group_quantiles(df, ["g"], "v", [0.25, 0.5]).collect()}
    p = {x.g: x.p for x in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5))).alias("p")).collect()}
    assert all(abs(q[(g, c)] - p[g][i]) < 1e-9 for g in p for i, c in enumerate((0.25, 0.5)))
    df.unpersist()
