"""Hot cases cut by position: one timestamp is split, duplicates are not."""

from pyspark.sql import functions as F

from caseflow.functions.ordered import CHUNK, case_frame, case_running, hot_cases, with_chunks
from caseflow.operators.prepare import prepare_log
from caseflow.spec import LogSpec

SPEC = LogSpec(case="c", activity="a", ts="ts", order=("seq",))


def one_moment(spark, n):
    return spark.range(n).select(F.when(F.col("id") % 100 == 0, "small").otherwise("x").alias("c"),
                                 (F.col("id") % 7).cast("string").alias("a"),
                                 F.timestamp_micros(F.lit(5)).alias("ts"), F.col("id").alias("seq")).repartition(6)


def test_one_timestamp_splits_evenly_and_equals_the_plain_window(spark):
    df = one_moment(spark, 100_000)
    hot = hot_cases(df, SPEC, 1500)
    sizes = [r["count"] for r in with_chunks(df, SPEC, hot).filter("c = 'x'").groupBy(CHUNK).count().collect()]
    assert sorted(sizes) == [0 + 99_000 % 1500 or 1500] + [1500] * (99_000 // 1500 - (0 if 99_000 % 1500 else 1))
    cols = ["c", "seq", "next_a", "case_n", "pos", "last"]
    got = [case_frame(df, SPEC, ["a"], bounds=True, last_flag="last", position="pos", hot_case_rows=T).select(cols)
           for T in (1500, 10**9)]
    assert got[0].exceptAll(got[1]).count() == 0 and got[0].count() == 100_000
    run = [case_running(df, SPEC, {"top": ("max", "a"), "sum": ("sum", "seq")}, hot_case_rows=T).select("c", "seq", "top", "sum")
           for T in (1500, 10**9)]
    assert run[0].exceptAll(run[1]).count() == 0


def test_no_list_of_cuts_travels_with_the_events(spark):
    df = one_moment(spark, 5000)
    hot = hot_cases(df, SPEC, 10)       # hundreds of chunks
    plan = with_chunks(df, SPEC, hot)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "array" not in plan


def test_duplicates_across_a_cut_and_filters_of_hot_cases(spark):
    df = one_moment(spark, 3000).withColumn("seq", F.col("seq"))
    twice = df.unionByName(df.withColumn("seq", F.col("seq") + 10_000))
    late = twice.unionByName(spark.range(40).select(F.lit("long").alias("c"), F.lit("b").alias("a"), F.timestamp_micros(
        F.col("id") * 86_400_000_000).alias("ts"), F.col("id").alias("seq")))
    for params in ({}, {"max_days": 10.0}, {"start_date": "1970-02"}, {"end_date": "1970-01"}):
        plain, _ = prepare_log(late, SPEC, params)
        cut, _, hot = prepare_log(late, SPEC, params, hot_case_rows=30, keep_chunk=True)
        assert hot is not False
        a, b = (sorted(map(tuple, x.select("c", "a", "ts", "seq").collect())) for x in (plain, cut))
        assert a == b
        if not params:
            assert len(a) == 14 + 40 and cut.select(CHUNK).distinct().count() == 2
