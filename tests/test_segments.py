"""Traces in segments: order, bounded arrays, padding, a state handed on."""

import random

import pandas as pd
from pyspark.sql import functions as F

from caseflow.operators import evaluate as V
from caseflow.operators import sequences as Q
from caseflow.spec import LogSpec

SPEC = LogSpec(case="c", activity="a", ts="ts", order=("seq",))


def log_of(spark, cases):
    rows = [(c, a, i // 2, i) for c, acts in cases.items() for i, a in enumerate(acts)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "c string, a string, s long, seq long").select(
        "c", "a", F.timestamp_seconds("s").alias("ts"), "seq").repartition(4)


CASES = {"x": list("abcabca"), "y": ["a"], "z": [None, "b", None, "d"], "w": [str(i) for i in range(50)]}


def test_segments_hold_the_events_in_order(spark):
    for size, hot in ((3, None), (3, 5), (100, None)):
        rows = Q.trace_segments(log_of(spark, CASES), SPEC, ["a", "seq"], size, hot).collect()
        assert all(len(r.a) <= size and r.start == size * r.segment for r in rows)
        for c, acts in CASES.items():
            own = sorted((r.segment, r.a, r.seq) for r in rows if r.c == c)
            assert sum((a for _, a, _ in own), []) == acts and sum((s for _, _, s in own), []) == list(range(len(acts)))


def test_padding_equals_padding_whole_traces(spark):
    segments = Q.trace_segments(log_of(spark, CASES), SPEC, ["a"], 3).withColumn(
        "batch", F.when(F.col("c").isin("x", "y"), 1).otherwise(2))
    got = {}
    for r in Q.pad_segments(segments, "c", "a", "batch", 3, "-").orderBy("c", "segment").collect():
        assert len(r.a) <= 3
        got.setdefault(r.c, []).extend(r.a)
    assert got == {c: acts + ["-"] * (n - len(acts)) for c, acts, n in
                   [(c, CASES[c], 7 if c in "xy" else 50) for c in CASES]}


def test_state_goes_from_segment_to_segment(spark):
    def step(state, segment):
        out = []
        for i, a in enumerate(segment.a):
            state = (state or "") + (a or "?")
            out.append((segment.c, segment.start + i, state))
        return pd.DataFrame(out, columns=["c", "pos", "seen"]), state

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")    # states cross Arrow batches too
    try:
        segments = Q.trace_segments(log_of(spark, CASES), SPEC, ["a"], 3)
        got = {(r.c, r.pos): r.seen for r in V.score_traces(segments, "c", step, "c string, pos long, seen string").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert got == {(c, i): "".join(a or "?" for a in acts[:i + 1]) for c, acts in CASES.items() for i in range(len(acts))}
