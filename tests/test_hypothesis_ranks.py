"""Property tests: exact order statistic and global row numbers against Python sorting."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseflow.functions.rank import global_row_number, kth_smallest


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=300), st.data())
def test_kth_smallest_matches_sorted(spark, values, data):
    k = data.draw(st.integers(min_value=0, max_value=len(values) - 1))
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert kth_smallest(df, "v", k=k, max_bracket=data.draw(st.sampled_from([3, 1_000_000]))) == sorted(values)[k]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 5), st.text(alphabet="abc", max_size=3)), min_size=1, max_size=200,
                unique=True))
def test_global_row_number_matches_sorted(spark, rows):
    df = spark.createDataFrame(rows, "a long, b string")
    got = {(r.a, r.b): r.rn for r in global_row_number(df, [F.col("a").desc(), F.col("b")], "rn",
                                                         partitions=5).collect()}
    expect = {r: i + 1 for i, r in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])))}
    assert got == expect
