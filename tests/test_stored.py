"""Caches, the stored history, inferred JSON schemas, targets without a logit."""

import datetime as dt
import os
import random
import tempfile
import warnings

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions.published import current, publish
from caseflow.operators import evaluate as V
from caseflow.operators.encode import build_event_log
from caseflow.sources import experiments as X
from caseflow.sources import sinks
from caseflow.sources.stored import StoredTable
from caseflow.spec import LogSpec


@pytest.fixture()
def root():
    return tempfile.mkdtemp(prefix="cf-stored-", dir="/tmp")


def test_a_failed_first_write_is_not_taken_for_the_cache(spark, root):
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    good = spark.range(10)
    with pytest.raises(Exception, match="broken"):
        sinks.cached_log(spark, "log", lambda: bad, root=root)
    assert sinks.cached_log(spark, "log", lambda: good, root=root).count() == 10
    with pytest.raises(Exception, match="broken"):
        sinks.cached_dataset(spark, "d", {"train": bad}, root=root)
    with pytest.raises(ValueError, match="not cached"):
        sinks.cached_dataset(spark, "d", None, root=root)
    assert sinks.cached_dataset(spark, "d", {"train": good, "test": good}, root=root).count() == 20
    with pytest.raises(Exception, match="broken"):      # a refresh that fails leaves the old version
        sinks.cached_log(spark, "log", lambda: bad, root=root, refresh=True)
    assert sinks.cached_log(spark, "log", lambda: bad, root=root).count() == 10
    assert sinks.cached_log(spark, "log", lambda: spark.range(3), root=root, refresh=True).count() == 3


def test_sources_and_parameters_are_the_key_of_a_cache(spark, root):
    source, calls = os.path.join(root, "in"), []
    spark.range(5).write.parquet(source)

    def get(params=None):
        def build():
            calls.append(params)
            return spark.read.parquet(source)
        return sinks.cached_log(spark, "log", build, root=root, sources=[source], params=params).count()

    assert [get(), get(), get({"a": 1}), get({"a": 2}), get({"a": 1})] == [5] * 5
    assert calls == [None, {"a": 1}, {"a": 2}]
    spark.range(2).write.mode("append").parquet(source)
    assert get({"a": 1}) == 7 and len(calls) == 4


def test_versions_are_published_in_turn(spark, root):
    assert current(spark, root) is None
    assert publish(spark, root, {"a": 1}) == 1
    first = current(spark, root)
    assert publish(spark, root, first | {"a": 2}) == 2
    assert current(spark, root) == {"a": 2, "version": 2}
    with pytest.raises(RuntimeError, match="another writer"):
        publish(spark, root, first | {"a": 3})


def test_merges_equal_an_upsert(spark, root):
    r = random.Random(3)
    stored = StoredTable(spark, root, buckets=5)
    want, touched = {}, []
    schema = "run_id string, step long, v double, at int"
    for k in range(4):
        rows = [(r.choice(["a", "b", None]), r.choice([1, 2, 3, None]), float(r.randint(0, 99)), i) for i in range(9 - 2 * k)]
        for run, step, v, at in rows:
            want[(run, step)] = v
        batch = spark.createDataFrame(rows, schema).repartition(3)
        assert stored.merge(batch, f"b{k}", ["at"])
        before = current(spark, root)
        assert not stored.merge(batch.withColumn("v", F.lit(-1.0)), f"b{k}", ["at"])     # in already
        assert current(spark, root) == before
        touched.append(set(before["buckets"].values()))
        assert {(x.run_id, x.step): x.v for x in stored.read().collect()} == want
        assert stored.read().count() == len(want)
    assert touched[0] & touched[1] or len(touched[1]) == 5
    one = spark.createDataFrame([("a", 1, "new")], "run_id string, step long, note string").withColumn("at", F.lit(1))
    stored.merge(one, "more", ["at"])
    got = {(x.run_id, x.step): (x.v, x.note) for x in stored.read().collect()}
    assert got[("a", 1)] == (None, "new") and all(n is None for k, (_, n) in got.items() if k != ("a", 1))
    kept = {b: f for b, f in before["buckets"].items() if current(spark, root)["buckets"][b] == f}
    assert len(kept) >= len(before["buckets"]) - 1      # only the touched bucket was written anew
    stored.merge(one.limit(0), "none", ["at"])
    assert stored.read().count() == len(got)


def test_a_merge_that_fails_changes_nothing(spark, root):
    stored = StoredTable(spark, root, buckets=2)
    rows = spark.createDataFrame([("a", 1, 1.0, 1), ("b", 2, 2.0, 1)], "run_id string, step long, v double, at int")
    assert stored.read() is None
    stored.merge(rows, "first", ["at"])
    bad = rows.withColumn("v", F.when(F.col("run_id") == "b", F.raise_error(F.lit("broken")).cast("double")).otherwise(9.0))
    with pytest.raises(Exception, match="broken"):
        stored.merge(bad, "second", ["at"])
    assert sorted(x.v for x in stored.read().collect()) == [1.0, 2.0]
    assert stored.merge(rows.withColumn("v", F.col("v") + 1), "second", ["at"])
    assert sorted(x.v for x in stored.read().collect()) == [2.0, 3.0]


def test_json_schema_keeps_names_kinds_and_values(spark):
    texts = ['{"AVOID":1.5,"a b":null,"b":null,"OBJECT<":{"VOID":1,"in":{"deep":[1,2.5]}},"n":3,"N":true,"l":[],"m":1,"x":{}}',
             '{"AVOID":3,"a b":"s","n":4,"m":"text","l":[{"k":1},{"j":"q"}]}', '{"AVOID":NaN,"m":{"o":1},"DECIMAL(2,1)":12345678901}',
             "no json", "", None, "[1]"]
    df = spark.createDataFrame([(str(i), "run", t) for i, t in enumerate(texts)], "id string, name string, config string")
    s = {f.name: f.dataType for f in X.infer_json_schema(df, "config").fields}
    assert {k: v.simpleString() for k, v in s.items()} == {
        "AVOID": "double", "a b": "string", "b": "string", "OBJECT<": "struct<VOID:bigint,in:struct<deep:array<double>>>",
        "n": "bigint", "N": "boolean", "l": "array<struct<j:string,k:bigint>>", "m": "string", "x": "string",
        "DECIMAL(2,1)": "bigint"}
    runs = df.withColumns({"summary": F.lit('{"n":7,"_runtime":2.0,"name":"other"}'), "metadata": F.lit(None).cast("string")})
    with_n = runs.withColumn("summary", F.when(F.col("id") == "1", F.lit('{"n":null}')).otherwise(F.col("summary")))
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        got = {r.id: r.asDict(recursive=True) for r in X.flatten_runs(with_n).collect()}
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert got["0"]["AVOID"] == 1.5 and got["0"]["N"] is True and got["0"]["OBJECT<"] == {"VOID": 1, "in": {"deep": [1.0, 2.5]}}
    assert got["0"]["n"] == 7 and got["1"]["n"] is None and got["1"]["a b"] == "s" and got["1"]["name"] == "run"
    assert got["0"]["name"] == "other" and got["0"]["duration_sec"] == 2.0
    assert (got["0"]["m"], got["1"]["m"], got["2"]["m"]) == ("1", "text", '{"o":1}')
    assert got["1"]["l"] == [{"j": None, "k": 1}, {"j": "q", "k": None}] and got["2"]["DECIMAL(2,1)"] == 12345678901
    assert got["4"]["AVOID"] is None and len(got) == len(texts)
    assert X.infer_json_schema(df.limit(0), "config") == T.StructType([])


def test_targets_without_a_logit_are_left_out_and_counted(spark):
    df = spark.createDataFrame([(0, True, [1.0, 2.0]), (1, True, [0.0, 0.0]), (5, True, [1.0, 2.0]), (2, True, [1.0, 2.0]),
                                (9, False, [1.0, 2.0]), (-1, True, [1.0, 2.0])], "target int, valid boolean, logits array<double>")
    assert sorted(r.target for r in V.flatten_valid(df).collect()) == [0, 1]
    assert V.left_out(df).first()[0] == 2
    assert V.masked_cross_entropy(df.filter("target > 1")).first()[0] == 0.0


def test_a_vocabulary_inferred_from_test_warns(spark):
    spec = LogSpec(case="case_id", activity="activity", ts="ts", order=("seq",))
    df = spark.sql("SELECT 'c' AS case_id, 'a' AS activity, timestamp'2024-01-01' AS ts, 1L AS seq")
    with pytest.warns(UserWarning, match="inferred from 'test'"):
        build_event_log({"test": df}, spec, ["activity"], [])
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        _, vocab = build_event_log({"train": df}, spec, ["activity"], [])
        build_event_log({"test": df}, spec, ["activity"], [], vocab=vocab)


def test_json_schemas_read_the_records_once_a_depth(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    deep, flat = '{"a":[{"b":{"c":1}},[2.5]],"d":{"e":[]}}', '{"a":null,"d":{"e":[true]},"f":1}'
    df = spark.createDataFrame([(deep, '{"a":"s"}'), (flat, None), (None, "[1]")], "config string, summary string").withColumn(
        "config", seen.asNondeterministic()("config"))
    schema = X.infer_json_schema(df, "config")
    assert read.value == 3 * 4                                  # three records, four depths
    assert [f.name for f in schema.fields] == ["a", "d", "f"]
    kinds = X.json_kinds(df, ["config", "summary"])
    assert read.value == 3 * 4 * 2
    assert kinds["summary"] == {("ka",): {"STRING"}}
    assert kinds["config"][("ka",)] == {"ARRAY", "VOID"} and kinds["config"][("ka", "[]", "kb", "kc")] == {"BIGINT"}
    assert kinds["config"][("ka", "[]")] == {"OBJECT", "ARRAY"} and kinds["config"][("kd", "ke", "[]")] == {"BOOLEAN"}


def test_inferred_runs_shuffle_narrow_rows_once(spark, tmp_path):
    from caseflow.plans.registry import QUERIES
    at = dt.datetime(1996, 5, 2)
    rows = [(1, 7, "F", 10.5, at, "1-URGENT"), (2, 7, "O", 20.0, at, "2-HIGH"), (2, 7, "P", 30.0, at, "3-MEDIUM"),
            (None, 7, "F", 40.0, at, "1-URGENT")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                                "o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    df = QUERIES["runs_inferred_orders"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan       # the texts stay where they are made
    got = sorted(((r.id, r.avoid, r.mixed, r.nested_number, r.nested_text, r.list_sum, r.epochs, r.duration_sec, r.log)
                  for r in df.collect()), key=str)
    o, p = (20.0, "x5", 5, "nO", 7, 99), (30.0, None, 5, "nP", 7, 5)
    assert got == sorted([("1", 10.5, "5", 5, "nF", 7, 5, 0.105, "1-URGENT"),
                          *[("2", *x, d, log) for x in (o, p) for d, log in ((0.2, "2-HIGH"), (0.3, "3-MEDIUM"))]], key=str)
