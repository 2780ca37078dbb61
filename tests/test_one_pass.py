"""Statistics and time features of all parts from one pass, against the parts one by one."""

import pytest
from pyspark.sql import functions as F

from caseflow.functions.storage import written
from caseflow.operators.features import split_time_features, time_features
from caseflow.operators import experiments as A
from caseflow.operators.encode import build_event_log
from caseflow.operators.prepare import case_summary, coerce_amount, fill_resource, prepare_log
from caseflow.operators.split import case_split, prefix_split, train_test_val
from caseflow.operators.stats import dataset_statistics, protocol_statistics, timeline
from caseflow.plans.nep_data import encoded_split, event_log_dataset
from caseflow.sources.logs import ADAPTER_PARAMS, load_log
from conftest import SF001


@pytest.fixture(scope="module")
def log(spark):
    raw, spec = load_log(spark, "events_by_user", SF001)
    return raw, *prepare_log(raw, spec, {"max_days": ADAPTER_PARAMS["events_by_user"].get("max_days")})


@pytest.mark.parametrize("val_size,hot", [(0.0, None), (0.25, None), (0.25, 20)])
def test_statistics_equal_those_of_the_parts(spark, log, val_size, hot):
    raw, df, spec = log
    summary = written(case_summary(raw, spec))
    got = protocol_statistics(spec, summary, timeline(df, spec, hot), 0.2, val_size)
    orig = raw.join(summary.filter("n >= 3").select(spec.case), spec.case, "left_semi")
    t = train_test_val(df, spec, 0.2, val_size)
    want = dataset_statistics(spec, orig, df, t["train"], t["test"], t["tt_trunc"], t["tt_sep_us"],
                              t["val"], t["tv_trunc"], t["tv_sep_us"])
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan      # one aggregation of the written timeline


@pytest.mark.parametrize("hot", [None, 20])
def test_features_equal_those_of_the_parts(spark, log, hot):
    _, df, spec = log
    sp = prefix_split(df, spec, 0.2)
    got = split_time_features(df, spec, sp.sep_us, hot)
    cols = ["split", spec.case, "seq", "accumulated_time", "remaining_time", "hour_of_day", "week_of_year"]
    want = None
    for name, part in (("train", sp.train), ("test", sp.test)):
        t = time_features(part, spec).withColumn("split", F.lit(name)).select(cols)
        want = t if want is None else want.unionByName(t)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.collect()))


def test_features_take_one_event_shuffle(spark, log):
    raw, df, spec = log
    plan = split_time_features(raw, spec, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1


def _held(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [None, 3])
def test_encoded_parts_equal_windows_of_each_part(spark, hot):
    raw, spec = load_log(spark, "lineitems_by_order", SF001)
    params = ADAPTER_PARAMS["lineitems_by_order"]
    num, cat = ["accumulated_time", "amount"], ["activity", "resource"]
    before = _held(spark)
    got, vocab, sep_us = event_log_dataset(raw, spec, params, cat, num, ["activity", "resource"], ["remaining_time"],
                                           scale=False, hot_case_rows=hot)
    assert _held(spark) == before
    df, sp = prepare_log(raw, spec, params)
    parts = prefix_split(df, sp, params.get("test_size", 0.2))
    plain = {n: time_features(coerce_amount(fill_resource(d, sp), sp), sp) for n, d in (("train", parts.train), ("test", parts.test))}
    want, _ = build_event_log(plain, sp, cat, num, ["activity", "resource"], ["remaining_time"], vocab=vocab)
    assert sep_us == parts.sep_us
    for name in want:
        cols = want[name].columns
        assert set(got[name].columns) == set(cols) and "Window" not in _plan(got[name])
        rows = sorted(map(str, got[name].select(cols).collect()))
        assert rows and rows == sorted(map(str, want[name].collect()))


def test_kept_frames_free_the_prepared_log(spark):
    raw, spec = load_log(spark, "events_by_user", SF001)
    before = _held(spark)
    es = encoded_split(raw, spec, ADAPTER_PARAMS["events_by_user"])
    want = es.train.count()
    kept = es.keep(es.train)
    assert _held(spark) == before and kept.count() == want and "Window" not in _plan(kept)


def test_parts_with_validation_read_written_frames(spark, log):
    _, df, spec = log
    for how in ("prefix", "classic"):
        t = train_test_val(df, spec, 0.2, 0.25, how)
        assert all("Window" not in _plan(t[n]) for n in ("train", "val", "test"))
        assert t["train"].count() and t["val"].count() and t["test"].count()
    a, b = prefix_split(df, spec, 0.2), prefix_split(df, spec, 0.2, keep=True)
    assert a.sep_us == b.sep_us
    for x, y in ((a.train, b.train), (a.test, b.test), (a.trunc, b.trunc)):
        assert sorted(map(str, x.collect())) == sorted(map(str, y.select(x.columns).collect()))


def test_newest_cases_with_ties_and_none(spark, log):
    _, _, spec = log
    df = spark.sql("""SELECT concat('c', id % 20) AS case_id, timestamp_seconds(1700000000 + (id % 20) div 5 * 86400 + id div 20) AS ts, id AS seq
                      FROM range(100)""")
    spec = type(spec)(case="case_id", activity="seq", ts="ts", order=("seq",))
    # the newest day has c15 to c19, the day before c10 to c14: two of them by name
    train, val, sep = case_split(df, spec, 0.35)
    assert {r.case_id for r in val.select("case_id").distinct().collect()} == {*[f"c{i}" for i in range(15, 20)], "c10", "c11"}
    assert val.count() == 35 and train.count() == 65 and sep == (1700000000 + 2 * 86400) * 1_000_000
    train, val, sep = case_split(df, spec, 0.01)
    assert train.count() == 100 and val.count() == 0 and sep is None
    assert case_split(df.limit(0), spec, 0.5)[2] is None


def test_descriptors_and_scopes_combine_once(spark):
    df = spark.createDataFrame([("a", 1, "x", None, 0.5), ("a", 2, "x", "u", 0.5), ("b", 3, None, None, None), ("b", 4, None, None, 0.2),
                                ("c", 5, "x", "u", 0.1), ("c", 6, "y", "u", None), ("c", 7, "x", "u", 0.3)],
                               "g string, id long, p string, q string, m double")
    d = A.descriptors(df, ["g"], ["p", "q"])
    assert {r.g: tuple(r)[1:] for r in d.collect()} == {"a": ("x", False, "u", True), "b": (None, False, None, False),
                                                        "c": ("x", True, "u", False)}
    assert "Expand" not in _plan(d)
    scopes = {"all": F.lit(True), "odd": F.col("id") % 2 == 1, "with q": F.col("q").isNotNull()}
    for ascending in (True, False):
        got = A.best_by_scope(df, scopes, ["g"], "m", ascending)
        assert _plan(got).count("Exchange") == 1
        want = [(n, *r) for n, pred in scopes.items() for r in A.best_by_group(df.filter(pred), ["g"], "m", ascending).collect()]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
