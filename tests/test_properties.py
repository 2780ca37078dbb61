"""Invariants of the protocol on driver data."""

import pytest
from pyspark.sql import functions as F

from caseflow.operators import prefixes as X
from caseflow.operators.baseline import transition_counts
from caseflow.operators.prepare import prepare_log
from caseflow.operators.split import prefix_split
from caseflow.plans.nep_data import encoded_split
from caseflow.sources.logs import ADAPTER_PARAMS, load_log
from conftest import SF01


@pytest.fixture(scope="module")
def day_log(spark):
    log, spec = load_log(spark, "events_by_user_day", SF01)
    return log, spec


def test_each_pair_scored_once(spark, day_log):
    log, spec = day_log
    prep, spec2 = prepare_log(log, spec, ADAPTER_PARAMS["events_by_user_day"])
    sp = prefix_split(prep, spec2, 0.2)
    scored = sp.train.filter(~F.col("masked")).count() + sp.test.filter(~F.col("masked")).count()
    assert scored == prep.count()
    # train rows plus the tails of truncated cases are the filtered rows
    tails = sp.trunc.filter(F.col("ts") > F.timestamp_micros(F.lit(sp.sep_us))).count()
    assert sp.train.count() + tails + (sp.test.count() - sp.trunc.count()) == prep.count()


def test_transition_totals_equal_unmasked_train_rows(spark, day_log):
    log, spec = day_log
    es = encoded_split(log, spec, ADAPTER_PARAMS["events_by_user_day"])
    total = transition_counts(es.train).agg(F.sum("count")).first()[0]
    assert total == es.train.filter(~F.col("masked")).count()


def test_prefix_identities(spark, day_log):
    log, spec = day_log
    prep, spec2 = prepare_log(log, spec, ADAPTER_PARAMS["events_by_user_day"])
    pairs = X.pairs_of_log(prep, spec2)
    stats, _ = X.prefix_outputs(pairs)
    n_events = prep.count()
    n_cases = prep.select("case_id").distinct().count()
    assert stats.agg(F.sum("count")).first()[0] == n_events
    assert pairs.filter(F.size("prefix") == 1).count() == n_cases
    s = X.prefix_summary(pairs, stats).first()
    assert 0.0 <= s["cond_entropy_bits"] <= s["marginal_entropy_bits"] + 1e-12
    assert 0.0 <= s["gini"] < 1.0
    assert 0.0 < s["top5_share"] <= s["top10_share"] <= 1.0


def test_results_independent_of_input_order(spark, day_log):
    log, spec = day_log
    shuffled = log.repartition(7, F.rand(3))
    a = encoded_split(log, spec, ADAPTER_PARAMS["events_by_user_day"])
    b = encoded_split(shuffled, spec, ADAPTER_PARAMS["events_by_user_day"])
    cols = ["case_id", "seq", "masked", "cur", "tgt"]
    assert sorted(a.test.select(*cols).collect()) == sorted(b.test.select(*cols).collect())
    assert a.sep_us == b.sep_us
