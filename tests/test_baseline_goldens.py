"""Hand goldens for the directly-follows baseline (FIXTURES §9)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from caseflow.operators import baseline as B
from caseflow.operators.features import apply_scaler_values, fit_scaler_values
from caseflow.plans.baseline_run import baseline_run
from caseflow.spec import LogSpec

SCHEMA = "case_id string, activity string, ts timestamp, seq long"


def h(x):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=x)


def test_unseen_test_activity(spark):
    rows = [("c1", "A", h(1), 1), ("c1", "B", h(2), 2), ("c1", "A", h(3), 3),
            ("c2", "A", h(4), 4), ("c2", "B", h(5), 5), ("c2", "A", h(6), 6),
            ("c3", "Z", h(7), 7), ("c3", "Z", h(8), 8), ("c3", "B", h(9), 9)]
    log = spark.createDataFrame(rows, SCHEMA)
    res = baseline_run(log, LogSpec(), {"test_size": 0.4})      # separation at 06:00
    vocab = {r.value: r.id for r in res["vocab"].collect()}
    assert "Z" not in vocab
    test = {(r.cur, r.tgt) for r in res["split"].test.collect()}
    # Z is encoded <UNK> (1); its successors are 1 and B; B ends the case (<EOS> = 2)
    assert test == {(1, 1), (1, vocab["B"]), (vocab["B"], 2)}
    preds = {r.cur: r.pred for r in res["predictions"].collect()}
    assert 1 not in preds and preds[vocab["B"]] == vocab["A"]
    m = {r.metric: r.value for r in res["metrics"].collect()}
    assert m["correct"] == 0 and m["total"] == 3 and m["accuracy"] == 0.0


def test_single_test_class_auroc_nan(spark):
    pos = spark.createDataFrame([(3, 5, 4), (4, 5, 2)], "cur int, label int, n long")
    counts = spark.createDataFrame([(3, 5, 7), (4, 6, 1)], "cur int, nxt int, count long")
    au = B.macro_auroc(pos, counts).first()["auroc_macro"]
    assert math.isnan(au)


def test_binary_auroc_is_auc_of_larger_label(spark):
    # two labels: AUROC of label 6 with scores count(cur -> 6) / row sum
    pos = spark.createDataFrame([(3, 5, 2), (3, 6, 1), (4, 6, 3), (4, 5, 1)], "cur int, label int, n long")
    counts = spark.createDataFrame([(3, 5, 3), (3, 6, 1), (4, 6, 2), (4, 5, 2)], "cur int, nxt int, count long")
    au = B.macro_auroc(pos, counts).first()["auroc_macro"]
    # scores for label 6: cur 3 -> 0.25, cur 4 -> 0.5; positives: 1 at .25, 3 at .5; negatives: 2 at .25, 1 at .5
    pairs = [(s_p, s_n) for s_p, cp in ((0.25, 1), (0.5, 3)) for _ in range(cp)
             for s_n, cn in ((0.25, 2), (0.5, 1)) for _ in range(cn)]
    expect = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert abs(au - expect) < 1e-12


def test_macro_f1_counts_minus_one_predictions(spark):
    scored = spark.createDataFrame([(5, 5), (5, -1), (6, 5)], "tgt int, pred int")
    f1 = B.macro_f1(scored).first()["f1_macro"]
    # labels {5, 6, -1}: F1(5) = 2*1/(2+2) = 0.5, F1(6) = 0, F1(-1) = 0
    assert abs(f1 - 0.5 / 3) < 1e-12


def test_constant_feature_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, 5.0), (1.0, 7.0)], "c double, x double")
    vals = fit_scaler_values(df, ["c", "x"])
    out = apply_scaler_values(df, vals).collect()
    assert all(r.c == 0.0 for r in out)
    # population std: x = 3, 5, 7 -> std sqrt(8/3)
    assert abs(out[2].x - 2 / math.sqrt(8 / 3)) < 1e-12
