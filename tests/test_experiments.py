"""Published significance tests and statistics helpers."""

import math

import pytest

from caseflow.operators.experiments import (correlation_p_value, wilcoxon_exact_p,
                                            wilcoxon_signed_rank)

# (W, n) -> exact two-sided p
PUBLISHED = [((0, 7), 0.015625), ((12, 7), 0.8125), ((11, 7), 0.6875), ((1, 10), 0.00390625),
             ((0, 10), 0.001953125), ((1, 7), 0.03125), ((7, 7), 0.296875), ((9, 7), 0.46875),
             ((10, 7), 0.578125)]


@pytest.mark.parametrize("wn,p", PUBLISHED)
def test_exact_wilcoxon_p(wn, p):
    w, n = wn
    assert wilcoxon_exact_p(w, n) == pytest.approx(p, abs=1e-12)


def test_wilcoxon_on_published_differences(spark):
    # Fig. 3 accuracy differences (gpt2-mini - nano, gpt2-small - nano) per log
    a = [-0.0391, -0.0154, -0.0284, -0.1804, -0.0728, -0.0058, -0.1425]
    b = [-0.0069, 0.1275, -0.0127, -0.1737, 0.062, 0.012, -0.0964]
    rows = [("3a", d) for d in a] + [("3b", d) for d in b] + [("zeros", 0.0), ("zeros", 0.0)]
    df = spark.createDataFrame(rows, "fig string, d double")
    got = {r.fig: r for r in wilcoxon_signed_rank(df, ["fig"], "d").collect()}
    assert (got["3a"].n, got["3a"].w) == (7, 0.0) and got["3a"].p_value == pytest.approx(0.015625)
    assert (got["3b"].n, got["3b"].w) == (7, 12.0) and got["3b"].p_value == pytest.approx(0.8125)
    assert (got["zeros"].n, got["zeros"].n_nonzero) == (2, 0) and got["zeros"].p_value is None
    assert {r.method for r in got.values()} == {"exact"}


def test_wilcoxon_groups_of_nulls_stay_and_zeros_count(spark):
    rows = [("n", None), ("n", None), ("m", 0.0), ("m", 1.0), ("m", None), (None, 2.0), (None, 3.0)]
    got = {r.g: r for r in wilcoxon_signed_rank(spark.createDataFrame(rows, "g string, d double"), ["g"], "d").collect()}
    assert (got["n"].n, got["n"].p_value) == (0, None)
    assert (got["m"].n, got["m"].n_nonzero, got["m"].w_plus, got["m"].p_value) == (2, 1, 1.0, 1.0)
    assert (got[None].n, got[None].w, got[None].p_value) == (2, 0.0, 0.5)


def test_normal_approximation_branch(spark):
    rows = [("g", float(i if i % 3 else -i)) for i in range(1, 80)]
    df = spark.createDataFrame(rows, "g string, d double")
    r = wilcoxon_signed_rank(df, ["g"], "d", method="normal").collect()[0]
    assert r.method == "normal"
    exact = wilcoxon_exact_p(r.w, r.n)
    assert r.n == 79 and abs(r.p_value - exact) < 0.01


def test_correlation_p_value(spark):
    # r = 0.5, n = 10: t = 1.633, dof 8 -> two-sided p ~ 0.1411; Student's table: t(.05, 7) = 2.365
    rows = [(0.5, 10), (0.5, 2), (1.0, 5), (0.0, 9), (2.3646243 / math.sqrt(7 + 2.3646243 ** 2), 9), (None, 7),
            (12.7062047 / math.sqrt(1 + 12.7062047 ** 2), 3), (4.3026527 / math.sqrt(2 + 4.3026527 ** 2), 4)]
    df = spark.createDataFrame(rows, "r double, n long")
    p = [x.p for x in df.select(correlation_p_value("r", "n").alias("p")).collect()]
    assert p[0] == pytest.approx(0.1411, abs=5e-5) and p[1] is None and p[2] == 0.0 and p[3] == pytest.approx(1.0)
    assert p[4] == pytest.approx(0.05, abs=1e-7) and p[5] is None
    assert p[6] == pytest.approx(0.05, abs=1e-7) and p[7] == pytest.approx(0.05, abs=1e-7)


def test_correlation_keeps_groups_without_complete_rows(spark):
    from caseflow.operators.experiments import metric_correlation
    rows = [("a", 1.0, None), ("a", 2.0, None), ("b", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 2.0, 3.0),
            ("d", 1.0, 2.0), ("d", 2.0, 3.0), ("d", 3.0, 5.0)]
    got = {r.g: r for r in metric_correlation(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert got["a"].n == got["b"].n == 0 and math.isnan(got["a"].pearson_r) and math.isnan(got["b"].spearman_r)
    assert (got["c"].n, got["c"].pearson_r, got["c"].spearman_r, got["c"].pearson_p) == (2, pytest.approx(1.0), None, None)
    assert got["d"].n == 3 and got["d"].spearman_r == pytest.approx(1.0)


def test_group_ranks_and_quantiles(spark):
    import random as _r

    import pandas as pd
    from caseflow.functions.rank import group_average_rank, group_quantiles
    rnd = _r.Random(5)
    rows = [(g, float(rnd.randint(0, 30))) for g in ("a", "b", "c") for _ in range(rnd.randint(5, 60))]
    df = spark.createDataFrame(rows, "g string, v double")
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    pdf["r"] = pdf.groupby("g").v.rank()
    assert sorted(map(tuple, group_average_rank(df, ["g"], "v", "r").collect())) == sorted(pdf.itertuples(index=False, name=None))
    got = {(r.g, r.q): r.value for r in group_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9]).collect()}
    want = pdf.groupby("g").v.quantile([0.1, 0.5, 0.9])
    assert len(got) == 9 and all(got[k] == pytest.approx(want[k]) for k in got)
