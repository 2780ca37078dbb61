"""Student's tail, exact Wilcoxon p and ranks with heavy values."""

import math
import random
import time
from collections import Counter
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from caseflow.functions.columns import student_two_sided
from caseflow.functions.rank import group_average_rank, group_value_ranks
from caseflow.operators.experiments import metric_correlation, metric_correlations, signed_rank_tail, wilcoxon_exact_p

getcontext().prec = 40
PI = Decimal("3.14159265358979323846264338327950288419717")


def student_by_sum(t, dof, terms=None):
    """The finite sum for whole dof in 40 digits (dof up to some thousand)."""
    t, dof = Decimal(t), int(dof)
    c2 = dof / (dof + t * t)
    s = (1 - c2).sqrt()
    if dof % 2:
        term, total, k = c2.sqrt(), Decimal(0), 1
        for k in range(3, dof + 1, 2):
            total += term
            term *= c2 * (k - 1) / k
        return 1 - 2 / PI * (arctan(t / Decimal(dof).sqrt()) + s * total)
    term, total = Decimal(1), Decimal(0)
    for k in range(2, dof + 1, 2):
        total += term
        term *= c2 * (k - 1) / k
    return 1 - s * total


def arctan(x):
    if x > 1:
        return PI / 2 - arctan(1 / x)
    halvings = 0
    while x > Decimal("0.05"):
        x, halvings = x / (1 + (1 + x * x).sqrt()), halvings + 1
    total, power, k = Decimal(0), x, 1
    while abs(power) > Decimal("1e-45"):
        total += power / k if k % 4 == 1 else -power / k
        power, k = power * x * x, k + 2
    return total * 2 ** halvings


def test_student_tail_agrees_to_ten_digits(spark):
    points = [(t, dof) for dof in (1, 2, 3, 4, 5, 10, 31, 100, 997, 5000) for t in (0.0, 0.01, 0.7, 1.5, 1.99, 2.0, 2.7, 5.0, 9.0)]
    df = spark.createDataFrame(points, "t double, dof long")
    for r in df.select("t", "dof", student_two_sided("t", "dof").alias("p")).collect():
        want = student_by_sum(r.t, r.dof)
        if want > Decimal("1e-25"):
            assert abs(Decimal(r.p) / want - 1) < Decimal("1e-10"), r
    # ten million, and far out: the normal tail with its first corrections in 1 / dof
    big = spark.createDataFrame([(2.0, 9_999_998), (1.0, 9_999_998), (6.0, 9_999_998), (2.0, 10**10), (30.0, 10**7)], "t double, dof long")
    got = [r.p for r in big.select(student_two_sided("t", "dof").alias("p")).collect()]
    def normal(t, dof):
        return math.erfc(t / math.sqrt(2)) + math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * (t ** 3 + t) / (2 * dof)

    assert got[0] == pytest.approx(normal(2, 9_999_998), rel=1e-10) and got[1] == pytest.approx(normal(1, 9_999_998), rel=1e-10)
    assert got[2] == pytest.approx(normal(6, 9_999_998), rel=1e-8) and got[3] == pytest.approx(normal(2, 10**10), rel=1e-10)
    assert 0 < got[4] < 1e-190
    t = time.time()
    many = spark.range(20_000).select(student_two_sided(F.col("id") / 5000, F.lit(10_000_000)).alias("p"))
    assert many.agg(F.min("p"), F.max("p")).first()[1] == 1.0 and time.time() - t < 30


def count_signs(w2, ranks2):
    counts = Counter({0: 1})
    for r in ranks2:
        counts = counts + Counter({s + r: n for s, n in counts.items()})
    return sum(n for s, n in counts.items() if s <= w2) / 2 ** len(ranks2)


def test_wilcoxon_tail_equals_counting():
    r = random.Random(2)
    for _ in range(60):
        values = sorted(r.randint(1, 6) for _ in range(r.randint(1, 12)))
        ranks2 = [2 * values.index(v) + values.count(v) + 1 for v in values]
        times = Counter(ranks2)
        w2 = r.randint(0, sum(ranks2))
        assert signed_rank_tail(w2, list(times), list(times.values())) == pytest.approx(count_signs(w2, ranks2), rel=1e-12)
        assert wilcoxon_exact_p(w2 / 2, len(values), ranks2) == pytest.approx(min(1, 2 * count_signs(w2, ranks2)), rel=1e-12)


def test_wilcoxon_of_500_pairs_with_ties_is_quick():
    values = sorted(i // 3 for i in range(500))
    ranks = Counter(2 * values.index(v) + values.count(v) + 1 for v in values)
    half = sum(r * t for r, t in ranks.items()) // 4
    t = time.time()
    p = wilcoxon_exact_p(half, 500, list(ranks), list(ranks.values()))
    assert time.time() - t < 1.5 and 0.9 < p <= 1.0
    assert 0 < wilcoxon_exact_p(half / 2 + 10_000, 500, list(ranks), list(ranks.values())) < 0.05
    assert signed_rank_tail(10, [2], [3000]) == pytest.approx(sum(math.comb(3000, j) for j in range(6)) / 2**3000, rel=1e-9) \
        or signed_rank_tail(10, [2], [3000]) == 0.0


def test_heavy_values_spread_and_keep_their_ranks(spark):
    df = spark.range(600_000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(
        F.xxhash64("id") % 100_000 / 1000.0).alias("v"), F.col("id").alias("k")).withColumn(
        "g", F.when(F.col("k") % 1000 == 1, None).otherwise(F.col("g")))
    ranks = group_average_rank(df, ["g"], "v", "r")
    w = Window.partitionBy("g").orderBy("v")
    plain = df.withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy("g", "v")) - 1) / 2.0)
    assert ranks.exceptAll(plain).count() == 0 and ranks.count() == 600_000
    per = group_value_ranks(df, ["g"], "v")
    assert per.agg(F.sum("__m")).first()[0] == 600_000
    assert per.filter("__m > 50000").count() == 2       # the heavy value is one row of each large group


def test_pairs_in_one_pass_equal_pairs_one_by_one(spark):
    r = random.Random(6)
    rows = [(r.choice("ab") if i % 9 else None, float(r.randint(0, 5)), 1.0, None if i % 4 == 0 else r.random()) for i in range(300)]
    df = spark.createDataFrame(rows + [("only", 1.0, 2.0, None)], "g string, x double, c double, y double")
    pairs = [("x", "y"), ("c", "x")]
    got = {(t.pair, t.g): t for t in metric_correlations(df, ["g"], pairs).collect()}
    for x, y in pairs:
        for t in metric_correlation(df, ["g"], x, y).collect():
            other = got.pop((f"{x} vs {y}", t.g))
            assert t.n == other.n
            for c in ("pearson_r", "spearman_r", "pearson_p", "spearman_p"):
                assert str(t[c]) == str(other[c]) or t[c] == pytest.approx(other[c], abs=1e-12)
    assert not got
