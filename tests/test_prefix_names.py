"""Prefix names against prefixes as lists: equal, in order, at every depth of levels."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseflow.operators import prefixes as X
from caseflow.operators.prefix_names import count_prefixes
from caseflow.spec import EOS, LogSpec

SPEC = LogSpec(case="case_id", activity="activity", ts="ts", order=("seq",))


def log_of(spark, cases):
    rows = [(c, a, 1_000_000 * (i // 3), i) for c, acts in cases.items() for i, a in enumerate(acts)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "case_id string, activity string, us long, seq long")
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us").repartition(5)


def want_of(cases, max_len=None):
    pairs = Counter()
    for acts in cases.values():
        for i in range(1, min(len(acts), max_len or len(acts)) + 1):
            nxt = acts[i] if i < len(acts) else None
            pairs[(tuple(acts[:i]), EOS if nxt is None else nxt)] += 1
    return pairs


def order_key(prefix):
    return [(a is not None, (a or "").encode()) for a in prefix]


def some_cases(r, alphabet, n, longest):
    return {f"c{i}": [r.choice(alphabet) for _ in range(r.randint(1, longest))] for i in range(n)}


ODD = ["a", "ab", "", "a b", "\x00", "\x01", "\x02", "\x03", "\x01\x02", "a\x00", "a\x01", "Z", "é", "日本", None]


@pytest.mark.parametrize("block,longest,hot", [(64, 9, None), (2, 9, None), (3, 40, None), (2, 40, 6), (64, 40, 6)])
def test_names_count_and_sort_as_the_prefixes(spark, block, longest, hot):
    r = random.Random(block * longest)
    cases = some_cases(r, ODD, 25, longest) | {f"d{i}": ["a", "ab"] * (longest // 2) for i in range(6)}
    named = count_prefixes(log_of(spark, cases), SPEC, block=block, hot_case_rows=hot)
    most = max(map(len, cases.values()))
    assert block ** len(named.levels) < max(most, 2) and block ** (len(named.levels) + 1) >= most
    rows = named.spelled(named.ranked()).orderBy("prefix_id").collect()
    want = want_of(cases)
    got = {(tuple(x.prefix), n.next_activity): n.next_count for x in rows for n in x.next}
    assert got == want
    totals = Counter()
    for (p, _), n in want.items():
        totals[p] += n
    assert [tuple(x.prefix) for x in rows] == sorted(totals, key=lambda p: (-totals[p], order_key(p)))
    assert all(x.prefix_length == len(x.prefix) and x["count"] == totals[tuple(x.prefix)] for x in rows)


def test_pairs_and_bounded_prefixes(spark):
    cases = some_cases(random.Random(4), ["x", "y", None], 30, 12)
    log = log_of(spark, cases)
    for max_len in (None, 1, 4):
        got = Counter((tuple(p.prefix), p.next_activity) for p in X.pairs_of_log(log, SPEC, max_len).collect())
        assert got == want_of(cases, max_len)
    stats = X.prefix_stats(count_prefixes(log, SPEC))
    old, _ = X.prefix_outputs(X.pairs_of_log(log, SPEC))
    order = ["prefix_id", "count", "prefix_length", "next_options", "prefix_str"]
    assert sorted(stats.select(order).collect()) == sorted(old.select(order).collect())
    a, b = X.log_summary(count_prefixes(log, SPEC)).first(), X.prefix_summary(X.pairs_of_log(log, SPEC), old).first()
    assert a.asDict() == pytest.approx(b.asDict())
    top = X.top_k_prefixes(count_prefixes(log, SPEC), 3).orderBy("prefix_id").collect()
    assert [(t.prefix_id, t.prefix_str) for t in top] == [(s.prefix_id, s.prefix_str) for s in old.orderBy("prefix_id").take(3)]


def test_empty_log(spark):
    named = count_prefixes(log_of(spark, {"c": ["a"]}).limit(0), SPEC)
    assert named.counts.count() == 0 and X.prefix_stats(named).collect() == []
    assert X.log_summary(named).first()["prefix_instances"] == 0


def test_a_case_of_100_000_events(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("long").alias("case_id"), F.concat(F.lit("a"), F.col("id") % 7).alias("activity"),
                               F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"), F.col("id").alias("seq"))
    two = df.union(df.withColumn("case_id", F.lit("again")).filter("seq < 50000"))
    named = count_prefixes(two, SPEC)
    assert len(named.levels) == 2
    got = named.per_prefix().groupBy("count").count().collect()
    assert sorted(map(tuple, got)) == [(1, 50_000), (2, 50_000)]
    ranked = named.ranked()
    assert named.spelled(ranked.filter("prefix_length in (1, 4096, 4097, 9000)").select("prefix_id", "name", "prefix_length")) \
        .filter(F.col("prefix") != F.transform(F.sequence(F.lit(0), F.col("prefix_length") - 1),
                                               lambda i: F.concat(F.lit("a"), i % 7))).count() == 0
    assert ranked.filter("prefix_id <= 50000").agg(F.max("prefix_length")).first()[0] == 50_000


def test_no_arrays_in_keys_of_the_plans(spark):
    log = log_of(spark, some_cases(random.Random(2), ["x", "y"], 20, 30))
    plan = count_prefixes(log, SPEC, block=4).ranked()._jdf.queryExecution().toString()
    keys = [line for line in plan.splitlines() if "Exchange" in line or "Aggregate" in line or "Sort" in line]
    assert keys and not any("prefix#" in k.split("functions=")[0] for k in keys)
