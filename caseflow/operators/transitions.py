"""Analytics over a transition table (current, next, count)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.rank import global_running


def transition_summary(t: DataFrame, cur: str = "current_activity", nxt: str = "next_activity",
                       c: str = "count") -> DataFrame:
    """Unique transitions, total transitions, branching factor
    (rows / distinct current), self-transition percentage."""
    return t.agg(F.count(F.lit(1)).alias("unique_transitions"),
                 F.coalesce(F.sum(c), F.lit(0)).alias("total_transitions"),
                 F.try_divide(F.count(F.lit(1)), F.countDistinct(cur)).alias("branching_factor"),
                 F.try_divide(100.0 * F.coalesce(F.sum(F.when(F.col(cur) == F.col(nxt), F.col(c))), F.lit(0)),
                              F.sum(c)).alias("self_transition_pct"))


def cumulative_coverage(t: DataFrame, cur: str = "current_activity", nxt: str = "next_activity",
                        c: str = "count") -> DataFrame:
    """D4 + D5: rank by count desc (ties by current, next), cumulative share of
    all transitions (%), and rank as a percentage of the number of rows.

    Rank and running count come from range partitions, the totals from one
    aggregation: no row set is ordered in one task.
    """
    r = global_running(t.select(cur, nxt, c), [F.col(c).desc(), F.col(cur), F.col(nxt)], "rank", {"__cum": c})
    tot = r.agg(F.sum(c).alias("total"), F.count(F.lit(1)).alias("n")).first()      # two scalars
    return r.select(cur, nxt, c, F.col("rank").cast("int").alias("rank"),
                    (100.0 * F.col("__cum") / F.lit(tot["total"])).alias("cumulative_pct"),
                    (100.0 * F.col("rank") / F.lit(tot["n"])).alias("rank_pct"))


def latest_per_key(runs: DataFrame, key: str, ts: str = "created_at", flag: str = None,
                   flag_value=None) -> DataFrame:
    """Keep runs whose flag matches (null -> False), newest per key."""
    r = runs
    if flag is not None:
        r = r.filter(F.coalesce(F.col(flag), F.lit(False)) == F.lit(flag_value))
    # partial aggregation: the newest row per key, ties -> largest id
    cols = [c for c in r.columns if c != key]
    best = r.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(ts), F.col("id")))
                              .alias("__b"))
    return best.select(key, *[F.col("__b")[c].alias(c) for c in cols]).select(*r.columns)


def metric_melt(df: DataFrame, ids: list, metrics: list, labels: dict = None) -> DataFrame:
    """Wide metrics -> (ids..., metric, score), optionally relabelled."""
    m = df.unpivot(ids, metrics, "metric", "score")
    if labels:
        lab = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
        m = m.withColumn("metric", F.coalesce(lab[F.col("metric")], F.col("metric")))
    return m
