"""Prefix frequencies, next-activity distributions, entropies,
concentration (Gini, top-n share).

All statistics are aggregations of the counts of (prefix name, next activity); ranks
use the range-partitioned global row number, names sort as the prefixes, and the Gini
coefficient works on the distinct count values with their multiplicities (no per-row
global rank).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.columns import combine_scalars
from caseflow.functions.rank import global_row_number, global_running
from caseflow.functions.storage import written
from caseflow.operators.prefix_names import PrefixCounts, count_prefixes
from caseflow.spec import LogSpec

SEP = " > "


def pairs_of_log(df: DataFrame, spec: LogSpec, max_len=None, hot_case_rows=None) -> DataFrame:
    """Q12: (prefix array, next activity or ``<EOS>``), a row for every position up to
    ``max_len`` of every case.  The pairs are counted by name first; arrays are made
    for these rows, which are asked for, and for nothing on the way."""
    named = count_prefixes(df, spec, max_len, hot_case_rows)
    rows = named.spelled(named.ranked().select("prefix_id", "name", "next"))
    return (rows.select("prefix", F.inline("next"))
            .select("prefix", "next_activity", F.explode(F.sequence(F.lit(1).cast("long"), "next_count")).alias("__n"))
            .drop("__n"))


def prefix_outputs(pairs: DataFrame):
    """X1-X6 of a table of pairs (prefix array, next_activity) that is there already:
    (prefix_stats, next_distribution).  A log is counted by ``count_prefixes``, whose
    keys are bounded."""
    n = F.col("next_count")
    per = pairs.groupBy("prefix", "next_activity").agg(F.count(F.lit(1)).alias("next_count")).groupBy("prefix").agg(
        F.sum(n).alias("count"), F.count(F.lit(1)).alias("next_options"),
        F.sum(n * F.log2(n)).alias("__nl"), F.collect_list(F.struct("next_activity", "next_count")).alias("next"))
    entropy = F.greatest(F.log2("count") - F.col("__nl") / F.col("count"), F.lit(0.0))
    ranked = global_row_number(per, [F.col("count").desc(), F.col("prefix").asc()], "prefix_id") \
        .withColumn("prefix_str", F.array_join("prefix", SEP))
    stats = ranked.select("prefix_id", "count", F.size("prefix").alias("prefix_length"), "next_options",
                          entropy.alias("next_entropy_bits"), "prefix", "prefix_str")
    return stats, _next_rows(ranked)


def _next_rows(rows: DataFrame) -> DataFrame:
    return (rows.select("prefix_id", "prefix", "prefix_str", "count", F.inline("next"))
            .select("prefix_id", "prefix", "prefix_str", "next_activity", "next_count",
                    (F.col("next_count") / F.col("count")).alias("next_prob")))


def with_text(named: PrefixCounts, rows: DataFrame) -> DataFrame:
    """``rows`` (prefix_id, name, ...) with ``prefix`` and ``prefix_str``."""
    return named.spelled(rows).withColumn("prefix_str", F.array_join("prefix", SEP)).drop("name")


def prefix_stats(named: PrefixCounts) -> DataFrame:
    """prefix_id (rank by count desc, prefix asc), count, prefix_length,
    next_options, next_entropy_bits, prefix, prefix_str."""
    return with_text(named, named.ranked().drop("next")).select(
        "prefix_id", "count", "prefix_length", "next_options", "next_entropy_bits", "prefix", "prefix_str")


def next_distribution(named: PrefixCounts) -> DataFrame:
    """prefix_id, prefix, prefix_str, next_activity, next_count, next_prob."""
    return _next_rows(with_text(named, named.ranked().select("prefix_id", "name", "count", "next")))


def gini(counts: DataFrame, c: str = "count") -> DataFrame:
    """Gini coefficient of a count column; 0 if empty or all zero.

    With x ascending and 1-based index i: 2*sum(i*x)/(n*sum x) - (n+1)/n.
    Rows with equal x form a block; the block of value v with multiplicity m
    after a smaller elements contributes v*(m*a + m(m+1)/2).
    """
    blocks = counts.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    b = global_running(blocks, [F.col("v")], "__i", {"__to": "m"}).withColumn("a", F.col("__to") - F.col("m"))
    s = b.agg(F.sum(F.col("v") * (F.col("m") * F.col("a") + F.col("m") * (F.col("m") + 1) / 2.0)).alias("six"),
              F.sum("m").alias("n"), F.sum(F.col("v") * F.col("m")).alias("tot"))
    return s.select(F.when((F.col("n").isNull()) | (F.col("n") == 0) | (F.col("tot") == 0), F.lit(0.0))
                     .otherwise(2.0 * F.col("six") / (F.col("n") * F.col("tot"))
                                - (F.col("n") + 1.0) / F.col("n")).alias("gini"))


def top_share(counts: DataFrame, n: int, c: str = "count") -> DataFrame:
    """Share of the n largest counts in the total; n <= 0 or empty -> 0."""
    total = counts.agg(F.sum(c).alias("t"))
    if n <= 0:
        return total.select(F.lit(0.0).alias(f"top{n}_share"))
    top = counts.orderBy(F.col(c).desc()).limit(n).agg(F.sum(c).alias("s"))
    both = combine_scalars([top, total])
    return both.select(F.when(F.coalesce(F.col("t"), F.lit(0.0)) == 0, F.lit(0.0))
                        .otherwise(F.col("s") / F.col("t")).alias(f"top{n}_share"))


def conditional_entropy(stats: DataFrame) -> DataFrame:
    """sum(count * H) / sum(count), 0 if empty."""
    return stats.agg(F.coalesce(F.sum(F.col("count") * F.col("next_entropy_bits")) / F.sum("count"),
                                F.lit(0.0)).alias("cond_entropy_bits"))


def marginal_entropy(pairs: DataFrame) -> DataFrame:
    """Entropy of the next activity over all pairs (rows, or counted in ``next_count``)."""
    n = F.sum("next_count") if "next_count" in pairs.columns else F.count(F.lit(1))
    c = pairs.groupBy("next_activity").agg(n.alias("n"))
    # H = log2(T) - sum(n log2 n) / T, from two sums over the distinct next activities
    s = c.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("nl"))
    return s.select(F.when(F.coalesce(F.col("t"), F.lit(0)) == 0, F.lit(0.0))
                     .otherwise(F.log2("t") - F.col("nl") / F.col("t")).alias("marginal_entropy_bits"))


def class_counts(df: DataFrame, spec: LogSpec) -> DataFrame:
    """X11: cases, distinct activities and activities + <EOS>."""
    return df.agg(F.countDistinct(spec.case).alias("n_cases"),
                  F.countDistinct(spec.activity).alias("n_activities")) \
             .withColumn("n_classes_with_eos", F.col("n_activities") + 1)


def prefix_summary(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """One row — instances, unique prefixes, top-5/10 share, Gini,
    H(next | prefix), H(next)."""
    base = stats.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("prefix_instances"),
                     F.count(F.lit(1)).alias("unique_prefixes"))
    parts = [base, top_share(stats, 5), top_share(stats, 10), gini(stats),
             conditional_entropy(stats), marginal_entropy(pairs)]
    return combine_scalars(parts, {"prefix_instances": "long", "unique_prefixes": "long"})


def log_summary(named: PrefixCounts) -> DataFrame:
    """X12 of a log.  No prefix is numbered or spelled out for it."""
    return prefix_summary(named.counts, written(named.per_prefix().select("count", "next_entropy_bits")))


def top_k_prefixes(named: PrefixCounts, k: int) -> DataFrame:
    """prefix_id, count, prefix, prefix_str of the first k prefixes; 0 = all.
    Only these are spelled out."""
    ranked = named.ranked().select("prefix_id", "count", "name")
    return with_text(named, ranked if k == 0 else ranked.filter(F.col("prefix_id") <= k))
