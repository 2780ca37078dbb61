"""Order statistics and ranks without a single-partition sort.

* ``kth_smallest`` — exact k-th smallest value: a narrow bracket of approximate
  percentiles, an exact count below it, then the distinct values inside.
* ``global_running`` — 1-based position and running sums in a total order: range
  partitioning by the order, written once; partition totals (one row per
  partition) and partition-local positions both come from the written rows.
* ``group_value_ranks``, ``group_average_rank``, ``group_quantiles`` — per-group ranks
  from running sums over the distinct (group, value) with their multiplicities, so
  no group and no value is sorted inside one task, whatever its share of the rows.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.storage import written

# Half-width of the first percentile bracket; the percentiles are accurate to 1e-5.
_BRACKET = 3e-5


def kth_smallest(df: DataFrame, c: str, k: int | None = None, n: int | None = None,
                 frac: float | None = None, max_bracket: int = 20_000):
    """Exact 0-based k-th smallest value of column ``c`` (nulls ignored).

    Either ``k`` or ``frac`` is given; with ``frac`` the rank is
    ``int(n * (1 - frac))`` (the separation index), with n counted in the same
    job as two approximate percentiles just around it.  They bracket the rank;
    the bracket is narrowed with further percentile passes until it holds at
    most ``max_bracket`` distinct values, which are fetched with their
    multiplicities.
    """
    v = F.col(c)
    grid = [i / 1000 for i in range(1001)]
    acc = 100_000
    if frac is None and n is None:
        n = df.agg(F.count(v)).first()[0]
        if not n:
            raise ValueError("no values")
    p = 1 - frac if frac is not None else (min(int(k), n - 1) + 0.5) / n
    row = df.agg(F.count(v).alias("n"), F.percentile_approx(
        v, [min(1.0, max(0.0, p - _BRACKET)), min(1.0, max(0.0, p + _BRACKET))], acc).alias("g")).first()
    n = row["n"]
    if not n:
        raise ValueError("no values")
    if frac is not None:
        k = int(n * (1 - frac))
    k = min(int(k), n - 1)
    if k < 0:
        raise ValueError("negative rank")
    lo, hi = row["g"]
    sub = df.filter(v.isNotNull())
    rounds = 0
    while True:
        rounds += 1
        # one job: the count below the bracket (null key) and the distinct
        # values inside it with multiplicities, at most max_bracket of them
        res = (sub.filter(v <= hi).groupBy(F.when(v >= lo, v).alias("x")).count()
                  .orderBy(F.col("x").asc_nulls_first()).limit(max_bracket + 2).collect())
        below = res[0]["count"] if res and res[0]["x"] is None else 0
        vals = [(r["x"], r["count"]) for r in res if r["x"] is not None]
        if len(vals) > max_bracket:
            inside = sub.filter(v.between(lo, hi))
            nin = inside.count()
            # more accuracy and a wider neighbourhood on every further round,
            # so a missed bracket cannot repeat forever
            acc_r = min(acc * (2 ** rounds), 10_000_000)
            gg = inside.agg(F.percentile_approx(v, grid, acc_r)).first()[0]
            jj = int((k - below + 0.5) / max(nin, 1) * 1000)
            pad = 2 + rounds
            lo, hi = gg[max(0, jj - pad)], gg[min(1000, jj + pad + 1)]
            continue
        nin = sum(cnt for _, cnt in vals)
        if below <= k < below + nin:
            break
        # approximation missed: widen to the full side
        if k < below:
            lo = sub.agg(F.min(v)).first()[0]
        else:
            hi = sub.agg(F.max(v)).first()[0]
    need = k - below
    for val, cnt in vals:
        if need < cnt:
            return val
        need -= cnt
    raise AssertionError("bracket walk failed")


def global_running(df: DataFrame, order_cols: list, name: str = "rn", sums: dict | None = None,
                   partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row in the total order ``order_cols``
    and, per entry ``out: column`` of ``sums``, the running sum of the column up to
    and with the row.

    The range-partitioned rows are written once: evaluated twice, their
    partition bounds could be sampled differently, and totals and rows disagree.
    Each partition's totals (one row) give the offsets of the next ones.
    """
    sums = sums or {}
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n_parts, *order_cols).sortWithinPartitions(*order_cols)
    # partition-local index: monotonically_increasing_id = (pid << 33) + index
    tagged = written(ordered.withColumn("__pid", F.spark_partition_id())
                     .withColumn("__local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    totals = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"),
                                         *[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums.values())])
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("__pid", F.sum("__n").over(before).alias("__off"),
                         *[F.sum(f"__t{i}").over(before).alias(f"__o{i}") for i in range(len(sums))])
    # one row per partition: bounded by the partition count
    out = tagged.join(F.broadcast(offs), "__pid", "left")
    local = Window.partitionBy("__pid").orderBy("__local").rowsBetween(Window.unboundedPreceding, 0)
    run = {o: F.coalesce(F.col(f"__o{i}"), F.lit(0)) + F.sum(c).over(local) for i, (o, c) in enumerate(sums.items())}
    return (out.withColumns({name: F.coalesce(F.col("__off"), F.lit(0)) + F.col("__local") + 1, **run})
               .drop("__pid", "__local", "__off", *[f"__o{i}" for i in range(len(sums))]))


def global_row_number(df: DataFrame, order_cols: list, name: str = "rn",
                      partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row in the total order ``order_cols``
    (Column expressions or names forming a total order)."""
    return global_running(df, order_cols, name, partitions=partitions)


# A value that more than this share of all rows holds is joined by broadcast: there
# are fewer than 1 / share of them.
HEAVY_SHARE = 1e-3


def group_value_ranks(df: DataFrame, group: list, col: str, aggs: Optional[dict] = None) -> DataFrame:
    """One row per distinct (group, value): ``__m`` rows hold it, ``__first`` rows of the
    group come before it, ``__gn`` rows are in the group, and the aggregates ``aggs``.

    Equal values are one row before anything is sorted, so neither a group nor a value
    that holds a large share of the rows ends up in one range partition."""
    values = df.groupBy(*group, col).agg(F.count(F.lit(1)).alias("__m"), *[e.alias(n) for n, e in (aggs or {}).items()])
    run = global_running(values, [F.col(g) for g in group] + [F.col(col)], "__at", {"__to": "__m"})
    sizes = run.groupBy(*[F.col(g).alias(f"__g_{g}") for g in group]).agg(
        F.min(F.col("__to") - F.col("__m")).alias("__before"), F.sum("__m").alias("__gn"))
    same = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group]
    return (run.join(sizes, same).withColumn("__first", F.col("__to") - F.col("__m") - F.col("__before"))
            .drop("__at", "__to", "__before", *[f"__g_{g}" for g in group]))


def group_average_rank(df: DataFrame, group: list, col: str, name: str) -> DataFrame:
    """1-based rank of ``col`` inside each group with ties averaged."""
    keys = [*group, col]
    ranks = written(group_value_ranks(df, group, col).select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], "__m",
        (F.col("__first") + (F.col("__m") + 1) / 2.0).alias(name)))
    total = ranks.agg(F.sum("__m")).first()[0] or 0
    often = F.col("__m") > F.lit(HEAVY_SHARE * total)
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    drop = ["__m", *[f"__r_{k}" for k in keys]]
    # at most 1 / HEAVY_SHARE values, whatever the size of the table
    few = df.join(F.broadcast(ranks.filter(often)), same, "left")
    rest = few.filter(F.col("__m").isNull()).drop(name, *drop)
    return few.filter(F.col("__m").isNotNull()).drop(*drop).unionByName(
        rest.join(ranks.filter(~often), same).drop(*drop))


def group_quantiles(df: DataFrame, group: list, col: str, qs: list) -> DataFrame:
    """Exact quantiles with linear interpolation (h = (n-1) q) per group:
    one row per (group, q) with ``value``.  The distinct values around the requested
    positions are picked by one aggregation — no group's values are buffered."""
    p = group_value_ranks(df.filter(F.col(col).isNotNull()), group, col)
    at = [(F.col("__gn") - 1) * F.lit(float(q)) for q in qs]
    holds = lambda k: (F.col("__first") <= k) & (k < F.col("__first") + F.col("__m"))
    aggs = [F.max("__gn").alias("__gn")]
    for i, h in enumerate(at):
        aggs += [F.max(F.when(holds(F.floor(h)), F.col(col))).alias(f"__lo{i}"),
                 F.max(F.when(holds(F.ceil(h)), F.col(col))).alias(f"__hi{i}")]
    g = p.groupBy(*group).agg(*aggs)
    value = [F.col(f"__lo{i}") + (h - F.floor(h)) * (F.col(f"__hi{i}") - F.col(f"__lo{i}")) for i, h in enumerate(at)]
    return g.select(*group, F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), v.alias("value"))
                                                for q, v in zip(qs, value)])).alias("__e")) \
            .select(*group, "__e.q", "__e.value")
