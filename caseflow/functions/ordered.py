"""Skew-safe per-case ordered windows.

Every "next event of the same case" computation (masks, next-activity
targets, transitions) is a ``lead`` over the case order.  A plain
``Window.partitionBy(case)`` puts a whole case into one task, so one case that
holds a large share of the log would stall the job.  ``case_frame`` therefore:

1. finds *hot* cases (more than ``hot_case_rows`` events) with a partially
   aggregated ``groupBy(case)`` and writes them as a table; without any, the
   plan is the plain window;
2. numbers the events of hot cases in the order of the case by range partitions
   and cuts a case every ``hot_case_rows`` positions, so any stretch is split,
   events of one timestamp too, into chunks of just that size; ordinary cases
   are chunk 0;
3. runs the window per ``(case, chunk)`` — chunks follow the order, so a
   ``lead`` is exact except at the last row of a chunk;
4. stitches the last row of each hot chunk to the first row of the next
   non-empty chunk through a table with one row per hot chunk.

Case start / end / size come from the same pass (unbounded window frames for
ordinary cases, the hot-case table for hot ones).  The hot tables are joined
without hints: Spark broadcasts them by their size or shuffles.
"""

from __future__ import annotations

from typing import Iterable, Optional, Union

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.columns import micros
from caseflow.functions.rank import global_row_number
from caseflow.functions.storage import written
from caseflow.spec import LogSpec

# Events per case above which a case is split into chunks.  One chunk is one
# window partition, so this is about the largest window partition a task sorts.
DEFAULT_HOT_CASE_ROWS = 2_000_000
_CHUNK = "__chunk"
_US = "__us"

#: The table of hot cases (case, n, lo, hi, size of a chunk); False: there are none; None: not known yet.
Hot = Union[DataFrame, bool, None]
HOT_COLUMNS = ["__hn", "__hlo", "__hhi"]


def case_window(spec: LogSpec, *extra_partition) -> Window:
    return Window.partitionBy(spec.case, *extra_partition).orderBy(*spec.order_by)


def hot_table(df: DataFrame, spec: LogSpec, summary: DataFrame, hot_case_rows: int) -> Hot:
    """The hot cases of ``summary`` (case, n, lo, hi), written; False if there are none."""
    found = written(summary.filter(F.col("n") > F.lit(hot_case_rows)).select(
        spec.case, "n", "lo", "hi", F.lit(hot_case_rows).cast("long").alias("size")))
    return found if found.limit(1).count() else False


def hot_cases(df: DataFrame, spec: LogSpec, hot_case_rows: int) -> Hot:
    """Hot cases of ``df``."""
    us = micros(spec.ts)
    summ = df.groupBy(spec.case).agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("lo"), F.max(us).alias("hi"))
    return hot_table(df, spec, summ, hot_case_rows)


CHUNK = _CHUNK


def _with_hot(df: DataFrame, spec: LogSpec, hot: DataFrame) -> DataFrame:
    h = hot.select(spec.case, F.col("n").alias("__hn"), F.col("lo").alias("__hlo"), F.col("hi").alias("__hhi"))
    return df.join(h, spec.case, "left")


def hot_chunks(own: DataFrame, spec: LogSpec, hot: DataFrame) -> DataFrame:
    """The events ``own`` of hot cases with their chunk: the position in the case, from
    range partitions over (case, order), divided by the size of a chunk.  What an
    event costs does not depend on the number of chunks."""
    at = global_row_number(own, [spec.case, *spec.order_by], "__at")
    first = at.groupBy(spec.case).agg(F.min("__at").alias("__from")).join(hot.select(spec.case, "size"), spec.case)
    return (at.join(first, spec.case).withColumn(_CHUNK, F.expr("(__at - __from) div size"))
            .drop("__at", "__from", "size"))


def _chunked(df: DataFrame, spec: LogSpec, hot: Hot) -> DataFrame:
    if hot is False:
        return df.withColumn(_CHUNK, F.lit(0).cast("long"))
    cases = hot.select(spec.case)
    rest = df.join(cases, spec.case, "left_anti").withColumn(_CHUNK, F.lit(0).cast("long"))
    return rest.unionByName(hot_chunks(df.join(cases, spec.case, "left_semi"), spec, hot))


def with_chunks(df: DataFrame, spec: LogSpec, hot: Hot, keep_hot_columns: bool = False) -> DataFrame:
    """Add the ``__chunk`` column (0 for ordinary cases, chunk of positions for hot
    ones).  ``keep_hot_columns`` adds ``__hn, __hlo, __hhi``."""
    out = _chunked(df, spec, hot)
    if not keep_hot_columns:
        return out
    return out.withColumns({c: F.lit(None).cast("long") for c in HOT_COLUMNS}) if hot is False else _with_hot(out, spec, hot)


def case_frame(df: DataFrame, spec: LogSpec, next_cols: Iterable[str] = (),
               prefix: str = "next_", bounds: bool = False, last_flag: Optional[str] = None,
               hot_case_rows: Optional[int] = None, hot: Hot = None,
               position: Optional[str] = None, upto_us: Optional[int] = None) -> DataFrame:
    """Add ``prefix+c`` = value of ``c`` at the next event of the same case (null at the end).

    Optional extra columns:
    * ``bounds``: ``case_start_us``, ``case_end_us``, ``case_n`` over the whole case;
    * ``upto_us``: ``case_upto_us``, the last event time of the case up to this one;
    * ``last_flag``: boolean, True on the last event of the case;
    * ``position``: name of a column with the 1-based position of the event in its case.
    """
    next_cols = list(next_cols)
    T = hot_case_rows or DEFAULT_HOT_CASE_ROWS
    if hot is None:
        hot = hot_cases(df, spec, T)
    some = hot is not False
    # a chunk column from upstream stays (and the data partitioned by it)
    base = (df if _CHUNK in df.columns else _chunked(df, spec, hot)).withColumn(_US, micros(spec.ts))
    if some:
        base = _with_hot(base, spec, hot)

    w = case_window(spec, _CHUNK)
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = base.withColumn("__in_chunk_next", F.lead(F.lit(True)).over(w))
    if position:
        out = out.withColumn(position, F.row_number().over(w).cast("long"))
    for c in next_cols:
        out = out.withColumn(prefix + c, F.lead(F.col(c)).over(w))
    if bounds:
        out = (out.withColumn("case_start_us", F.min(_US).over(wall))
                  .withColumn("case_end_us", F.max(_US).over(wall))
                  .withColumn("case_n", F.count(F.lit(1)).over(wall)))
    early = F.when(F.col(_US) <= F.lit(upto_us), F.col(_US)) if upto_us is not None else F.lit(None).cast("long")
    if upto_us is not None:
        out = out.withColumn("case_upto_us", F.max(early).over(wall))

    if some:
        # per hot chunk: its first row, size and time range; per hot case the
        # next chunk's first row and exact totals (one row per hot chunk)
        hot_rows = base.filter(F.col("__hn").isNotNull())
        chunks = hot_rows.groupBy(spec.case, _CHUNK).agg(
            F.min_by(F.struct(*[F.col(c) for c in next_cols] or [F.lit(True).alias("_")]),
                     F.struct(*[F.col(c) for c in spec.order_by])).alias("__first"),
            F.count(F.lit(1)).alias("__cn"), F.min(_US).alias("__clo"), F.max(_US).alias("__chi"),
            F.max(early).alias("__cup"))
        wc = Window.partitionBy(spec.case).orderBy(_CHUNK)
        wall_c = Window.partitionBy(spec.case)
        stitch = chunks.select(spec.case, _CHUNK,
                               F.lead("__first").over(wc).alias("__next_first"),
                               F.sum("__cn").over(wall_c).alias("__case_n"),
                               F.coalesce(F.sum("__cn").over(wc.rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0)).alias("__prev_n"),
                               F.min("__clo").over(wall_c).alias("__case_lo"),
                               F.max("__chi").over(wall_c).alias("__case_hi"),
                               F.max("__cup").over(wall_c).alias("__case_up"))
        out = out.join(stitch, [spec.case, _CHUNK], "left")
        at_end = F.col("__in_chunk_next").isNull()
        for c in next_cols:
            out = out.withColumn(prefix + c, F.when(at_end, F.col("__next_first")[c])
                                 .otherwise(F.col(prefix + c)))
        is_last = at_end & F.col("__next_first").isNull()
        if position:
            out = out.withColumn(position, F.col(position) + F.coalesce(F.col("__prev_n"), F.lit(0)))
        if bounds:
            out = (out.withColumn("case_start_us", F.coalesce(F.col("__case_lo"), F.col("case_start_us")))
                      .withColumn("case_end_us", F.coalesce(F.col("__case_hi"), F.col("case_end_us")))
                      .withColumn("case_n", F.coalesce(F.col("__case_n"), F.col("case_n"))))
        if upto_us is not None:
            out = out.withColumn("case_upto_us", F.coalesce(F.col("__case_up"), F.col("case_upto_us")))
        drop = ["__next_first", "__case_n", "__prev_n", "__case_lo", "__case_hi", "__case_up", *HOT_COLUMNS]
    else:
        is_last = F.col("__in_chunk_next").isNull()
        drop = []
    if last_flag:
        out = out.withColumn(last_flag, is_last)
    # a chunk column that came in stays (later passes reuse the partitioning)
    own_chunk = [] if _CHUNK in df.columns else [_CHUNK]
    return out.drop("__in_chunk_next", _US, *own_chunk, *drop)


_FUNCS = {"min": F.min, "max": F.max, "sum": F.sum}
_COMBINE = {"min": F.least, "max": F.greatest, "sum": lambda a, b: a + b}


def case_running(df: DataFrame, spec: LogSpec, aggs: dict, exclusive: bool = False,
                 hot_case_rows: Optional[int] = None, hot: Hot = None,
                 position: Optional[str] = None) -> DataFrame:
    """Running aggregates along each case's order: ``aggs`` maps an output name
    to ``(func, column)`` with func in min / max / sum.  ``exclusive`` aggregates
    the rows strictly before the current one (null for the first row).

    Hot cases are chunked as in ``case_frame``: the running aggregate runs per
    (case, chunk) and is combined with the aggregate of all earlier chunks of
    the case, taken from a table with one row per hot chunk.
    """
    T = hot_case_rows or DEFAULT_HOT_CASE_ROWS
    if hot is None:
        hot = hot_cases(df, spec, T)
    some = hot is not False
    reuse = _CHUNK in df.columns
    base = (df if reuse else _chunked(df, spec, hot)).withColumn(_US, micros(spec.ts))
    if some:
        base = _with_hot(base, spec, hot)
    w = case_window(spec, _CHUNK)
    frame = w.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    out = base
    for name, (fn, c) in aggs.items():
        out = out.withColumn(name, _FUNCS[fn](c).over(frame))
    if position:
        out = out.withColumn(position, F.row_number().over(w).cast("long"))
    if some:
        chunk_aggs = [_FUNCS[fn](c).alias(f"__c_{name}") for name, (fn, c) in aggs.items()]
        chunks = base.filter(F.col("__hn").isNotNull()).groupBy(spec.case, _CHUNK).agg(
            F.count(F.lit(1)).alias("__cn"), *chunk_aggs)
        wc = Window.partitionBy(spec.case).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carry = chunks.select(spec.case, _CHUNK,
                              F.coalesce(F.sum("__cn").over(wc), F.lit(0)).alias("__prev_n"),
                              *[_FUNCS[fn](f"__c_{name}").over(wc).alias(f"__p_{name}")
                                for name, (fn, c) in aggs.items()])
        out = out.join(carry, [spec.case, _CHUNK], "left")
        for name, (fn, c) in aggs.items():
            prev, here = F.col(f"__p_{name}"), F.col(name)
            comb = F.when(prev.isNull(), here).when(here.isNull(), prev).otherwise(_COMBINE[fn](prev, here))
            out = out.withColumn(name, comb)
        if position:
            out = out.withColumn(position, F.col(position) + F.coalesce(F.col("__prev_n"), F.lit(0)))
        out = out.drop("__prev_n", *[f"__p_{n}" for n in aggs], *HOT_COLUMNS)
    # a chunk column that came in stays (a following pass reuses the partitioning)
    return out.drop(_US) if reuse else out.drop(_CHUNK, _US)
