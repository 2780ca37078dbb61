"""Log cleaning and case-level filters.

Case filters (length, start month, end month, duration, right censoring) are
all decided from ONE partially aggregated case summary ``(case, n, start,
end)``; the surviving case keys are then semi-joined to the events (AQE picks
broadcast or shuffle from the measured size and splits a skewed case).
Duplicates are removed afterwards (quirk K3: a case may shrink below 3).
"""

from __future__ import annotations

import warnings
from typing import Optional

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.columns import days_between_us, isclose_le, micros, US_PER_DAY
from caseflow.functions.storage import written
from caseflow.spec import LogSpec, UNKNOWN_RESOURCE


def combine_lifecycle(df: DataFrame, spec: LogSpec, lifecycle: bool = True):
    """activity = activity + '_' + lifecycle (null in either -> null).

    If the log has no lifecycle column the step is disabled.  Returns (df, spec).
    """
    if not lifecycle:
        return df, spec
    if not spec.lifecycle or spec.lifecycle not in df.columns:
        warnings.warn("the log has no lifecycle column: activities stay as they are")
        return df, spec
    out = df.withColumn(spec.activity, F.concat(F.col(spec.activity), F.lit("_"), F.col(spec.lifecycle)))
    return out, spec


def select_log_columns(df: DataFrame, spec: LogSpec) -> DataFrame:
    """Keep case, activity, time, tie-break and the optional columns that exist."""
    keep = [spec.case, spec.activity, spec.ts, *spec.order,
            *[c for c in (spec.resource, spec.amount) if c]]
    seen, cols = set(), []
    for c in keep:
        if c in df.columns and c not in seen:
            seen.add(c)
            cols.append(c)
    return df.select(*cols)


def to_utc(df: DataFrame, spec: LogSpec) -> DataFrame:
    """Timestamps as UTC instants (naive values are read as UTC)."""
    return df.withColumn(spec.ts, F.col(spec.ts).cast("timestamp"))


def case_summary(df: DataFrame, spec: LogSpec) -> DataFrame:
    """(case, n, start_us, end_us) — partial aggregation, one row per case."""
    us = micros(spec.ts)
    return df.groupBy(spec.case).agg(F.count(F.lit(1)).alias("n"),
                                     F.min(us).alias("start_us"),
                                     F.max(us).alias("end_us"))


def _keep_cases(df: DataFrame, spec: LogSpec, cases: DataFrame) -> DataFrame:
    return df.join(cases.select(spec.case), spec.case, "left_semi")


def _month(us_col) -> F.Column:
    return F.date_format(F.timestamp_micros(F.col(us_col)), "yyyy-MM")


def min_case_length(df: DataFrame, spec: LogSpec, k: int = 3) -> DataFrame:
    """Keep cases with at least ``k`` events (reference: size > 2)."""
    return _keep_cases(df, spec, case_summary(df, spec).filter(F.col("n") >= k))


def cases_starting_from(df: DataFrame, spec: LogSpec, month: Optional[str]) -> DataFrame:
    """Keep cases whose first event's month (yyyy-MM) is >= ``month``."""
    if month is None:
        return df
    return _keep_cases(df, spec, case_summary(df, spec).filter(_month("start_us") >= F.lit(month)))


def cases_ending_before(df: DataFrame, spec: LogSpec, month: Optional[str]) -> DataFrame:
    """Keep cases whose last event's month is <= ``month``."""
    if month is None:
        return df
    return _keep_cases(df, spec, case_summary(df, spec).filter(_month("end_us") <= F.lit(month)))


def drop_duplicate_events(df: DataFrame, spec: LogSpec) -> DataFrame:
    """Drop exact duplicates over the kept columns, keep the first in order.

    The tie-break columns are not part of the key; the kept row is the one with
    the smallest tie-break tuple.
    """
    key = [c for c in df.columns if c not in spec.order]
    if not spec.order:
        return df.dropDuplicates(key)
    first = F.min(F.struct(*[F.col(c) for c in spec.order])).alias("__first")
    return (df.groupBy(*key).agg(first)
              .select(*key, *[F.col("__first")[c].alias(c) for c in spec.order])
              .select(*df.columns))


def duration_ok(max_days: float) -> F.Column:
    d = days_between_us("start_us", "end_us")
    return isclose_le(d, float(max_days))


def max_case_duration(df: DataFrame, spec: LogSpec, max_days: float) -> DataFrame:
    """Keep cases with duration (float days) < max_days or isclose to it."""
    return _keep_cases(df, spec, case_summary(df, spec).filter(duration_ok(max_days)))


def latest_start_us(summary: DataFrame, max_days: float) -> int:
    """max(end over the given cases) - max_days, in microseconds (driver scalar)."""
    mx = summary.agg(F.max("end_us")).first()[0]
    if mx is None:
        return None
    return int(mx) - int(round(max_days * US_PER_DAY))


def drop_right_censored(df: DataFrame, spec: LogSpec, max_days: float):
    """P10: keep cases that start no later than max(ts) - max_days.

    Returns ``(df, latest_start_us)``.
    """
    summ = case_summary(df, spec)
    ls = latest_start_us(summ, max_days)
    if ls is None:
        return df, None
    return _keep_cases(df, spec, summ.filter(F.col("start_us") <= F.lit(ls))), ls


def fill_resource(df: DataFrame, spec: LogSpec) -> DataFrame:
    """Null resource -> 'UNKNOWN'."""
    if not spec.resource or spec.resource not in df.columns:
        return df
    return df.withColumn(spec.resource, F.coalesce(F.col(spec.resource).cast("string"),
                                                   F.lit(UNKNOWN_RESOURCE)))


def coerce_amount(df: DataFrame, spec: LogSpec) -> DataFrame:
    """Amount to double, unparsable / null -> 0.0."""
    if not spec.amount or spec.amount not in df.columns:
        return df
    return df.withColumn(spec.amount, F.coalesce(F.expr(f"try_cast(`{spec.amount}` AS double)"),
                                                 F.lit(0.0)))


def validate_columns(df: DataFrame, spec: LogSpec, features=(), targets=(), extra=()) -> DataFrame:
    """Require case id, features and targets; at least one case; keep only
    those (plus the ordering columns and ``extra``)."""
    need = [spec.case, *features, *[t for t in targets if t not in features]]
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    keep = list(dict.fromkeys([*need, spec.ts, *spec.order, *extra]))
    out = df.select(*[c for c in keep if c in df.columns])
    if not out.limit(1).take(1):
        raise ValueError("the log has no cases")
    return out


def prepare_log(df: DataFrame, spec: LogSpec, params: Optional[dict] = None,
                lifecycle: bool = False, hot_case_rows: Optional[int] = None,
                keep_chunk: bool = False, summary: Optional[DataFrame] = None):
    """P1 -> P2 -> P3 -> (P4, P6, P7, P9, P10 case filters) -> P8.

    Physical plan: one written case summary gives the P10 scalar and the table of
    hot cases (more than ``hot_case_rows`` events); the log is then shuffled ONCE
    by case, and everything after stays on that partitioning: case-level filters
    from window aggregates, duplicate removal grouped by keys that include the
    case, and, with ``keep_chunk``, the downstream case windows of the split.
    Hot cases go their own way: judged by the hot table, freed of duplicates, and
    cut into chunks of positions.

    ``summary``: the written ``case_summary`` of the log, where it is there already.

    Returns ``(filtered log, spec)``, or ``(filtered log, spec, hot cases)``
    when ``hot_case_rows`` is given.  With ``keep_chunk`` the ``__chunk``
    column stays (``case_frame`` reuses it).
    """
    from caseflow.functions.ordered import CHUNK, DEFAULT_HOT_CASE_ROWS, hot_chunks, hot_table
    params = params or {}
    T = hot_case_rows or DEFAULT_HOT_CASE_ROWS
    df, spec = combine_lifecycle(df, spec, lifecycle)
    df = to_utc(select_log_columns(df, spec), spec)
    start_date, end_date, max_days = params.get("start_date"), params.get("end_date"), params.get("max_days")

    def conds(n, s, e):
        c = n >= F.lit(3)
        if start_date is not None:
            c = c & (F.date_format(F.timestamp_micros(s), "yyyy-MM") >= F.lit(start_date))
        if end_date is not None:
            c = c & (F.date_format(F.timestamp_micros(e), "yyyy-MM") <= F.lit(end_date))
        if max_days:
            c = c & isclose_le((e - s) / F.lit(US_PER_DAY), float(max_days))
        return c

    # P10 scalar over the P4-P9 survivors, and the hot cases of the log
    summ = written(case_summary(df, spec)) if summary is None else summary
    ls = None
    if max_days:
        mx = summ.agg(F.max(F.when(conds(F.col("n"), F.col("start_us"), F.col("end_us")), F.col("end_us")))).first()[0]
        ls = int(mx) - int(round(max_days * US_PER_DAY)) if mx is not None else None
    hot = hot_table(df, spec, summ.select(spec.case, "n", F.col("start_us").alias("lo"), F.col("end_us").alias("hi")), T)

    us = micros(spec.ts)
    started = (lambda s: s <= F.lit(ls) if ls is not None else F.lit(False)) if max_days else lambda s: F.lit(True)
    # without hot cases the chunk is the constant 0, which Catalyst folds out of
    # the window keys; partitioning by the case alone then satisfies them all
    rest = df if hot is False else df.join(hot.select(spec.case), spec.case, "left_anti")
    part = rest.withColumn(CHUNK, F.lit(0).cast("long")).repartition(spec.case)
    wall = Window.partitionBy(spec.case, CHUNK)
    n, s_, e_ = F.count(F.lit(1)).over(wall), F.min(us).over(wall), F.max(us).over(wall)
    kept = part.withColumn("__keep", conds(n, s_, e_) & started(s_)).filter("__keep").drop("__keep")
    out = drop_duplicate_events(kept, spec)
    if hot is not False:
        # hot cases are judged by their row of the hot table; duplicates go before the
        # chunks are cut, so that none lies in two of them
        fine = hot.filter(conds(F.col("n"), F.col("lo"), F.col("hi")) & started(F.col("lo")))
        own = drop_duplicate_events(df.join(fine.select(spec.case), spec.case, "left_semi"), spec)
        out = out.unionByName(hot_chunks(own, spec, hot))
    if not keep_chunk:
        out = out.drop(CHUNK)
    spec = spec.with_(lifecycle=None)
    if hot_case_rows:
        return out, spec, hot
    return out, spec
