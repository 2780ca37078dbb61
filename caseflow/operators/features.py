"""Time features and standard scaling.

Case-relative features (accumulated / remaining time) take the case start
and end of *this split* from the skew-safe case pass; calendar features are
plain column functions.  Scaling parameters are one row per fit, attached
with a broadcast (it is a single row).
"""

from __future__ import annotations

from typing import Iterable, Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.columns import US_PER_DAY, micros, sinusoid_encoding
from caseflow.functions.ordered import case_frame
from caseflow.spec import NUMERICAL_FEATURES, LogSpec


def calendar_features(ts) -> dict:
    """Calendar and clock parts of a timestamp column."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return {
        "day_of_month": F.dayofmonth(t).cast("double"),
        "day_of_week": F.weekday(t).cast("double"),          # Monday = 0
        "day_of_year": F.dayofyear(t).cast("double"),
        "hour_of_day": F.hour(t).cast("double"),
        "min_of_hour": F.minute(t).cast("double"),
        "month_of_year": F.month(t).cast("double"),
        "sec_of_min": F.second(t).cast("double"),
        "secs_within_day": (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("double"),
        "week_of_year": F.weekofyear(t).cast("double"),      # ISO week
    }


def time_features(df: DataFrame, spec: LogSpec, remaining: bool = True,
                  hot_case_rows: Optional[int] = None, hot=None) -> DataFrame:
    """accumulated_time, remaining_time (days, within this split) and calendar parts."""
    fr = case_frame(df, spec, bounds=True, hot_case_rows=hot_case_rows, hot=hot)
    us = micros(spec.ts)
    out = fr.withColumn("accumulated_time", (us - F.col("case_start_us")) / F.lit(US_PER_DAY))
    if remaining:
        out = out.withColumn("remaining_time", (F.col("case_end_us") - us) / F.lit(US_PER_DAY))
    out = out.withColumns(calendar_features(spec.ts))
    return out.drop("case_start_us", "case_end_us", "case_n")


_BOUNDS = ("case_start_us", "case_end_us", "case_n", "case_upto_us")


def part_features(part: DataFrame, spec: LogSpec, end: str) -> DataFrame:
    """F1-F6 of one part of a frame with case bounds; ``end`` is the column with the last
    event time of the case in this part.  The bounds are dropped."""
    us = micros(spec.ts)
    return part.withColumns({"accumulated_time": (us - F.col("case_start_us")) / F.lit(US_PER_DAY),
                             "remaining_time": (F.col(end) - us) / F.lit(US_PER_DAY),
                             **calendar_features(spec.ts)}).drop(*_BOUNDS)


def split_time_features(df: DataFrame, spec: LogSpec, sep_us: int, hot_case_rows: Optional[int] = None,
                        hot=None) -> DataFrame:
    """F1-F6 of the train and test part of a prefix split at ``sep_us``: the events of
    both with a column ``split`` in front (an event of a case that straddles the
    separation is in both).  One pass: the bounds of a case in each part are window
    aggregates of the same frame, and the parts are unfolded after it."""
    fr = case_frame(df, spec, bounds=True, upto_us=sep_us, hot_case_rows=hot_case_rows, hot=hot)
    us, sep = micros(spec.ts), F.lit(sep_us)
    part = lambda name, inside, end: F.when(inside, F.struct(F.lit(name).alias("split"), F.col(end).alias("end")))
    parts = F.array_compact(F.array(part("train", us <= sep, "case_upto_us"),
                                    part("test", F.col("case_end_us") > sep, "case_end_us")))
    out = part_features(fr.withColumn("__part", F.explode(parts)), spec, "__part.end")
    return out.select("__part.split", *[c for c in out.columns if c != "__part"])


def fit_scaler(train: DataFrame, columns: Iterable[str]) -> DataFrame:
    """one row with mean and population std of every column (masked rows included)."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return train.agg(*aggs)


def fit_scaler_values(train: DataFrame, columns: Iterable[str]) -> dict:
    """F7 as driver values: {column: (mean, std)} — one aggregate row, 2 numbers per column."""
    columns = list(columns)
    row = fit_scaler(train, columns).first()
    return {c: (row[f"{c}__mean"], row[f"{c}__std"]) for c in columns}


def apply_scaler_values(df: DataFrame, values: dict) -> DataFrame:
    """F8 with literal parameters (std 0 or null treated as 1)."""
    for c, (m, sd) in values.items():
        if m is None:
            continue
        d = 1.0 if (sd is None or sd == 0) else float(sd)
        df = df.withColumn(c, (F.col(c) - F.lit(float(m))) / F.lit(d))
    return df


def apply_scaler(df: DataFrame, params: DataFrame, columns: Iterable[str]) -> DataFrame:
    """F8 with a one-row parameter frame (``fit_scaler``): its 2 x columns
    numbers are read once and applied as literals."""
    columns = list(columns)
    row = params.first()
    return apply_scaler_values(df, {c: (row[f"{c}__mean"], row[f"{c}__std"]) for c in columns})


def scale_columns(df_columns: Iterable[str]) -> list:
    """Columns the protocol scales: the ten numeric features, remaining_time, amount if present."""
    cols = list(NUMERICAL_FEATURES) + ["remaining_time"]
    if "amount" in df_columns:
        cols.append("amount")
    return cols


def time_encoding(t, d: int, base: float = 10000.0):
    """sinusoid features of accumulated time."""
    return sinusoid_encoding(t, d, base)


def position_encoding(pos, d: int):
    """the same encoding of an integer position."""
    p = F.col(pos) if isinstance(pos, str) else pos
    return sinusoid_encoding(p.cast("double"), d)
