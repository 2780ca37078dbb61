"""Dataset statistics of a split protocol."""

from __future__ import annotations

from functools import reduce
from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.columns import micros
from caseflow.functions.ordered import CHUNK, case_frame
from caseflow.functions.rank import kth_smallest
from caseflow.functions.storage import written
from caseflow.spec import LogSpec


def max_case_duration_days(df: DataFrame, spec: LogSpec, mask: Optional[str] = None) -> DataFrame:
    """One row ``max_duration_days`` = max over cases of whole days (floor)
    between first and last event, ignoring masked rows; 0 if empty."""
    if mask:
        df = df.filter(~F.col(mask))
    us = micros(spec.ts)
    per_case = df.groupBy(spec.case).agg(F.floor((F.max(us) - F.min(us)) / F.lit(86_400_000_000)).alias("d"))
    return per_case.agg(F.coalesce(F.max("d"), F.lit(0)).cast("long").alias("max_duration_days"))


def split_statistics(df: DataFrame, spec: LogSpec, name: str, mask: Optional[str] = None,
                     with_events: bool = True) -> DataFrame:
    """One row: split, cases, events, start_day, end_day, max_duration_days."""
    if mask:
        df = df.filter(~F.col(mask))
    us = micros(spec.ts)
    per_case = df.groupBy(spec.case).agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("s"), F.max(us).alias("e"))
    day = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd")
    out = per_case.agg(F.count(F.lit(1)).alias("cases"),
                       F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
                       day(F.min("s")).alias("start_day"), day(F.max("e")).alias("end_day"),
                       F.coalesce(F.max(F.floor((F.col("e") - F.col("s")) / F.lit(86_400_000_000))), F.lit(0))
                        .cast("long").alias("max_duration_days"))
    out = out.select(F.lit(name).alias("split"), "*")
    if not with_events:
        out = out.withColumn("events", F.lit(None).cast("long"))
    return out


def dataset_statistics(spec: LogSpec, orig: DataFrame, filtered: DataFrame, train: DataFrame,
                       test: DataFrame, tt_trunc: DataFrame, sep_us: int,
                       val: Optional[DataFrame] = None, tv_trunc: Optional[DataFrame] = None,
                       tv_sep_us: Optional[int] = None, mask: str = "masked") -> DataFrame:
    """Long table, one row per part (orig, filtered, train, test, val and the
    train/test and train/val intersections); train/test/val exclude masked rows;
    intersections report no event count.  ``separation_day`` is the day of the
    split a part comes from: the train/val split for val and its intersection,
    the train/test split for all others."""
    parts = [split_statistics(orig, spec, "orig"), split_statistics(filtered, spec, "filtered"),
             split_statistics(train, spec, "train", mask), split_statistics(test, spec, "test", mask),
             split_statistics(tt_trunc, spec, "train_test_intersect", with_events=False)]
    if val is not None:
        parts.append(split_statistics(val, spec, "val", mask if mask in val.columns else None))
    if tv_trunc is not None:
        parts.append(split_statistics(tv_trunc, spec, "train_val_intersect", with_events=False))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    day = lambda us: F.date_format(F.timestamp_micros(F.lit(us).cast("long")), "yyyy-MM-dd")
    return out.withColumn("separation_day", F.when(F.col("split").isin("val", "train_val_intersect"), day(tv_sep_us))
                          .otherwise(day(sep_us)))


def timeline(df: DataFrame, spec: LogSpec, hot_case_rows: Optional[int] = None) -> DataFrame:
    """(case, us, next_us) of every event, written: all that the parts of a split, their
    masks and their statistics depend on."""
    slim = df.select(*dict.fromkeys([spec.case, *spec.order_by, *[c for c in (CHUNK,) if c in df.columns]]))
    fr = case_frame(slim.withColumn("us", micros(spec.ts)), spec, next_cols=["us"], hot_case_rows=hot_case_rows)
    return written(fr.select(spec.case, "us", "next_us"))


def protocol_statistics(spec: LogSpec, summary: DataFrame, events: DataFrame, test_size: float, val_size: float = 0.0,
                        min_length: int = 3) -> DataFrame:
    """T12 of a prefix split (and a prefix validation split of its train part) in one
    aggregation: every part is a condition on an event and on its case, so a case
    yields the counts and bounds of all parts at once, and they are unfolded after.

    ``summary``: the case summary of the raw log (case, n, start_us, end_us), its cases
    of ``min_length`` events or more are part ``orig``; ``events``: the ``timeline`` of the
    filtered log."""
    us, nxt = F.col("us"), F.col("next_us")
    sep = kth_smallest(events, "us", frac=test_size)
    vsep = kth_smallest(events.filter(us <= sep), "us", frac=val_size) if val_size > 0 else None
    in_train, last = us <= sep, F.max(F.when(us <= sep, us))
    after = lambda t: F.coalesce(nxt > t, F.lit(False))
    seen = lambda t: F.coalesce(nxt <= t, F.lit(False))
    always, straddles = F.lit(True), (F.col("__s") <= sep) & (F.col("__e") > sep)
    # part: condition on an event, condition on its case
    parts = {"filtered": (always, always), "test": (~seen(sep), F.col("__e") > sep), "train_test_intersect": (always, straddles)}
    if vsep is None:
        parts["train"] = (in_train & ~after(sep), always)
    else:
        own = F.when(nxt <= sep, nxt)       # the next event inside the train part
        kept = in_train & ~after(sep)
        parts["train"] = (kept & (us <= vsep) & ~F.coalesce(own > vsep, F.lit(False)), always)
        parts["val"] = (kept & ~F.coalesce(own <= vsep, F.lit(False)), F.col("__last") > vsep)
        parts["train_val_intersect"] = (in_train, (F.col("__s") <= vsep) & (F.col("__last") > vsep))
    aggs = [F.min(us).alias("__s"), F.max(us).alias("__e"), last.alias("__last")]
    for name, (event, _) in parts.items():
        at = F.when(event, us)
        aggs.append(F.struct(F.count(at).alias("n"), F.min(at).alias("s"), F.max(at).alias("e")).alias(f"__p_{name}"))
    cases = events.groupBy(spec.case).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(name).alias("split"), F.when(case, F.col(f"__p_{name}")["n"]).otherwise(0).alias("n"),
                              F.col(f"__p_{name}")["s"].alias("s"), F.col(f"__p_{name}")["e"].alias("e"))
                     for name, (_, case) in parts.items()])
    per_case = cases.select(F.inline(rows)).filter("n > 0").unionByName(
        summary.filter(F.col("n") >= min_length).select(F.lit("orig").alias("split"), "n", F.col("start_us").alias("s"),
                                                        F.col("end_us").alias("e")))
    day = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd")
    own_day = lambda t: day(F.lit(t).cast("long"))
    of_val = F.col("split").isin("val", "train_val_intersect")
    return per_case.groupBy("split").agg(
        F.count(F.lit(1)).alias("cases"), F.sum("n").alias("__events"), day(F.min("s")).alias("start_day"),
        day(F.max("e")).alias("end_day"),
        F.max(F.floor((F.col("e") - F.col("s")) / F.lit(86_400_000_000))).cast("long").alias("max_duration_days")).select(
        "split", "cases", F.when(~F.col("split").endswith("intersect"), F.col("__events")).alias("events"),
        "start_day", "end_day", "max_duration_days",
        F.when(of_val, own_day(vsep)).otherwise(own_day(sep)).alias("separation_day"))


def dataset_overview(stats: DataFrame) -> DataFrame:
    """Per log train/test cases and events, totals and mean events per case (1 decimal)."""
    w = stats.groupBy().pivot("split", ["train", "test"]).agg(F.max("cases").alias("cases"),
                                                              F.max("events").alias("events"))
    return w.select("*", (F.col("train_cases") + F.col("test_cases")).alias("total_cases"),
                    (F.col("train_events") + F.col("test_events")).alias("total_events"),
                    F.round(F.try_divide(F.col("train_events") + F.col("test_events"),
                                         F.col("train_cases") + F.col("test_cases")), 1).alias("avg_events_per_case"))
