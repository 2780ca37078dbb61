"""Temporal prefix split with target masks, and the case ("classic") split.

One pass: the next timestamp of every event (skew-safe ordered window) on the
full log, then

* train = events with ts <= sep; masked where the next event lies after sep
  (the last train event of a truncated case);
* test  = every event of cases ending after sep; masked where the next event
  is at or before sep (its target was already seen in training);
* trunc = events of cases that straddle sep (statistics only).

The mask is a boolean column, so it can never fall out of row alignment.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.columns import micros
from caseflow.functions.ordered import case_frame
from caseflow.functions.rank import global_row_number, kth_smallest
from caseflow.functions.storage import written
from caseflow.spec import LogSpec

MASK = "masked"


@dataclass
class Split:
    train: DataFrame
    test: DataFrame
    trunc: Optional[DataFrame]
    sep_us: int


def separation_index(n: int, frac: float) -> int:
    """Index into the sorted timestamps, rounded exactly as the reference does."""
    return int(n * (1 - frac))


def separation_time_us(df: DataFrame, spec: LogSpec, frac: float) -> int:
    """The timestamp (µs) at 0-based index int(n*(1-frac)) of all sorted event times."""
    us = df.select(micros(spec.ts).alias("__us"))
    return int(kth_smallest(us, "__us", frac=frac))


def prefix_split(df: DataFrame, spec: LogSpec, frac: float, mask_in: Optional[str] = None,
                 sep_us: Optional[int] = None, hot_case_rows: Optional[int] = None,
                 hot=None, keep: bool = False) -> Split:
    """T8 (with T2-T7): temporal prefix split of ``df`` at fraction ``frac``.

    ``mask_in``: name of an incoming boolean mask column to OR into both splits (T7).
    ``keep``: write the frame of the windows; the separation time and the parts read
    that table, and ``df`` is worked out for it alone (and for the sizes of its cases
    where ``hot`` is not known).
    ``hot``: hot cases already known (e.g. from ``prepare_log``); a split only
    shrinks cases, so a table computed on a superset stays valid.
    """
    if frac <= 0.0:
        raise ValueError("split size must be > 0")  # K2
    if sep_us is None and not keep:
        sep_us = separation_time_us(df, spec, frac)
    fr = case_frame(df.withColumn("__at", micros(spec.ts)), spec, next_cols=["__at"], prefix="__n", bounds=True,
                    hot_case_rows=hot_case_rows, hot=hot)
    if keep:
        fr = written(fr)
        if sep_us is None:
            sep_us = separation_time_us(fr, spec, frac)
    sep, us, nxt = F.lit(sep_us), F.col("__at"), F.col("__n__at")
    carry = (lambda m: m | F.coalesce(F.col(mask_in), F.lit(False))) if mask_in else (lambda m: m)
    helper = ["__at", "__n__at", "case_start_us", "case_end_us", "case_n"]
    train = (fr.filter(us <= sep)
               .withColumn(MASK, carry(F.coalesce(nxt > sep, F.lit(False)))))
    test = (fr.filter(F.col("case_end_us") > sep)
              .withColumn(MASK, carry(F.coalesce(nxt <= sep, F.lit(False)))))
    trunc = fr.filter((F.col("case_start_us") <= sep) & (F.col("case_end_us") > sep))
    drop_mask_in = [mask_in] if mask_in and mask_in != MASK else []
    return Split(train.drop(*helper, *drop_mask_in), test.drop(*helper, *drop_mask_in),
                 trunc.drop(*helper, *drop_mask_in, *([MASK] if MASK in trunc.columns else [])),
                 sep_us)


def truncated_cases(df: DataFrame, spec: LogSpec, sep_us: int) -> DataFrame:
    """T4: cases with start <= sep < end."""
    us = micros(spec.ts)
    return (df.groupBy(spec.case).agg(F.min(us).alias("s"), F.max(us).alias("e"))
              .filter((F.col("s") <= sep_us) & (F.col("e") > sep_us)).select(spec.case))


def case_split(df: DataFrame, spec: LogSpec, frac: float, mask_in: Optional[str] = None):
    """The newest int(frac * n_cases) cases by first event become validation.

    Order: first event descending, case id ascending for ties (explicit, so it is
    reproducible).  Returns ``(train, val, sep_us)`` with sep = min ts of val.
    The masks follow their rows (it is a column).  The starts of the cases are
    positioned over range partitions and written; ``df`` is read once for them and
    once for each part.
    """
    us = micros(spec.ts)
    starts = df.groupBy(spec.case).agg(F.min(us).alias("__start"))
    placed = written(global_row_number(starts, [F.col("__start").desc_nulls_last(), F.col(spec.case)], "__place"))
    k = int(frac * placed.count())
    if k <= 0:
        return df, df.limit(0), None
    val_cases = placed.filter(F.col("__place") <= k)
    sep = val_cases.agg(F.min("__start")).first()[0]
    return (df.join(val_cases.select(spec.case), spec.case, "left_anti"),
            df.join(val_cases.select(spec.case), spec.case, "left_semi"), sep)


def train_test_val(df: DataFrame, spec: LogSpec, test_size: float = 0.2, val_size: float = 0.0,
                   val_split: str = "prefix", hot_case_rows: Optional[int] = None) -> dict:
    """Test split first; if val_size > 0 split train again (prefix or classic).

    The frame of each split is written and its parts read it, so ``df`` is not worked
    out again for every part."""
    tt = prefix_split(df, spec, test_size, hot_case_rows=hot_case_rows, keep=True)
    out = {"train": tt.train, "test": tt.test, "tt_trunc": tt.trunc, "tt_sep_us": tt.sep_us,
           "val": None, "tv_trunc": None, "tv_sep_us": None}
    if val_size > 0:
        if val_split == "prefix":
            tv = prefix_split(tt.train, spec, val_size, mask_in=MASK, hot_case_rows=hot_case_rows, keep=True)
            out.update(train=tv.train, val=tv.test, tv_trunc=tv.trunc, tv_sep_us=tv.sep_us)
        elif val_split == "classic":
            tr, va, sep = case_split(tt.train, spec, val_size)
            out.update(train=tr, val=va, tv_sep_us=sep)
        else:
            raise ValueError(f"unknown val split {val_split!r}")
    return out
