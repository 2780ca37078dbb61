"""Exact names of prefixes (X1, X2, Q12) that keep their order, without whole-case arrays.

A prefix of a case is named in blocks of ``BLOCK`` events.  On the first level the
name of an event is the run of activities of its own block up to it, written so
that strings sort as the activities do.  The distinct names are numbered in that
order; on the next level a name is the numbers of the full blocks before, and the
event's own, of a block of ``BLOCK`` numbers; and so on until one block holds the
longest case: cases of up to 64 events take one level, of 4,096 two, of 262,144
three.  On the last level two events have one name exactly if their prefixes are
equal, and names sort as the prefixes (a prefix before its continuations).

Every key of a group, a join or a sort is a string of at most ``BLOCK`` elements.  A
long case is worked on block by block, and a prefix is spelled out only for the rows
that ask for it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.columns import micros
from caseflow.functions.ordered import (CHUNK, DEFAULT_HOT_CASE_ROWS, case_frame, hot_table, with_chunks)
from caseflow.functions.rank import global_row_number
from caseflow.functions.storage import written
from caseflow.spec import EOS, LogSpec

BLOCK = 64
# Ends an activity; starts one that is not null; escapes the characters below \x03.
_END, _START, _ESC = "\x01", "\x02", "\x02"
_ESCAPED = (("\x02", "\x05"), ("\x01", "\x04"), ("\x00", "\x03"))


def _written_out(activity: Column) -> Column:
    """An activity as a string that sorts, with others after it, as the activity."""
    c = activity
    for raw, mark in _ESCAPED:
        c = F.replace(c, F.lit(raw), F.lit(_ESC + mark))
    return F.when(activity.isNull(), F.lit(_END)).otherwise(F.concat(F.lit(_START), c, F.lit(_END)))


def _read_back(part: Column) -> Column:
    c = F.substring(part, 2, 2147483647)
    for raw, mark in reversed(_ESCAPED):
        c = F.replace(c, F.lit(_ESC + mark), F.lit(raw))
    return F.when(part != "", c)


@dataclass
class PrefixCounts:
    """``counts`` (name, prefix_length, next_activity, next_count), written, and the
    numbered names of the levels below (name, number) that spell a name out."""

    counts: DataFrame
    levels: list
    widths: list
    block: int

    def per_prefix(self) -> DataFrame:
        """name, prefix_length, count, next_options, next_entropy_bits, next (the next
        activities with their counts, at most the vocabulary).  The entropy is
        log2 T - sum(n log2 n) / T."""
        n = F.col("next_count")
        per = self.counts.groupBy("name").agg(
            F.max("prefix_length").cast("int").alias("prefix_length"), F.sum(n).alias("count"),
            F.count(F.lit(1)).alias("next_options"), F.sum(n * F.log2(n)).alias("__nl"),
            F.collect_list(F.struct("next_activity", "next_count")).alias("next"))
        return per.withColumn("next_entropy_bits", F.greatest(
            F.log2("count") - F.col("__nl") / F.col("count"), F.lit(0.0))).drop("__nl")

    def ranked(self) -> DataFrame:
        """``per_prefix`` with prefix_id: 1-based, by (count desc, prefix asc)."""
        return global_row_number(self.per_prefix(), [F.col("count").desc(), F.col("name").asc()], "prefix_id")

    def spelled(self, rows: DataFrame, key: str = "prefix_id") -> DataFrame:
        """``rows`` (``key``, name, ...) with their ``prefix`` as an array."""
        if not self.levels:
            parts = F.split("name", _END)
            return rows.withColumn("prefix", F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), _read_back))
        at = rows.select(F.col(key).alias("__key"), F.lit(0).cast("long").alias("__at"), F.col("name").alias("__name"))
        for names, width in zip(reversed(self.levels), reversed(self.widths)):
            parts = at.select("__key", "__at", F.posexplode(
                F.regexp_extract_all("__name", F.lit(f"([0-9a-f]{{{width}}})"), F.lit(1))).alias("i", "__number"))
            at = (parts.withColumn("number", F.conv("__number", 16, 10).cast("long")).join(names, "number")
                  .select("__key", (F.col("__at") * self.block + F.col("i")).alias("__at"), F.col("name").alias("__name")))
        parts = F.split("__name", _END)
        steps = (at.select("__key", "__at", F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("i", "a"))
                 .select("__key", (F.col("__at") * self.block + F.col("i")).alias("at"), _read_back(F.col("a")).alias("a")))
        whole = steps.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("at", "a"))).alias("__steps"))
        return (rows.join(whole, F.col(key) == F.col("__key"))
                .withColumn("prefix", F.transform("__steps", lambda s: s["a"])).drop("__steps", "__key"))


def _positions(df: DataFrame, spec: LogSpec, max_len: Optional[int], hot_case_rows: Optional[int], block: int):
    """(case, __pos, __next, activity as a string, [chunk]) of every event, and the
    length of the longest prefix."""
    rows = hot_case_rows or DEFAULT_HOT_CASE_ROWS
    own = dict.fromkeys([spec.case, *spec.order_by, spec.activity])
    slim = df.select(*own).withColumn(spec.activity, F.col(spec.activity).cast("string"))
    us = micros(spec.ts)
    cases = written(slim.groupBy(spec.case).agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("lo"), F.max(us).alias("hi")))
    longest = cases.agg(F.max("n")).first()[0] or 0
    hot = hot_table(slim, spec, cases, rows) if longest > rows else False
    ev = case_frame(with_chunks(slim, spec, hot), spec, [spec.activity], hot=hot, hot_case_rows=rows, position="__pos")
    if max_len is not None:
        ev = ev.filter(F.col("__pos") <= max_len)
        longest = min(longest, max_len)
    # ordinary cases stay partitioned as they are; a hot case's blocks cross its chunks
    keys = [spec.case] + ([CHUNK] if hot is False else [])
    ev = ev.select(*keys, "__pos", F.expr(f"(__pos - 1) div {block}").alias("__block"),
                   _written_out(F.col(spec.activity)).alias("__a"),
                   F.coalesce("next_" + spec.activity, F.lit(EOS)).alias("next_activity"))
    return ev, keys, longest


def count_prefixes(df: DataFrame, spec: LogSpec, max_len: Optional[int] = None, hot_case_rows: Optional[int] = None,
                   block: int = BLOCK) -> PrefixCounts:
    """X2 on a log: counts of (prefix, next activity or ``<EOS>``), the prefixes of up to
    ``max_len`` events (None: all) by their exact names."""
    ev, keys, longest = _positions(df, spec, max_len, hot_case_rows, block)
    case = spec.case
    so_far = Window.partitionBy(*keys, "__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    named = ev.select(case, "__pos", "next_activity",
                      F.concat_ws("", F.collect_list("__a").over(so_far)).alias("name"))
    levels, widths, size = [], [], block
    while size < longest:
        named = written(named)
        names = written(global_row_number(named.select("name").distinct(), ["name"], "number"))
        levels.append(names)
        widths.append(len(f"{names.count():x}"))
        numbered = written(named.join(names, "name").select(
            case, "__pos", "next_activity", F.lower(F.lpad(F.hex("number"), widths[-1], "0")).alias("__number")))
        # the numbers of the full blocks before a block, within its block of the next level
        full = numbered.filter(F.col("__pos") % size == 0).select(
            case, F.expr(f"__pos div {size}").alias("__block"), "__number")
        in_next = Window.partitionBy(case, F.expr(f"(__block - 1) div {block}")).orderBy("__block")
        before = (full.select(case, "__block", F.concat_ws("", F.collect_list("__number").over(
                      in_next.rowsBetween(Window.unboundedPreceding, 0))).alias("__before"))
                  .filter(F.col("__block") % block != 0))
        named = (numbered.withColumn("__block", F.expr(f"(__pos - 1) div {size}"))
                 .join(before, [case, "__block"], "left")
                 .select(case, "__pos", "next_activity",
                         F.concat(F.coalesce("__before", F.lit("")), F.col("__number")).alias("name")))
        size *= block
    counts = named.groupBy("name", "next_activity").agg(F.count(F.lit(1)).alias("next_count"),
                                                        F.max("__pos").alias("prefix_length"))
    return PrefixCounts(written(counts), levels, widths, block)
