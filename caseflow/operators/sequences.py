"""Q1-Q12: traces, padding, prefix windows and prefix / next pairs.

A trace is one row per case with its ordered events as arrays (the data
model of the sequence models).  Array work after that (slicing, padding,
windows) is higher-order column functions, no Python.
"""

from __future__ import annotations

from typing import Iterable, Optional

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.ordered import case_frame
from caseflow.spec import EOS, LogSpec


def traces(df: DataFrame, spec: LogSpec, columns: Iterable[str], first_k: Optional[int] = None,
           hot_case_rows: Optional[int] = None) -> DataFrame:
    """Q1: ``(case, <col> array ...)`` with the events of each case in order.

    ``first_k`` keeps only the first k events of every case *before* collecting
    (skew-safe positions), so no collected array exceeds k elements.
    """
    columns = list(columns)
    if first_k is not None:
        df = (case_frame(df, spec, position="__pos", hot_case_rows=hot_case_rows)
              .filter(F.col("__pos") <= F.lit(first_k)).drop("__pos"))
    ev = F.struct(*[F.col(c) for c in spec.order_by], *[F.col(c).alias(f"__v{i}") for i, c in enumerate(columns)])
    g = df.groupBy(spec.case).agg(F.sort_array(F.collect_list(ev)).alias("__ev"))
    def field(name):
        return lambda e: e[name]
    return g.select(spec.case, *[F.transform("__ev", field(f"__v{i}")).alias(c)
                                 for i, c in enumerate(columns)])


# Events of a trace that one row holds.
SEGMENT_EVENTS = 4096


def trace_segments(df: DataFrame, spec: LogSpec, columns: Iterable[str], size: int = SEGMENT_EVENTS,
                   hot_case_rows: Optional[int] = None) -> DataFrame:
    """Q1 in segments: ``(case, segment, start, <col> array ...)``, the events of each
    case in order, ``size`` a row; ``start`` events of the case come before.  No array
    is longer than a segment, however long the case."""
    columns = list(columns)
    fr = case_frame(df, spec, position="__pos", hot_case_rows=hot_case_rows)
    segment = F.expr(f"(__pos - 1) div {size}")
    ev = F.struct("__pos", *[F.col(c).alias(f"__v{i}") for i, c in enumerate(columns)])
    g = fr.groupBy(spec.case, segment.alias("segment")).agg(F.sort_array(F.collect_list(ev)).alias("__ev"))
    arrays = [F.col(f"__ev.__v{i}").alias(c) for i, c in enumerate(columns)]
    return g.select(spec.case, "segment", (F.col("segment") * size).alias("start"), *arrays)


def pad_segments(segments: DataFrame, case: str, arr: str, batch: str, size: int, value=0) -> DataFrame:
    """Q3 in segments: ``(batch, case, segment, n_valid, <arr>)``, every case of a batch
    padded to its longest: rows are added up to the last segment of the batch, and
    arrays filled up to ``size`` or to the end of the longest case."""
    n = segments.groupBy(batch, case).agg(F.max(F.col("start") + F.size(arr)).alias("__n"))
    longest = n.groupBy(batch).agg(F.max("__n").alias("__T"))
    cells = n.join(longest, batch).select(batch, case, "__T", F.explode(
        F.sequence(F.lit(0).cast("long"), F.expr(f"(__T - 1) div {size}"))).alias("segment"))
    own = segments.select(batch, case, "segment", arr)
    kind = segments.schema[arr].dataType.simpleString()
    have = F.coalesce(F.col(arr), F.array().cast(kind))
    width = F.least(F.lit(size), F.col("__T") - F.col("segment") * size).cast("int")
    return cells.join(own, [batch, case, "segment"], "left").select(
        batch, case, "segment", F.size(have).alias("n_valid"),
        F.concat(have, F.array_repeat(F.lit(value), F.greatest(width - F.size(have), F.lit(0)))).alias(arr))


def activity_sequences(df: DataFrame, spec: LogSpec, first_k: Optional[int] = None,
                       hot_case_rows: Optional[int] = None) -> DataFrame:
    """(case, acts array<string>), optionally only the first k events of each case."""
    return traces(df, spec, [spec.activity], first_k, hot_case_rows).withColumnRenamed(spec.activity, "acts")


def pad_right(arr, length, value=0):
    """Q3: right-pad an array column to ``length`` with ``value``."""
    a = F.col(arr) if isinstance(arr, str) else arr
    n = F.lit(length) if isinstance(length, int) else (F.col(length) if isinstance(length, str) else length)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(n - F.size(a), F.lit(0))))


def pad_batch(df: DataFrame, arr: str, batch: str, value=0) -> DataFrame:
    """Q3: pad every array of a batch to the longest array in that batch."""
    mx = df.groupBy(batch).agg(F.max(F.size(arr)).alias("__T"))
    return df.join(mx, batch).withColumn(arr, pad_right(arr, F.col("__T"), value)).drop("__T")


def prefix_windows(seqs: DataFrame, arr: str, k: int, pad=-1) -> DataFrame:
    """Q6: per case all prefixes 1..min(n, k-1) right-padded to k, then every
    length-k sliding window (if n >= k).  One output row per window:
    ``(…, win_idx, window)``."""
    a = F.col(arr)
    n = F.size(a)
    short = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(k - 1))),
                        lambda i: pad_right(F.slice(a, 1, i), k, pad))
    empty = F.array().cast(f"array<{seqs.schema[arr].dataType.simpleString()}>")
    full = F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda s: F.slice(a, s, k))) \
            .otherwise(empty)
    short = F.when(n >= 1, short).otherwise(empty) if k > 1 else empty
    return seqs.select("*", F.posexplode(F.concat(short, full)).alias("win_idx", "window"))


def prefix_suffix(seqs: DataFrame, feat: str, tgt: str, k: int, pad=0,
                  include_first: bool = False) -> DataFrame:
    """Q7: (prefix window of features, suffix window of up to k targets starting
    at the window's last event), both right-padded to k with ``pad``.

    Windows are identified by their last event e (1-based): e = 1..n when
    n < k; otherwise the short prefixes e = 1..k-1 and the full windows
    e = k+1..n — the first full window (e = k) is skipped as in the reference
    (quirk K6) unless ``include_first``.  One output row per window:
    ``(…, pair_idx, prefix, suffix)``.
    """
    f, t = F.col(feat), F.col(tgt)
    n = F.size(f)
    empty = F.array().cast("array<int>")
    short_end = F.when(n < k, n).otherwise(F.lit(k - 1))
    shorts = F.when(short_end >= 1, F.sequence(F.lit(1), short_end)).otherwise(empty)
    first = F.when((n >= k) & F.lit(include_first), F.array(F.lit(k))).otherwise(empty)
    longs = F.when(n >= k + 1, F.sequence(F.lit(k + 1), n)).otherwise(empty)
    ends = F.concat(shorts, first, longs)

    def pair(e):
        pre = pad_right(F.slice(f, F.greatest(e - k + 1, F.lit(1)), F.least(e, F.lit(k))), k, pad)
        suf = pad_right(F.slice(t, e, k), k, pad)
        return F.struct(pre.alias("prefix"), suf.alias("suffix"))
    return (seqs.select("*", F.posexplode(F.transform(ends, pair)).alias("pair_idx", "pair"))
                .select("*", F.col("pair.prefix").alias("prefix"), F.col("pair.suffix").alias("suffix"))
                .drop("pair"))


# Events of a case whose windows one task builds.
BLOCK_EVENTS = 100_000


def event_windows(df: DataFrame, spec: LogSpec, back: dict, ahead: dict, k: int, block: int = BLOCK_EVENTS,
                  hot_case_rows: Optional[int] = None) -> DataFrame:
    """One row per event with its 1-based position ``pos``, the size ``n`` of its
    case, and arrays of up to ``k`` elements: per entry ``out: column`` of ``back``
    the last values up to and with the event, of ``ahead`` the next ones from it.

    Events go to blocks of ``block`` positions of their case; the k - 1 events
    around a block's ends go to the neighbour too, as context.  So a window
    function sees a bounded stretch and no case becomes one row.
    """
    block = max(block, k)
    fr = case_frame(df, spec, position="__pos", bounds=True, hot_case_rows=hot_case_rows)
    own = F.floor((F.col("__pos") - 1) / block)
    at = F.pmod(F.col("__pos") - 1, F.lit(block))
    many = F.col("case_n") > block
    to = F.array(own, F.when(many & (at >= block - k + 1), own + 1), F.when(many & (at < k - 1) & (own > 0), own - 1))
    rows = fr.withColumn("__own", own).withColumn("__block", F.explode(F.array_compact(to)))
    w = Window.partitionBy(spec.case, "__block").orderBy("__pos")
    arrays = {}
    for cols, frame in ((back, w.rowsBetween(1 - k, 0)), (ahead, w.rowsBetween(0, k - 1))):
        for out, c in cols.items():
            # structs, as a list drops nulls
            arrays[out] = F.transform(F.collect_list(F.struct(F.col(c).alias("v"))).over(frame), lambda x: x["v"])
    return (rows.withColumns(arrays).filter("__own = __block")
                .select(spec.case, F.col("__pos").alias("pos"), F.col("case_n").alias("n"), *back, *ahead))


def case_prefix_windows(df: DataFrame, spec: LogSpec, col: str, k: int, pad=-1, **options) -> DataFrame:
    """Q6 from events: (case, win_idx, window) — every event's last min(pos, k) values
    right-padded to k: the short prefixes, then the sliding windows."""
    w = event_windows(df, spec, {"__w": col}, {}, k, **options)
    return w.select(spec.case, (F.col("pos") - 1).cast("int").alias("win_idx"), pad_right("__w", k, pad).alias("window"))


def case_prefix_suffix(df: DataFrame, spec: LogSpec, feat: str, tgt: str, k: int, pad=0,
                       include_first: bool = False, **options) -> DataFrame:
    """Q7 from events: (case, pair_idx, prefix, suffix), both right-padded to k; the
    first full window of a case is skipped (quirk K6) unless ``include_first``."""
    w = event_windows(df, spec, {"__p": feat}, {"__s": tgt}, k, **options)
    pos = F.col("pos")
    skip = F.lit(not include_first) & (F.col("n") >= k)
    idx = pos - 1 - F.when(skip & (pos > k), 1).otherwise(0)
    return w.filter(~(skip & (pos == k))).select(
        spec.case, idx.cast("int").alias("pair_idx"), pad_right("__p", k, pad).alias("prefix"),
        pad_right("__s", k, pad).alias("suffix"))


def last_valid(arr, pad=0):
    """Q8: the element at the last non-pad position."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.element_at(F.filter(a, lambda x: x != F.lit(pad)), -1)


def truncate_recent(arr, k: int):
    """Q10: keep the last k steps."""
    a = F.col(arr) if isinstance(arr, str) else arr
    m = F.least(F.lit(k), F.size(a))
    return F.when(m > 0, F.slice(a, -m, m)).otherwise(a)


def trace_lengths(mask_arr):
    """Q11: number of valid (true) positions, at least 1."""
    a = F.col(mask_arr) if isinstance(mask_arr, str) else mask_arr
    return F.greatest(F.aggregate(a, F.lit(0), lambda acc, x: acc + F.when(x, 1).otherwise(0)), F.lit(1))


def collate_choice(name: str) -> str:
    """Q9: 'continuous' or 'prefix'."""
    if name not in ("continuous", "prefix"):
        raise ValueError(f"unknown collate {name!r}")
    return name
