"""Layer-1 composition: prepared log -> split -> encoded positions.

One case-ordered pass produces, for every event, the next event's timestamp
and encoded activity; train / test rows, masks and next-activity targets are
filters and expressions over that pass (the reference builds them in several
sorts and group-bys).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.columns import micros
from caseflow.functions.ordered import CHUNK, DEFAULT_HOT_CASE_ROWS, case_frame
from caseflow.functions.storage import written
from caseflow.operators.encode import apply_mask, encode, fit_vocab, next_categorical
from caseflow.operators.prepare import prepare_log
from caseflow.operators.split import MASK, separation_time_us
from caseflow.spec import MASKED_TARGET, LogSpec


@dataclass
class EncodedSplit:
    train: DataFrame      # case, ts, order..., cur, tgt, masked
    test: DataFrame
    vocab: DataFrame
    sep_us: int
    spec: LogSpec
    prepared: DataFrame   # persisted until ``release`` or ``keep``
    frame: DataFrame      # every event once: cur, train_tgt and test_tgt (null outside the part)

    def release(self) -> None:
        """Free the copy of the prepared log; the frames can still be read, at the price of a new preparation."""
        self.prepared.unpersist()

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, made of these frames, written once; the copy of the prepared log is freed."""
        out = written(df)
        self.release()
        return out


def encoded_split(log: DataFrame, spec: LogSpec, params: Optional[dict] = None,
                  lifecycle: bool = False, hot_case_rows: Optional[int] = None) -> EncodedSplit:
    """Prepare, split at ``test_size`` and encode the activity with a train-fitted vocabulary.

    Train positions: events with ts <= sep; target = next activity within the
    train part of the case (<EOS> at its end), -1 on the last train event of a
    truncated case.  Test positions: every event of cases ending after sep;
    target = next activity (<EOS> at the end), -1 where the next event is at or
    before sep.
    """
    params = params or {}
    T = hot_case_rows or DEFAULT_HOT_CASE_ROWS
    # partitioned once by (case, chunk); the case window below reuses it
    prepared, spec, hot = prepare_log(log, spec, params, lifecycle, hot_case_rows=T, keep_chunk=True)
    # reused by the separation time, the vocabulary and the encoding
    prepared = prepared.persist()
    test_size = params.get("test_size", 0.2) or 0.2
    sep = separation_time_us(prepared, spec, test_size)
    us = micros(spec.ts)
    vocab = written(fit_vocab(prepared.filter(us <= F.lit(sep)), [spec.activity]))
    enc = encode(prepared, vocab, spec.activity, out="cur").withColumn("__at", us)
    fr = case_frame(enc, spec, next_cols=["__at", "cur"], prefix="__n", bounds=True,
                    hot_case_rows=T, hot=hot)
    s = F.lit(sep)
    nxt_us, nxt_id = F.col("__n__at"), F.col("__ncur")
    in_train, in_test = F.col("__at") <= s, F.col("case_end_us") > s
    train_mask, test_mask = F.coalesce(nxt_us > s, F.lit(False)), F.coalesce(nxt_us <= s, F.lit(False))
    train = fr.filter(in_train).withColumn(MASK, train_mask).withColumn(
        "tgt", apply_mask(next_categorical(F.when(nxt_us <= s, nxt_id)), MASK))
    test = fr.filter(in_test).withColumn(MASK, test_mask).withColumn("tgt", apply_mask(next_categorical("__ncur"), MASK))
    masked = F.lit(MASKED_TARGET)
    frame = fr.select("cur", F.when(in_train, F.when(train_mask, masked).otherwise(
        next_categorical(F.when(nxt_us <= s, nxt_id)))).alias("train_tgt"),
        F.when(in_test, F.when(test_mask, masked).otherwise(next_categorical("__ncur"))).alias("test_tgt"))
    helper = ["__at", "__n__at", "__ncur", "case_start_us", "case_end_us", "case_n", CHUNK]
    return EncodedSplit(train.drop(*helper), test.drop(*helper), vocab, sep, spec, prepared, frame)


def event_log_dataset(log: DataFrame, spec: LogSpec, params: Optional[dict] = None,
                      categorical=("activity",), numerical=("accumulated_time",),
                      cat_targets=("activity",), num_targets=("remaining_time",),
                      scale: bool = True, hot_case_rows: Optional[int] = None):
    """The full preparation protocol of the sequence models: prepare -> P11/P12 ->
    split -> time features per split (F1-F6) -> scaling fitted on train (F7/F8) ->
    vocabulary, encoding, next targets, masks (E11).

    One pass over the cases: next event and bounds of every case, in both parts, come
    from one frame, which is written; parts, features, scaler, vocabulary and encoding
    read that table, and the copy of the prepared log is released.

    Returns ``({'train': df, 'test': df}, vocab, sep_us)``.
    """
    from caseflow.operators.encode import AFTER, HAS_NEXT, build_event_log
    from caseflow.operators.features import apply_scaler_values, fit_scaler_values, part_features, scale_columns
    from caseflow.operators.prepare import coerce_amount, fill_resource

    params = params or {}
    T = hot_case_rows or DEFAULT_HOT_CASE_ROWS
    prepared, spec, hot = prepare_log(log, spec, params, hot_case_rows=T, keep_chunk=True)
    prepared = prepared.persist()      # read by the separation time and the frame
    sep_us = separation_time_us(prepared, spec, params.get("test_size", 0.2) or 0.2)
    us, sep = micros(spec.ts), F.lit(sep_us)
    base = coerce_amount(fill_resource(prepared, spec), spec).withColumn("__at", us)
    frame = written(case_frame(base, spec, next_cols=["__at", *cat_targets], prefix=AFTER, bounds=True,
                               upto_us=sep_us, hot_case_rows=T, hot=hot))
    prepared.unpersist()
    after = F.col(f"{AFTER}__at")
    shape = {"train": (us <= sep, "case_upto_us", after > sep, after <= sep),
             "test": (F.col("case_end_us") > sep, "case_end_us", after <= sep, after.isNotNull())}
    parts = {}
    for name, (inside, end, masked, follows) in shape.items():
        part = frame.filter(inside).withColumns({MASK: F.coalesce(masked, F.lit(False)),
                                                 HAS_NEXT: F.coalesce(follows, F.lit(False))})
        parts[name] = part_features(part, spec, end).drop("__at", f"{AFTER}__at", CHUNK)
    if scale:
        cols = [c for c in scale_columns(parts["train"].columns) if c in parts["train"].columns]
        values = fit_scaler_values(parts["train"], cols)          # one row of parameters
        parts = {k: apply_scaler_values(v, values) for k, v in parts.items()}
    vocab = written(fit_vocab(parts["train"], list(dict.fromkeys(list(categorical) + list(cat_targets)))))
    enc, vocab = build_event_log(parts, spec, categorical, numerical, cat_targets, num_targets, vocab=vocab)
    return enc, vocab, sep_us
