"""Vocabularies, integer encoding, next-event targets and masks."""

from __future__ import annotations

import warnings
from functools import reduce
from typing import Iterable, Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.joins import checked_broadcast
from caseflow.functions.rank import global_row_number
from caseflow.spec import EOS_ID, MASKED_TARGET, SPECIALS, UNK_ID, LogSpec


def fit_vocab(train: DataFrame, features: Iterable[str], spark=None) -> DataFrame:
    """``(feature, value, id)``; ids 0..2 are <PAD>, <UNK>, <EOS>, then the
    sorted distinct training values from 3.  Masked rows are included.

    The ranking is a range-partitioned global row number — no single-partition sort.
    """
    features = list(features)
    distinct = reduce(lambda a, b: a.unionByName(b),
                      [train.select(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value"))
                            .filter(F.col("value").isNotNull()).distinct() for f in features])
    ranked = global_row_number(distinct, [F.col("feature"), F.col("value")], "__rn")
    first = ranked.groupBy("feature").agg(F.min("__rn").alias("__first"))
    # one row per feature: bounded by the feature list
    learned = (ranked.join(F.broadcast(first), "feature")
                     .select("feature", "value",
                             (F.col("__rn") - F.col("__first") + len(SPECIALS)).cast("int").alias("id")))
    sess = spark or train.sparkSession
    specials = sess.createDataFrame([(f, v, i) for f in features for i, v in enumerate(SPECIALS)],
                                    "feature string, value string, id int")
    return specials.unionByName(learned)


def vocab_sizes(vocab: DataFrame) -> DataFrame:
    """Number of entries per feature, specials included."""
    return vocab.groupBy("feature").agg(F.count(F.lit(1)).alias("size"))


def encode(df: DataFrame, vocab: DataFrame, feature: str, out: Optional[str] = None,
           source: Optional[str] = None) -> DataFrame:
    """Value -> id with the vocabulary of ``feature``; unseen or null -> 1 (<UNK>).

    ``source`` is the column holding the values (default ``feature``); the
    result goes to ``out`` (default: replaces ``source``).  The vocabulary is
    broadcast after a size check (keeps the event side's partitioning); a
    vocabulary beyond the bound is joined with a shuffle.
    """
    source = source or feature
    out = out or source
    v = checked_broadcast(vocab.filter(F.col("feature") == feature).filter(F.col("id") >= len(SPECIALS))
                          .select(F.col("value").alias("__v"), F.col("id").alias("__id")))
    j = df.join(v, F.col(source).cast("string") == F.col("__v"), "left")
    return j.withColumn(out, F.coalesce(F.col("__id"), F.lit(UNK_ID))).drop("__v", "__id")


def decode(df: DataFrame, vocab: DataFrame, feature: str, id_col: str, out: str) -> DataFrame:
    """Id -> value, falling back to str(id)."""
    v = checked_broadcast(vocab.filter(F.col("feature") == feature)
                          .select(F.col("id").alias("__id"), F.col("value").alias("__v")))
    j = df.join(v, F.col(id_col) == F.col("__id"), "left")
    return j.withColumn(out, F.coalesce(F.col("__v"), F.col(id_col).cast("string"))).drop("__id", "__v")


def ensure_dtypes(df: DataFrame, categorical=(), numerical=()) -> DataFrame:
    """Categorical -> int32, numerical -> float32."""
    for c in categorical:
        df = df.withColumn(c, F.col(c).cast("int"))
    for c in numerical:
        df = df.withColumn(c, F.col(c).cast("float"))
    return df


def next_categorical(next_id) -> F.Column:
    """The next event's id, <EOS> (2) at the end of the case."""
    c = F.col(next_id) if isinstance(next_id, str) else next_id
    return F.coalesce(c, F.lit(EOS_ID)).cast("int")


def apply_mask(target, mask: str = "masked") -> F.Column:
    """Masked rows get -1 as categorical target."""
    return F.when(F.col(mask), F.lit(MASKED_TARGET)).otherwise(target).cast("int")


def case_count(df: DataFrame, spec: LogSpec) -> int:
    """Number of distinct cases."""
    return df.select(spec.case).distinct().count()


def clamp_unknown(id_col, size) -> F.Column:
    """Ids outside [0, size) become <UNK> (1)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    s = F.lit(size) if isinstance(size, int) else (F.col(size) if isinstance(size, str) else size)
    return F.when((c < 0) | (c >= s), F.lit(UNK_ID)).otherwise(c).cast("int")


#: A split that already knows its next events: whether there is one in the split, and its values.
HAS_NEXT, AFTER = "__has_next", "__after_"


def build_event_log(splits: dict, spec: LogSpec, categorical: Iterable[str], numerical: Iterable[str],
                    cat_targets: Iterable[str] = (), num_targets: Iterable[str] = (),
                    vocab: Optional[DataFrame] = None, mask: str = "masked",
                    hot_case_rows: Optional[int] = None, hot=None):
    """P14 -> E1 -> E2 -> E6 -> E7/E8 -> E9 over named splits (``{'train': df, ...}``).

    The vocabulary is fitted on ``splits['train']`` for features and targets
    (K9) unless given (E5: test / val reuse it); without a train split it is inferred
    from the first one, with a warning.  Categorical targets become
    ``next_<t>`` = id of the next event in the case within the split (<EOS>
    at its end), -1 where masked; numerical targets are copied unshifted
    (K8).  A split with the columns ``__has_next`` and ``__after_<t>`` of all its
    targets (from a frame made before the split) takes no window.  Returns ``({name: encoded df}, vocab)``.
    """
    from caseflow.functions.ordered import case_frame
    from caseflow.operators.prepare import validate_columns

    categorical, numerical = list(categorical), list(numerical)
    cat_targets, num_targets = list(cat_targets), list(num_targets)
    if vocab is None:
        fitted_on = "train" if "train" in splits else next(iter(splits))
        if fitted_on != "train":
            warnings.warn(f"the vocabulary is inferred from {fitted_on!r}; pass that of the train split to share it",
                          stacklevel=2)
        vocab = fit_vocab(splits[fitted_on], list(dict.fromkeys(categorical + cat_targets)))
    out = {}
    for name, df in splits.items():
        after = {t: f"{AFTER}{t}" for t in cat_targets}
        known = HAS_NEXT in df.columns and all(c in df.columns for c in after.values())
        extra = [c for c in (mask, "__chunk", *((HAS_NEXT, *after.values()) if known else ())) if c in df.columns]
        df = validate_columns(df, spec, categorical + numerical, cat_targets + num_targets, extra=extra)
        for c in dict.fromkeys(categorical + cat_targets):
            df = encode(df, vocab, c)
        df = ensure_dtypes(df, categorical + cat_targets, numerical)
        if known:
            for t, c in after.items():
                df = encode(df, vocab, t, source=c).withColumn(c, F.when(F.col(HAS_NEXT), F.col(c)))
        elif cat_targets:
            df = case_frame(df, spec, next_cols=cat_targets, prefix=AFTER, hot_case_rows=hot_case_rows, hot=hot)
        for t, c in after.items():
            tgt = next_categorical(c)
            df = df.withColumn(f"next_{t}", apply_mask(tgt, mask) if mask in df.columns else tgt)
        df = df.drop(HAS_NEXT, *after.values())
        for t in num_targets:
            df = df.withColumn(f"next_{t}", F.col(t).cast("float"))   # copied, not shifted (K8)
        out[name] = df
    return out, vocab
