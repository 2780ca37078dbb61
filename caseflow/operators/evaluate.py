"""Evaluation over scored-position tables produced by any model.

A scored-position frame has one row per (sequence, position) with an integer
``target``, a boolean ``valid`` and ``logits array<double>`` (optionally
``teacher_logits``).  Losses and metrics are column expressions over the
arrays plus ordinary aggregations; nothing is collected.
"""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.columns import argmax_index, log_softmax_at, log_sum_exp
from caseflow.operators.baseline import per_label_f1


def _asked(target: str, valid: Optional[str]):
    return (F.col(valid) if valid else F.lit(True)) & (F.col(target) >= 0)


def flatten_valid(df: DataFrame, logits: str = "logits", target: str = "target",
                  valid: Optional[str] = "valid") -> DataFrame:
    """V1: keep positions with the mask set and a target from 0 to the number of logits
    less one; ``left_out`` counts those whose target has no logit."""
    return df.filter(_asked(target, valid) & (F.col(target) < F.size(logits)))


def left_out(df: DataFrame, logits: str = "logits", target: str = "target", valid: Optional[str] = "valid") -> DataFrame:
    """``left_out``: positions with the mask set and a target that is no class of their logits."""
    return df.agg(F.count_if(_asked(target, valid) & (F.col(target) >= F.size(logits))).alias("left_out"))


def cross_entropy(logits: str = "logits", target: str = "target") -> F.Column:
    """-log softmax(logits)[target] per row."""
    return -log_softmax_at(logits, target)


def masked_cross_entropy(df: DataFrame, logits="logits", target="target", valid="valid") -> DataFrame:
    """V2: mean cross-entropy over valid positions; 0.0 if there are none."""
    v = flatten_valid(df, logits, target, valid)
    return v.agg(F.coalesce(F.avg(cross_entropy(logits, target)), F.lit(0.0)).alias("ce_loss"))


def _scaled(arr, t: float):
    return F.transform(F.col(arr), lambda x: x / F.lit(float(t)))


def kl_per_row(teacher: str, student: str, temperature: float = 1.0) -> F.Column:
    """sum_c p_t (log p_t - log p_s) of the temperature-scaled distributions."""
    t = _scaled(teacher, temperature)
    s = _scaled(student, temperature)
    lse_t, lse_s = log_sum_exp(t), log_sum_exp(s)
    terms = F.zip_with(t, s, lambda a, b: F.exp(a - lse_t) * ((a - lse_t) - (b - lse_s)))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def masked_kl(df: DataFrame, teacher="teacher_logits", student="logits", temperature: float = 1.0,
              valid="valid") -> DataFrame:
    """V3: T^2 * mean KL(teacher || student) over masked-in positions; 0.0 if none."""
    v = df.filter(F.col(valid)) if valid else df
    return v.agg((F.coalesce(F.avg(kl_per_row(teacher, student, temperature)), F.lit(0.0))
                  * F.lit(float(temperature) ** 2)).alias("kl_loss"))


def distill_alpha(epoch: int, epochs: int, start: float, end: float) -> float:
    """V4: linear alpha schedule."""
    return start + (end - start) * epoch / max(1, epochs)


def distill_loss(kl_col, ce_col, alpha: float) -> F.Column:
    """V4: alpha * KL + (1 - alpha) * CE."""
    k = F.col(kl_col) if isinstance(kl_col, str) else kl_col
    c = F.col(ce_col) if isinstance(ce_col, str) else ce_col
    return F.lit(alpha) * k + F.lit(1.0 - alpha) * c


def masked_mse(df: DataFrame, pred="pred_num", label="label_num", valid="valid") -> DataFrame:
    """V5: mean squared error on valid positions; 0.0 if there are none."""
    v = df.filter(F.col(valid)) if valid else df
    return v.agg(F.coalesce(F.avg(F.pow(F.col(pred) - F.col(label), 2)), F.lit(0.0)).alias("mse"))


def total_loss(per_target: DataFrame, loss: str = "loss") -> DataFrame:
    """V6: sum over targets of their mean losses (input: one row per target)."""
    return per_target.agg(F.sum(loss).alias("total_loss"))


def with_prediction(df: DataFrame, logits="logits", out="pred") -> DataFrame:
    """V7: argmax class, first maximum wins."""
    return df.withColumn(out, argmax_index(logits))


def micro_accuracy(scored: DataFrame, target="target", pred="pred") -> DataFrame:
    """V8: correct / total."""
    return scored.agg(F.avg((F.col(target) == F.col(pred)).cast("double")).alias("acc"))


def macro_f1(scored: DataFrame, target="target", pred="pred") -> DataFrame:
    """V9: mean F1 over classes present as target or prediction."""
    conf = scored.groupBy(F.col(target).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return per_label_f1(conf).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"))


def mean_of_batch_losses(df: DataFrame, batch="batch", loss_col="ce") -> DataFrame:
    """The logged loss — unweighted mean of per-batch mean losses."""
    return (df.groupBy(batch).agg(F.avg(loss_col).alias("__b"))
              .agg(F.avg("__b").alias("mean_batch_loss")))


def phase_metrics(df: DataFrame, phase="phase", target_name="target_name", logits="logits",
                  target="target", valid="valid", batch="batch") -> DataFrame:
    """Long table (key, value) with keys ``{phase}_{target}_{loss|acc|f1}``."""
    v = with_prediction(flatten_valid(df, logits, target, valid), logits) \
        .withColumn("__ce", cross_entropy(logits, target))
    g = [phase, target_name]
    loss = (v.groupBy(*g, batch).agg(F.avg("__ce").alias("__b"))
              .groupBy(*g).agg(F.avg("__b").alias("loss")))
    acc = v.groupBy(*g).agg(F.avg((F.col(target) == F.col("pred")).cast("double")).alias("acc"))
    conf = v.groupBy(*g, F.col(target).alias("t"), F.col("pred").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    parts = conf.select(*g, F.col("t").alias("label"),
                        F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                        F.col("n").alias("nt"), F.lit(0).cast("long").alias("np")) \
                .unionByName(conf.select(*g, F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"),
                                         F.lit(0).cast("long").alias("nt"), F.col("n").alias("np")))
    f1 = (parts.groupBy(*g, "label").agg(F.sum("tp").alias("tp"), F.sum("nt").alias("nt"), F.sum("np").alias("np"))
               .groupBy(*g).agg(F.avg(2.0 * F.col("tp") / (F.col("nt") + F.col("np"))).alias("f1")))
    # each metric is already one row per (phase, target): stack them, no join
    long_ = (loss.select(*g, F.lit("loss").alias("metric"), F.col("loss").alias("value"))
             .unionByName(acc.select(*g, F.lit("acc").alias("metric"), F.col("acc").alias("value")))
             .unionByName(f1.select(*g, F.lit("f1").alias("metric"), F.col("f1").alias("value"))))
    return long_.select(F.concat_ws("_", F.col(phase), F.col(target_name), F.col("metric")).alias("key"), "value")


def confidence_by_class(df: DataFrame, logits="logits", target="target", valid="valid") -> DataFrame:
    """Per class — mean max-probability and accuracy of the positions
    predicted as that class, predicted count, and true count; 0 when none.
    Targets < 0 are not counted as true labels (K12)."""
    v = df.filter(F.col(valid)) if valid else df
    v = with_prediction(v, logits).withColumn("__conf", F.exp(F.array_max(logits) - log_sum_exp(logits)))
    by_pred = v.groupBy(F.col("pred").alias("cls")).agg(
        F.avg("__conf").alias("avg_confidence"),
        F.avg((F.col("pred") == F.col(target)).cast("double")).alias("avg_accuracy"),
        F.count(F.lit(1)).alias("predicted_count"))
    by_true = v.filter(F.col(target) >= 0).groupBy(F.col(target).alias("cls")) \
               .agg(F.count(F.lit(1)).alias("true_count"))
    j = by_pred.join(by_true, "cls", "full")
    return j.select("cls", F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"),
                    F.coalesce("avg_accuracy", F.lit(0.0)).alias("avg_accuracy"),
                    F.coalesce("predicted_count", F.lit(0)).alias("predicted_count"),
                    F.coalesce("true_count", F.lit(0)).alias("true_count"))


def score_traces(segments: DataFrame, case: str, step: Callable, schema: str) -> DataFrame:
    """Scoring of traces by a user predictor, segment by segment
    (``sequences.trace_segments``).

    ``step(state, segment) -> (pandas.DataFrame, state)`` receives the rows of a case in
    order, with the state it returned for the segment before (None at the start of a
    case), and returns rows of ``schema`` (typically ``case_id, pos, logits
    array<double>``).  Runs as ``mapInPandas`` over partitions that hold whole cases
    in order: one Arrow batch and one state at a time, never a whole case.
    """
    def run(batches):
        import pandas as pd

        last, state = object(), None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                own = getattr(row, case)
                if own != last:
                    last, state = own, None
                rows, state = step(state, row)
                out.append(rows)
            if out:
                yield pd.concat(out, ignore_index=True)

    return segments.repartition(case).sortWithinPartitions(case, "segment").mapInPandas(run, schema)


def early_stop_replay(history: DataFrame, run="run_id", step="step", loss="val_loss",
                      patience: int = 5, min_delta: float = 0.0,
                      hot_case_rows: Optional[int] = None) -> DataFrame:
    """Replay early stopping per run.

    improved(step) = loss < best_before - min_delta, where best_before is the
    running minimum of *all* earlier losses (K14: small gains move the bar
    without resetting the counter).  The counter counts steps since the last
    improvement; training stops at the first step where it reaches
    ``patience``.  Output per run: saved_step (last improving step at or
    before the stop), stop_step (null if never stopped), best_loss.

    The running minimum, the position and the last improving position are
    skew-safe running aggregates (a run with very many steps is chunked);
    everything after that is aggregation.
    """
    from caseflow.functions.ordered import DEFAULT_HOT_CASE_ROWS, case_running, hot_cases, with_chunks
    from caseflow.spec import LogSpec

    spec = LogSpec(case=run, activity=loss, ts="__ts", order=(step,))
    h = (history.filter(F.col(loss).isNotNull())
                .withColumn("__ts", F.timestamp_micros(F.col(step).cast("long"))))
    hot_case_rows = hot_case_rows or DEFAULT_HOT_CASE_ROWS
    hot = hot_cases(h, spec, hot_case_rows)          # one small job, reused by all passes
    h = with_chunks(h, spec, hot)     # the running passes share this partitioning
    h = case_running(h, spec, {"__best_before": ("min", loss)}, exclusive=True,
                     hot_case_rows=hot_case_rows, hot=hot, position="__pos")
    h = h.withColumn("__imp", F.col("__best_before").isNull() |
                     (F.col(loss) < F.col("__best_before") - F.lit(float(min_delta))))
    h = case_running(h.withColumn("__imp_pos", F.when(F.col("__imp"), F.col("__pos"))), spec,
                     {"__last_imp": ("max", "__imp_pos")}, hot_case_rows=hot_case_rows, hot=hot)
    out = F.col("__pos") - F.col("__last_imp") >= patience
    h = case_running(h.withColumn("__out", out.cast("int")), spec, {"__gone": ("max", "__out")}, exclusive=True,
                     hot_case_rows=hot_case_rows, hot=hot)
    alive = F.coalesce(F.col("__gone"), F.lit(0)) == 0      # up to and with the stop
    return h.filter(alive).groupBy(run).agg(
        F.max(F.when(F.col("__imp"), F.col(step))).alias("saved_step"),
        F.min(F.when(F.col("__out") == 1, F.col(step))).alias("stop_step"),
        F.min(loss).alias("best_loss"))
