"""Directly-follows (transition-frequency) next-activity predictor and its metrics.

Inputs are *position* frames with an integer current activity ``cur`` and an
integer target ``tgt`` (-1 = masked, 2 = <EOS>).  Everything after the
event-level filter runs on aggregates whose size is bounded by the number of
distinct (current, next) pairs, never by the number of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.columns import combine_scalars, one_row
from caseflow.functions.storage import written
from caseflow.spec import MASKED_TARGET, PAD_ID


def attention_mask(cur: str = "cur") -> F.Column:
    """Q5: True where the position holds an event (not PAD)."""
    return F.col(cur) != PAD_ID


def loss_mask(cur: str = "cur", tgt: str = "tgt") -> F.Column:
    """Q5 / Q4: True where the position holds an event and its target counts (not -1)."""
    return attention_mask(cur) & (F.col(tgt) != MASKED_TARGET)


def masked_target(tgt: str = "tgt") -> F.Column:
    """Q4: targets with the masked ones (-1) as 0, to be used with the loss mask."""
    return F.when(F.col(tgt) == MASKED_TARGET, F.lit(0)).otherwise(F.col(tgt))


def valid_positions(df: DataFrame, cur: str = "cur", tgt: str = "tgt") -> DataFrame:
    """Q4: the positions of the loss mask."""
    return df.filter(loss_mask(cur, tgt))


def transition_counts(train: DataFrame, cur: str = "cur", tgt: str = "tgt") -> DataFrame:
    """B1: (cur, nxt, count) over valid positions, <EOS> included."""
    return (valid_positions(train, cur, tgt)
            .groupBy(F.col(cur).alias("cur"), F.col(tgt).alias("nxt"))
            .agg(F.count(F.lit(1)).alias("count")))


def argmax_predictions(counts: DataFrame) -> DataFrame:
    """B2: per current activity the most frequent next; ties -> smallest id (K5)."""
    return counts.groupBy("cur").agg(
        F.max_by("nxt", F.struct(F.col("count"), -F.col("nxt"))).alias("pred"))


def predict(test: DataFrame, predictions: DataFrame, cur: str = "cur") -> DataFrame:
    """Lookup; a current activity never seen in training predicts -1."""
    p = predictions.select(F.col("cur").alias("__cur"), F.col("pred").alias("__pred"))
    return (test.join(p, F.col(cur) == F.col("__cur"), "left")
                .withColumn("pred", F.coalesce(F.col("__pred"), F.lit(MASKED_TARGET)))
                .drop("__cur", "__pred"))


def accuracy(scored: DataFrame, tgt: str = "tgt", pred: str = "pred") -> DataFrame:
    """One row (correct, total, accuracy); accuracy 0.0 when there is nothing to score."""
    return scored.agg(F.count_if(F.col(tgt) == F.col(pred)).alias("correct"),
                      F.count(F.lit(1)).alias("total")) \
                 .withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total"))
                             .otherwise(F.lit(0.0)))


def confusion(scored: DataFrame, tgt: str = "tgt", pred: str = "pred") -> DataFrame:
    """(t, p, n) counts — bounded by labels²."""
    return scored.groupBy(F.col(tgt).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def per_label_f1(conf: DataFrame) -> DataFrame:
    """(label, tp, n_true, n_pred, f1) over the union of true and predicted labels."""
    parts = conf.select(F.col("t").alias("label"),
                        F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                        F.col("n").alias("n_true"), F.lit(0).cast("long").alias("n_pred")) \
                .unionByName(conf.select(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"),
                                         F.lit(0).cast("long").alias("n_true"), F.col("n").alias("n_pred")))
    g = parts.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("n_true").alias("n_true"),
                                   F.sum("n_pred").alias("n_pred"))
    den = F.col("n_true") + F.col("n_pred")
    return g.withColumn("f1", F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(F.lit(0.0)))


def macro_f1(scored: DataFrame, tgt: str = "tgt", pred: str = "pred") -> DataFrame:
    """Mean per-label F1 over labels seen as target or prediction (-1 included); 0/0 -> 0."""
    return per_label_f1(confusion(scored, tgt, pred)).agg(
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1_macro"))


def position_pairs(test: DataFrame, cur: str = "cur", tgt: str = "tgt") -> DataFrame:
    """(cur, label, n): valid test positions aggregated by current activity and target."""
    return (valid_positions(test, cur, tgt)
            .groupBy(F.col(cur).alias("cur"), F.col(tgt).alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


def macro_auroc(pos: DataFrame, counts: DataFrame) -> DataFrame:
    """B6 + B7: one-vs-rest AUROC per test label with transition-frequency scores, plain mean.

    Score of a sample for label l = count(cur -> l) / sum over test labels of
    count(cur -> l'); unseen current (or zero sum) -> uniform 1/k.  k = 2 ->
    the AUROC of the larger label; k < 2 -> NaN.  ``pos`` is ``position_pairs(test)``.

    The score depends only on (cur, l), so samples are aggregated to
    (label, score, positives, negatives) first; only pairs with a non-zero
    training count are enumerated, the zero-score and uniform-score samples of
    each label are folded into one row each — no labels x currents product.
    """
    labels = pos.groupBy("label").agg(F.sum("n").alias("P"))       # positives per label
    total = pos.agg(F.sum("n").alias("N_all"))
    k_df = labels.agg(F.count(F.lit(1)).alias("k"))
    n_cur = pos.groupBy("cur").agg(F.sum("n").alias("Ncur"))       # samples per current
    # training counts restricted to test labels
    tc = counts.join(labels.select(F.col("label").alias("nxt")), "nxt", "left_semi")
    rowsum = tc.groupBy("cur").agg(F.sum("count").alias("rs"))
    cur_kind = n_cur.join(rowsum, "cur", "left") \
                    .withColumn("uniform", F.coalesce(F.col("rs"), F.lit(0)) == 0)
    # sparse pairs (cur, label) with a positive training count, cur present in test and not uniform
    sparse = (tc.join(cur_kind.filter(~F.col("uniform")), "cur")
                .select("cur", F.col("nxt").alias("label"), (F.col("count") / F.col("rs")).alias("score"),
                        "Ncur"))
    sparse = (sparse.join(pos, ["cur", "label"], "left")
                    .select("label", "score", F.coalesce(F.col("n"), F.lit(0)).alias("pos"),
                            (F.col("Ncur") - F.coalesce(F.col("n"), F.lit(0))).alias("neg")))
    # uniform currents: same score 1/k for every label
    unif_cur = cur_kind.filter(F.col("uniform")).select("cur", "Ncur")
    unif_total = unif_cur.agg(F.coalesce(F.sum("Ncur"), F.lit(0)).alias("U"))
    unif_pos = pos.join(unif_cur.select("cur"), "cur", "left_semi").groupBy("label").agg(F.sum("n").alias("upos"))
    # three scalars (total samples, number of labels, uniform-scored samples)
    sc = one_row(combine_scalars([total, k_df, unif_total], {"N_all": "long", "k": "long", "U": "long"}))
    per_label = (labels.withColumns({"N_all": F.lit(sc.get("N_all") or 0), "k": F.lit(sc.get("k") or 0),
                                     "U": F.lit(sc.get("U") or 0)})
                       .join(unif_pos, "label", "left")
                       .withColumn("upos", F.coalesce(F.col("upos"), F.lit(0))))
    sp_sum = sparse.groupBy("label").agg(F.sum("pos").alias("spos"), F.sum("neg").alias("sneg"))
    per_label = (per_label.join(sp_sum, "label", "left")
                 .withColumn("spos", F.coalesce(F.col("spos"), F.lit(0)))
                 .withColumn("sneg", F.coalesce(F.col("sneg"), F.lit(0)))
                 .withColumn("Nneg", F.col("N_all") - F.col("P")))
    unif_rows = per_label.select("label", (F.lit(1.0) / F.col("k")).alias("score"),
                                 F.col("upos").alias("pos"), (F.col("U") - F.col("upos")).alias("neg"))
    zero_rows = per_label.select("label", F.lit(0.0).alias("score"),
                                 (F.col("P") - F.col("upos") - F.col("spos")).alias("pos"),
                                 (F.col("Nneg") - (F.col("U") - F.col("upos")) - F.col("sneg")).alias("neg"))
    groups = (sparse.unionByName(unif_rows).unionByName(zero_rows)
                    .groupBy("label", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    w = Window.partitionBy("label").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    auc = (groups.withColumn("neg_below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
                 .groupBy("label")
                 .agg(F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("u"),
                      F.sum("pos").alias("P"), F.sum("neg").alias("N"))
                 .withColumn("auc", F.when(F.col("P") * F.col("N") > 0, F.col("u") / (F.col("P") * F.col("N")))))
    summary = auc.agg(F.count(F.lit(1)).alias("k"),
                      F.avg("auc").alias("mean_auc"),
                      F.max_by("auc", "label").alias("top_auc"))
    return summary.select(
        F.when(F.col("k") < 2, F.lit(float("nan")))
         .when(F.col("k") == 2, F.col("top_auc"))
         .otherwise(F.col("mean_auc")).alias("auroc_macro"))


def pair_counts(both: DataFrame, tgt: str, label: str, n: str) -> DataFrame:
    """(cur, ``label``, ``n``): valid pairs of one target column summed from a table
    of (cur, targets..., n)."""
    return (valid_positions(both, "cur", tgt).groupBy("cur", F.col(tgt).alias(label)).agg(F.sum("n").alias(n)))


def evaluate(test: DataFrame, counts: DataFrame, predictions: DataFrame,
             cur: str = "cur", tgt: str = "tgt") -> DataFrame:
    """Accuracy, macro-F1 and macro-AUROC of the predictor on the valid test positions,
    as one long table (metric, value).

    The event-level work is one aggregation to (cur, label, n); every metric is
    computed from that table, whose size is bounded by distinct transitions.
    """
    # cut lineage at the small aggregate: every metric branch reads it
    return evaluate_pairs(written(position_pairs(test, cur, tgt)), counts, predictions)


def evaluate_pairs(pos: DataFrame, counts: DataFrame, predictions: DataFrame) -> DataFrame:
    """``evaluate`` on aggregated positions (cur, label, n)."""
    scored = (pos.join(predictions, "cur", "left")
                 .withColumn("pred", F.coalesce(F.col("pred"), F.lit(MASKED_TARGET))))
    acc = scored.agg(F.coalesce(F.sum(F.when(F.col("label") == F.col("pred"), F.col("n"))), F.lit(0)).alias("correct"),
                     F.coalesce(F.sum("n"), F.lit(0)).alias("total")) \
                .withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total"))
                            .otherwise(F.lit(0.0)))
    conf = scored.groupBy(F.col("label").alias("t"), F.col("pred").alias("p")).agg(F.sum("n").alias("n"))
    f1 = per_label_f1(conf).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1_macro"))
    au = macro_auroc(pos, counts)
    def long_(df, names):
        return df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                             for m in names])).alias("m")).select("m.*")
    return (long_(acc, ["accuracy"]).unionByName(long_(f1, ["f1_macro"])).unionByName(long_(au, ["auroc_macro"]))
            .unionByName(long_(acc, ["correct", "total"])))
