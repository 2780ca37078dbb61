"""The directly-follows baseline end to end (prepare -> split -> encode ->
counts -> predictions -> accuracy / macro-F1 / macro-AUROC)."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.storage import written
from caseflow.operators import baseline as B
from caseflow.plans.nep_data import encoded_split
from caseflow.spec import LogSpec


def baseline_run(log: DataFrame, spec: LogSpec, params: Optional[dict] = None,
                 lifecycle: bool = False, hot_case_rows: Optional[int] = None,
                 metrics: bool = True) -> dict:
    """Returns dict with 'metrics' (metric, value; None unless ``metrics``),
    'counts', 'predictions', 'vocab', 'split'.

    The events are aggregated once, by current activity and both targets; the
    training counts and the test pairs are sums over that table, which is
    bounded by the distinct transitions."""
    es = encoded_split(log, spec, params, lifecycle, hot_case_rows)
    both = written(es.frame.groupBy("cur", "train_tgt", "test_tgt").agg(F.count(F.lit(1)).alias("n")))
    es.release()
    counts = B.pair_counts(both, "train_tgt", "nxt", "count")
    preds = B.argmax_predictions(counts)
    m = B.evaluate_pairs(B.pair_counts(both, "test_tgt", "label", "n"), counts, preds) if metrics else None
    return {"metrics": m, "counts": counts, "predictions": preds,
            "vocab": es.vocab, "split": es}
