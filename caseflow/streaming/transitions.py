"""Incremental directly-follows pairs and counts over an event stream.

State per case: its last (activity, ts, seq).  Each micro-batch's events of a
case are ordered by (ts, seq) and paired with their predecessor (the state's
last event first).  A case that sees no event for ``case_gap`` of event time
(past the watermark) times out and emits ``(last, <EOS>)``.  Events of one
case must arrive in time order across micro-batches (any order inside one);
rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from typing import Iterator, Optional

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caseflow.spec import EOS, LogSpec

PAIR_SCHEMA = "current_activity string, next_activity string"
STATE_SCHEMA = "last_activity string, last_ts_ms long, last_seq long"


def transition_pairs_stream(events: DataFrame, spec: LogSpec, watermark: str = "1 hour",
                            case_gap_ms: int = 3_600_000) -> DataFrame:
    """Streaming (current_activity, next_activity) pairs, <EOS> on case timeout."""
    act, ts = spec.activity, spec.ts
    seq = spec.order[0] if spec.order else None

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            last = state.get
            state.remove()
            yield pd.DataFrame({"current_activity": [last[0]], "next_activity": [EOS]})
            return
        pdf = pd.concat(list(pdfs), ignore_index=True)
        order = [ts] + ([seq] if seq else [])
        pdf = pdf.sort_values(order, kind="stable")
        acts = pdf[act].tolist()
        if state.exists:
            cur = [state.get[0]] + acts[:-1]
            nxt = acts
        else:
            cur, nxt = acts[:-1], acts[1:]
        last_ts_ms = int(pd.Timestamp(pdf[ts].iloc[-1]).value // 1_000_000)
        last_seq = int(pdf[seq].iloc[-1]) if seq else 0
        state.update((acts[-1], last_ts_ms, last_seq))
        state.setTimeoutTimestamp(last_ts_ms + case_gap_ms)
        yield pd.DataFrame({"current_activity": cur, "next_activity": nxt})

    cols = [spec.case, act, ts] + ([seq] if seq else [])
    return (events.select(*cols).withWatermark(ts, watermark)
                  .groupBy(spec.case)
                  .applyInPandasWithState(step, PAIR_SCHEMA, STATE_SCHEMA, "append",
                                          GroupStateTimeout.EventTimeTimeout))


def start_transition_counter(events: DataFrame, spec: LogSpec, out_path: str, checkpoint: str,
                             trigger: Optional[dict] = None, **kw):
    """Start the streaming counter: pairs from ``transition_pairs_stream``; every
    micro-batch's partial counts are written to ``out_path/batch=<id>`` with
    overwrite, so a replayed batch after a failure rewrites the same folder
    (exactly-once totals).  Returns the StreamingQuery."""
    pairs = transition_pairs_stream(events, spec, **kw)

    def write(batch: DataFrame, batch_id: int):
        (batch.groupBy("current_activity", "next_activity").agg(F.count(F.lit(1)).alias("count"))
              .write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={batch_id}"))

    w = pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def read_transition_counts(spark, out_path: str) -> DataFrame:
    """Running totals (current_activity, next_activity, count) over all committed batches."""
    return (spark.read.parquet(out_path).groupBy("current_activity", "next_activity")
                 .agg(F.sum("count").alias("count")))
