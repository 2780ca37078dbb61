"""Queries on inputs with gaps: masked positions, several phases and targets,
null resources, unparsable amounts, missing lifecycles, and the planned grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions.columns import combine_scalars, micros
from caseflow.operators import baseline as B
from caseflow.operators import evaluate as V
from caseflow.operators import experiments as A
from caseflow.operators.encode import case_count, clamp_unknown
from caseflow.operators.prepare import coerce_amount, fill_resource, prepare_log
from caseflow.operators.split import train_test_val
from caseflow.plans.nep_data import encoded_split
from caseflow.plans.registry import (_EXP_CTES, _GRID_BACKBONES, _GRID_LOGS, _GRID_LRS, _SCORED_SQL, ADAPTER_PARAMS, DIGITS,
                                     US_DAY, _exp, _grid_values_sql, _scored, load_log, r, register, split_ctes, table)
from caseflow.sources.experiments import baseline_run_tables, transition_tables_from_lineitem

# -- evaluation with masks, -1 targets, two phases and two targets

_MASKED_SQL = _SCORED_SQL + """,
m AS (SELECT rows_.vec_id, rows_.batch, tn, CASE WHEN rows_.vec_id % 2 = 0 THEN 'val' ELSE 'test' END AS phase, rows_.vec_id % 5 <> 0 AS valid,
             CASE WHEN rows_.vec_id % 7 = 0 THEN -1 WHEN tn = 'next_activity' THEN rows_.target ELSE (rows_.target + 1) % c END AS t,
             rows_.pred, lse.lse, e.l, rows_.kl
      FROM rows_ JOIN lse USING (vec_id) JOIN e USING (vec_id), k, (VALUES ('next_activity'), ('next_resource')) AS names(tn)),
v AS (SELECT *, lse - l[t + 1] AS ce FROM m WHERE valid AND t >= 0)"""


def _masked(spark, sf_dir):
    s = _scored(spark, sf_dir)
    names = F.array(F.lit("next_activity"), F.lit("next_resource"))
    s = s.withColumn("target_name", F.explode(names)).withColumn(
        "phase", F.when(F.col("vec_id") % 2 == 0, "val").otherwise("test")).withColumn("valid", F.col("vec_id") % 5 != 0)
    shifted = F.when(F.col("target_name") == "next_activity", F.col("target")).otherwise(
        (F.col("target") + 1) % F.size("logits"))
    return s.withColumn("target", F.when(F.col("vec_id") % 7 == 0, -1).otherwise(shifted).cast("int"))


@register("masked_phase_metrics_embeddings", "WITH " + _MASKED_SQL + f""",
lab AS (SELECT phase, tn, t AS l, 1 AS nt, 0 AS np, CAST(t = pred AS INTEGER) AS tp FROM v
        UNION ALL SELECT phase, tn, pred, 0, 1, 0 FROM v),
f1 AS (SELECT phase, tn, avg(2.0 * tp / (nt + np)) AS f FROM (
       SELECT phase, tn, l, sum(tp) AS tp, sum(nt) AS nt, sum(np) AS np FROM lab GROUP BY ALL) GROUP BY phase, tn)
SELECT phase || '_' || tn || '_loss' AS key, round(avg(b), {DIGITS}) AS value
FROM (SELECT phase, tn, batch, avg(ce) AS b FROM v GROUP BY ALL) GROUP BY phase, tn
UNION ALL SELECT phase || '_' || tn || '_acc', round(avg(CAST(t = pred AS INTEGER)), {DIGITS}) FROM v GROUP BY phase, tn
UNION ALL SELECT phase || '_' || tn || '_f1', round(f, {DIGITS}) FROM f1""")
def masked_phase_metrics_embeddings(spark, sf_dir):
    """V1 + V11: metrics of two phases and two targets over positions with invalid rows and -1 targets."""
    return V.phase_metrics(_masked(spark, sf_dir)).select("key", r("value").alias("value"))


@register("masked_losses_embeddings", "WITH " + _MASKED_SQL + f""",
num AS (SELECT vec_id, list_avg(CAST(embedding AS DOUBLE[])) AS p, list_max(CAST(embedding AS DOUBLE[])) AS y FROM embeddings)
SELECT round((SELECT avg(ce) FROM v WHERE tn = 'next_activity'), {DIGITS}) AS ce_loss,
       round((SELECT avg(kl) * 4 FROM m WHERE valid AND tn = 'next_activity'), {DIGITS}) AS kl_loss,
       round((SELECT avg((p - y) * (p - y)) FROM num WHERE vec_id % 5 <> 0), {DIGITS}) AS mse, 0.0 AS empty_mse,
       round((SELECT avg(ce) FROM v WHERE tn = 'next_activity')
             + (SELECT avg((p - y) * (p - y)) FROM num WHERE vec_id % 5 <> 0), {DIGITS}) AS total_loss""")
def masked_losses_embeddings(spark, sf_dir):
    """V2, V3, V5, V6: masked losses; a numeric target (mean against largest component) and one
    without any valid position, whose loss is 0 and adds nothing to the total."""
    s = _masked(spark, sf_dir).filter("target_name = 'next_activity'")
    emb = F.col("embedding").cast("array<double>")
    mean = F.aggregate(emb, F.lit(0.0), lambda a, x: a + x) / F.size(emb)
    num = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5 != 0).alias("valid"), mean.alias("pred_num"),
                                                    F.array_max(emb).alias("label_num"))
    ce, mse = V.masked_cross_entropy(s), V.masked_mse(num)
    none = V.masked_mse(num.withColumn("valid", F.lit(False))).withColumnRenamed("mse", "empty_mse")
    total = V.total_loss(ce.select(F.col("ce_loss").alias("loss")).unionByName(mse.select(F.col("mse").alias("loss")))
                         .unionByName(none.select(F.col("empty_mse").alias("loss"))))
    out = combine_scalars([ce, V.masked_kl(s, temperature=2.0), mse, none, total])
    return out.select(*[r(c).alias(c) for c in ("ce_loss", "kl_loss", "mse", "empty_mse", "total_loss")])


@register("position_masks_events_by_user_day", "WITH " + split_ctes("events_by_user_day") + """
SELECT split, case_id, seq, cur <> 0 AS attention, cur <> 0 AND tgt <> -1 AS loss, CASE WHEN tgt = -1 THEN 0 ELSE tgt END AS target
FROM (SELECT 'train' AS split, * FROM train UNION ALL SELECT 'test', * FROM test)""")
def position_masks_events_day(spark, sf_dir):
    """Q4 + Q5: attention and loss masks, and targets with -1 as 0."""
    log, spec = load_log(spark, "events_by_user_day", sf_dir)
    es = encoded_split(log, spec, ADAPTER_PARAMS["events_by_user_day"])
    cols = ["case_id", "seq", B.attention_mask().alias("attention"), B.loss_mask().alias("loss"),
            B.masked_target().alias("target")]
    return es.keep(es.train.select(F.lit("train").alias("split"), *cols).unionByName(
        es.test.select(F.lit("test").alias("split"), *cols)))


# -- cleaning

_START, _MAX_DAYS = "2024-01", 0.5


@register("cleaned_log_events_by_user_day", f"""
WITH log AS (SELECT CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y-%m-%d') AS case_id, ts, event_id AS seq,
       CASE WHEN event_id % 10 <> 0 THEN event_type || '_' || CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'complete' END END AS activity,
       CASE WHEN event_id % 3 <> 0 THEN 'r' || (event_id % 5) END AS resource, CASE WHEN event_id % 4 <> 0 THEN value END AS amount FROM events),
summ AS (SELECT case_id, min(ts) AS s, max(ts) AS e, (epoch_us(max(ts)) - epoch_us(min(ts))) / {US_DAY} AS d FROM log GROUP BY case_id HAVING count(*) >= 3),
ok0 AS (SELECT * FROM summ WHERE strftime(s, '%Y-%m') >= '{_START}' AND (d < {_MAX_DAYS} OR abs(d - {_MAX_DAYS}) <= {1e-8 + 1e-5 * _MAX_DAYS!r})),
ok AS (SELECT case_id FROM ok0 WHERE epoch_us(s) <= (SELECT max(epoch_us(e)) FROM ok0) - {int(_MAX_DAYS * 86400e6)})
SELECT case_id, activity, epoch_us(ts) AS ts_us, min(seq) AS seq, coalesce(resource, 'UNKNOWN') AS resource, coalesce(amount, 0.0) AS amount
FROM log WHERE case_id IN (SELECT case_id FROM ok) GROUP BY case_id, activity, ts, resource, amount""")
def cleaned_log_events_day(spark, sf_dir):
    """Lifecycle joined to the activity (null in either: null), a start
    month, null resources and unparsable amounts."""
    log, spec = load_log(spark, "events_by_user_day", sf_dir)
    n = F.col("seq")
    log = (log.withColumn("lifecycle", F.when(n % 10 != 0, F.when(n % 2 == 0, "start").otherwise("complete")))
              .withColumn("resource", F.when(n % 3 != 0, F.concat(F.lit("r"), n % 5)))
              .withColumn("amount", F.when(n % 4 == 0, "n/a").otherwise(F.col("amount").cast("string"))))
    spec = spec.with_(lifecycle="lifecycle", resource="resource")
    df, spec = prepare_log(log, spec, {"start_date": _START, "max_days": _MAX_DAYS}, lifecycle=True)
    df = coerce_amount(fill_resource(df, spec), spec)
    return df.select("case_id", "activity", micros("ts").alias("ts_us"), "seq", "resource", "amount")


# -- experiments

@register("missing_runs_grid", "WITH " + _EXP_CTES + ",\n" + _grid_values_sql() + """,
va AS (SELECT DISTINCT log, backbone, lr, CAST(epochs AS VARCHAR) AS epochs FROM runs WHERE lr IS NOT NULL OR backbone = 'baseline'),
fg AS (SELECT DISTINCT g.log, g.backbone, CAST(g.lr AS DOUBLE) AS lr, coalesce(va.epochs, '__MISSING__') AS epochs FROM grid g
       LEFT JOIN va ON g.log = va.log AND g.backbone = va.backbone AND g.lr IS NOT DISTINCT FROM va.lr),
s AS (SELECT log, backbone, lr, CAST(epochs AS VARCHAR) AS epochs, count(acc) AS n_runs, avg(acc) AS mean FROM runs GROUP BY ALL),
j AS (SELECT fg.*, s.n_runs IS NULL AS missing_row, coalesce(s.n_runs, 0) AS n_runs, s.mean FROM fg
      LEFT JOIN s ON fg.log = s.log AND fg.backbone = s.backbone AND fg.lr IS NOT DISTINCT FROM s.lr AND fg.epochs = s.epochs),
o AS (SELECT *, row_number() OVER (PARTITION BY log, backbone ORDER BY mean NULLS LAST, lr NULLS FIRST, epochs) AS rn FROM j)
SELECT log, backbone, lr, epochs, n_runs, missing_row,
       CAST(greatest(CASE WHEN backbone = 'baseline' THEN 1 ELSE 5 END - n_runs, 0) AS BIGINT) AS missing_runs,
       CAST(CASE WHEN rn = 1 AND mean IS NOT NULL THEN greatest(10 - n_runs, 0) ELSE 0 END AS BIGINT) AS missing_to_best FROM o""")
def missing_runs_grid(spark, sf_dir):
    """The grid with observed variants and placeholders, runs missing to the target and,
    on the best row of each log and backbone, to ten."""
    runs, _ = _exp(spark, sf_dir)
    grid = A.experiment_grid(spark, _GRID_LOGS, _GRID_BACKBONES, _GRID_LRS, special="baseline")
    full = A.full_grid(grid, runs, ["epochs"], special="baseline")
    m = A.missing_runs(full, runs, "acc", ["epochs"], special="baseline")
    return m.select("log", "backbone", "lr", "epochs", "n_runs", "missing_row",
                    F.col("missing_runs").cast("long").alias("missing_runs"),
                    F.col("missing_to_best").cast("long").alias("missing_to_best"))


@register("run_sources_orders", "WITH " + _EXP_CTES + """,
l AS (SELECT id, model, CASE backbone WHEN 'F' THEN 'x-nanogpt_scratch-1' WHEN 'O' THEN 'distill-y' END AS p,
             CAST(hidden_size AS VARCHAR) || '_' || CAST(n_layers AS VARCHAR) || '_' || CAST(n_heads AS VARCHAR) AS arch FROM runs)
SELECT id, CASE WHEN p LIKE '%distill%' THEN 'distill_' || arch WHEN p LIKE '%nanogpt_scratch%' THEN 'scratch_' || arch ELSE model END AS label,
       CASE WHEN p LIKE '%distill%' THEN 'distill' WHEN p LIKE '%nanogpt_scratch%' THEN 'scratch' ELSE 'finetune' END AS source,
       CASE WHEN p IS NULL THEN model ELSE arch END AS display,
       CASE WHEN model LIKE 'qwen%' THEN 'qwen' WHEN model LIKE 'nano%' THEN 'nano' WHEN model LIKE 'distill%' THEN 'distill'
            WHEN model LIKE 'gpt2%' THEN 'gpt2' WHEN model LIKE 'LSTM%' THEN 'LSTM' ELSE 'baseline' END AS model_group FROM l""")
def run_sources_orders(spark, sf_dir):
    """A6 + A7: labels with their source, the source, the display label and the model group."""
    runs, _ = _exp(spark, sf_dir)
    p = F.when(F.col("backbone") == "F", "x-nanogpt_scratch-1").when(F.col("backbone") == "O", "distill-y")
    t = runs.withColumn("project", p).withColumn("label", A.source_label("project", "model"))
    return t.select("id", "label", A.source_of("label").alias("source"), A.display_label("label").alias("display"),
                    A.group_of("model").alias("model_group"))


@register("baseline_run_tables_runs", "WITH " + _EXP_CTES + """,
sel AS (SELECT id FROM runs WHERE log = '1-URGENT' AND backbone = 'P' AND coalesce(lifecycle, false) = false
        AND state = 'finished' ORDER BY created_at DESC, id DESC LIMIT 1)
SELECT 'transitions' AS kind, l_returnflag AS activity, l_linestatus AS next_activity, CAST(l_quantity AS BIGINT) AS count
FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) IN (SELECT id FROM sel)
UNION ALL SELECT 'predictions', l_returnflag, l_linestatus, NULL FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) IN (SELECT id FROM sel)""")
def baseline_run_tables_runs(spark, sf_dir):
    """Transition and prediction table of the newest finished reference run of a log."""
    runs, _ = _exp(spark, sf_dir)
    stored = transition_tables_from_lineitem(spark, sf_dir)
    said = stored.select("run_id", F.col("current_activity").alias("activity"), F.col("next_activity").alias("predicted_next"))
    t, p = baseline_run_tables(runs, stored, said, "1-URGENT", False, backbone="P")
    return t.select(F.lit("transitions").alias("kind"), F.col("current_activity").alias("activity"), "next_activity", "count") \
            .unionByName(p.select(F.lit("predictions").alias("kind"), "activity", F.col("predicted_next").alias("next_activity"),
                                  F.lit(None).cast("long").alias("count")))


@register("run_counts_runs", "WITH " + _EXP_CTES + """
SELECT log, backbone, count(*) AS runs FROM runs GROUP BY log, backbone""")
def run_counts_runs(spark, sf_dir):
    """Runs per log and backbone."""
    return A.run_counts(_exp(spark, sf_dir)[0])


@register("unplanned_configs_runs", "WITH " + _EXP_CTES + """
SELECT DISTINCT log, backbone, lr FROM runs WHERE NOT (log IN ('1-URGENT', '5-LOW') AND backbone IN ('F', 'O') AND lr = 1e-3)""")
def unplanned_configs_runs(spark, sf_dir):
    """Observed configurations outside a small planned grid (anti join)."""
    grid = A.experiment_grid(spark, ["1-URGENT", "5-LOW"], ["F", "O"], [1e-3])
    return A.unplanned_configs(grid, _exp(spark, sf_dir)[0])


@register("summary_stats_tuned_runs", "WITH " + _EXP_CTES + f"""
SELECT log, fine_tuning, count(*) AS n, round(avg(acc), {DIGITS}) AS mean, round(stddev_samp(acc), {DIGITS}) AS std
FROM runs WHERE acc IS NOT NULL AND fine_tuning IS NOT NULL GROUP BY log, fine_tuning""")
def summary_stats_tuned_runs(spark, sf_dir):
    """A10 with null keys dropped: runs without fine-tuning have no group."""
    s = A.summary_stats(_exp(spark, sf_dir)[0], ["log", "fine_tuning"], "acc", drop_null_keys=True)
    return s.select("log", "fine_tuning", "n", r("mean").alias("mean"), r("std").alias("std"))


@register("columns_equal_runs", "WITH " + _EXP_CTES + """
SELECT 'embedding_size' AS other, bool_and(hidden_size IS NOT DISTINCT FROM embedding_size) AS equal FROM runs
UNION ALL SELECT 'n_heads', bool_and(hidden_size IS NOT DISTINCT FROM n_heads) FROM runs""")
def columns_equal_runs(spark, sf_dir):
    """Whether the hidden size equals another column on every run."""
    runs, _ = _exp(spark, sf_dir)
    say = lambda c: A.columns_equal(runs, "hidden_size", c).select(F.lit(c).alias("other"), "equal")
    return say("embedding_size").unionByName(say("n_heads"))


@register("clamped_ids_events_by_user_day", "WITH " + split_ctes("events_by_user_day") + """,
k AS (SELECT count(*) + 3 AS size FROM vocab), c AS (SELECT count(DISTINCT case_id) AS cases FROM prep)
SELECT split, case_id, seq, CAST(CASE WHEN id < 0 OR id >= size THEN 1 ELSE id END AS INTEGER) AS id, cases FROM (
  SELECT 'train' AS split, case_id, seq, tgt + cur AS id FROM train UNION ALL SELECT 'test', case_id, seq, tgt + cur FROM test), k, c""")
def clamped_ids_events_day(spark, sf_dir):
    """E10 + E12: ids outside the vocabulary (here sums of two ids, and -1 targets) become <UNK>;
    the number of prepared cases beside them."""
    log, spec = load_log(spark, "events_by_user_day", sf_dir)
    es = encoded_split(log, spec, ADAPTER_PARAMS["events_by_user_day"])
    size, cases = es.vocab.count(), case_count(es.prepared, es.spec)
    cols = ["case_id", "seq", clamp_unknown(F.col("tgt") + F.col("cur"), size).alias("id"), F.lit(cases).cast("long").alias("cases")]
    return es.keep(es.train.select(F.lit("train").alias("split"), *cols).unionByName(
        es.test.select(F.lit("test").alias("split"), *cols)))


@register("train_val_classic_events_by_user_day", "WITH " + split_ctes("events_by_user_day") + """,
st AS (SELECT case_id, min(us) AS s FROM train GROUP BY case_id),
k AS (SELECT CAST(floor(0.25 * count(*)) AS BIGINT) AS k FROM st),
v AS (SELECT case_id FROM (SELECT case_id, row_number() OVER (ORDER BY s DESC, case_id) AS rn FROM st), k WHERE rn <= k.k)
SELECT CASE WHEN case_id IN (SELECT case_id FROM v) THEN 'val' ELSE 'train' END AS split, case_id, seq, masked FROM train
UNION ALL SELECT 'test', case_id, seq, masked FROM test""")
def train_val_classic_events_day(spark, sf_dir):
    """T10 with the classic validation split: the newest quarter of the train cases, masks kept."""
    log, spec = load_log(spark, "events_by_user_day", sf_dir)
    params = ADAPTER_PARAMS["events_by_user_day"]
    df, spec = prepare_log(log, spec, params)
    t = train_test_val(df, spec, params["test_size"], 0.25, "classic")
    cols = ["case_id", "seq", "masked"]
    return t["train"].select(F.lit("train").alias("split"), *cols).unionByName(
        t["val"].select(F.lit("val").alias("split"), *cols)).unionByName(t["test"].select(F.lit("test").alias("split"), *cols))
