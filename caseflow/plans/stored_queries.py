"""Queries that write and read back: caches, the merged history, inferred JSON
schemas, result tables, and targets without a logit."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caseflow.functions.columns import combine_scalars
from caseflow.operators import evaluate as V
from caseflow.operators import prefixes as X
from caseflow.operators import sequences as Q
from caseflow.operators.features import time_features
from caseflow.operators.prepare import prepare_log
from caseflow.operators.split import prefix_split
from caseflow.plans.registry import (_EXP_CTES, _SCORED_SQL, ADAPTER_PARAMS, DIGITS, US_DAY, _exp, _named_prefixes, _prepared,
                                     _scored, pairs_ctes, prep_ctes, r, register, split_ctes, table)
from caseflow.session import ensure_checkpoint_dir
from caseflow.sources import experiments as E
from caseflow.sources.logs import (XES_ACTIVITY, XES_AMOUNTS, XES_CASE, XES_TIME, benchmark_params, from_xes_columns, load_log,
                                   read_log)
from caseflow.sources.sinks import append_rows, cached_dataset, cached_log, save_csv, write_table
from caseflow.sources.stored import StoredTable
from caseflow.spec import feature_set


def _new_root(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def _not_again():
    raise AssertionError("a cached table was built twice")


# -- caches

@register("cached_log_events_by_user_day", "WITH " + prep_ctes("events_by_user_day") + """
SELECT case_id, activity, epoch_us(ts) AS us, seq FROM prep""")
def cached_log_events_by_user_day(spark, sf_dir):
    """The prepared log from its cache, built by the first call and read by the second."""
    root, adapter = _new_root(spark), "events_by_user_day"
    build = lambda: _prepared(spark, sf_dir, adapter)[0].select("case_id", "activity", "ts", "seq")
    options = {"root": root, "sources": [f"{sf_dir}/events.parquet"], "params": ADAPTER_PARAMS[adapter]}
    cached_log(spark, adapter, build, **options)
    log = cached_log(spark, adapter, _not_again, **options)
    return log.select("case_id", "activity", F.unix_micros("ts").alias("us"), "seq")


@register("cached_dataset_events_by_user_day", "WITH " + split_ctes("events_by_user_day") + """
SELECT 'train' AS split, case_id, seq, masked FROM train UNION ALL SELECT 'test', case_id, seq, masked FROM test""")
def cached_dataset_events_by_user_day(spark, sf_dir):
    """The two splits from their cache."""
    root, adapter = _new_root(spark), "events_by_user_day"
    df, spec = _prepared(spark, sf_dir, adapter)
    sp = prefix_split(df, spec, ADAPTER_PARAMS[adapter].get("test_size", 0.2))
    parts = {k: p.select("case_id", "seq", "masked") for k, p in (("train", sp.train), ("test", sp.test))}
    options = {"root": root, "sources": [f"{sf_dir}/events.parquet"], "params": ADAPTER_PARAMS[adapter]}
    cached_dataset(spark, adapter, parts, **options)
    return cached_dataset(spark, adapter, None, **options).select("split", "case_id", "seq", "masked")


# -- history merged batch by batch

@register("history_merge_lineitem", f"""SELECT run_id, step, round(val_loss, {DIGITS}) AS val_loss,
  round(val_acc, {DIGITS}) AS val_acc, round(val_f1, {DIGITS}) AS val_f1 FROM (
  SELECT CAST(l_orderkey AS VARCHAR) AS run_id, CAST(l_linenumber % 2 AS BIGINT) AS step, l_discount + l_tax AS val_loss,
         1.0 - l_discount AS val_acc, l_quantity / 50.0 AS val_f1,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_partkey % 3 DESC, l_shipdate DESC,
           l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS rn
  FROM lineitem) WHERE rn = 1""")
def history_merge_lineitem(spark, sf_dir):
    """Three batches merged into a stored history, the first of them twice more."""
    h = E.history_from_lineitem(spark, sf_dir).withColumn("step", F.col("step") % 2)
    stored = StoredTable(spark, _new_root(spark), buckets=16)
    for k in (0, 1, 0, 2, 0):
        stored.merge(h.filter(F.col("l_partkey") % 3 == k), f"batch-{k}", E.HISTORY_INGEST)
    flat = E.flatten_history(stored.read().select("run_id", "step", "metrics"), E.HISTORY_SCHEMA)
    return flat.select("run_id", "step", *[r(c).alias(c) for c in ("val_loss", "val_acc", "val_f1")])


# -- runs without given schemas

@register("runs_inferred_orders", f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, round(o_totalprice, {DIGITS}) AS avoid,
  CASE o_orderstatus WHEN 'F' THEN CAST(month(o_orderdate) AS VARCHAR) WHEN 'O' THEN 'x' || month(o_orderdate) END AS mixed,
  CAST(month(o_orderdate) AS BIGINT) AS nested_number, 'n' || o_orderstatus AS nested_text,
  CAST(list_sum([month(o_orderdate), 2]) AS BIGINT) AS list_sum,
  CAST(CASE o_orderstatus WHEN 'O' THEN 99 ELSE month(o_orderdate) END AS BIGINT) AS epochs,
  round(o_totalprice / 100.0, {DIGITS}) AS duration_sec, o_orderpriority AS log FROM orders""")
def runs_inferred_orders(spark, sf_dir):
    """Runs flattened by inferred schemas: keys that look like types or hold blanks,
    a key of several kinds, nested objects and arrays, a key in two columns."""
    orders, joined = table(spark, sf_dir, "orders"), f"{_new_root(spark)}/orders"
    o = orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"),
                      F.month("o_orderdate").alias("m"))
    # Narrow rows are joined, once; every pass makes its texts from them, so no text is shuffled.
    # Both sides are one table, none of them the small one; the shuffle also spreads a single file.
    write_table(orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice")
                .join(o.hint("merge"), "o_orderkey"), joined)
    runs = E.stored_runs(spark.read.parquet(joined), ("price", "status", "m"))
    by_status = (F.when(F.col("status") == "F", F.col("m").cast("string"))
                 .when(F.col("status") == "O", F.concat(F.lit('"x'), "m", F.lit('"'))).otherwise(F.lit("null")))
    more = F.concat(F.lit(',"AVOID":'), F.col("price").cast("string"), F.lit(',"a b":'), by_status,
                    F.lit(',"opt":{"VOID":'), "m", F.lit(',"name":"n'), "status", F.lit('","DECIMAL(1,0)":['), "m",
                    F.lit(',2]}}'))
    last = F.when(F.col("status") == "O", F.lit(',"epochs":99}')).otherwise(F.lit("}"))
    cut = lambda c: F.expr(f"substring({c}, 1, length({c}) - 1)")
    runs = runs.select("id", "name", F.concat(cut("config"), more).alias("config"),
                       F.concat(cut("summary"), last).alias("summary"), "metadata")
    flat = E.flatten_runs(runs)
    opt = F.col("opt")
    return flat.select("id", r("AVOID").alias("avoid"), F.col("a b").alias("mixed"), opt["VOID"].alias("nested_number"),
                       opt["name"].alias("nested_text"),
                       F.aggregate(opt.getField("DECIMAL(1,0)"), F.lit(0).cast("long"), lambda a, x: a + x).alias("list_sum"),
                       "epochs", r("duration_sec").alias("duration_sec"), "log")


# -- targets without a logit (V1)

@register("targets_without_logits_embeddings", "WITH " + _SCORED_SQL + f""",
h AS (SELECT e.vec_id, CASE WHEN vec_id % 3 = 0 THEN target + 4 ELSE target END AS t, l, lse.lse, c
      FROM e JOIN lse USING (vec_id), k)
SELECT count(*) FILTER (t >= c) AS left_out, round(avg(lse - l[t + 1]) FILTER (t < c), {DIGITS}) AS ce_loss,
       count(*) FILTER (t < c) AS n FROM h""")
def targets_without_logits_embeddings(spark, sf_dir):
    """V1: positions whose target is no class of their logits are left out and counted."""
    s = _scored(spark, sf_dir)
    s = s.withColumn("target", F.when(F.col("vec_id") % 3 == 0, F.col("target") + 4).otherwise(F.col("target")))
    parts = [V.left_out(s), V.masked_cross_entropy(s), V.flatten_valid(s).agg(F.count(F.lit(1)).alias("n"))]
    out = combine_scalars(parts, {"left_out": "long", "n": "long"})
    return out.select("left_out", r("ce_loss").alias("ce_loss"), "n")


# -- a raw log read from its folder

@register("raw_log_events_by_user", "WITH " + prep_ctes("events_by_user") + f"""
SELECT case_id, seq, activity, round(amount, {DIGITS}) AS amount,
  round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY case_id)) / {US_DAY}, {DIGITS}) AS accumulated_time,
  CAST(dayofmonth(ts) AS DOUBLE) AS day_of_month, CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week,
  CAST(dayofyear(ts) AS DOUBLE) AS day_of_year, CAST(hour(ts) AS DOUBLE) AS hour_of_day,
  CAST(minute(ts) AS DOUBLE) AS min_of_hour, CAST(month(ts) AS DOUBLE) AS month_of_year,
  CAST(second(ts) AS DOUBLE) AS sec_of_min, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS secs_within_day,
  CAST(weekofyear(ts) AS DOUBLE) AS week_of_year FROM prep""")
def raw_log_events_by_user(spark, sf_dir):
    """A CSV log with raw names, read from its folder, renamed,
    prepared, and given all numeric features."""
    root = _new_root(spark)
    log, _ = load_log(spark, "events_by_user", sf_dir)
    low, high = (F.when(F.col("seq") % 2 == k, F.col("amount")) for k in (0, 1))
    raw = log.select(F.col("case_id").alias(XES_CASE), F.col("activity").alias(XES_ACTIVITY), F.col("ts").alias(XES_TIME),
                     low.alias(XES_AMOUNTS[0]), high.alias(XES_AMOUNTS[1]), "seq")
    write_table(raw, f"{root}/log.csv", "csv")
    back = read_log(spark, root)
    back = back.withColumns({"seq": F.col("seq").cast("long"), **{c: F.col(f"`{c}`").cast("double") for c in XES_AMOUNTS}})
    df, spec = from_xes_columns(back)
    df, spec = prepare_log(df, spec, benchmark_params("events_by_user") or ADAPTER_PARAMS["events_by_user"])
    features = feature_set("all")
    return time_features(df, spec, remaining=False).select(
        "case_id", "seq", "activity", r("amount").alias("amount"),
        *[r(c).alias(c) if c == "accumulated_time" else F.col(c) for c in features])


# -- runs of several projects

@register("several_projects_runs", "WITH " + _EXP_CTES + f"""
SELECT 'finished' AS project, id, log, lr, round(acc, {DIGITS}) AS acc FROM runs WHERE backbone = 'F'
UNION ALL SELECT 'open', id, log, NULL, round(acc, {DIGITS}) FROM runs WHERE backbone = 'O'""")
def several_projects_runs(spark, sf_dir):
    """The union of two projects, one without ``lr``; a third is not there and left out."""
    runs = _exp(spark, sf_dir)[0].select("id", "log", "lr", "acc", "backbone")
    root = _new_root(spark)
    write_table(runs.filter("backbone = 'F'"), f"{root}/finished")
    write_table(runs.filter("backbone = 'O'").drop("lr"), f"{root}/open")
    loaded, missing = E.load_multiple({p: (lambda p=p: spark.read.parquet(f"{root}/{p}")) for p in ("finished", "open", "lost")})
    if missing != ["lost"]:
        raise AssertionError(f"left out: {missing}")
    return loaded.select("project", "id", "log", "lr", r("acc").alias("acc"))


# -- result tables

@register("prefix_csv_conversations", "WITH " + pairs_ctes("conversations") + """
SELECT CAST(prefix_id AS VARCHAR) AS prefix_id, CAST(count AS VARCHAR) AS count,
       '["' || array_to_string(prefix, '","') || '"]' AS prefix FROM ranked""")
def prefix_csv_conversations(spark, sf_dir):
    """The prefix table saved as CSV, its arrays as JSON lists, and read back."""
    path = f"{_new_root(spark)}/prefixes"
    stats = X.prefix_stats(_named_prefixes(spark, sf_dir, "conversations"))
    save_csv(stats.select("prefix_id", "count", "prefix"), path, "prefix")
    return spark.read.option("header", "true").option("escape", "\\").csv(path)


@register("appended_confidence_embeddings", "WITH " + _SCORED_SQL + f""",
bp AS (SELECT pred AS cls, avg(conf) AS conf, count(*) AS n FROM rows_ GROUP BY pred)
SELECT run, CAST(cls AS INTEGER) AS cls, round(conf, {DIGITS}) AS avg_confidence, n AS predicted_count
FROM bp, (VALUES ('first'), ('second')) AS runs(run)""")
def appended_confidence_embeddings(spark, sf_dir):
    """S11 + S13: the confidence rows of one run written, those of another appended."""
    path = f"{_new_root(spark)}/confidence"
    rows = V.confidence_by_class(_scored(spark, sf_dir)).filter("predicted_count > 0").select(
        "cls", "avg_confidence", "predicted_count")
    write_table(rows.withColumn("run", F.lit("first")), path)
    append_rows(rows.withColumn("run", F.lit("second")), path)
    return spark.read.parquet(path).select("run", "cls", r("avg_confidence").alias("avg_confidence"), "predicted_count")


# -- traces in segments (Q1, Q3)

@register("trace_segments_events_by_user_day", "WITH " + prep_ctes("events_by_user_day") + """,
seqs AS (SELECT right(case_id, 1) AS batch, case_id, list(activity ORDER BY ts, seq) AS acts FROM prep GROUP BY case_id),
t AS (SELECT *, max(len(acts)) OVER (PARTITION BY batch) AS longest FROM seqs),
s AS (SELECT *, unnest(range((longest - 1) // 4 + 1)) AS segment FROM t)
SELECT batch, case_id, segment, CAST(least(greatest(len(acts) - 4 * segment, 0), 4) AS INTEGER) AS n_valid,
  array_to_string(list_resize(list_slice(acts, 4 * segment + 1, 4 * segment + 4), least(4, longest - 4 * segment), '<PAD>'), ',') AS acts
FROM s""")
def trace_segments_events_by_user_day(spark, sf_dir):
    """Q1 + Q3: traces in segments of four events, padded to the longest of their batch."""
    df, spec = _prepared(spark, sf_dir, "events_by_user_day")
    segments = Q.trace_segments(df, spec, [spec.activity], size=4).withColumn("batch", F.expr("right(case_id, 1)"))
    p = Q.pad_segments(segments, spec.case, spec.activity, "batch", 4, value="<PAD>")
    return p.select("batch", spec.case, "segment", "n_valid", F.array_join(spec.activity, ",").alias("acts"))
