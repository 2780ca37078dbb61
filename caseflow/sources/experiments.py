"""Experiment run and history tables.

Stored form (one row per run): ``id, name, config, summary, metadata`` with
JSON strings; history: ``run_id, step, metrics`` (JSON) plus an ingest order.
Loading flattens the JSON into wide columns with a schema merged from the
(path, kind) pairs of all records (distributed passes, one a depth for all columns).

The driver tables contain no training runs, so ``runs_from_orders`` and
``history_from_lineitem`` derive stored-form tables from ``orders`` and
``lineitem`` (one run per order, one history row per line item).
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Optional

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.sources.logs import spread, table

# Key prefixes removed from run summaries and history metrics,
# and the summary key renamed to duration_sec.
DROP_PREFIXES = ("_", "gradients/", "parameters/")
RUNTIME_KEY = "_runtime"


def _keep_key(k):
    return ~reduce(lambda a, b: a | b, [k.startswith(p) for p in DROP_PREFIXES])


def normalise_summary(summary_json) -> F.Column:
    """JSON object -> map<string,string>; ``_runtime`` -> ``duration_sec``,
    keys starting with ``_``, ``gradients/``, ``parameters/`` dropped."""
    m = F.from_json(summary_json, "map<string,string>")
    m = F.transform_keys(m, lambda k, v: F.when(k == F.lit(RUNTIME_KEY), F.lit("duration_sec")).otherwise(k))
    return F.map_filter(m, lambda k, v: _keep_key(k))


def normalise_metrics(metrics_json) -> F.Column:
    """S7 for history rows: the same key filter, no rename."""
    return F.map_filter(F.from_json(metrics_json, "map<string,string>"), lambda k, v: _keep_key(k))


_NUMBERS = {"TINYINT", "SMALLINT", "INT", "BIGINT", "DECIMAL", "FLOAT", "DOUBLE"}
_ELEMENT = "[]"


def json_kinds(df: DataFrame, cols: Iterable[str]) -> dict:
    """column -> path -> kinds of value found there, over all records of JSON-string
    columns.  A path is a tuple of keys (with ``k`` before each) and ``[]`` for array
    elements.

    One distributed pass a depth, over all columns that have values there: the distinct
    (column, path, kind) triples reach the driver, as many as the schemas have fields."""
    kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z_]+", 0)
    below = lambda key: F.concat("path", F.array(key)).alias("path")
    fields = F.transform(F.map_entries(F.col("v").cast("map<string,variant>")),
                         lambda e: F.struct(below(F.concat(F.lit("k"), e["key"])), e["value"].alias("v")))
    items = F.transform(F.col("v").cast("array<variant>"), lambda x: F.struct(below(F.lit(_ELEMENT)), x.alias("v")))
    found: dict = {c: {} for c in cols}
    nested, depth = set(found), 0
    while nested:
        texts = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("text")) for c in sorted(nested)])
        rows = df.select(F.inline(texts)).select("col", F.explode(F.from_json("text", "map<string,variant>")).alias("k", "v"))
        rows = rows.select("col", F.array(F.concat(F.lit("k"), "k")).alias("path"), "v")
        for _ in range(depth):
            rows = rows.select("col", F.inline(F.when(kind == "OBJECT", fields).when(kind == "ARRAY", items)))
        level = rows.select("col", "path", kind.alias("kind")).distinct().collect()
        for r in level:
            found[r["col"]].setdefault(tuple(r["path"]), set()).add(r["kind"])
        nested, depth = {r["col"] for r in level if r["kind"] in ("OBJECT", "ARRAY")}, depth + 1
    return found


def _type_at(kinds: dict, path: tuple) -> T.DataType:
    """The type that holds all kinds of a path; kinds that do not mix are kept as text."""
    own = kinds.get(path, set()) - {"VOID"}
    if own == {"OBJECT"}:
        fields = _fields_at(kinds, path)
        return T.StructType(fields) if fields else T.StringType()
    if own == {"ARRAY"}:
        return T.ArrayType(_type_at(kinds, (*path, _ELEMENT)))
    if own and own <= _NUMBERS:
        return T.DoubleType() if own & {"DECIMAL", "FLOAT", "DOUBLE"} else T.LongType()
    return T.BooleanType() if own == {"BOOLEAN"} else T.StringType()


def _fields_at(kinds: dict, path: tuple) -> list:
    names = sorted(p[-1][1:] for p in kinds if len(p) == len(path) + 1 and p[:-1] == path and p[-1] != _ELEMENT)
    return [T.StructField(n, _type_at(kinds, (*path, "k" + n))) for n in names]


def infer_json_schemas(df: DataFrame, cols: Iterable[str]) -> dict:
    """column -> schema of a JSON-string column over all its records, keys as they are,
    in order.  Whole numbers are long, other numbers double, mixed kinds and keys that
    are always null text.  No records: no fields."""
    return {c: T.StructType(_fields_at(kinds, ())) for c, kinds in json_kinds(df, cols).items()}


def infer_json_schema(df: DataFrame, col: str) -> T.StructType:
    """``infer_json_schemas`` of one column."""
    return infer_json_schemas(df, [col])[col]


def _by_position(schema: T.StructType) -> T.StructType:
    """Fields named by number: keys that differ in case only stay apart."""
    return T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])


def _common(kinds: list) -> T.DataType:
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    numbers = (T.LongType(), T.DoubleType())
    return T.DoubleType() if all(k in numbers for k in kinds) else T.StringType()


def _cast(value, kind: T.DataType, to: T.DataType):
    if kind == to:
        return value
    return F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.cast(to)


def flatten_runs(runs: DataFrame, schemas: Optional[dict] = None) -> DataFrame:
    """Stored runs -> wide rows ``id, name, <config keys>, <summary keys>, <metadata keys>``.

    Each JSON column is parsed once into a typed struct (schema inferred over
    all records when not given); the summary's fields are normalised by name
    (S7: ``_runtime`` -> ``duration_sec``; ``_``, ``gradients/``,
    ``parameters/`` keys dropped).  A key that a record holds in several of them has
    the value of the last, null included, as has one named ``id`` or ``name``.
    ``created_at`` becomes a timestamp.
    """
    schemas = schemas or infer_json_schemas(runs, ("config", "summary", "metadata"))
    parsed = runs.select("id", "name", *schemas, *[
        F.from_json(c, schemas[c]).cast(_by_position(schemas[c])).alias(f"__{c}") for c in schemas if schemas[c].fields])
    values = {c: [(None, F.col(c), parsed.schema[c].dataType)] for c in ("id", "name")}
    for c in schemas:
        for i, f in enumerate(schemas[c].fields):
            name = "duration_sec" if (c == "summary" and f.name == RUNTIME_KEY) else f.name
            if c == "summary" and name.startswith(DROP_PREFIXES):
                continue
            has = F.coalesce(F.array_contains(F.json_object_keys(c), f.name), F.lit(False))
            values.setdefault(name, []).append((has, F.col(f"__{c}")[f"c{i}"], f.dataType))
    cols = []
    for name, found in values.items():
        to = _common([kind for _, _, kind in found])
        value = _cast(found[0][1], found[0][2], to)
        for has, later, kind in found[1:]:
            value = F.when(has, _cast(later, kind, to)).otherwise(value)
        cols.append(value.alias(name))
    out = parsed.select(*cols)
    if "created_at" in out.columns:
        out = out.withColumn("created_at", F.to_timestamp("created_at"))
    return out


def upsert_history(history: DataFrame, ingest: Iterable[str], run: str = "run_id",
                   step: str = "step") -> DataFrame:
    """(run_id, step) is a primary key; the last write (largest ``ingest`` tuple) wins.

    An aggregation (``max_by``), so a run with very many steps is spread over
    tasks by (run, step) hashing and partially aggregated.
    """
    ingest = list(ingest)
    others = [c for c in history.columns if c not in (run, step)]
    key = F.struct(*[F.col(c) for c in ingest])
    return (history.groupBy(run, step)
                   .agg(F.max_by(F.struct(*[F.col(c) for c in others]), key).alias("__last"))
                   .select(run, step, *[F.col("__last")[c].alias(c) for c in others]))


def flatten_history(history: DataFrame, schema: Optional[T.StructType] = None,
                    carry: Iterable[str] = ()) -> DataFrame:
    """History rows -> ``run_id, step, <metric keys>`` (+ ``carry`` columns);
    prefixed keys dropped (S7) and rows with no metric key left are dropped."""
    schema = schema or infer_json_schema(history, "metrics")
    keep = [f for f in schema.fields if not f.name.startswith(DROP_PREFIXES)]
    has_metric = F.exists(F.json_object_keys("metrics"), lambda k: _keep_key(k))
    p = history.filter(has_metric).withColumn("__p", F.from_json("metrics", schema))
    return p.select("run_id", "step", *[F.col("__p").getField(f.name).alias(f.name) for f in keep], *carry)


def load_multiple(frames: dict, skip_missing: bool = True) -> tuple:
    """(union of per-project run tables with a ``project`` column, names left out).

    Missing columns are null.  ``frames`` maps project -> DataFrame or a
    callable returning one.  A project whose files are not there is left out and
    named; any other failure, such as a storage fault, is raised."""
    loaded, missing = [], []
    for project, f in frames.items():
        try:
            df = f() if callable(f) else f
        except (FileNotFoundError, AnalysisException) as e:
            absent = isinstance(e, FileNotFoundError) or e.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")
            if not (skip_missing and absent):
                raise
            missing.append(project)
            continue
        loaded.append(df.withColumn("project", F.lit(project)))
    if not loaded:
        raise ValueError("no project could be loaded")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), loaded), missing


def baseline_run_tables(runs: DataFrame, transitions: DataFrame, predictions: Optional[DataFrame], log: str,
                        lifecycle: bool, backbone: str = "baseline") -> tuple:
    """(transition table, prediction table or None) of the newest finished
    baseline run of ``log``; both come from the same run, predictions are optional."""
    pick = lambda t: baseline_tables(runs, t, log, lifecycle, backbone)
    return pick(transitions), pick(predictions) if predictions is not None else None


def baseline_tables(runs: DataFrame, tables: DataFrame, log: str, lifecycle: bool,
                    backbone: str = "baseline") -> DataFrame:
    """Rows of ``tables`` (run_id, ...) belonging to the newest finished
    baseline run of ``log`` with the given lifecycle setting (null -> False)."""
    sel = (runs.filter((F.col("log") == log) & (F.col("backbone") == backbone)
                       & (F.coalesce(F.col("lifecycle"), F.lit(False)) == F.lit(lifecycle))
                       & (F.col("state") == "finished"))
               .agg(F.max_by("id", F.struct("created_at", "id")).alias("run_id")))
    return tables.join(F.broadcast(sel), "run_id", "left_semi")   # sel is one row


# ---------------------------------------------------------------------------
# Stored-form tables derived from the driver data
# ---------------------------------------------------------------------------

def runs_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored run per order: log = priority, backbone = status,
    lr = 1e-(year - 1992), epochs = month, accuracy = totalprice / 600000,
    f1 = accuracy², duration = totalprice / 100 s, created at the order date,
    project = 'exp-' + status; model gpt2-small / nano_64 / lstm_64 and
    fine_tuning 'None' / null / 'last-2' for status F / O / P; hidden size =
    32 * month, layers = year - 1994, heads = day of month, total params =
    12 * hidden² * layers, trainable = 1000 * hidden * layers."""
    return stored_runs(spread(table(spark, sf_dir, "orders")))


def stored_runs(o: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
    """``runs_from_orders`` of given orders, with the ``carry`` columns beside."""
    acc = F.col("o_totalprice") / F.lit(600000.0)
    lr = F.concat(F.lit("1e-"), (F.year("o_orderdate") - 1992).cast("string")).cast("double")
    hidden = (F.lit(32) * F.month("o_orderdate")).cast("long")
    layers = (F.year("o_orderdate") - 1994).cast("long")
    model = (F.when(F.col("o_orderstatus") == "F", F.lit("gpt2-small"))
              .when(F.col("o_orderstatus") == "O", F.lit("nano_64")).otherwise(F.lit("lstm_64")))
    tuning = (F.when(F.col("o_orderstatus") == "F", F.lit("None"))
               .when(F.col("o_orderstatus") == "P", F.lit("last-2")))
    config = F.to_json(F.struct(F.col("o_orderpriority").alias("log"), F.col("o_orderstatus").alias("backbone"),
                                lr.alias("lr"), F.month("o_orderdate").alias("epochs"),
                                F.concat(F.lit("exp-"), F.col("o_orderstatus")).alias("project"),
                                model.alias("model"), tuning.alias("fine_tuning"),
                                hidden.alias("hidden_size"), layers.alias("n_layers"),
                                F.dayofmonth("o_orderdate").cast("long").alias("n_heads"),
                                (hidden * hidden * layers * 12).alias("total_params"),
                                (hidden * layers * 1000).alias("trainable_params"),
                                hidden.alias("embedding_size"),
                                (F.col("o_orderstatus") == "F").alias("lifecycle")))
    summary = F.to_json(F.struct(
        (F.col("o_totalprice") / 100.0).alias("_runtime"),
        F.month("o_orderdate").alias("_step"),
        F.lit(0.0).alias("gradients/w"),
        acc.alias("best_test_final_next_activity_acc"),
        (acc * acc).alias("best_test_final_next_activity_f1")))
    pr = F.ascii(F.substring("o_orderpriority", 1, 1)) - 48          # 1..5, constant per log
    metadata = F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
                                  F.when(F.col("o_orderstatus") == "O", F.lit("running"))
                                   .otherwise(F.lit("finished")).alias("state"),
                                  (F.length("o_orderpriority") * 1000).cast("long").alias("train_events"),
                                  (pr * 100).cast("long").alias("val_events"),
                                  F.lit(None).cast("long").alias("test_events")))
    return o.select(F.col("o_orderkey").cast("string").alias("id"),
                    F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("name"),
                    config.alias("config"), summary.alias("summary"), metadata.alias("metadata"), *carry)


# Flattened schemas of the derived tables (known, so no inference pass is needed).
RUN_SCHEMAS = {
    "config": T.StructType([T.StructField("log", T.StringType()), T.StructField("backbone", T.StringType()),
                            T.StructField("lr", T.DoubleType()), T.StructField("epochs", T.LongType()),
                            T.StructField("project", T.StringType()), T.StructField("model", T.StringType()),
                            T.StructField("fine_tuning", T.StringType()), T.StructField("hidden_size", T.LongType()),
                            T.StructField("n_layers", T.LongType()), T.StructField("n_heads", T.LongType()),
                            T.StructField("total_params", T.LongType()), T.StructField("trainable_params", T.LongType()),
                            T.StructField("embedding_size", T.LongType()), T.StructField("lifecycle", T.BooleanType())]),
    "summary": T.StructType([T.StructField("_runtime", T.DoubleType()), T.StructField("_step", T.LongType()),
                             T.StructField("gradients/w", T.DoubleType()),
                             T.StructField("best_test_final_next_activity_acc", T.DoubleType()),
                             T.StructField("best_test_final_next_activity_f1", T.DoubleType())]),
    "metadata": T.StructType([T.StructField("created_at", T.StringType()), T.StructField("state", T.StringType()),
                              T.StructField("train_events", T.LongType()), T.StructField("val_events", T.LongType()),
                              T.StructField("test_events", T.LongType())]),
}

HISTORY_SCHEMA = T.StructType([T.StructField("_step", T.LongType()), T.StructField("val_loss", T.DoubleType()),
                               T.StructField("val_acc", T.DoubleType()), T.StructField("val_f1", T.DoubleType())])


def history_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored history row per line item: run = order, step = line number,
    val_loss = discount + tax, val_acc = 1 - discount, val_f1 = quantity / 50;
    (order, line number) repeats, so the ingest order (ship date, then the
    remaining columns) decides which write is last."""
    li = spread(table(spark, sf_dir, "lineitem"))
    metrics = F.to_json(F.struct(
        F.col("l_linenumber").alias("_step"),
        (F.col("l_discount") + F.col("l_tax")).alias("val_loss"),
        (F.lit(1.0) - F.col("l_discount")).alias("val_acc"),
        (F.col("l_quantity") / 50.0).alias("val_f1")))
    return li.select(F.col("l_orderkey").cast("string").alias("run_id"),
                     F.col("l_linenumber").cast("long").alias("step"), metrics.alias("metrics"),
                     "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                     "l_discount", "l_tax")


HISTORY_INGEST = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def derived_experiment(spark: SparkSession, sf_dir: str):
    """(runs, history) flattened from the derived stored tables."""
    runs = flatten_runs(runs_from_orders(spark, sf_dir), RUN_SCHEMAS)
    # keep the last write per (run, step) (as stored at ingest), then parse
    hist = upsert_history(history_from_lineitem(spark, sf_dir), HISTORY_INGEST)
    hist = flatten_history(hist.select("run_id", "step", "metrics"), HISTORY_SCHEMA)
    return runs, hist


def transition_tables_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored transition tables per run: run = order, (return flag -> line
    status, quantity) per line item."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("run_id"),
                     F.col("l_linenumber").cast("long").alias("line"),
                     F.col("l_returnflag").alias("current_activity"),
                     F.col("l_linestatus").alias("next_activity"),
                     F.col("l_quantity").cast("long").alias("count"))
