"""Analytics over flattened run and history tables.

Run tables have one row per training run; history tables one row per
(run, step).  Everything is grouping, ranking windows and joins; only the
Wilcoxon p-value of a group is computed in Python (a vectorised UDF over the
group rows, after the ranking is done in Spark).
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Iterable, Optional, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.columns import isclose, p_stars, student_two_sided  # noqa: F401  (A36 re-exported)
from caseflow.functions.rank import global_row_number, group_average_rank, group_quantiles, group_value_ranks


# --- A1-A3: best validation step --------------------------------------------

def best_val_step(runs: DataFrame, history: DataFrame, loss: str = "val_loss", acc: str = "val_acc",
                  f1: str = "val_f1", run_id: str = "run_id", step: str = "step") -> DataFrame:
    """A1: per run the history row with the minimal loss (null losses dropped,
    ties -> earliest step), renamed best_step / best_val_*, left-joined to runs."""
    missing = [c for c in (loss, acc, f1) if c not in history.columns]
    if missing:
        raise ValueError(f"Columns not found in history: {missing}")
    best = (history.filter(F.col(loss).isNotNull())
                   .groupBy(run_id)
                   .agg(F.min_by(F.struct(F.col(step).alias("best_step"), F.col(loss).alias("best_val_loss"),
                                          F.col(acc).alias("best_val_acc"), F.col(f1).alias("best_val_f1")),
                                 F.struct(F.col(loss), F.col(step))).alias("__b"))
                   .select(F.col(run_id).alias("__rid"), "__b.*"))
    return runs.join(best, runs["id"] == best["__rid"], "left").drop("__rid")


def test_at_best_val(enriched: DataFrame, history: DataFrame, test_cols: dict, run_id="run_id",
                     step="step", atol: float = 1e-8) -> DataFrame:
    """A2: history test metrics at the best step, and whether they match the
    logged finals (``test_cols``: history column -> run column) by isclose."""
    h = history.select(F.col(run_id).alias("__rid"), F.col(step).alias("__st"),
                       *[F.col(c).alias(f"hist_{c}") for c in test_cols])
    j = enriched.join(h, (enriched["id"] == h["__rid"]) & (enriched["best_step"] == h["__st"]), "left") \
                .drop("__rid", "__st")
    for hc, rc in test_cols.items():
        j = j.withColumn(f"match_{hc}", isclose(f"hist_{hc}", rc, atol=atol))
    return j


def best_row(df: DataFrame, group: Sequence[str], order: list) -> DataFrame:
    """The first row per group under ``order`` — a list of (column, ascending,
    nulls_last) — as a partial aggregation (``min_by`` over an ordering
    struct), so a group holding many rows is combined map-side instead of
    being sorted in one task."""
    keys = []
    for c, asc, nulls_last in order:
        col = F.col(c)
        keys.append((col.isNull() if nulls_last else col.isNotNull()).alias(f"__n_{c}"))
        keys.append((col if asc else -col).alias(f"__v_{c}"))
    cols = [c for c in df.columns if c not in group]
    best = df.groupBy(*group).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*keys)).alias("__b"))
    return best.select(*group, *[F.col("__b")[c].alias(c) for c in cols]).select(*df.columns)


def best_by_group(df: DataFrame, group: Sequence[str], metric: str, ascending: bool = True,
                  tie: str = "id") -> DataFrame:
    """The row with the best metric per group (nulls last, ties -> smallest ``tie``)."""
    return best_row(df, group, [(metric, ascending, True), (tie, True, True)])


def best_by_scope(df: DataFrame, scopes: dict, group: Sequence[str], metric: str, ascending: bool = True,
                  tie: str = "id", scope: str = "scope") -> DataFrame:
    """A3 over several scopes (``scopes``: name -> Column predicate): per scope and group the
    row with the best metric, with the scope's name in column ``scope``.  One aggregation
    with a conditional best row for each scope; a group without a row in a scope has none there."""
    key = F.struct(F.col(metric).isNull(), F.col(metric) if ascending else -F.col(metric), F.col(tie))
    row = F.struct(*[F.col(c) for c in df.columns if c not in group])
    names = list(scopes)
    aggs = []
    for i, n in enumerate(names):
        aggs.append(F.min_by(row, F.when(scopes[n], key)).alias(f"__s{i}"))
    best = df.groupBy(*group).agg(*aggs)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"__s{i}").alias("r")) for i, n in enumerate(names)]))
    return (best.select(*group, each.alias("__e")).filter("__e.r is not null")
            .select(F.col("__e.n").alias(scope), *[c if c in group else F.col("__e.r")[c].alias(c) for c in df.columns]))


def best_run_id(df: DataFrame, group: Sequence[str], metric: str, maximize: bool = True,
                run: str = "id") -> DataFrame:
    """Run id at the max (or min) metric per group; ties -> smallest id."""
    key = F.struct((-F.col(metric)) if maximize else F.col(metric), F.col(run))
    return (df.filter(F.col(metric).isNotNull()).groupBy(*group)
              .agg(F.min_by(run, key).alias("best_run_id")))


# --- A4-A9: labels -----------------------------------------------------------

def coalesce_metric(*cols) -> F.Column:
    """A4: first non-null of several metric columns, as double."""
    return F.coalesce(*[F.col(c).try_cast("double") for c in cols])


NO_TUNING = ("None", "nan", "")


def normalise_labels(df: DataFrame, tuning: str = "fine_tuning", log_map: Optional[dict] = None,
                     exclude_backbones: Iterable[str] = (), weight_tying: Optional[str] = None) -> DataFrame:
    """A5: no fine-tuning (null, 'None', 'nan', '') -> freeze='all', tune='no freezing';
    logs renamed by map; excluded backbones dropped; weight tying to bool (null -> False)."""
    none = F.col(tuning).isNull() | F.col(tuning).isin(*NO_TUNING)
    out = df.withColumn("freeze", F.when(none, F.lit("all")).otherwise(F.col(tuning))) \
            .withColumn("fine_tune", F.when(none, F.lit("no freezing")).otherwise(F.col(tuning)))
    if log_map:
        m = F.create_map(*[x for k, v in log_map.items() for x in (F.lit(k), F.lit(v))])
        out = out.withColumn("log", F.coalesce(m[F.col("log")], F.col("log")))
    ex = list(exclude_backbones)
    if ex:
        out = out.filter(~F.col("backbone").isin(*ex) | F.col("backbone").isNull())
    if weight_tying:
        out = out.withColumn(weight_tying, F.coalesce(F.col(weight_tying).try_cast("boolean"), F.lit(False)))
    return out


def arch_label(hidden="hidden_size", layers="n_layers", heads="n_heads", sep="-") -> F.Column:
    """A6: 'hidden-layers-heads' as integers, 'nan' for missing parts."""
    part = lambda c: F.coalesce(F.col(c).try_cast("int").cast("string"), F.lit("nan"))
    return F.concat_ws(sep, part(hidden), part(layers), part(heads))


# Name prefixes and display labels of model families, the project
# name parts that tell trained-from-scratch and distilled runs, their prefixes.
FAMILY_PREFIXES = ("qwen", "nano", "distill", "gpt2", "LSTM")
SOURCES = {"scratch": "nanogpt_scratch", "distill": "distill"}


def source_label(project="project", backbone="backbone", **arch) -> F.Column:
    """Runs of scratch and distillation projects are labelled
    '<source>_<hidden>_<layers>_<heads>', all others keep their backbone."""
    out = F.col(backbone)
    for source, part in SOURCES.items():       # a later source wins
        out = F.when(F.coalesce(F.col(project).contains(part), F.lit(False)),
                     F.concat(F.lit(source + "_"), arch_label(**{"sep": "_", **arch}))).otherwise(out)
    return out


def source_of(label) -> F.Column:
    """A7: 'scratch', 'distill' or 'finetune' from a source label."""
    c = F.col(label)
    out = F.lit("finetune")
    for source in SOURCES:
        out = F.when(c.startswith(source + "_"), F.lit(source)).otherwise(out)
    return out


def display_label(label) -> F.Column:
    """A source label without its source."""
    out = F.col(label)
    for source in SOURCES:
        out = F.when(F.col(label).startswith(source + "_"), F.substring(F.col(label), len(source) + 2, 1 << 30)).otherwise(out)
    return out


def group_of(backbone="backbone", unknown: str = "baseline") -> F.Column:
    """The name prefix of a backbone, ``unknown`` if it has none of them."""
    out = F.lit(unknown)
    for p in reversed(FAMILY_PREFIXES):
        out = F.when(F.col(backbone).startswith(p), F.lit(p)).otherwise(out)
    return out


def model_family(backbone="backbone", unknown: str = "Other") -> F.Column:
    """Display family from backbone name prefixes; ``unknown`` for other names."""
    b = F.lower(F.col(backbone))
    return (F.when(b.startswith("lstm"), "LSTM").when(b.startswith("nano"), "From Scratch")
             .when(b.startswith("distill"), "Distilled").when(b.startswith("gpt2"), "Pre-trained GPT-2")
             .when(b.startswith("qwen"), "Pre-trained Qwen-3").when(b == "baseline", "Argmax")
             .otherwise(unknown))


def alias_values(c, mapping: dict) -> F.Column:
    """Display label, falling back to the value itself."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(c)], F.col(c))


def project_view(df: DataFrame, views: dict, name: str, include_baseline: bool = False) -> DataFrame:
    """Union of source masks chosen by view name (``views``: name -> Column predicate)."""
    if name not in views:
        raise ValueError(f"unknown view {name!r}")
    pred = views[name]
    if include_baseline:
        pred = pred | (F.col("backbone") == "baseline")
    return df.filter(pred)


# --- A10-A22: summaries ------------------------------------------------------

def summary_stats(df: DataFrame, keys: Sequence[str], metric: str, drop_null_keys: bool = False) -> DataFrame:
    """A10: count, mean, sample std, min, max of ``metric`` per key (null metric rows dropped)."""
    d = df.filter(F.col(metric).isNotNull())
    if drop_null_keys:
        d = d.dropna(subset=list(keys))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"),
                                F.stddev_samp(metric).alias("std"), F.min(metric).alias("min"),
                                F.max(metric).alias("max"))


def descriptors(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """A non-null value per group (the smallest), and for each column whether it
    varies inside a group (null counts as a value).  A column varies when its extremes
    differ or only some of its values are null, so the rows are combined once, whatever
    the number of columns."""
    aggs = []
    for c in cols:
        some_null = (F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))
        aggs += [F.min(c).alias(c),
                 (F.coalesce(F.min(c) != F.max(c), F.lit(False)) | some_null).alias(f"{c}__varies")]
    return df.groupBy(*keys).agg(*aggs)


def projects_list(df: DataFrame, keys: Sequence[str], project: str = "project") -> DataFrame:
    """Sorted distinct projects joined by ', ' per group."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(project)), ", ").alias("projects"))


def experiment_grid(spark, logs: Sequence[str], backbones: Sequence[str], lrs: Sequence,
                    special: Optional[str] = None) -> DataFrame:
    """The planned configuration grid (a parameter, not data): every
    (log, backbone, lr); the ``special`` backbone only without lr (null)."""
    rows = [(lg, b, float(lr)) for lg in logs for b in backbones if b != special for lr in lrs]
    if special:
        rows += [(lg, special, None) for lg in logs]
    return spark.createDataFrame(rows, "log string, backbone string, lr double")


def missing_configs(grid: DataFrame, observed: DataFrame, keys=("log", "backbone", "lr"),
                    target: int = 5, special: Optional[str] = None, special_target: int = 1) -> DataFrame:
    """A15 + A16: grid joined with observed run counts; n_runs null -> 0;
    missing = max(target - n_runs, 0) (``special_target`` for the special backbone)."""
    keys = list(keys)
    counts = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"))
    c = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], "n_runs")
    cond = reduce(lambda a, b: a & b, [grid[k].eqNullSafe(c[f"__{k}"]) for k in keys])  # null lr matches null
    j = (grid.join(c, cond, "left").drop(*[f"__{k}" for k in keys])
             .withColumn("n_runs", F.coalesce(F.col("n_runs"), F.lit(0))))
    tgt = F.when(F.col("backbone") == F.lit(special), F.lit(special_target)).otherwise(F.lit(target)) \
        if special else F.lit(target)
    return j.withColumn("missing", F.greatest(tgt - F.col("n_runs"), F.lit(0)))


MISSING = "__MISSING__"


def full_grid(grid: DataFrame, observed: DataFrame, rest: Sequence[str], keys=("log", "backbone", "lr"),
              special: Optional[str] = None) -> DataFrame:
    """Every planned (log, backbone, lr) with the variants of ``rest`` observed
    for it, or one placeholder variant.  Observed rows without a learning rate count
    for the ``special`` backbone alone.  Variant columns are strings."""
    keys, rest = list(keys), list(rest)
    ok = F.col("lr").isNotNull() | (F.col("backbone") == special) if special else F.col("lr").isNotNull()
    v = (observed.filter(ok).select(*[F.col(k).alias(f"__{k}") for k in keys],
                                    *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in rest]).distinct())
    same = [grid[k].eqNullSafe(v[f"__{k}"]) for k in keys]
    return (grid.join(v, same, "left").select(*keys, *[F.coalesce(F.col(c), F.lit(MISSING)).alias(c) for c in rest])
                .distinct())


def missing_runs(full: DataFrame, runs: DataFrame, metric: str, rest: Sequence[str], keys=("log", "backbone", "lr"),
                 target: int = 5, special: Optional[str] = None, special_target: int = 1,
                 best_target: int = 10) -> DataFrame:
    """A15 + A16 on the full grid: n_runs and mean per variant, ``missing_row``,
    ``missing_runs`` to the row's target, and ``missing_to_best``: on the row with
    the smallest mean of each (log, backbone) the runs left to ``best_target``, 0
    on all others (ties: first by the keys)."""
    keys, rest = list(keys), list(rest)
    s = runs.groupBy(*keys, *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in rest]).agg(
        F.count(metric).alias("n_runs"), F.avg(metric).alias("mean"))
    s = s.select(*[F.col(c).alias(f"__{c}") for c in keys + rest], "n_runs", "mean")
    same = [full[c].eqNullSafe(s[f"__{c}"]) for c in keys + rest]
    j = full.join(s, same, "left").select(*keys, *rest, F.col("n_runs").isNull().alias("missing_row"),
                                          F.coalesce("n_runs", F.lit(0)).alias("n_runs"), "mean")
    order = F.struct("mean", *[c for c in keys + rest if c not in ("log", "backbone")])
    best = j.filter("mean is not null").groupBy("log", "backbone").agg(F.min(order).alias("__best"))
    goal = F.when(F.col("backbone") == special, special_target).otherwise(target) if special else F.lit(target)
    return (j.join(best, ["log", "backbone"], "left")
             .withColumn("missing_runs", F.greatest(goal - F.col("n_runs"), F.lit(0)))
             .withColumn("missing_to_best", F.when(F.coalesce(order == F.col("__best"), F.lit(False)),
                                                   F.greatest(best_target - F.col("n_runs"), F.lit(0))).otherwise(0))
             .drop("__best"))


def unplanned_configs(grid: DataFrame, observed: DataFrame, keys=("log", "backbone", "lr")) -> DataFrame:
    """Observed configurations that are not in the grid (anti join)."""
    return observed.select(*keys).distinct().join(grid, list(keys), "left_anti")


def best_per_log(stats: DataFrame, metric: str = "mean", min_runs: int = 4, log: str = "log") -> DataFrame:
    """Flag the minimal mean per log among rows with at least ``min_runs`` runs."""
    eligible = F.col("n") >= min_runs
    best = stats.groupBy(log).agg(F.min(F.when(eligible, F.col(metric))).alias("__best"))   # one row per log
    j = stats.join(best, log, "left")
    return j.withColumn("is_best", eligible & (F.col(metric) == F.col("__best"))).drop("__best")


def recorded_runs(df: DataFrame, keys: Sequence[str], excluded_projects: Iterable[str],
                  project: str = "project", target: int = 10) -> DataFrame:
    """Per config total runs, runs from projects not excluded (trimmed
    names), missing to ``target``, and the project list."""
    ex = [p.strip() for p in excluded_projects]
    ok = ~F.trim(F.col(project)).isin(*ex) if ex else F.lit(True)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(ok).alias("recorded_runs"),
        F.array_join(F.sort_array(F.collect_set(project)), ", ").alias("projects")) \
        .withColumn("missing_to_target", F.greatest(F.lit(target) - F.col("recorded_runs"), F.lit(0)))


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, nulls, non_nulls)."""
    agg = df.agg(*[x for c in cols for x in (F.count_if(F.col(c).isNull()).alias(f"{c}__n"),
                                             F.count(c).alias(f"{c}__nn"))])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("nulls"),
                                                   F.col(f"{c}__nn").alias("non_nulls")) for c in cols]))
                      .alias("s")).select("s.*")


def columns_equal(df: DataFrame, a: str, b: str) -> DataFrame:
    """Whether two columns are equal on every row (null-safe)."""
    return df.agg(F.coalesce(F.bool_and(F.col(a).eqNullSafe(F.col(b))), F.lit(True)).alias("equal"))


def hashable_key(c) -> F.Column:
    """Stable JSON text of a list / struct value; null stays null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isNull(), F.lit(None)).otherwise(F.to_json(col))


def multi_metric_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Count / mean / sample std of several metrics; rows where all are null dropped."""
    d = df.filter(reduce(lambda a, b: a | b, [F.col(m).isNotNull() for m in metrics]))
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return d.groupBy(*keys).agg(*aggs)


def best_lr(summary: DataFrame, group=("log", "backbone"), f1="f1_mean", acc="acc_mean", n="n",
            lr="lr") -> DataFrame:
    """One row per group by f1 desc, acc desc, n desc, lr asc (nulls last)."""
    return best_row(summary, list(group), [(f1, False, True), (acc, False, True), (n, False, True),
                                           (lr, True, True)])


# --- A23-A27: differences and tests ------------------------------------------

def paired_diff(stats: DataFrame, by: str, key: str, a: str, b: str,
                mean: str = "mean", std: str = "std") -> DataFrame:
    """Per ``by`` value: mean_a - mean_b and err = sqrt(sd_a² + sd_b²)
    (null sd -> 0); pairs with a side missing are skipped."""
    sa = stats.filter(F.col(key) == a).select(by, F.col(mean).alias("mean_a"), F.col(std).alias("std_a"))
    sb = stats.filter(F.col(key) == b).select(by, F.col(mean).alias("mean_b"), F.col(std).alias("std_b"))
    j = sa.join(sb, by)
    return j.select(by, "mean_a", "std_a", "mean_b", "std_b",
                    (F.col("mean_a") - F.col("mean_b")).alias("diff"),
                    F.sqrt(F.pow(F.coalesce("std_a", F.lit(0.0)), 2) + F.pow(F.coalesce("std_b", F.lit(0.0)), 2))
                    .alias("err"))


def diff_by_dataset(a: DataFrame, b: DataFrame, keys=("log", "size"), metric="mean", by="log") -> DataFrame:
    """A - b per (log, size), then mean and sample sd over sizes per log (null sd -> 0)."""
    keys = list(keys)
    j = a.select(*keys, F.col(metric).alias("__a")).join(b.select(*keys, F.col(metric).alias("__b")), keys)
    d = j.withColumn("diff", F.col("__a") - F.col("__b"))
    return d.groupBy(by).agg(F.avg("diff").alias("diff_mean"),
                             F.coalesce(F.stddev_samp("diff"), F.lit(0.0)).alias("diff_std"),
                             F.count(F.lit(1)).alias("n"))


def diff_by_size(a: DataFrame, b: DataFrame, keys=("log", "size"), metric="mean", std="std",
                 by="size") -> DataFrame:
    """Per size over the common logs: mean of per-log means of each side,
    sd over logs, diff and combined error."""
    keys = list(keys)
    common = a.select(*keys).join(b.select(*keys), keys)
    def side(df, s):
        return (df.join(common, keys, "left_semi").groupBy(by)
                  .agg(F.avg(metric).alias(f"mean_{s}"), F.stddev_samp(metric).alias(f"std_{s}")))
    j = side(a, "a").join(side(b, "b"), by)
    return j.withColumn("diff", F.col("mean_a") - F.col("mean_b")) \
            .withColumn("err", F.sqrt(F.pow(F.coalesce("std_a", F.lit(0.0)), 2) +
                                      F.pow(F.coalesce("std_b", F.lit(0.0)), 2)))


def diff_vs_reference(df: DataFrame, family: str, metric: str, target_family: str, ref_family: str,
                      by: str = "log") -> DataFrame:
    """Per log, runs of ``target_family`` against ``ref_family``: mean/sd
    each (conditional aggregates in one pass), diff and combined error."""
    t = F.col(family) == target_family
    r_ = F.col(family) == ref_family
    g = df.groupBy(by).agg(F.avg(F.when(t, F.col(metric))).alias("mean_t"),
                           F.stddev_samp(F.when(t, F.col(metric))).alias("std_t"),
                           F.avg(F.when(r_, F.col(metric))).alias("mean_r"),
                           F.stddev_samp(F.when(r_, F.col(metric))).alias("std_r"))
    g = g.filter(F.col("mean_t").isNotNull() & F.col("mean_r").isNotNull())
    return g.withColumn("diff", F.col("mean_t") - F.col("mean_r")) \
            .withColumn("err", F.sqrt(F.pow(F.coalesce("std_t", F.lit(0.0)), 2) +
                                      F.pow(F.coalesce("std_r", F.lit(0.0)), 2)))


def signed_rank_tail(w2: int, ranks2: Sequence[int], times: Sequence[int]) -> float:
    """P(W+ <= w2 / 2) over all sign assignments, of doubled ranks that occur ``times``.

    The distribution is the product of one binomial factor ((1 + x^r) / 2)^t a distinct
    rank, held as one array of the sums up to ``w2``."""
    import numpy as np

    share = np.zeros(w2 + 1)
    share[0] = 1.0
    for r, t in zip(ranks2, times):
        whole, factor = share, 0.5 ** min(t, 1000)
        share = whole * factor
        for j in range(1, min(t, w2 // r) + 1):
            factor *= (t - j + 1) / j
            share[r * j:] += factor * whole[:w2 + 1 - r * j]
        if t > 1000:
            share *= 0.5 ** (t - 1000)
    return float(share.sum())


def wilcoxon_exact_p(w: float, n: int, ranks2: Optional[Sequence[int]] = None,
                     times: Optional[Sequence[int]] = None) -> float:
    """Two-sided exact p of the signed-rank statistic W = min(W+, W-).

    ``ranks2``: the doubled (integer) ranks, which handles averaged ties, each
    ``times`` (once by default); by default 2, 4, ..., 2n."""
    r2 = list(ranks2) if ranks2 is not None else [2 * i for i in range(1, n + 1)]
    t = list(times) if times is not None else [1] * len(r2)
    w2 = min(int(round(2 * w)), sum(r * k for r, k in zip(r2, t)))
    return min(1.0, 2.0 * signed_rank_tail(w2, r2, t))


def _norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def wilcoxon_signed_rank(df: DataFrame, group: Sequence[str], diff: str, method: str = "exact",
                         zero_tol: float = 1e-12, all_zero_tol: float = 1e-8) -> DataFrame:
    """Per group Wilcoxon signed-rank test of the paired differences.

    Nulls dropped; ``n`` counts the pairs, ``n_nonzero`` those kept for ranking
    (|d| > ``zero_tol``); |d| ranked with ties averaged; W = min(W+, W-).  The
    caller chooses the p-value: ``exact`` multiplies one factor a distinct rank of
    the group (memory: its distinct ranks and W; time: its size times W),
    ``normal`` is the approximation with tie correction; the column
    ``method`` says which.  Groups without pairs, or whose differences are all
    within ``all_zero_tol``, have null W and p.
    """
    if method not in ("exact", "normal"):
        raise ValueError(f"unknown method {method!r}")
    group = list(group)
    a = F.abs(F.col(diff))
    pairs = df.groupBy(*group).agg(F.count(diff).alias("n"), (F.max(a) > all_zero_tol).alias("__some"),
                                   F.count(F.when(a > zero_tol, 1)).alias("n_nonzero"))
    nz = df.filter(a > zero_tol).withColumn("__a", a)
    # tie-averaged ranks of the distinct |d| per group; doubled to stay integral
    per = group_value_ranks(nz, group, "__a", {"__pos": F.count(F.when(F.col(diff) > 0, 1))}) \
        .withColumn("__r2", (2 * F.col("__first") + F.col("__m") + 1).cast("long"))
    per = per.groupBy(*group).agg(
        F.sum("__m").alias("__n"), (F.sum(F.col("__r2") * F.col("__pos")) / 2.0).alias("w_plus"),
        (F.sum(F.col("__r2") * (F.col("__m") - F.col("__pos"))) / 2.0).alias("w_minus"),
        F.sum(F.pow(F.col("__m"), 3) - F.col("__m")).alias("__ties"),
        *([F.collect_list(F.struct("__r2", "__m")).alias("__ranks")] if method == "exact" else []))
    w = F.least("w_plus", "w_minus")
    if method == "exact":
        p = F.pandas_udf(lambda w, ranks, times: pd.Series(
            [wilcoxon_exact_p(x, 0, [int(v) for v in rs], [int(v) for v in ts]) for x, rs, ts in zip(w, ranks, times)],
            dtype="float64"), "double")(w, F.col("__ranks.__r2"), F.col("__ranks.__m"))
    else:
        m = F.col("__n")
        var = m * (m + 1) * (2 * m + 1) / 24.0 - F.col("__ties") / 48.0
        z = F.abs(w - m * (m + 1) / 4.0) / F.sqrt(var)
        p = F.pandas_udf(lambda z: pd.Series([min(1.0, 2.0 * _norm_sf(x)) for x in z], dtype="float64"),
                         "double")(F.when(var > 0, z).otherwise(F.lit(0.0)))
    tested = per.select(*[F.col(g).alias(f"__g_{g}") for g in group], "w_plus", "w_minus", w.alias("w"), p.alias("p_value"))
    same = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group]
    out = pairs.join(tested, same, "left")
    some = F.coalesce("__some", F.lit(False))
    return out.select(*group, "n", "n_nonzero", *[F.when(some, F.col(c)).alias(c)
                                                 for c in ("w_plus", "w_minus", "w", "p_value")],
                      F.lit(method).alias("method"))


# --- A28-A44: timing, params, correlations, curves ---------------------------

def wall_clock_summary(df: DataFrame, backbone="backbone", log="log", duration="duration_sec",
                       epochs="epochs") -> DataFrame:
    """Mean duration / epochs per (backbone, log), then per backbone:
    datasets, runs, avg/min/max/sd minutes (over logs), mean epochs."""
    per = df.groupBy(backbone, log).agg(F.avg(duration).alias("__d"), F.avg(epochs).alias("__e"),
                                        F.count(F.lit(1)).alias("__n"))
    return per.groupBy(backbone).agg(
        F.count(F.lit(1)).alias("datasets"), F.sum("__n").alias("runs"),
        (F.avg("__d") / 60.0).alias("avg_minutes"), (F.min("__d") / 60.0).alias("min_minutes"),
        (F.max("__d") / 60.0).alias("max_minutes"), (F.stddev_samp("__d") / 60.0).alias("sd_minutes"),
        F.avg("__e").alias("avg_epochs"))


def wall_clock_by_family(df: DataFrame, family="family", backbone="backbone", log="log",
                         duration="duration_sec") -> DataFrame:
    """Three levels — (family, backbone, log) -> (family, backbone) -> family."""
    l1 = df.groupBy(family, backbone, log).agg(F.avg(duration).alias("__d"))
    l2 = l1.groupBy(family, backbone).agg(F.avg("__d").alias("__d"))
    return l2.groupBy(family).agg(F.count(F.lit(1)).alias("backbones"), (F.avg("__d") / 60.0).alias("avg_minutes"),
                                  (F.stddev_samp("__d") / 60.0).alias("sd_minutes"))


def mean_per_backbone(df: DataFrame, backbone="backbone", acc="acc", f1="f1", params="params") -> DataFrame:
    """Acc and f1 means per backbone with the median parameter count (order key)."""
    # a backbone has few distinct parameter counts: their frequencies hold the median
    sized = df.groupBy(backbone, F.col(params).cast("double").alias("__p")).agg(
        F.count(params).alias("__f"), F.sum(acc).alias("__a"), F.count(acc).alias("__na"),
        F.sum(f1).alias("__b"), F.count(f1).alias("__nb"))
    up = Window.partitionBy(backbone).orderBy(F.col("__p").asc_nulls_first())
    at = sized.withColumn("__to", F.sum("__f").over(up)).withColumn("__n", F.sum("__f").over(Window.partitionBy(backbone)))

    def kth(k):
        return F.min(F.when(F.col("__to") > k, F.col("__p")))
    lo, hi = kth(F.floor((F.col("__n") - 1) / 2)), kth(F.floor(F.col("__n") / 2))
    return at.groupBy(backbone).agg(F.try_divide(F.sum("__a"), F.sum("__na")).alias("acc_mean"),
                                    F.try_divide(F.sum("__b"), F.sum("__nb")).alias("f1_mean"),
                                    ((lo + hi) / 2.0).alias("median_params"))


def metric_by_params(df: DataFrame, metric: str, backbone: str = "backbone", params: str = "params",
                     reference: Optional[F.Column] = None, reference_label: str = "baseline") -> DataFrame:
    """Mean / sample sd / n of a metric per (backbone, params), plus one
    row for the reference runs (``reference`` predicate) with null params."""
    a = summary_stats(df, [backbone, params], metric).select(backbone, params, "mean", "std", "n")
    if reference is None:
        return a
    ref = (df.filter(reference).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"),
                                    F.count(F.lit(1)).alias("n"))
             .select(F.lit(reference_label).alias(backbone), F.lit(None).cast(df.schema[params].dataType).alias(params),
                     "mean", "std", "n"))
    return a.unionByName(ref)


def slot_order(df: DataFrame, key: str, params: str) -> DataFrame:
    """One row per key ordered by parameter count (nulls last); 0-based position."""
    d = df.groupBy(key).agg(F.min(params).alias(params))
    return global_row_number(d, [F.col(params).asc_nulls_last(), F.col(key)], "slot").withColumn("slot", F.col("slot") - 1)


def params_per_dim(df: DataFrame, keys=("backbone", "log", "size"), trainable="trainable_params",
                   embedding="embedding_size") -> DataFrame:
    """Trainable parameters per embedding dimension, the smallest of a key."""
    return df.groupBy(*keys).agg(F.min(F.col(trainable) / F.col(embedding)).alias("params_per_dim"))


def correlation_p_value(r, n) -> F.Column:
    """p of a correlation coefficient from the t distribution (n > 2, else null)."""
    r, n = (F.col(c) if isinstance(c, str) else c for c in (r, n))
    t = F.abs(r) * F.sqrt((n - 2) / (1 - r * r))
    return F.when((n <= 2) | r.isNull() | F.isnan(r), F.lit(None).cast("double")) \
            .when(F.abs(r) >= 1.0, F.lit(0.0)).otherwise(student_two_sided(t, n - 2))


def _pearson(x: str, y: str) -> F.Column:
    """Pearson's r as an aggregate; NaN where a column is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))),
                      F.lit(float("nan")))


def metric_correlation(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Per group on complete rows: n, Pearson r, Spearman rho (Pearson of
    averaged ranks), and their p-values from the t distribution (n > 2).  Groups
    with fewer than two complete rows appear with n = 0 and NaN coefficients, as has
    a constant metric; with two rows there is Pearson alone and no p."""
    group = list(group)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, x, y)
    # tie-averaged ranks per group (skew-safe), chained so each row carries both
    rk = group_average_rank(group_average_rank(d, group, x, "__rx"), group, y, "__ry")
    g = rk.groupBy(*[F.col(c).alias(f"__g_{c}") for c in group]).agg(
        F.count(F.lit(1)).alias("__n"), _pearson(x, y).alias("__p"), _pearson("__rx", "__ry").alias("__s"))
    same = [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in group]
    nan = F.lit(float("nan"))
    n = F.coalesce(F.col("__n"), F.lit(0))
    out = df.select(*group).distinct().join(g, same, "left").select(
        *group, F.when(n > 1, n).otherwise(F.lit(0)).alias("n"),
        F.when(n > 1, F.col("__p")).otherwise(nan).alias("pearson_r"),
        F.when(n > 2, F.col("__s")).when(n < 2, nan).alias("spearman_r"))
    return (out.withColumn("pearson_p", correlation_p_value("pearson_r", "n"))
               .withColumn("spearman_p", correlation_p_value("spearman_r", "n")))


def metric_correlations(df: DataFrame, group: Sequence[str], pairs: Sequence[tuple]) -> DataFrame:
    """A35 over several metric pairs: a ``pair`` column 'x vs y' in front.  One pass: the
    pairs are a key like the group's, so each column is sorted once for all of them."""
    long_ = df.select(*group, F.explode(F.array(*[F.struct(
        F.lit(f"{x} vs {y}").alias("pair"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
        for x, y in pairs])).alias("__p"))
    long_ = long_.select("__p.pair", *group, "__p.__x", "__p.__y")
    return metric_correlation(long_, ["pair", *group], "__x", "__y")


def learning_curve(history: DataFrame, runs: DataFrame, metric: str, group: Optional[str] = None,
                   run_id="run_id", step="step") -> DataFrame:
    """Mean and sample sd of a metric per step (and group) over the selected runs."""
    sel = runs.select(F.col("id").alias(run_id), *([group] if group else []))
    h = history.join(sel, run_id)
    keys = [step] + ([group] if group else [])
    return h.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"),
                                F.count(F.lit(1)).alias("n_runs"))


def split_curves(history: DataFrame, metrics: dict, run_id="run_id", step="step") -> DataFrame:
    """Melt split metrics (``{'train': col, 'val': col, 'test': col}``) per
    step into (step, split, mean, std, n_runs)."""
    long_ = history.unpivot([run_id, step], list(metrics.values()), "__col", "value")
    m = F.create_map(*[x for k, v in metrics.items() for x in (F.lit(v), F.lit(k))])
    long_ = long_.withColumn("split", m[F.col("__col")]).filter(F.col("value").isNotNull())
    return long_.groupBy(step, "split").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                            F.countDistinct(run_id).alias("n_runs"))


def common_horizon(history: DataFrame, run_id="run_id", step="step", group: Optional[str] = None) -> DataFrame:
    """Keep steps <= min over runs of their last step (per group if given)."""
    last = history.groupBy(*([group] if group else []), run_id).agg(F.max(step).alias("__last"))
    keys = [group] if group else []
    hz = last.groupBy(*keys).agg(F.min("__last").alias("__hz"))
    if keys:
        return history.join(hz, keys).filter(F.col(step) <= F.col("__hz")).drop("__hz")
    horizon = hz.first()["__hz"]          # one scalar
    return history.filter(F.col(step) <= F.lit(horizon))


def bar_summary(df: DataFrame, x: str, hue: Optional[str], metric: str) -> DataFrame:
    """Mean and sd per category (and hue)."""
    keys = [x] + ([hue] if hue else [])
    return df.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"),
                                 F.count(F.lit(1)).alias("n"))


def distribution_summary(df: DataFrame, x: str, metric: str) -> DataFrame:
    """Quartiles (linear interpolation) per category, exact and without
    buffering a category's values (``group_quantiles``)."""
    q = group_quantiles(df, [x], metric, [0.25, 0.5, 0.75])
    wide = q.groupBy(x).pivot("q", [0.25, 0.5, 0.75]).agg(F.max("value"))
    wide = wide.select(x, *[F.col(f"`{c}`").alias(n) for c, n in
                            zip(wide.columns[1:], ("q1", "median", "q3"))])
    mm = df.groupBy(x).agg(F.min(metric).alias("min"), F.max(metric).alias("max"))
    return mm.join(wide, x).select(x, "min", "q1", "median", "q3", "max")


def lr_label(lr="lr") -> F.Column:
    """Learning-rate label '%.0e'."""
    return F.when(F.col(lr).isNull(), F.lit("nan")).otherwise(F.format_string("%.0e", F.col(lr)))


def pivot_mean(df: DataFrame, row: str, col: str, metric: str, values: Optional[list] = None) -> DataFrame:
    """Row x col table of means (pivot values given, or discovered by Spark)."""
    return df.groupBy(row).pivot(col, values).agg(F.avg(metric))


def dataset_size(train="train_events", val="val_events", test="test_events") -> F.Column:
    """Train + val + test events, nulls as 0."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in (train, val, test)), F.lit(0))


def lr_filter(df: DataFrame, lr_value: float, lr="lr") -> DataFrame:
    """Runs with the given lr or without one."""
    return df.filter((F.col(lr) == F.lit(lr_value)) | F.col(lr).isNull())


def run_counts(df: DataFrame, keys=("log", "backbone")) -> DataFrame:
    """Runs per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"))
