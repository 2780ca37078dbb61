"""Divergence of the sources within each language, by an Arrow compute pipeline.

Each Arrow batch is lower-cased (``ascii_lower``), split (``split_pattern_regex``),
dictionary-encoded and counted by hash ``group_by`` inside ``mapInArrow``; what
leaves a task are partial counts of (lang, source, term). Spark merges them and
cuts them into shards of a language's terms, and within each shard the columns
are compared source against source with integer arithmetic only.

A language's kept terms are those in at least ``MIN_DOCS`` of its documents (V of
them). With N the kept words of a group, a term with n of them has
p = 1 + floor(10^9 * (n + 2) / (N + 2 * V)); two values are apart by
floor((p - q)^2 / (p + q)). Part ``pair`` sums this over all kept terms for each
other source of the language; part ``term`` lists the ten terms that are furthest
above the language as a whole.

Tiles: a group (lang, shard, i, j) holds the rows of two blocks of sources and one
shard of terms, so neither many sources nor many terms outgrow a task; every count
is summed before it is sent on, so a frequent word, source or language is as many
rows as there are terms.

Defined results: null text, lang and source are read as ''; a text without terms
adds its group only; a text is read whole, however long; repeated rows count each;
ties go to the smaller item in UTF-8 order; an empty table gives no rows; a source
that is alone in its language has no pairs; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.joins import checked_broadcast
from caseflow.llm.common import small_batches, written

SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
TOP_TERMS = 10
SCALE_STEPS = 3             # of a factor 1000 each: 10^9
HELD_ROWS = 400_000         # partial counts that a task holds before it sends them on
SHARD_ROWS = 50_000         # counts of a shard, about
BLOCK_SOURCES = 128         # sources of a block, about
MATRIX_CELLS = 1_000_000    # cells of a tile that are compared at once

_PARTIAL = "lang string, source string, term string, n long, docs long"


def batch_counts(batch):
    """lang, source, term, n, docs of one Arrow batch (lang, source, text); each group
    also has a row without a term that holds its documents."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lang, source = (pc.dictionary_encode(pc.fill_null(batch.column(c), "")) for c in ("lang", "source"))
    width = len(source.dictionary)
    group = pc.add(pc.multiply(lang.indices.cast(pa.int64()), width), source.indices.cast(pa.int64()))
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), pattern=SEPARATORS)
    term = pc.dictionary_encode(pc.list_flatten(lists))
    words = pa.table({"doc": pc.list_parent_indices(lists), "term": term.indices})
    blank = pc.index(term.dictionary, "").as_py()
    if blank >= 0:
        words = words.filter(pc.not_equal(words["term"], blank))
    per_doc = words.group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
    per_doc = per_doc.append_column("group", pc.take(group, per_doc["doc"]))
    counts = (per_doc.group_by(["group", "term"], use_threads=False)
              .aggregate([("count_all", "sum"), ("count_all", "count")]))
    own = pa.table({"group": group}).group_by("group", use_threads=False).aggregate([([], "count_all")])
    at = pa.concat_arrays([c for x in (counts["group"], own["group"]) for c in x.chunks])
    blanks = own.num_rows
    return pa.table({
        "lang": pc.take(lang.dictionary, pc.divide(at, width)),
        "source": pc.take(source.dictionary, pc.subtract(at, pc.multiply(pc.divide(at, width), width))),
        "term": pa.chunked_array([*pc.take(term.dictionary, counts["term"]).chunks, pa.nulls(blanks, pa.string())],
                                 pa.string()).combine_chunks(),
        "n": pa.chunked_array([*counts["count_all_sum"].chunks, pa.array([0] * blanks, pa.int64())]).combine_chunks(),
        "docs": pa.chunked_array([*counts["count_all_count"].chunks, *own["count_all"].chunks]).combine_chunks()})


def partial_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: what each task counted, added up within the task."""

    def run(batches):
        import pyarrow as pa

        def added(tables):
            t = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False)
            t = t.aggregate([("n", "sum"), ("docs", "sum")])
            return t.rename_columns(["lang", "source", "term", "n", "docs"])

        held, rows = [], 0
        for b in small_batches(batches, "text"):
            held.append(batch_counts(b))
            rows += held[-1].num_rows
            if rows > HELD_ROWS:
                held = [added(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held[0].to_batches(max_chunksize=10_000)
                    held, rows = [], 0
        if held:
            yield from added(held).to_batches(max_chunksize=10_000)

    return docs.select("lang", "source", "text").mapInArrow(run, _PARTIAL)


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, lang_n, first: counts of the kept terms, and a row
    without a term for each group. ``first`` is 1 on one row of each (lang, term)."""
    merged = (partial_counts(docs).groupBy("lang", "source", "term")
              .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    by_term = Window.partitionBy("lang", "term")
    return (merged.select("*", F.sum("docs").over(by_term).alias("lang_docs"), F.sum("n").over(by_term).alias("lang_n"),
                          F.row_number().over(by_term.orderBy("source")).alias("at"))
            .where(F.col("term").isNull() | (F.col("lang_docs") >= min_docs))
            .select("lang", "source", "term", "n", "lang_n",
                    (F.col("term").isNotNull() & (F.col("at") == 1)).cast("long").alias("first")))


def scaled(n, total):
    """1 + floor(10^9 * n / total) of integer arrays, by long division: no product
    outgrows 64 bits while ``total`` is below 9 * 10^15."""
    out, rest = n // total, n % total
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def apart(p, q):
    return (p - q) * (p - q) // (p + q)


def tile_rows(counts, sources):
    """lang, source, part, item, value of one tile: ``counts`` (source, term, n,
    lang_n) against ``sources`` (lang, source, shard, block, i, j, total, v, lang_total).

    A term that no source of the tile holds has no row here, yet parts two sources of
    different size: every pair counts as if it had none of the V terms (in the first
    shard), and the terms seen add their difference to that."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lang, shard, i, j = (sources.column(c)[0].as_py() for c in ("lang", "shard", "i", "j"))
    names = sources.column("source").combine_chunks()
    block, total = (sources.column(c).to_numpy() for c in ("block", "total"))
    v, lang_total = (sources.column(c)[0].as_py() for c in ("v", "lang_total"))
    whole = total + 2 * v
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    none = scaled(np.full(len(whole), 2), np.maximum(whole, 1))
    unseen = apart(none[left][:, None], none[right][None, :])
    sums = unseen * (v if shard == 0 else 0)
    out = []
    if counts.num_rows:
        at = pc.index_in(counts.column("source"), value_set=names).to_numpy()
        term = pc.dictionary_encode(counts.column("term").combine_chunks())
        code = term.indices.to_numpy()
        n = counts.column("n").to_numpy()
        p = scaled(n + 2, whole[at])
        sums -= unseen * len(term.dictionary)
        step = max(1, MATRIX_CELLS // len(whole))
        order = np.argsort(code, kind="stable")
        ends = np.searchsorted(code[order], np.arange(0, len(term.dictionary) + step, step))
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            width = min(step, len(term.dictionary) - k * step)
            pick = order[a:b]
            cells = np.repeat(none[:, None], width, axis=1)
            cells[at[pick], code[pick] - k * step] = p[pick]
            for x, s in enumerate(left):
                sums[x] += apart(cells[s], cells[right]).sum(axis=1)
        if i == j:
            q = scaled(counts.column("lang_n").to_numpy() + 2, np.int64(lang_total + 2 * v))
            over = np.flatnonzero(p > q)
            best = pa.table({"at": at[over], "value": -apart(p[over], q[over]),
                             "term": pc.take(counts.column("term").combine_chunks(), pa.array(over))})
            best = best.sort_by([("at", "ascending"), ("value", "ascending"), ("term", "ascending")])
            own = best.column("at").to_numpy()
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
            rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
            best = best.filter(pa.array(rank < TOP_TERMS))
            out.append(("term", pc.take(names, best.column("at")), best.column("term"), pc.negate(best.column("value"))))
    a, b = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    pair = np.flatnonzero(a < b) if i == j else np.arange(len(a))
    value = pa.array(sums.ravel()[pair])
    for x, y in ((a, b), (b, a)):
        out.append(("pair", names.take(pa.array(x[pair])), names.take(pa.array(y[pair])), value))
    return pa.concat_tables([pa.table({
        "lang": pa.array([lang] * len(value), pa.string()), "source": source, "part": pa.array([part] * len(value), pa.string()),
        "item": item, "value": value}) for part, source, item, value in out])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (lang, source, text)."""
    kept = written(kept_counts(docs, min_docs))
    groups = written(kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("first"),
                                                        F.count("term").alias("terms")))
    langs = written(groups.groupBy("lang").agg(
        F.sum("first").alias("v"), F.sum("total").alias("lang_total"),
        F.greatest(F.ceil(F.sum("terms") / SHARD_ROWS), F.lit(1)).alias("shards"),
        F.ceil(F.count("lang") / BLOCK_SOURCES).alias("blocks")))
    small = checked_broadcast(langs)
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tile = (F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    counts = (kept.where(F.col("term").isNotNull()).join(small, "lang")
              .select("lang", "source", "term", "n", "lang_n", block, F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"),
                      other)
              .select("lang", "source", "term", "n", "lang_n", "shard", *tile))
    sources = (groups.join(small, "lang")
               .select("lang", "source", "total", "v", "lang_total", "shards", block, other)
               .select("lang", "source", "total", "v", "lang_total", "block", *tile,
                       F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")))
    key = ("lang", "shard", "i", "j")
    parts = (counts.groupBy(*key).cogroup(sources.groupBy(*key))
             .applyInArrow(tile_rows, "lang string, source string, part string, item string, value long"))
    ranked = (parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part")
                                                      .orderBy(F.desc("value"), F.asc("item")))))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))


_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_P = "CAST(1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * v.v) AS BIGINT)"
_F = "((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)"
ORACLE = rf"""WITH d AS (SELECT coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, lang, source,
  unnest(regexp_extract_all(translate(t, '{_UP}', '{_UP.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY w.lang, source, w.term),
gn AS (SELECT grp.lang, grp.source, coalesce(sum(c.n), 0) AS n FROM grp LEFT JOIN c USING (lang, source)
  GROUP BY grp.lang, grp.source),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, {_P.format(n="coalesce(c.n, 0)", total="gn.n")} AS p
  FROM gn JOIN v USING (lang) JOIN kept USING (lang)
  LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
q AS (SELECT kept.lang, kept.term, {_P.format(n="kept.n", total="v.n")} AS p FROM kept JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum({_F}) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT a.lang, a.source, 'term', a.term, {_F} FROM p a JOIN q b ON a.lang = b.lang AND a.term = b.term
  WHERE a.n > 0 AND a.p > b.p)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item) ASC) AS rank FROM parts)
WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
