"""Exact dedup: group by a 128-bit content hash, keep the row with the largest
id, and compare bytes inside groups to exclude collisions.

Only DataFrame functions. No text of a document without a copy is moved: pass
one aggregates (hash, id) with map-side combine and writes the groups of two or
more; pass two joins them back to the scan. The table of groups is broadcast
when its counted size is within ``broadcast_groups``, else it is joined on
(hash, salt), each group repeated once per salt, so that a group with a third of
all rows spreads over ``salts`` partitions.

Bytes are compared by the smallest and largest text of each group, an
aggregate that combines before its shuffle: copies of a hot group meet as one
text per map task. Groups where they differ hold a hash collision and are
split by (hash, text).

Defined results: null text counts as empty, so null and empty are copies of
each other; a null id counts as smaller than any other and such a row stays
only if all ids of its group are null; rows with equal id and equal text get the
same verdict, and ``keep_one`` leaves one of them, with or without an id; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.joins import checked_broadcast
from caseflow.llm.common import lower_ascii, one_row, written

BROADCAST_GROUPS = 500_000   # 24 bytes each: 12 MB at most
SALTS = 32

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalise(c: Column) -> Column:
    """Null as empty, A-Z lower-cased, all else untouched."""
    return lower_ascii(F.coalesce(c, F.lit("")))


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _verdicts(docs: DataFrame, id_col: str, text_col: str, hash_of, broadcast_groups: int, salts: int) -> DataFrame:
    """row (the input row as a struct), id, norm, keep_id, group_size per input row."""
    hashed = (docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
              .select("row", F.col(f"row.`{id_col}`").alias("id"), normalise(F.col(f"row.`{text_col}`")).alias("norm"))
              .withColumn("h", hash_of(F.col("norm"))))

    multi = written(hashed.groupBy("h").agg(F.max("id").alias("m_keep"), F.count(F.lit(1)).alias("m_size"))
                    .filter("m_size > 1"))
    small = multi.limit(broadcast_groups + 1).count() <= broadcast_groups

    def with_groups(left: DataFrame, groups: DataFrame, how: str) -> DataFrame:
        if small:
            return left.join(F.broadcast(groups), "h", how)
        s = left.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        g = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        return s.join(g, ["h", "salt"], how).drop("salt")

    texts = hashed.drop("row", "id") if small else hashed.drop("row")
    clash = written(with_groups(texts, multi.select("h"), "inner").groupBy("h")
                    .agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).filter("lo <> hi").select("h"))
    fixed = None
    if clash.take(1):   # one hash, two texts: those groups go by (hash, text)
        fixed = (with_groups(hashed.drop("row"), clash, "inner").groupBy("h", "norm")
                 .agg(F.max("id").alias("c_keep"), F.count(F.lit(1)).alias("c_size")))
        multi = multi.join(clash, "h", "left_anti")
    out = with_groups(hashed, multi, "left")
    if fixed is not None:
        out = (out.join(fixed, ["h", "norm"], "left").withColumn("m_keep", F.coalesce("c_keep", "m_keep"))
               .withColumn("m_size", F.coalesce("c_size", "m_size")))
    return out.select("row", "id", "norm",
                      F.when(F.col("m_size").isNull(), F.col("id")).otherwise(F.col("m_keep")).alias("keep_id"),
                      F.coalesce("m_size", F.lit(1)).cast("long").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash,
                broadcast_groups: int = BROADCAST_GROUPS, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    v = _verdicts(docs.select(id_col, text_col), id_col, text_col, hash_of, broadcast_groups, salts)
    return v.select(F.col("id").alias("doc_id"), "keep_id", "group_size",
                    F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.sha2("norm", 256).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash,
             broadcast_groups: int = BROADCAST_GROUPS, salts: int = SALTS) -> DataFrame:
    """One row of each group, all columns: of the rows with its largest id the one with
    the smallest hash of its columns, so rows that repeat whole leave one."""
    v = _verdicts(docs, id_col, text_col, hash_of, broadcast_groups, salts)
    stays = v.filter(F.col("id").eqNullSafe(F.col("keep_id"))).withColumn("sum", F.sha2("norm", 256))
    # groups whose largest id stands in several rows; the other rows stay where they are
    many = written(stays.filter("group_size > 1").groupBy(F.col("sum").alias("many_sum"))
                   .agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("many_sum"))
    if not many.take(1):
        return stays.select("row.*")
    again, few = F.col("sum") == F.col("many_sum"), checked_broadcast(many)
    repeated = stays.join(few, again, "left_semi").select("row.*")
    return (stays.join(few, again, "left_anti").select("row.*")
            .unionByName(one_row(repeated, F.sha2(normalise(F.col(f"`{text_col}`")), 256))))


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
