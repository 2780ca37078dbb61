"""N-gram Jaccard self-join by MinHash banding.

1. One pass over the texts gives every document the 128-bit hash of its word
   sequence (its node: copies are one node from here on) and its band hashes.
   Rows per band and number of bands follow from the threshold and the target
   recall.
2. Band hashes are shuffled. A bucket is a band hash that two or more nodes
   share; of buckets with the same members one is kept.
3. Texts of the nodes in kept buckets, one per node, go to tiles: a bucket of up
   to ``tile`` nodes is one tile, a larger one is cut into blocks and each pair
   of blocks is a tile, so no task holds a large bucket. A tile checks its pairs
   on their full n-gram sets. A pair that shares several buckets is checked in
   the first of them only. A tile returns per node its number of linked documents
   and its root in a spanning forest of the tile's links, never pairs.
4. Classes are the connected components of the links, by label propagation with
   pointer jumping, on the linked nodes alone.

Words are maximal runs of letters, digits and underscores, lower-cased; n-grams
are sets of ``n`` consecutive words; a shorter text is one n-gram of all its words.

Defined results: texts without words (null, empty) are copies of each other and
link to nothing else; copies count as links; very long texts are compared whole;
rows with a null id take part like others and have a null class_id only if all
ids of their class are null; ids that repeat get the result of their own text;
an empty table gives an empty result; extra columns are not read by ``join`` and
kept by ``keep_one``.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import one_row, small_batches, worker_cache, written

N = 5
THRESHOLD = 0.8
RECALL = 0.9995      # chance that a pair just at the threshold shares a bucket
MAX_HASHES = 128
TILE = 256
MANY_SHARE = 1e-3       # of all documents that share a text
BROADCAST_ROWS = 200_000   # rows of three short columns, under 100 bytes each
REMEMBERED = 150_000

_WORDS = re.compile(r"\w+")


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands still reach the recall."""
    best = None
    for rows in range(1, max_hashes + 1):
        hit = threshold ** rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows > max_hashes:
            break
        best = bands, rows
    return best or (max_hashes, 1)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def ngrams_of(words: list[str], n: int = N) -> set:
    if not words:
        return set()
    if len(words) <= n:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(n))))


class Signer:
    """Node hash and band hashes of a text; word hashes are remembered per worker."""

    def __init__(self, n: int, bands: int, rows: int):
        import numpy as np

        r = np.random.default_rng(20240229)
        self.n, self.bands, self.rows = n, bands, rows
        self.at = r.integers(0, 2**64, n, dtype="uint64") | np.uint64(1)
        self.mul = r.integers(0, 2**64, bands * rows, dtype="uint64") | np.uint64(1)
        self.add = r.integers(0, 2**64, bands * rows, dtype="uint64")
        self.fold = r.integers(0, 2**64, (bands, rows), dtype="uint64") | np.uint64(1)
        self.known = worker_cache("word hashes")

    def _hashes(self, words):
        import numpy as np
        from xxhash import xxh3_64_intdigest
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), "uint64", len(words))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), "uint64", len(words))

    @staticmethod
    def _mix(h):
        import numpy as np
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h

    def sign(self, text):
        """(node hash, band hashes as little-endian 64-bit integers)."""
        import hashlib

        import numpy as np
        words = words_of(text)
        node = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if not words:
            return node, b""
        w = self._hashes(words)
        k = max(1, len(w) - self.n + 1)
        h = np.zeros(k, "uint64")
        for i in range(min(self.n, len(w))):
            h += w[i:i + k] * self.at[i]
        h = self._mix(h)
        low = np.full(len(self.mul), 2**64 - 1, "uint64")
        for s in range(0, k, 512):
            low = np.minimum(low, (h[s:s + 512, None] * self.mul + self.add).min(0))
        b = (low.reshape(self.bands, self.rows) * self.fold).sum(1, dtype="uint64")
        b = self._mix(b + np.arange(self.bands, dtype="uint64"))
        return node, b.astype("<u8").tobytes()


def signed(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, sum (of the raw text), node, bands; written."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("sum"),
                      F.col(text_col).alias("text"))
    schema = T.StructType([src.schema["doc_id"], src.schema["sum"], T.StructField("node", T.BinaryType()),
                           T.StructField("bands", T.BinaryType())])

    def run(batches):
        import pyarrow as pa
        signer = Signer(n, bands, rows)
        for b in small_batches(batches, "text"):
            got = [signer.sign(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("sum"), pa.array([g[0] for g in got], pa.binary()),
                 pa.array([g[1] for g in got], pa.binary())], names=schema.names)

    return written(src.mapInArrow(run, schema))


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if it has few rows (counted; ``df`` is a written table)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _buckets(nodes: DataFrame, bands: int) -> DataFrame:
    """node, bucket, size: memberships of the kept buckets; written."""
    part = F.expr("transform(sequence(0, int(octet_length(bands) / 8) - 1), i -> substring(bands, i * 8 + 1, 8))")
    entry = nodes.filter("octet_length(bands) > 0").select("node", F.explode(part).alias("bucket"))
    size = (entry.groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node") % F.lit(1 << 40)).alias("s1"),
                 F.sum(F.xxhash64(F.lit(7), "node") % F.lit(1 << 40)).alias("s2"))
            .filter("size > 1"))
    kept = written(size.groupBy("size", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "size"))
    return written(entry.join(_small(kept), "bucket"))


def _tiles(members: DataFrame, tile: int) -> DataFrame:
    """Each membership once per tile it takes part in: bucket, a, b, block."""
    blocks = F.ceil(F.col("size") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    m = members.withColumn("blocks", blocks).withColumn("block", own)
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return m.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other"))


_TILE_OUT = "node binary, links long, root binary"


def _check_tile(n: int, threshold: float):
    def check(t):
        import pyarrow as pa

        seen, rows = set(), []
        for r in t.select(["node", "count", "block", "a", "b", "bucket", "buckets", "text"]).to_pylist():
            if r["node"] not in seen:
                seen.add(r["node"])
                rows.append(r)
        ids: dict = {}
        for r in rows:
            r["set"] = {ids.setdefault(g, len(ids)) for g in ngrams_of(words_of(r["text"]), n)}
            r["text"] = None
            r["buckets"] = set(r["buckets"])
        rows.sort(key=lambda r: len(r["set"]))
        root = list(range(len(rows)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        links = [0] * len(rows)
        for j, y in enumerate(rows):
            need = threshold * len(y["set"])
            for i in range(j - 1, -1, -1):
                x = rows[i]
                if len(x["set"]) < need:   # so are all before it
                    break
                # two blocks meet in one tile; inside one block pairs are the tile (a, a)'s
                if x["a"] != x["b"] and x["block"] == y["block"]:
                    continue
                both = len(x["set"] & y["set"])
                if both < threshold * (len(x["set"]) + len(y["set"]) - both):
                    continue
                if min(x["buckets"] & y["buckets"]) != x["bucket"]:
                    continue
                links[i] += y["count"]
                links[j] += x["count"]
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
        got = [i for i, l in enumerate(links) if l]
        return pa.table({"node": pa.array([rows[i]["node"] for i in got], pa.binary()),
                         "links": pa.array([links[i] for i in got], pa.int64()),
                         "root": pa.array([rows[find(i)]["node"] for i in got], pa.binary())})
    return check


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for (node, root) edges: every
    round takes the smallest label of the neighbours and jumps to that label's label."""
    both = written(edges.select("node", F.col("root").alias("to"))
                   .unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("to"))).distinct())
    label = written(both.groupBy("node").agg(F.min("to").alias("m"))
                    .select("node", F.least("node", "m").alias("label")))
    while True:
        near = (both.join(label.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("label").alias("m")))
        step = label.join(near, "node").select("node", "label", F.least("label", "m").alias("next"))
        jump = label.select(F.col("node").alias("next"), F.col("label").alias("over"))
        new = written(step.join(jump, "next").select("node", "label", F.least("next", "over").alias("next")))
        if not new.filter("label <> next").take(1):
            return label
        label = new.select("node", F.col("next").alias("label"))


def _classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL,
             id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, sum, first (id and sum of its class's smallest
    id, then sum; null ids last), n_links, class_size."""
    bands, rows = bands_for(threshold, recall)
    marks = signed(docs, n, bands, rows, id_col, text_col)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sum")
    nodes = written(marks.groupBy("node").agg(F.count(F.lit(1)).alias("count"), F.min(row).alias("first"),
                                              F.max("bands").alias("bands")))
    members = _buckets(nodes.select("node", "bands"), bands)
    own = members.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))   # at most one per band
    wanted = written(nodes.join(own, "node").select("node", "count", "buckets", F.col("first.doc_id").alias("id"),
                                                    F.col("first.sum").alias("sum")))
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("sum"))
    few = _small(wanted.select("node", "id", "sum"))
    texts = written(text.join(few, (text["sum"] == few["sum"]) & text["doc_id"].eqNullSafe(few["id"]))
                    .select("node", "text"))
    tiles = _tiles(members, tile).join(wanted.select("node", "count", "buckets"), "node").join(texts, "node")
    found = written(tiles.select("bucket", "a", "b", "block", "node", "count", "buckets", "text")
                    .groupBy("bucket", "a", "b").applyInArrow(_check_tile(n, threshold), _TILE_OUT))
    label = components(found.filter("node <> root"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = nodes.select("node", "first", "count").join(links, "node").join(label, "node")
    classes = linked.groupBy("label").agg(F.min("first").alias("c_first"), F.sum("count").alias("class_size"))
    linked = linked.select("node", "links", "label").join(classes, "label").drop("label")
    per_node = written(nodes.select("node", "first", "count").join(linked, "node", "left").select(
        "node", F.coalesce("c_first", "first").alias("first"),
        (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"),
        F.coalesce("class_size", "count").alias("class_size"), "count"))
    # texts that many documents share, fewer than 1 / MANY_SHARE of them, go by broadcast
    often = F.col("count") > F.lit(MANY_SHARE * (per_node.agg(F.sum("count")).first()[0] or 0))
    few = marks.select("doc_id", "sum", "node").join(F.broadcast(per_node.filter(often)), "node", "left")
    rest = few.filter(F.col("first").isNull()).select("doc_id", "sum", "node").join(per_node.filter(~often), "node")
    return few.filter(F.col("first").isNotNull()).unionByName(rest).drop("node", "count")


def join(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), n_links
    (other documents at the threshold or above), class_size."""
    return _classes(docs, **options).select("doc_id", F.col("first.doc_id").alias("class_id"), "n_links", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, all columns: that with id and text of the first of the
    class (smallest id, then smallest md5 of the text; null ids last); of rows that
    repeat these, the one with the smallest hash of its columns."""
    marks = written(_classes(docs, id_col=id_col, text_col=text_col, **options)
                    .select("doc_id", "sum", "first", "class_size"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sum") == F.col("first.sum"))
    gone = written(marks.filter(~stays).select(F.col("doc_id").alias("gone_id"), F.col("sum").alias("gone_sum"))
                   .distinct())
    many = written(marks.filter(stays & (F.col("class_size") > 1))
                   .groupBy(F.col("doc_id").alias("many_id"), F.col("sum").alias("many_sum"))
                   .agg(F.count(F.lit(1)).alias("many_n")).filter("many_n > 1").select("many_id", "many_sum"))
    of = F.md5(F.coalesce(docs[text_col], F.lit("")))
    kept = docs.join(_small(gone), docs[id_col].eqNullSafe(gone["gone_id"]) & (of == gone["gone_sum"]), "left_anti")
    if not many.take(1):
        return kept
    few, copies = _small(many), docs[id_col].eqNullSafe(many["many_id"]) & (of == many["many_sum"])
    repeated = docs.join(few, copies, "left_semi")
    return kept.join(few, copies, "left_anti").unionByName(one_row(repeated, F.struct(docs[id_col], of)))


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {N - 1}], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE c >= {THRESHOLD} * (x.n + y.n - c)
         UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON len(x.w) = 0 AND len(y.w) = 0 AND x.doc_id <> y.doc_id),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
cls AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM reach GROUP BY a)
SELECT doc_id, class_id, coalesce(k.n, 0) AS n_links, class_size
FROM cls LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM link GROUP BY a) k USING (doc_id)
"""
