"""Suffix-array dedup: bytes covered by a string of ``min_len`` bytes that also
starts in a document with a smaller id are removed.

The suffixes of all texts are far more than can be shuffled, so buckets of
suffixes are formed by content. The *key* of a window of ``min_len`` bytes is
the smallest hash of its ``K``-byte substrings; equal windows have equal keys,
and neighbours mostly share theirs (a *run*).

1. Documents are dealt into blocks by a hash of the id (the only shuffle of
   texts). Each block sends its distinct keys with their number of documents.
2. Keys met in two or more documents go back to their blocks, marked hot if in
   more than ``HOT_DOCS`` documents. All other windows are unique.
3. Blocks send their runs with such keys, distinct contents once, to suffix
   buckets by key; windows of hot keys go one by one by a hash of their content,
   each content once per block with its smallest id, so no bucket gathers a row
   per document of a passage that a third of them share.
4. A bucket sorts its suffixes with a difference cover, one slice after another
   (see ``suffix_sort``), finds the smallest id of each class of equal windows
   and sends the windows with a larger id back as intervals.
5. Blocks cut the covered bytes out.

Defined results: null text is empty; texts shorter than ``min_len`` bytes are
never touched; texts of any length are treated whole; documents with equal ids
(repeated rows) do not remove from each other; a row with a null id counts as
larger than all others; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_LEN = 50
K = 24                        # three 8-byte words
BLOCK_BYTES = 6 << 20         # texts of a block
KEY_BUCKET_BYTES = 24 << 20   # keys of a key bucket
SORT_BYTES = 2 << 20          # texts per suffix bucket
KEY_BITS = 48                 # of a key that travel; a clash costs a needless look, nothing else
SLICE = 400_000               # windows that a task sorts at a time
HOT_DOCS = 2_000
LONG_RUN = 256                # windows of a run that travel as one piece
CHUNK = 1 << 20

_NULL_ID = 2**63 - 1


class Block:
    """The texts of a block, in a fixed order, as one byte array."""

    def __init__(self, table, min_len: int):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.combine_chunks()
        order = pc.sort_indices(table.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
        table = table.take(order)
        self.doc_id = table.column("doc_id")
        self.id = pc.fill_null(self.doc_id, _NULL_ID).to_numpy().astype("int64")
        text = pa.concat_arrays(pc.fill_null(table.column("text").cast(pa.large_binary()), b"").chunks) \
            if table.num_rows else pa.array([], pa.large_binary())
        at = np.frombuffer(text.buffers()[1], "int64")[text.offset:text.offset + len(text) + 1] if len(text) else np.zeros(1, "int64")
        data = text.buffers()[2] if len(text) else None
        self.data = (np.frombuffer(data, "uint8")[at[0]:at[-1]] if data is not None and data.size
                     else np.zeros(0, "uint8"))
        self.at = at - at[0]
        self.min_len = min_len

    def __len__(self):
        return len(self.id)

    def runs(self):
        """(start, end, key) of the maximal stretches of windows with one key."""
        import numpy as np

        n, length = len(self.data), self.min_len
        wide = length - K + 1
        # windows that stay inside their document
        mark = np.zeros(n + 2, "int8")
        lo, hi = self.at[:-1], self.at[1:] - length + 1
        ok = hi > lo
        mark[lo[ok]] = 1
        mark[hi[ok]] = -1
        valid = np.cumsum(mark[:n], dtype="int8") > 0
        out = []
        for c in range(0, n, CHUNK):
            e = min(n, c + CHUNK)
            good = valid[c:e]
            if not good.any():
                continue
            seg = self.data[c:e + length + 8]
            pad = np.concatenate([seg, np.zeros(length + 16 - max(0, len(seg) - (e - c)), "uint8")])
            w = np.ndarray((len(pad) - 7,), "<u8", pad.tobytes(), strides=(1,)).astype("u8")
            m = (e - c) + wide - 1
            h = w[:m] * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h += w[8:8 + m]
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            h += w[16:16 + m]
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            size = 1
            while 2 * size <= wide:
                h = np.minimum(h[:-size], h[size:])
                size *= 2
            if size < wide:
                h = np.minimum(h[:len(h) - (wide - size)], h[wide - size:])
            h = h[:e - c]
            first = good.copy()
            first[1:] &= ~good[:-1] | (h[1:] != h[:-1])
            last = good.copy()
            last[:-1] &= ~good[1:] | (h[1:] != h[:-1])
            s = np.flatnonzero(first)
            out.append((s + c, np.flatnonzero(last) + c + 1, _spread(h[s])))
        if not out:
            z = np.zeros(0, "int64")
            return z, z, np.zeros(0, "u8")
        return tuple(np.concatenate(x) for x in zip(*out))

    def rows_of(self, pos):
        import numpy as np
        return np.searchsorted(self.at, pos, side="right") - 1


def _ranges(start, count):
    """Concatenated ranges [start, start + count)."""
    import numpy as np
    total = int(count.sum())
    if not total:
        return np.zeros(0, "int64")
    step = np.ones(total, "int64")
    first = np.cumsum(count) - count
    some = count > 0
    step[first[some]] = start[some] - np.concatenate([[0], (start + count - 1)[some][:-1]])
    return np.cumsum(step)


def _spread(h):
    """Hashes as evenly spread keys (they are minima, so their high bits are alike)."""
    import numpy as np
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h >> np.uint64(64 - KEY_BITS)


def _bucket(key, buckets: int):
    """Range bucket of a key."""
    import numpy as np
    return (key.astype("float64") * (buckets / 2.0**KEY_BITS)).astype("int64").clip(0, buckets - 1)


def _pack(a, rising: bool = False) -> bytes:
    """An integer array, small: byte planes (of the differences, if ``rising``), zstd."""
    import numpy as np
    import zstandard
    a = np.ascontiguousarray(a)
    if rising and len(a):
        a = np.concatenate([a[:1], a[1:] - a[:-1]])
    return zstandard.compress(a.view("u1").reshape(len(a), a.itemsize).T.tobytes(), 1)


def _unpack(b: bytes, dtype: str, rising: bool = False):
    import numpy as np
    import zstandard
    raw = np.frombuffer(zstandard.decompress(b), "u1")
    size = np.dtype(dtype).itemsize
    a = np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(dtype).reshape(-1)
    return np.cumsum(a, dtype=dtype) if rising else a


def _join_up(col, dtype: str, rising: bool = False):
    """The unpacked arrays of a column in a row, and their lengths."""
    import numpy as np
    parts = [_unpack(x, dtype, rising) for x in col.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(p) for p in parts], "int64")


# -- 1 and 2: keys

_KEYS = "bucket int, block long, keys binary, docs binary"
_SHARED = "block long, keys binary, hot binary"


def _send_keys(t, *, buckets: int, min_len: int):
    import numpy as np
    import pyarrow as pa

    block = t.column("block")[0].as_py()
    b = Block(t, min_len)
    start, _, key = b.runs()
    o = np.argsort(key, kind="stable")      # runs come in document order
    key, row = key[o], b.rows_of(start[o])
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    doc = new.copy()
    doc[1:] |= row[1:] != row[:-1]
    firsts = np.flatnonzero(new)
    docs = np.add.reduceat(doc.astype("u4"), firsts) if len(firsts) else np.zeros(0, "u4")
    key = key[firsts]
    to = _bucket(key, buckets)     # rising, as the keys are
    ends = np.flatnonzero(np.append(to[1:] != to[:-1], True)) + 1 if len(to) else []
    rows, a = [], 0
    for e in ends:
        rows.append((int(to[a]), block, _pack(key[a:e].astype("<u8"), True), _pack(docs[a:e].astype("<u4"))))
        a = e
    return _table(rows, [("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])


def _table(rows, fields):
    import pyarrow as pa
    cols = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table({n: pa.array(list(c), k) for c, (n, k) in zip(cols, fields)})


def _shared_keys(t, *, hot_docs: int):
    import numpy as np
    import pyarrow as pa

    key, n = _join_up(t.column("keys"), "<u8", True)
    docs, _ = _join_up(t.column("docs"), "<u4")
    o = np.argsort(key, kind="stable")
    k, d = key[o], docs[o].astype("int64")
    firsts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, "int64")
    total = np.add.reduceat(d, firsts) if len(firsts) else d
    of = np.empty(len(k), "int64")
    of[o] = np.repeat(total, np.diff(np.append(firsts, len(k))))
    rows, a = [], 0
    for block, m in zip(t.column("block").to_pylist(), n):
        own = of[a:a + m]
        hit = own > 1
        if hit.any():
            rows.append((block, _pack(key[a:a + m][hit], True), _pack((own[hit] > hot_docs).astype("u1"))))
        a += m
    return _table(rows, [("block", pa.int64()), ("keys", pa.binary()), ("hot", pa.binary())])


# -- 3: windows to suffix buckets

# Integer columns are packed arrays. data holds the bytes of all pieces in a row, zstd; a piece has ``many`` windows and
# ``many + min_len - 1`` bytes; place is its start in its block, least its smallest id.
# Rows with own = true carry intervals that the block has found itself.
_PIECES = "bucket int, block long, own boolean, data binary, many binary, place binary, least binary"
_CUTS = "block long, place binary, many binary"


def _send_windows(t, s, *, buckets: int, min_len: int):
    import numpy as np
    import pyarrow as pa
    from xxhash import xxh3_64_intdigest

    fields = [("bucket", pa.int32()), ("block", pa.int64()), ("own", pa.bool_()), ("data", pa.binary()),
              ("many", pa.binary()), ("place", pa.binary()), ("least", pa.binary())]
    if not t.num_rows or not s.num_rows:
        return _table([], fields)
    block = t.column("block")[0].as_py()
    b = Block(t, min_len)
    shared, _ = _join_up(s.column("keys"), "<u8", True)
    hot, _ = _join_up(s.column("hot"), "u1")
    o = np.argsort(shared)
    shared, hot = shared[o], hot[o]
    start, end, key = b.runs()
    j = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
    hit = shared[j] == key
    start, end, key, warm = start[hit], end[hit], key[hit], hot[j[hit]] > 0
    rows = []

    # hot keys: windows one by one, each content once, with its smallest id (rows
    # are in the order of ids, so the first is the smallest)
    pos = _ranges(start[warm], (end - start)[warm])
    if len(pos):
        raw, at, own = b.data.tobytes(), {}, []
        ids = b.id[b.rows_of(pos)]
        firsts = []
        for i, p in enumerate(pos.tolist()):
            f = at.setdefault(raw[p:p + min_len], i)
            if f == i or ids[f] == ids[i]:
                firsts.append(i)
            else:
                own.append(p)
        pos, ids = pos[firsts], ids[firsts]
        if own:
            rows.append((int(block % buckets), block, True, b"", _pack(np.ones(len(own), "<u4")),
                         _pack(np.array(own, "<i8"), True), b""))
        to = np.fromiter((xxh3_64_intdigest(raw[p:p + min_len]) % buckets for p in pos.tolist()), "int64", len(pos))
        rows += _pieces(b, block, to, pos, np.ones(len(pos), "int64"), ids, min_len)

    # other shared keys: runs, long ones cut
    start, end, key = start[~warm], end[~warm], key[~warm]
    if len(start):
        cuts = -(-(end - start) // LONG_RUN)
        nth = _ranges(np.zeros(len(cuts), "int64"), cuts)
        of = np.repeat(np.arange(len(cuts)), cuts)
        first = start[of] + nth * LONG_RUN
        many = np.minimum(end[of] - first, LONG_RUN)
        to = _bucket(key[of], buckets)
        rows += _pieces(b, block, to, first, many, b.id[b.rows_of(first)], min_len)
    return _table(rows, fields)


def _pieces(b, block, to, place, many, least, min_len):
    import numpy as np
    import zstandard

    o = np.argsort(to, kind="stable")
    to, place, many, least = to[o], place[o], many[o], least[o]
    ends = np.flatnonzero(np.append(to[1:] != to[:-1], True)) + 1 if len(to) else []
    out, a = [], 0
    for e in ends:
        data = zstandard.compress(b.data[_ranges(place[a:e], many[a:e] + min_len - 1)].tobytes(), 1)
        out.append((int(to[a]), block, False, data, _pack(many[a:e].astype("<u4")),
                    _pack(place[a:e].astype("<i8"), True), _pack(least[a:e].astype("<i8"), True)))
        a = e
    return out


# -- 4: one suffix bucket

def _sort_bucket(t, *, min_len: int, slice_windows: int):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import zstandard

    fields = [("block", pa.int64()), ("place", pa.binary()), ("many", pa.binary())]
    own = t.filter(t.column("own")).select(["block", "place", "many"])
    rows = [(r["block"], r["place"], r["many"]) for r in own.to_pylist()]
    t = t.filter(pc.invert(t.column("own")))
    if t.num_rows:
        many, n = _join_up(t.column("many"), "<u4")
        many = many.astype("int64")
        place, _ = _join_up(t.column("place"), "<i8", True)
        least, _ = _join_up(t.column("least"), "<i8", True)
        block = np.repeat(np.array(t.column("block").to_pylist(), "int64"), n)
        data = b"".join(map(zstandard.decompress, t.column("data").to_pylist()))
        size = many + min_len - 1
        stop = np.cumsum(size)
        # equal pieces are one, with the smallest id of them
        kind: dict = {}
        of = np.fromiter((kind.setdefault(data[e - s:e], len(kind)) for s, e in zip(size.tolist(), stop.tolist())),
                         "int64", len(size))
        low = np.full(len(kind), _NULL_ID, "int64")
        np.minimum.at(low, of, least)
        texts = list(kind)
        del data, kind
        floor = _smallest_ids(texts, low, min_len, slice_windows)
        # windows of the pieces whose class has a smaller id elsewhere
        width = np.array([len(x) - min_len + 1 for x in texts], "int64")
        begin = np.cumsum(width) - width
        w = floor[_ranges(begin[of], many)]
        gone = w < np.repeat(least, many)
        start = np.repeat(place, many) + _ranges(np.zeros(len(many), "int64"), many)
        piece = np.repeat(np.arange(len(many)), many)
        hit = np.flatnonzero(gone)
        if len(hit):
            new = np.ones(len(hit), bool)
            new[1:] = (np.diff(hit) > 1) | (np.diff(piece[hit]) > 0)
            f = np.flatnonzero(new)
            count = np.diff(np.append(f, len(hit)))
            p, blk = start[hit[f]], block[piece[hit[f]]]
            o = np.lexsort((p, blk))
            p, blk, count = p[o], blk[o], count[o]
            a = 0
            for e in np.flatnonzero(np.append(blk[1:] != blk[:-1], True)) + 1:
                rows.append((int(blk[a]), _pack(p[a:e].astype("<i8"), True), _pack(count[a:e].astype("<u4"))))
                a = e
    return _table(rows, fields)


def _smallest_ids(texts: list, low, min_len: int, slice_windows: int):
    """For each window of the texts in a row the smallest id of its class.

    Texts are sorted by the key of their windows' bucket slice: a slice takes whole
    groups of texts until it has ``slice_windows`` windows, so equal windows meet
    in one slice."""
    import numpy as np

    from caseflow.llm import suffix_sort

    width = np.array([len(x) - min_len + 1 for x in texts], "int64")
    begin = np.cumsum(width) - width
    floor = np.empty(int(width.sum()), "int64")
    if not len(texts):
        return floor
    key = _keys_of(texts, min_len)
    o = np.argsort(key, kind="stable")
    ends = np.flatnonzero(np.append(key[o][1:] != key[o][:-1], True)) + 1
    upto = np.cumsum(width[o])
    a = 0
    while a < len(o):
        done = int(upto[a - 1]) if a else 0
        i = int(np.searchsorted(upto[ends - 1], done + slice_windows, side="right")) - 1
        e = int(ends[i]) if i >= 0 and ends[i] > a else int(ends[np.searchsorted(ends, a, side="right")])
        own = o[a:e]
        data = np.frombuffer(b"".join([texts[x] for x in own]), "uint8")
        size = width[own] + min_len - 1
        pos = _ranges(np.cumsum(size) - size, width[own])
        c = suffix_sort.classes(data, pos, min_len, slice_windows)
        ids = np.repeat(low[own], width[own])
        best = np.full(int(c.max()) + 1, _NULL_ID, "int64")
        np.minimum.at(best, c, ids)
        floor[_ranges(begin[own], width[own])] = best[c]
        a = e
    return floor


def _keys_of(texts: list, min_len: int):
    """The key that all windows of a piece share, from its first window."""
    import numpy as np
    import pyarrow as pa

    t = pa.table({"doc_id": pa.array(np.arange(len(texts))), "text": pa.array([x[:min_len] for x in texts], pa.binary())})
    return Block(t, min_len).runs()[2] if len(texts) < 2 else _first_keys(Block(t, min_len), len(texts))


def _first_keys(b: Block, n: int):
    import numpy as np
    start, _, key = b.runs()
    out = np.zeros(n, "u8")
    out[b.rows_of(start)] = key
    return out


# -- 5: cutting

def _cut(t, c, *, min_len: int, id_type):
    import hashlib

    import numpy as np
    import pyarrow as pa

    b = Block(t, min_len) if t.num_rows else None
    n = len(b) if b else 0
    size = np.diff(b.at) if n else np.zeros(0, "int64")
    mark = np.zeros((len(b.data) if b else 0) + 1, "int32")
    place, _ = _join_up(c.column("place"), "<i8", True)
    many, _ = _join_up(c.column("many"), "<u4")
    if n and len(place):
        np.add.at(mark, place, 1)
        np.add.at(mark, place + many.astype("int64") + min_len - 1, -1)
    gone = np.cumsum(mark[:-1], dtype="int32") > 0
    touched = np.zeros(n, bool)
    if len(place):
        touched[b.rows_of(place)] = True
    removed, spans, sha = np.zeros(n, "int64"), np.zeros(n, "int64"), []
    for i in range(n):
        x = b.data[b.at[i]:b.at[i + 1]]
        if touched[i]:
            g = gone[b.at[i]:b.at[i + 1]]
            removed[i] = g.sum()
            spans[i] = int(g[0]) + int((g[1:] & ~g[:-1]).sum())
            x = x[~g]
        sha.append(hashlib.sha256(x.tobytes()).hexdigest())
    return pa.table({"doc_id": b.doc_id if n else pa.array([], id_type), "n_bytes": pa.array(size, pa.int64()),
                     "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept_sha256": pa.array(sha, pa.string())})


def _bound(f, **options):
    """``f`` as a function of its tables alone (Spark looks at the number of arguments)."""
    g = functools.partial(f, **options)
    return (lambda t, s: g(t, s)) if f in (_send_windows, _cut) else (lambda t: g(t))


def dedup(docs: DataFrame, min_len: int = MIN_LEN, id_col: str = "doc_id", text_col: str = "text",
          block_bytes: int = BLOCK_BYTES, hot_docs: int = HOT_DOCS, slice_windows: int = SLICE) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    import pyarrow as pa

    if min_len < K:
        raise ValueError(f"min_len must be at least {K}")
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, math.ceil(total / block_bytes))
    # a block sends a distinct key for every (min_len - K) / 2 + 1 bytes or so, 12 bytes each
    key_buckets = max(parts, math.ceil(total * 12 / ((min_len - K) / 2 + 1) / KEY_BUCKET_BYTES))
    sort_buckets = max(2 * parts, math.ceil(total / SORT_BYTES))

    # by text too: documents without an id, or with one id, spread like all others
    src = src.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    keys = src.groupBy("block").applyInArrow(_bound(_send_keys, buckets=key_buckets, min_len=min_len), _KEYS)
    shared = keys.groupBy("bucket").applyInArrow(_bound(_shared_keys, hot_docs=hot_docs), _SHARED)
    pieces = src.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        _bound(_send_windows, buckets=sort_buckets, min_len=min_len), _PIECES)
    cuts = pieces.groupBy("bucket").applyInArrow(
        _bound(_sort_bucket, min_len=min_len, slice_windows=slice_windows), _CUTS)
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
                        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                        T.StructField("kept_sha256", T.StringType())])
    return src.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(
        _bound(_cut, min_len=min_len, id_type=pa.int64()), out)


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, length(x) // 2 AS n_bytes FROM d),
pos AS (SELECT doc_id, x, unnest(range(0, n_bytes)) AS p FROM n),
win AS (SELECT doc_id, p, substr(x, 2 * p + 1, 2) AS byte, n_bytes - p >= {MIN_LEN} AS whole,
        substr(x, 2 * p + 1, {2 * MIN_LEN}) AS s FROM pos JOIN (SELECT doc_id, n_bytes FROM n) USING (doc_id)),
seen AS (SELECT md5(s) AS h, min(doc_id) AS low FROM win WHERE whole GROUP BY 1),
hit AS (SELECT w.doc_id, w.p, w.byte, coalesce(w.whole AND k.low < w.doc_id, false) AS dup
        FROM win w LEFT JOIN seen k ON w.whole AND md5(w.s) = k.h),
gone AS (SELECT doc_id, p, byte, bool_or(dup) OVER (PARTITION BY doc_id ORDER BY p
         ROWS BETWEEN {MIN_LEN - 1} PRECEDING AND CURRENT ROW) AS cut FROM hit),
edge AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM gone),
per AS (SELECT doc_id, count(*) FILTER (cut) AS n_removed, count(*) FILTER (opens) AS n_spans,
        string_agg(byte, '' ORDER BY p) FILTER (NOT cut) AS kept FROM edge GROUP BY doc_id)
SELECT n.doc_id, n.n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM n LEFT JOIN per USING (doc_id)
"""
