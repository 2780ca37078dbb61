"""Byte-level BPE by monoid tree reduction.

Each match of the split pattern is a byte string whose two halves are encoded
on their own, recursively, and joined. A join re-encodes a window around the
boundary (the last tokens of the left half with the first of the right) and
widens it until the tokens at its rims are stable against their neighbours
outside: two neighbouring tokens are stable if their bytes together encode to
just these two. A sequence of which all neighbours are stable is the encoding
of its bytes: take the first merge that would cross one of its borders; up to
then both tokens have evolved as they do alone, so the same merge, still the
lowest and leftmost there, would cross the border when the two are encoded
alone. Inside the kept parts all neighbours are stable because those parts are
encodings. Decoding concatenates bytes up the same tree.

A worker remembers the ids of the words it has met (a bound, not a limit:
forgetting costs time only). A text is cut at spaces that stand between two
characters that are no white space; no match of the pattern reaches over such
a space from the left, so the parts encode on their own.

Defined results: null text is empty, an empty text has no ids; one text may be
one very long match; repeated rows are encoded each; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import small_batches, worker_cache

LEAF_BYTES = 6
HEAP_FROM = 48
REMEMBERED = 400_000
REMEMBERED_CHARS = 48   # longer words are not kept


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_bytes: int = LEAF_BYTES):
        import regex

        self.ranks, self.leaf = ranks, max(1, leaf_bytes)
        self.bytes_of = {i: b for b, i in ranks.items()}
        # White_Space by name: \s of this engine holds a few control characters more
        ws = r"\p{White_Space}"
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{ws}").replace(r"\S", rf"\P{{White_Space}}")
                                     .replace(r"\s", ws))
        self.unsafe = regex.compile(f" {ws}|{ws} ")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.short: dict[bytes, list[int]] = {}    # merged windows
        self.pieces: dict[str, bytes] = {}         # matches
        self.words: dict[str, bytes] = {}          # words with a space in front

    # -- merges of one short window

    def merged(self, s: bytes) -> list[int]:
        """Lowest rank first, leftmost first, until no neighbours merge."""
        ranks = self.ranks
        if len(s) > HEAP_FROM:
            return self._merged_by_heap(s)
        parts = [s[i:i + 1] for i in range(len(s))]
        near = [ranks.get(s[i:i + 2]) for i in range(len(s) - 1)]
        while near:
            best = at = None
            for i, r in enumerate(near):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del near[at]
            if at < len(near):
                near[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                near[at - 1] = ranks.get(parts[at - 1] + parts[at])
        return [ranks[p] for p in parts]

    def _merged_by_heap(self, s: bytes) -> list[int]:
        import heapq

        ranks, n = self.ranks, len(s)
        end = list(range(1, n + 1))      # end of the part that starts here; 0: no part starts here
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(s[i:i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i):
            j = end[i]
            if j < n and (r := ranks.get(s[i:end[j]])) is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, 0
            if k < n:
                prev[k] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[s[i:end[i]]])
            i = end[i]
        return out

    # -- the tree

    def stable(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            got = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def window(self, s: bytes) -> list[int]:
        """``merged``, remembered for short windows."""
        got = self.short.get(s)
        if got is None:
            got = self.merged(s)
            if len(s) <= 2 * LEAF_BYTES:
                self.short[s] = got
        return got

    def join(self, a: list[int], b: list[int]) -> list[int]:
        if not a or not b:
            return a + b
        if self.stable(a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            w = self.window(b"".join(map(self.bytes_of.__getitem__, a[-i:] + b[:j])))
            left = i == len(a) or self.stable(a[-i - 1], w[0])
            right = j == len(b) or self.stable(w[-1], b[j])
            if left and right:
                return a[:-i] + w + b[j:]
            if not left:
                i = min(len(a), 2 * i)
            if not right:
                j = min(len(b), 2 * j)

    def tree(self, s: bytes) -> list[int]:
        if len(s) <= self.leaf:
            return self.window(s)
        m = len(s) // 2
        return self.join(self.tree(s[:m]), self.tree(s[m:]))

    # -- texts

    def encode_match(self, piece: str) -> bytes:
        s = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(s)
        got = packed([whole] if whole is not None else self.tree(s))
        if len(piece) <= REMEMBERED_CHARS:
            self.pieces[piece] = got
        return got

    def _encode_part(self, part: str) -> bytes:
        known = self.pieces
        return b"".join([known.get(m) or self.encode_match(m) for m in self.pattern.findall(part)])

    def encode(self, text: str | None) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.unsafe.search(text):
            return self._encode_part(text)
        first, *rest = text.split(" ")
        head = self._encode_part(first)
        known = self.words
        try:
            return head + b"".join(map(known.__getitem__, rest))
        except KeyError:
            pass
        out = [head]
        long: dict[str, bytes] = {}
        for w in rest:
            v = known.get(w)
            if v is None:
                v = long.get(w)
            if v is None:
                v = self._encode_part(" " + w)
                (known if len(w) <= REMEMBERED_CHARS else long)[w] = v
            out.append(v)
        return b"".join(out)

    def forget(self) -> None:
        for d in (self.words, self.pieces, self.short, self.pairs):
            if len(d) > REMEMBERED:
                d.clear()

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1024:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary; its memories live as long."""
    cache = worker_cache("bpe")
    key = (ranks_path, pattern)
    if key not in cache:
        cache[key] = Codec(load_ranks(ranks_path), pattern)
    return cache[key]


def _mapped(df: DataFrame, in_cols: dict, out: list, setup) -> DataFrame:
    """``setup()`` gives a task its function of one value and what to call after each slice."""
    names = list(in_cols)
    schema = T.StructType([T.StructField(names[0], df.schema[in_cols[names[0]]].dataType)] + out)

    def run(batches):
        import pyarrow as pa

        f, forget = setup()
        arrow = {T.BinaryType: pa.binary(), T.LongType: pa.int64(), T.StringType: pa.string()}
        for b in small_batches(batches, names[1]):
            rows = [f(v) for v in b.column(names[1]).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(names[0])] + [pa.array([r[i] for r in rows], arrow[type(o.dataType)])
                                        for i, o in enumerate(out)], names=schema.names)
            forget()

    return df.select(*[F.col(c).alias(n) for n, c in in_cols.items()]).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit)."""
    def setup():
        c = codec(ranks_path, pattern)
        return lambda t: (c.encode(t),), c.forget
    return _mapped(docs, {"doc_id": id_col, "text": text_col}, [T.StructField("ids", T.BinaryType())], setup)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, text (binary) from ``encode_documents``."""
    def setup():
        import numpy as np
        c = codec(ranks_path, pattern)
        return lambda ids: (c.decode(np.frombuffer(ids or b"", "<u4").tolist()),), c.forget
    return _mapped(encoded, {"doc_id": "doc_id", "ids": "ids"}, [T.StructField("text", T.BinaryType())], setup)


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one task,
    so that ids need not travel."""
    def setup():
        import hashlib

        import numpy as np
        c = codec(ranks_path, pattern)

        def row(t):
            ids = c.encode(t)
            back = c.decode(np.frombuffer(ids, "<u4").tolist())
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()
        return row, c.forget
    return _mapped(docs, {"doc_id": id_col, "text": text_col},
                   [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                    T.StructField("decoded_sha256", T.StringType())], setup)
