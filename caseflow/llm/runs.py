"""Periodic runs of words, by online dyadic square catching.

Words are appended to a stream. On level k the stream is laid out in blocks of
m = 2^k words, one starting every m / 2; once a block is complete, a catcher stands
on it and waits for the block to come again m / 2 + 1 to m words later. These waits
do not overlap, so each appended word advances one comparison a level: the suffix of
m words that it ends against the block of the one catcher then awake. Suffixes are
compared by 64-bit names, the name of 2m words being made of those of its halves.

A block that comes again after q <= m words is a square: m + q >= 2q words of period
q. Catchers of neighbouring blocks that report the same q hold overlapping squares of
one run; they are merged, compared word by word and extended to both sides.

Why no run of length 4q is missed: 3q words hold a whole block of the level with
m / 2 < q <= m. Why the first report of a block is the period: were a block of m >= q
words to come again sooner inside a run, the run would have a smaller period
(Fine and Wilf). Reports whose q is a multiple of the period are dropped after a
look at q's prime divisors. Two different suffixes with one name would show in the
comparison by words; the stream is then read again with other names.

The documents of an Arrow batch make one stream, with a word that occurs nowhere else
after each. A level keeps the last names it needs: memory is a few dozen bytes a word
of one batch or of one longer text.

Defined results: null and empty texts have no words, no runs and the digests of the
empty string; a text is read whole, however long; a null id rewrites nothing; repeated
rows are judged each; of runs with the greatest exponent the first start wins, then the
smaller period; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import small_batches

MIN_LENGTH = 6
MIN_PERIODS = 4
PIECE = 65_536      # words that a stream takes at once


class _Names:
    """The last names of a level; ``at(a, b)`` are those of the windows that start at
    a to b - 1 of the stream."""

    def __init__(self, need: int):
        import numpy as np

        self.need, self.base, self.end = need, 0, 0
        self.held = np.empty(2 * need, "uint64")

    def at(self, a: int, b: int):
        return self.held[a - self.base:b - self.base]

    def append(self, names) -> None:
        import numpy as np

        if self.end - self.base + len(names) > len(self.held):
            keep = min(self.end - self.base, self.need)
            held = np.empty(2 * (self.need + len(names)), "uint64")
            held[:keep] = self.at(self.end - keep, self.end)
            self.held, self.base = held, self.end - keep
        self.held[self.end - self.base:self.end - self.base + len(names)] = names
        self.end += len(names)


class _Level:
    def __init__(self, k: int):
        self.m = 1 << k
        self.half = max(1, self.m // 2)
        self.names = _Names(3 * self.m)
        self.blocks, self.lags = [], []     # first report of each block


def _mixed(a, b):
    """64-bit names of pairs of names."""
    import numpy as np

    with np.errstate(over="ignore"):
        z = a * np.uint64(0x9E3779B97F4A7C15)
        z ^= (b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(32)
    return z


class SquareCatchers:
    """Online: ``append`` words (integers) in any pieces, ``runs`` at any time."""

    def __init__(self, max_period: int | None = None, seed: int = 1):
        self.max_period, self.seed = max_period, seed
        self.pieces, self.n, self.levels = [], 0, []

    def append(self, ids) -> None:
        import numpy as np

        ids = np.asarray(ids, "int64")
        for a in range(0, len(ids), PIECE):
            self._piece(ids[a:a + PIECE])

    def _piece(self, ids) -> None:
        import numpy as np

        self.pieces.append(ids)
        self.n += len(ids)
        new = _mixed(ids.view("uint64"), np.full(len(ids), self.seed, "uint64"))
        k = 0
        while True:
            if k == len(self.levels):
                # A level opens with its first window: the one below still holds all its names then.
                if (1 << k) // 2 >= (self.max_period or self.n) or 1 << k > self.n:
                    return
                self.levels.append(_Level(k))
                if k:
                    new = self._named(k, 0)
            elif k:
                new = self._named(k, self.levels[k].names.end)
            level = self.levels[k]
            level.names.append(new)
            self._advance(level, level.names.end - len(new), level.names.end)
            k += 1

    def _named(self, k: int, a: int):
        """Names of level k from window a on, as far as the words go."""
        below, m = self.levels[k - 1], 1 << k
        b = max(a, self.n - m + 1)
        return _mixed(below.names.at(a, b), below.names.at(a + m // 2, b + m // 2))

    def _advance(self, level: _Level, a: int, b: int) -> None:
        """The suffixes that start at a to b - 1, each against the catcher awake."""
        import numpy as np

        h, m = level.half, level.m
        a = max(a, 1 if m == 1 else h + 1)
        if a >= b:
            return
        first = (a - 1) // h - (m > 1)
        last = (b - 2) // h - (m > 1)
        starts = level.names.at(first * h, last * h + 1)[::h]
        cut = a - (first + (m > 1)) * h - 1     # suffixes of the first block that came before
        again = np.repeat(starts, h)[cut:cut + b - a] == level.names.at(a, b)
        at = np.flatnonzero(again) + a
        if not len(at):
            return
        block = (at - 1) // h - (m > 1)
        block, where = np.unique(block, return_index=True)
        lag = at[where] - block * h
        if level.blocks and level.blocks[-1][-1] == block[0]:
            block, lag = block[1:], lag[1:]
        if len(block):
            level.blocks.append(block)
            level.lags.append(lag)

    def runs(self):
        """(start, length, period) of the maximal runs, by start, then period."""
        import numpy as np

        words = np.concatenate(self.pieces) if self.pieces else np.empty(0, "int64")
        self.pieces = [words]
        found = set()
        for level in self.levels:
            if not level.blocks:
                continue
            block, lag = np.concatenate(level.blocks), np.concatenate(level.lags)
            new = np.r_[True, (np.diff(block) != 1) | (np.diff(lag) != 0)]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(block)] - 1
            q = lag[first]
            start, end = block[first] * level.half, block[last] * level.half + level.m + q
            least = np.maximum(MIN_LENGTH, MIN_PERIODS * q)
            for i in np.flatnonzero(end - start + 2 * (level.half - 1) >= least):
                run = self._extended(words, int(start[i]), int(end[i]), int(q[i]), level.half)
                if run is None:
                    return self._again(words)
                if run[1] >= least[i] and _primitive(words, run[0], run[2]):
                    found.add(run)
        return sorted(found, key=lambda r: (r[0], r[2]))

    def _extended(self, words, start: int, end: int, q: int, step: int):
        import numpy as np

        if not np.array_equal(words[start:end - q], words[start + q:end]):
            return None
        while start:
            a = max(0, start - step)
            differ = np.flatnonzero(words[a:start] != words[a + q:start + q])
            start = a + int(differ[-1]) + 1 if len(differ) else a
            if len(differ):
                break
        while end < len(words):
            b = min(len(words), end + step)
            differ = np.flatnonzero(words[end:b] != words[end - q:b - q])
            end = end + int(differ[0]) if len(differ) else b
            if len(differ):
                break
        return start, end - start, q

    def _again(self, words):
        other = SquareCatchers(self.max_period, self.seed + 1)
        other.append(words)
        return other.runs()


def _primitive(words, start: int, q: int) -> bool:
    """Whether no divisor of q is a period of the run of period q at ``start``."""
    import numpy as np

    rest, r = q, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            p = q // r
            if np.array_equal(words[start:start + 2 * q - p], words[start + p:start + 2 * q]):
                return False
            while rest % r == 0:
                rest //= r
        r += 1
    return True


def rewritten(n: int, doc_id):
    """Word numbers of a text of n words after the contract's rewriting, or None where
    it leaves the text as it is."""
    import zlib

    import numpy as np

    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def words_of(texts):
    """(word numbers, dictionary, words per text) of an Arrow string array."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = pc.dictionary_encode(pc.list_flatten(lists))
    code = words.indices.to_numpy().astype("int64")
    of = pc.list_parent_indices(lists).to_numpy()
    blank = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
    if blank >= 0:
        real = code != blank
        code, of = code[real], of[real]
    return code, words.dictionary, np.bincount(of, minlength=len(texts))


def batch_runs(texts, ids=None):
    """Of an Arrow string array: the runs of each text, and the words of each text that
    stay (an Arrow list array). ``ids``: rewrites the texts by the contract's rule."""
    import numpy as np
    import pyarrow as pa

    code, dictionary, size = words_of(texts)
    ends = np.cumsum(size)
    starts = ends - size
    if ids is not None:
        for d, doc_id in enumerate(ids):
            at = rewritten(int(size[d]), doc_id)
            if at is not None:
                code[starts[d]:ends[d]] = code[starts[d] + at]
    n = len(size)
    stream = np.empty(len(code) + n, "int64")
    at = np.arange(len(code)) + np.repeat(np.arange(n), size)
    stream[at] = code
    stream[ends + np.arange(n)] = -1 - np.arange(n)     # occurs once: no run passes it
    catchers = SquareCatchers(max(1, int(size.max(initial=0)) // MIN_PERIODS))
    catchers.append(stream)
    runs = [[] for _ in range(n)]
    gone = np.zeros(len(stream) + 1, "int64")
    opens = starts + np.arange(n)
    found = catchers.runs()
    for d, (start, length, q) in zip(np.searchsorted(opens, [r[0] for r in found], side="right") - 1, found):
        runs[d].append((start - int(opens[d]), length, q))
        gone[start + q] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone)[at] == 0
    left = np.r_[0, np.cumsum(np.bincount(np.repeat(np.arange(n), size)[keep], minlength=n))]
    words = dictionary.take(pa.array(code[keep]))
    kept = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words)
    return runs, kept


def _digest_row(runs) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256."""
    from hashlib import sha256

    whole = sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    if not runs:
        return 0, None, None, None, None, whole
    s, n, q = best = runs[0]
    for s, n, q in runs[1:]:
        if n * best[2] > best[1] * q:
            best = (s, n, q)
    s, n, q = best
    return len(runs), s, n, q, 1000 * n // q, whole


_COUNTS = ("n_runs", "start", "length", "period", "exponent_milli")


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = True) -> DataFrame:
    """One row per document: doc_id, n_runs, the run with the greatest exponent, and the
    digests of all runs and of the text without the repetitions."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]
                          + [T.StructField(c, T.LongType()) for c in _COUNTS]
                          + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")])

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa
        import pyarrow.compute as pc

        for b in small_batches(batches, "text"):
            ids = b.column("doc_id")
            runs, kept = batch_runs(b.column("text"), ids.to_pylist() if rewrite else None)
            rows = list(zip(*(_digest_row(r) for r in runs)))
            collapsed = pc.binary_join(kept, " ").cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays(
                [ids] + [pa.array(c, pa.int64()) for c in rows[:-1]]
                + [pa.array(rows[-1], pa.string()),
                   pa.array([sha256(x.as_buffer()).hexdigest() for x in collapsed], pa.string())], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every run cut to its first period (words joined by one space);
    texts without a run stay as they are."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in small_batches(batches, text_col):
            texts = b.column(text_col)
            runs, kept = batch_runs(texts)
            some = pa.array([bool(r) for r in runs])
            joined = pc.binary_join(kept, " ").cast(texts.type)
            yield b.set_column(b.schema.get_field_index(text_col), b.schema.field(text_col),
                               pc.if_else(some, joined, texts))

    return docs.mapInArrow(run, docs.schema)


# CRC-32 of the decimal id, bit by bit (3988292384 is its reversed polynomial).
_BITS = """list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
  lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)"""
_CRC = f"""xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
  list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS UBIGINT))), lambda c, b: {_BITS}))"""
ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CAST({_CRC} AS BIGINT) AS h FROM documents),
e AS (SELECT rid, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS twist,
  CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d),
r AS (SELECT *, CASE WHEN twist THEN 1 + (n - a) // (3 + g % 8) END AS p FROM e),
words AS (SELECT rid, n, i, CASE WHEN twist AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM r)),
eq AS (SELECT x.rid, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.rid = y.rid AND x.word = y.word
  AND y.i > x.i AND y.i - x.i <= x.n // {MIN_PERIODS}),
isles AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS isle FROM eq),
long AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM isles GROUP BY rid, q, isle
  HAVING count(*) + q >= greatest({MIN_LENGTH}, {MIN_PERIODS} * q)),
runs AS (SELECT * FROM long l WHERE NOT EXISTS (SELECT 1 FROM long s WHERE s.rid = l.rid AND s.q < l.q
  AND s.start <= l.start AND s.start + s.length >= l.start + l.length)),
gone AS (SELECT DISTINCT rid, unnest(range(start + q, start + length)) AS i FROM runs),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length / q DESC, start, q) AS k FROM runs)
  WHERE k = 1),
told AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS t
  FROM runs GROUP BY rid),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT d.doc_id, coalesce(told.n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length,
  CAST(best.q AS BIGINT) AS period, CAST(1000 * best.length // best.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)"""
