"""Quality rules as a short-circuit cascade.

A document is rejected as soon as one rule rejects it. The order of the rules
is found by measurement: every rule runs on every document of a bounded sample,
drawn from the whole table, its seconds and rejections are summed in Spark, and
rules run by rejections per second, best first. Splitting a text into words is paid
by whichever rule runs first, so no rule is charged for it. The order changes what a
run costs, never its result.

Defined results: null and empty texts have no words and fail the word count; a
text is judged whole, however long; repeated rows are judged each; an empty
table gives an empty result; other columns, whatever their names and nulls, pass
through untouched in ``filter_quality`` and are not read in ``judge``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import small_batches

SAMPLE_ROWS = 1000

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_SYMBOLS_PCT = 20
MAX_DUP_LINES_PCT = 40
MIN_MEAN_WORD, MAX_MEAN_WORD = 2, 40
MIN_UPPER_PCT = 30   # of a text's characters that A-Z must be before capitals count against it
SYMBOLS = "#*$%&|<>"


class Doc:
    """Counts of one text, each computed on first use and shared by the rules."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name):
        value = getattr(Doc, "_" + name)(self)
        setattr(self, name, value)
        return value

    def _words(self):
        t = self.text
        for c in "\n\t\r\x0b\x0c":
            if c in t:
                t = t.replace(c, " ")
        return [w for w in t.split(" ") if w]

    def _n_words(self):
        return len(self.words)

    def _word_chars(self):
        return len(self.text) - sum(self.text.count(c) for c in " \t\n\x0b\x0c\r")

    def _n_symbols(self):
        return sum(self.text.count(c) for c in SYMBOLS)

    def _lines(self):
        return [x for x in self.text.split("\n") if x.strip(" \t\x0b\x0c\r")]

    def _n_lines(self):
        return len(self.lines)

    def _n_dup_lines(self):
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self):
        w = self.words
        n = len(w) - 2
        if n < 2 or len(set(zip(w, w[1:], w[2:]))) == n:
            return 0
        first, inside = {}, bytearray(len(w))
        for i, x in enumerate(zip(w, w[1:], w[2:])):
            j = first.setdefault(x, i)
            if j != i:
                inside[i:i + 3] = b"\1\1\1"
                inside[j:j + 3] = b"\1\1\1"
        return sum(inside)

    def _ascii(self):
        return self.text.encode("utf-8", "surrogatepass")

    def _n_upper(self):
        return len(self.ascii.translate(None, _NOT_UPPER))

    def _n_lower(self):
        return len(self.ascii.translate(None, _NOT_LOWER))


_NOT_UPPER = bytes(i for i in range(256) if not 65 <= i <= 90)
_NOT_LOWER = bytes(i for i in range(256) if not 97 <= i <= 122)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]
    sql: str   # the same test over the counts, for the SQL oracle


RULES = (
    Rule("few_words", lambda d: d.n_words < MIN_WORDS, f"n_words < {MIN_WORDS}"),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > MAX_REPEAT_PCT * d.n_words,
         f"100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words"),
    Rule("symbols", lambda d: 100 * d.n_symbols > MAX_SYMBOLS_PCT * d.n_words,
         f"100 * n_symbols > {MAX_SYMBOLS_PCT} * n_words"),
    Rule("repeated_lines", lambda d: 100 * d.n_dup_lines > MAX_DUP_LINES_PCT * d.n_lines,
         f"100 * n_dup_lines > {MAX_DUP_LINES_PCT} * n_lines"),
    Rule("short_words", lambda d: d.word_chars < MIN_MEAN_WORD * d.n_words,
         f"word_chars < {MIN_MEAN_WORD} * n_words"),
    Rule("long_words", lambda d: d.word_chars > MAX_MEAN_WORD * d.n_words,
         f"word_chars > {MAX_MEAN_WORD} * n_words"),
    Rule("upper_case", lambda d: d.n_upper > d.n_lower and 100 * d.n_upper > MIN_UPPER_PCT * d.word_chars,
         f"n_upper > n_lower AND 100 * n_upper > {MIN_UPPER_PCT} * word_chars"),
)
BASE = ("few_words", "repeated_windows")


def measure(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """rule, tested, rejected, seconds on about ``sample_rows`` rows, each drawn by itself
    (copies of one text are not drawn together) and tested where it was read."""

    def run(batches):
        import time

        import pyarrow as pa

        stat = {r.name: [0, 0, 0.0] for r in rules}
        for b in small_batches(batches, "text"):
            for text in b.column("text").to_pylist():
                words = Doc(text).words
                for r in rules:
                    d = Doc(text)
                    d.words = words
                    t = time.perf_counter()
                    no = r.rejects(d)
                    s = stat[r.name]
                    s[0] += 1
                    s[1] += no
                    s[2] += time.perf_counter() - t
        yield pa.RecordBatch.from_pylist([{"rule": k, "tested": v[0], "rejected": v[1], "seconds": v[2]}
                                          for k, v in stat.items()])

    share = min(1.0, sample_rows / max(1, docs.count()))
    part = (docs.select(F.col(text_col).alias("text")).sample(share, seed=7)
            .mapInArrow(run, "rule string, tested long, rejected long, seconds double"))
    return part.groupBy("rule").agg(F.sum("tested").alias("tested"), F.sum("rejected").alias("rejected"),
                                    F.sum("seconds").alias("seconds"))


def ordered_rules(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list:
    """``rules`` by rejections per second, best first (one row per rule reaches the driver)."""
    got = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9)
           for r in measure(docs, rules, text_col, sample_rows).collect()}
    return sorted(rules, key=lambda r: -got.get(r.name, 0.0))


def passes(doc: Doc, order) -> bool:
    return not any(r.rejects(doc) for r in order)


def judge(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept. The base
    counts are asked for on every row, so the base rules cost nothing more and
    come first; the others follow in measured order on what is left."""
    base = [r for r in rules if r.name in BASE]
    order = ordered_rules(docs, [r for r in rules if r.name not in BASE], text_col, sample_rows)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]
                          + [T.StructField(c, T.LongType()) for c in counts]
                          + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        for b in small_batches(batches, "text"):
            cols = [[] for _ in range(len(counts) + 2)]
            for text in b.column("text").to_pylist():
                d = Doc(text)
                failed = not passes(d, base)
                for to, v in zip(cols, [getattr(d, c) for c in counts] + [failed, not failed and passes(d, order)]):
                    to.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")] + [pa.array(c, pa.int64()) for c in cols[:-2]]
                + [pa.array(c, pa.bool_()) for c in cols[-2:]], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def filter_quality(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects."""
    order = ordered_rules(docs, rules, text_col, sample_rows)

    def run(batches):
        import pyarrow as pa

        for b in small_batches(batches, text_col):
            keep = [passes(Doc(t), order) for t in b.column(text_col).to_pylist()]
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


_WORD = r"[^\x20\x09-\x0D]+"
COUNTS_SQL = rf"""
src AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM src),
win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
        FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
counts AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
  length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
 FROM w LEFT JOIN cov USING (rid))"""
_base = " OR ".join(f"({r.sql})" for r in RULES if r.name in BASE)
_any = " OR ".join(f"({r.sql})" for r in RULES)
ORACLE = f"""WITH {COUNTS_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({_base}) AS base_failed, NOT ({_any}) AS kept FROM counts"""
