"""Source divergences against the definition in plain Python, with many small tiles."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from caseflow.llm import source_divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(rows, min_docs):
    docs = [(lang or "", source or "", TERM.findall(lower(t or ""))) for lang, source, t in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = {w for w, n in df.items() if n >= min_docs}
        group = defaultdict(Counter)
        for _, s, words in own:
            group[s].update(w for w in words if w in kept)
        whole = sum(group.values(), Counter())

        def p(c):
            return {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}

        ps, q = {s: p(c) for s, c in group.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in group:
            pair = [(o, sum(f(ps[s][w], ps[o][w]) for w in kept)) for o in group if o != s]
            term = [(w, f(ps[s][w], q[w])) for w in kept if group[s][w] and ps[s][w] > q[w]]
            for part, got, most in (("pair", pair, None), ("term", term, D.TOP_TERMS)):
                got.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, w, v, k + 1) for k, (w, v) in enumerate(got[:most])}
    return out


def result(df, **kw):
    return {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in D.divergence(df, **kw).collect()}


def some_rows():
    r = random.Random(3)
    words = ["the", "The", "cat", "dög", "ÄRGER", "x1y", "日本", "a-b", "_u_", "\x00nul", "end."] + [f"w{c}" for c in "abcdefgh"]
    rows = [(r.choice(["en", "en", "de", None]), r.choice([f"s{i}" for i in range(9)] + [None]),
             " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for _ in range(150)]
    return rows + [("en", "s1", None), ("fr", "only", "so few"), ("fr", None, ""), ("", "s2", "A" * 300_000), ("it", "x", None)] \
        + [("en", "s3", "copy the copy")] * 30


def test_equals_the_definition_in_small_tiles(spark, monkeypatch):
    rows = some_rows()
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "n long, lang string, source string, text string")
    want = brute(rows, 10)
    assert len({x[2] for x in want}) == 2
    assert result(df.repartition(5)) == want
    for name, v in (("SHARD_ROWS", 7), ("BLOCK_SOURCES", 2), ("MATRIX_CELLS", 8), ("HELD_ROWS", 5)):
        monkeypatch.setattr(D, name, v)
    assert result(df.repartition(3), min_docs=3) == brute(rows, 3)


def test_empty_table_and_groups_without_terms(spark):
    schema = "lang string, source string, text string, value long"
    assert result(spark.createDataFrame([], schema)) == set()
    rows = [("en", "a", "1 2 3", 7), ("en", None, None, None), ("en", "b", "", 1)]
    assert result(spark.createDataFrame(rows, schema)) == brute([r[:3] for r in rows], 10)


def test_long_division_is_exact():
    n = np.array([2, 7, 10**15, 3, 10**15 - 1], "int64")
    total = np.array([6, 7, 10**15, 8 * 10**15, 10**15 + 9], "int64")
    assert D.scaled(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total)]


def test_counts_of_a_batch_cover_documents_once():
    b = pa.RecordBatch.from_pydict({"lang": ["x", "x", None], "source": ["s", "s", "s"], "text": ["a A b", "a", None]})
    got = {(r["lang"], r["source"], r["term"], r["n"], r["docs"]) for r in D.batch_counts(b).to_pylist()}
    assert got == {("x", "s", "a", 3, 2), ("x", "s", "b", 1, 1), ("x", "s", None, 0, 2), ("", "s", None, 0, 1)}
