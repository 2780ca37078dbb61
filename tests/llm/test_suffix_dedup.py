"""Suffix dedup against a dictionary of all windows."""

import hashlib
import random

import pytest
from conftest import SF001

from caseflow.llm import suffix_dedup as D
from caseflow.llm.common import table


def brute(rows, length=50):
    big = 2**63 - 1
    low = {}
    texts = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            low[s] = min(i, low.get(s, big))
    out = []
    for (i, b), (raw, _) in zip(texts, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if low[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((raw, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def agree(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int").repartition(3)
    got = sorted((tuple(r) for r in D.dedup(docs, **options).collect()), key=str)
    assert got == sorted(brute(rows, options.get("min_len", 50)), key=str)


def mixed(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeionrst") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(70):
        parts = [r.choice(passages) if r.random() < .4 else " ".join(word() for _ in range(r.randint(1, 30)))
                 for _ in range(r.randint(0, 6))]
        rows.append((r.randrange(500), " ".join(parts)))
    return rows + rows[:5] + [(900 + k, rows[k][1]) for k in range(5)]


@pytest.mark.parametrize("options", [{}, {"hot_docs": 2}, {"block_bytes": 500, "slice_windows": 60},
                                     {"min_len": 24}, {"min_len": 61, "hot_docs": 5}])
def test_passages_and_copies(spark, options):
    agree(spark, mixed(len(options)), **options)


def test_periodic_and_odd_rows(spark):
    rows = [(1, "a" * 700), (2, "a" * 800 + "b"), (3, None), (3, ""), (None, "xyz " * 40), (4, "xyz " * 40),
            (None, "xyz " * 39), (5, "é" * 60), (6, "é" * 26 + "z"), (7, "short"), (8, "\0" * 120), (2, "a" * 800 + "b"),
            (9, "\0" * 49 + "q"), (10, "Ating. " * 200), (11, "Ating. " * 150)]
    agree(spark, rows)
    agree(spark, rows, hot_docs=1)
    assert D.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_table(spark):
    docs = table(spark, SF001, "documents")
    got = sorted(tuple(r) for r in D.dedup(docs).collect())
    assert got == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))
