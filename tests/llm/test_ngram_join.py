"""The banded join against all pairs compared by brute force."""

import random

import pytest
from conftest import SF01
from pyspark.sql import functions as F

from caseflow.llm import ngram_join as J
from caseflow.llm.common import table


def brute(rows, n=5, threshold=0.8):
    sets = [J.ngrams_of(J.words_of(t), n) for _, t in rows]
    links = [set() for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (a and b and len(a & b) >= threshold * len(a | b)):
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(links[i]), len(seen)))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def agree(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("c"))
    got = [tuple(r) for r in J.join(docs, **options).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, options.get("n", 5), options.get("threshold", .8)), key=key)


def near_copies(seed, n_docs=60, words=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [[r.choice(vocab) for _ in range(words)] for _ in range(5)]
    rows = []
    for i in range(n_docs):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("tile", [3, 256])
def test_near_copies_and_large_buckets(spark, tile):
    agree(spark, near_copies(1), tile=tile)


def test_large_tables_of_groups_do_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(J._small, "__defaults__", (0,))
    agree(spark, near_copies(2, 30))


def test_odd_rows(spark):
    agree(spark, [(5, None), (4, ""), (9, " ,. "), (1, "a"), (2, "A!"), (3, "a b c d e"), (8, "A b, c d E."),
                  (None, "one two three four five six"), (6, "one two three four five six"), (None, None),
                  (7, "x " * 30_000), (10, "x " * 29_000), (11, "p q r s"), (12, "p q r s t u v w x y z")])
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_table(spark):
    docs = table(spark, SF01, "documents")
    got = sorted(tuple(r) for r in J.join(docs).collect())
    assert got == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))
    kept = J.keep_one(docs.withColumn("links", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _, _ in got})


def test_repeated_ids_stay_by_their_own_text(spark):
    a, b, c = ("one two three four five six", "p q r s t u v", "k l m n o")
    rows = [(7, a), (7, b), (3, b), (5, c), (5, c.upper()), (9, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sum", F.lit("c"))
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text.lower()) for r in kept.collect())
    assert got == [(3, b), (5, c), (7, a)]


@pytest.mark.parametrize("small", [J.BROADCAST_ROWS, 0])
def test_one_row_stays_of_repeated_rows(spark, monkeypatch, small):
    monkeypatch.setattr(J._small, "__defaults__", (small,))
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(None, long, 1), (None, long, 2), (None, long + " x", 3), (None, long + " x", 4), (None, "a b", 5),
            (None, "c d", 6), (4, "c d", 7), (4, "c d", 7), (None, None, 8), (None, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted((r.text or "", r.doc_id) for r in J.keep_one(docs).collect())
    assert [x for x in got if not x[0].startswith("w0")] == [("", None), ("a b", None), ("c d", 4)]
    assert len(got) == 4
    hot = spark.createDataFrame([(7, long)] * 1000, "doc_id long, text string")
    assert J.keep_one(hot).count() == 1


def test_bands_reach_the_recall():
    for t, r in ((.8, .9995), (.5, .99), (.9, .999)):
        b, k = J.bands_for(t, r, 1024)
        assert 1 - (1 - t ** k) ** b >= r


def test_planted_pairs_just_above_the_threshold_are_found(spark):
    """3,000 pairs of a similarity from 0.8 to 0.85: the banding finds all but the
    share that its recall allows (0.0005 at 0.8, less above)."""
    r = random.Random(5)
    rows, near = [], set()
    while len(near) < 3000:
        i = len(near)
        words = [f"p{i}x{k}" for k in range(r.randint(60, 140))]
        other = list(words)
        for k in r.sample(range(len(words)), 2 if len(words) > 100 else 1):
            other[k] += "y"
        a, b = J.ngrams_of(words), J.ngrams_of(other)
        while len(a & b) / len(a | b) > .85:
            other = other[1:]
            b = J.ngrams_of(other)
        if len(a & b) / len(a | b) >= .8:
            near.add(i)
            rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {x.doc_id // 2 for x in J.join(docs).filter("n_links = 1 and doc_id <> class_id").collect()}
    assert len(found) >= 2990
