"""Exact dedup against a dictionary of normalised texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from caseflow.llm import exact_dedup as D

ROWS = [(1, "Hello"), (2, "hELLO"), (3, "Élan"), (4, "élan"), (5, None), (6, ""), (None, "hello"), (None, "only"),
        (None, "only"), (7, "x" * 100_000), (8, "X" * 100_000), (9, "same"), (9, "same"), (9, "other"), (10, " same"), (11, "ſK")]
ROWS += [(100 + i, "Hot Text") for i in range(300)] + [(1000 + i, f"t{i}") for i in range(50)]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"broadcast_groups": 0, "salts": 5},
                                     {"hash_of": lambda c: F.unhex(F.substring(F.md5(c), 1, 2))},
                                     {"hash_of": lambda c: F.unhex(F.substring(F.md5(c), 1, 1)), "broadcast_groups": 0}])
def test_groups_collisions_and_hot_groups(spark, options):
    docs = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, norm int").repartition(4)
    got = sorted((tuple(r) for r in D.exact_dedup(docs, **options).collect()), key=str)
    assert got == brute(ROWS)
    kept = D.keep_one(docs, **options)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.filter("doc_id is not null").collect()) == \
        sorted({(i, t or "") for i, t in ROWS if i is not None and (i, True) in {(b[0], b[3]) for b in brute([*ROWS]) if b[4] == hashlib.sha256(low(t).encode()).hexdigest()}})


def test_empty_and_no_python(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert D.exact_dedup(none).count() == 0 == D.keep_one(none).count()
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = D.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("options", [{}, {"broadcast_groups": 0, "salts": 5},
                                     {"hash_of": lambda c: F.unhex(F.substring(F.md5(c), 1, 1))}])
def test_one_row_stays_of_repeated_rows(spark, options):
    docs = spark.createDataFrame(ROWS + [(None, "ONLY"), (None, "lone")], "doc_id long, text string") \
                .withColumn("n", F.monotonically_increasing_id())
    kept = D.keep_one(docs, **options)
    assert kept.columns == docs.columns
    assert sorted(r.text.lower() for r in kept.filter("doc_id is null").collect()) == ["lone", "only"]
    assert kept.filter("text = 'same'").count() == 1   # equal id and text: one document
    hot = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("all alike").alias("text"))
    assert D.keep_one(hot, **options).count() == 1
