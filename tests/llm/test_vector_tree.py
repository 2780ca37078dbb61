"""Nearest vectors against brute force, its recall, and odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF01

from caseflow.llm import vector_tree as V
from caseflow.llm.common import table


def valid(v, d):
    return v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, d, step, top):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and valid(v, d)})
    out = set()
    for q, a in rows:
        if q % step:
            continue
        got = []
        for i, b in rows:
            if (i, b) == (q, a):
                continue
            s = 0.0
            for x, y in zip(a, b):
                s += x * y
            got.append((-s, i))
        out |= {(q, k + 1, i, -s, a) for k, (s, i) in enumerate(sorted(got)[:top])}
    return {x[:4] for x in out}


def found(df, **kw):
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in V.nearest(df, **kw).collect()]


SCHEMA = "vec_id long, embedding array<float>, label string, rank int"


def some_rows():
    r = np.random.default_rng(2)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f(r.normal(size=6) * r.uniform(0.2, 5))) for i in range(400)]
    hot = f([1, 2, 0, 0, 1, 3])
    rows += [(1000 + i, hot) for i in range(200)]                        # a third has one vector
    rows += [(5000 + i, f([0, 0, 0, 0, 0, i % 3 + 1])) for i in range(60)]    # ties of many
    return rows + [(40, hot), (40, hot), (None, hot), (7, None), (8, []), (9, [0.0] * 6), (20, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
                   (60, [float("nan")] * 6), (80, [float("inf")] * 6), (100, [1.0, 2.0]), (3, f(r.normal(size=6))),
                   (120, [-0.0, 0.0, 0.0, 0.0, 0.0, 1.0])]


def test_equals_brute_force_when_all_leaves_are_visited(spark, monkeypatch):
    rows = some_rows()
    df = spark.createDataFrame([(i, v, None, 1) for i, v in rows], SCHEMA).repartition(7)
    want = brute(rows, 6, 20, 20)
    wide = V.Index.__init__
    monkeypatch.setattr(V.Index, "__init__", lambda self, tree, r, visits: wide(self, tree, r, tree.leaves))
    got = found(df)
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(V, "CHUNK", 64)
    monkeypatch.setattr(V, "BLOCK", 8)
    assert set(found(df)) == want


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "a", 1), (20, [1.0, 1.0], "b", 2), (5, [0.5, 0.0], None, 3)], SCHEMA)
    assert sorted(found(df)) == [(0, 1, 20, 1.0), (0, 2, 5, 0.5), (20, 1, 0, 1.0), (20, 2, 5, 0.5)]
    assert found(df.where("vec_id = 0")) == []
    assert found(df.where("vec_id = 5")) == []
    assert found(df.limit(0)) == []
    assert [x for x in found(df.withColumn("embedding", df.embedding.cast("array<double>")), top=1)][0][2] in (20, 0)


def test_recall_is_reached_and_not_all_leaves_are_read(spark):
    df = table(spark, "/root/testdata/check_s", "embeddings")
    t = df.toArrow()
    x, ids = V.matrix(t["embedding"]), t["vec_id"].to_numpy()
    rows, index = V.build(df)
    assert index.visits < 0.8 * index.tree.leaves
    got = {}
    for q, _, v, _ in found(df):
        got.setdefault(q, set()).add(v)
    hit = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        hit += len(got[ids[k]] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hit / (20 * len(got)) >= 0.9 and all(len(g) == 20 for g in got.values())


def test_clustered_vectors_need_few_leaves(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 16)) * 4
    x = centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 16))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(4000), "embedding": [v.tolist() for v in x]}))
    _, index = V.build(df)
    assert index.visits <= 0.35 * index.tree.leaves


def test_bins_hold_runs_of_small_leaves_and_cut_large_ones():
    assert V.bins_of([3, 3, 5, 25, 2, 0, 9], 10) == ([0, 0, 1, 2, 3, 3, 4], [1, 1, 3, 1, 1])
    assert V.bins_of([], 10) == ([], [])


def test_scores_of_the_registered_query(spark):
    df = table(spark, SF01, "embeddings")
    x = {r.vec_id: r.embedding for r in df.collect()}
    for q, _, v, s in found(df)[:200]:
        assert s == pytest.approx(math.fsum(a * b for a, b in zip(x[q], x[v])), abs=1e-12)
