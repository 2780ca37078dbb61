"""Batches keep all rows in order, whatever their sizes."""

import random

import pyarrow as pa
import pytest

from caseflow.llm.common import small_batches


@pytest.mark.parametrize("chars", [1, 7, 100, 10**6])
def test_small_batches(chars):
    r = random.Random(chars)
    texts = [None if r.random() < .1 else "x" * r.choice([0, 1, 3, 50, 400]) for _ in range(300)]
    rows = pa.table({"i": list(range(300)), "text": pa.array(texts, pa.string())})
    for size in (1, 13, 300):
        out = list(small_batches(rows.to_batches(max_chunksize=size), "text", chars))
        assert [i for b in out for i in b.column("i").to_pylist()] == list(range(300))
        assert [t for b in out for t in b.column("text").to_pylist()] == texts
        for b in out:
            assert b.num_rows == 1 or sum(len(t or "") for t in b.column("text").to_pylist()) <= chars
    assert list(small_batches(rows.slice(0, 0).to_batches(), "text", chars)) == []
