"""The difference-cover sort against plain sorting."""

import random

import numpy as np
import pytest

from caseflow.llm import suffix_sort as S


def texts():
    r = random.Random(5)
    yield b"a" * 400
    yield b"ab" * 300 + b"aab" * 100
    yield bytes(r.randrange(256) for _ in range(900))
    yield b"".join(r.choice([b"the ", b"theory ", b"thin ", b"\0\0", b"\xff"]) for _ in range(300))
    x = bytes(r.choice(b"abc") for _ in range(120))
    yield x * 6 + b"!" + x * 5
    yield b"xy"


def test_cover():
    assert {(a - b) % S.V for a in S.COVER for b in S.COVER} == set(range(S.V)) and S.HEAD >= S.V


@pytest.mark.parametrize("size", [2, 4, 8, 32, 128])
def test_network_sorts(size):
    r = random.Random(size)
    for _ in range(200):
        x = np.array([r.randrange(5) for _ in range(size)])
        for a, b in S._network(size):
            assert len(set(a) | set(b)) == 2 * len(a)
            lo, hi = np.minimum(x[a], x[b]), np.maximum(x[a], x[b])
            x[a], x[b] = lo, hi
        assert (np.diff(x) >= 0).all()


@pytest.mark.parametrize("data", list(texts()))
def test_order_and_classes(data):
    d = np.frombuffer(data, "uint8")
    for length in (1, 5, 8, 13, 50):
        if len(d) < length:
            continue
        pos = np.arange(len(d) - length + 1)
        w = S.words(d)
        where = np.zeros(len(d) + S.V, bool)
        where[:] = True
        got = S.sort_suffixes(w, pos.copy(), S.sample_ranks(w, where, 50))
        padded = data + b"\0" * 80
        keys = [padded[i:i + 50] for i in got]
        assert keys == sorted(keys) and sorted(got) == list(pos)
        for bucket in (1, 40, 10**6):
            c = S.classes(d, pos, length, bucket)
            by = {}
            for i, n in zip(pos, c):
                by.setdefault(n, set()).add(data[i:i + length])
            assert all(len(v) == 1 for v in by.values())
            assert len(by) == len({data[i:i + length] for i in pos})
