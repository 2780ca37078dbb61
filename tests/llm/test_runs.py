"""Runs and collapsed texts against the definition."""

import random
import re
import time
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from caseflow.llm import runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(
                    all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = WORD.findall(text or "")
    h, n = (1 if doc_id is None else zlib.crc32(str(doc_id).encode())), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def catch(ids, pieces=None):
    c = R.SquareCatchers()
    for p in pieces or [ids]:
        c.append(p)
    return c.runs()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12),
                                                                    st.integers(3, 7)), max_size=3))
def test_catchers_equal_the_definition(ids, plants):
    for at, q, times in plants:
        part = ids[at:at + q]
        ids = ids[:at] + part * times + ids[at + q:]
    assert catch(ids) == brute_runs(ids)


def test_word_by_word_equals_all_at_once():
    r = random.Random(1)
    for _ in range(40):
        ids = [r.randint(0, 1) for _ in range(r.randint(0, 50))] + [1, 2, 3] * r.randint(0, 9) + [5] * r.randint(0, 9)
        assert catch(ids, [[x] for x in ids]) == catch(ids) == brute_runs(ids)
        cut = r.randint(0, len(ids))
        assert catch(ids, [ids[:cut], ids[cut:]]) == brute_runs(ids)


def test_fibonacci_periods_of_every_length_and_hard_shapes():
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    assert catch(b) == brute_runs(b)
    for q in range(1, 70):
        x = list(range(q))
        for extra in (-1, 0, 1):
            ids = [900, 901] + (x * 5)[:4 * q + extra] + [902]
            assert catch(ids) == brute_runs(ids), q
    for x in ([1] * 14 + [2], [1] * 8 + [2] * 7, [1, 1, 2, 1, 1, 2, 1, 1], [1] * 16 + [2] * 15):
        for shift in range(9):
            ids = list(range(50, 50 + shift)) + x * 5 + [3]
            assert catch(ids) == brute_runs(ids)


def test_wrong_names_are_found_and_named_anew(monkeypatch):
    real = R._mixed

    def weak(a, b):     # with the first seed all suffixes have one name
        return real(a, b) if weak.good else np.zeros(len(a), "uint64")

    weak.good = False
    again = R.SquareCatchers._again

    def other(self, words):
        weak.good = True
        return again(self, words)

    monkeypatch.setattr(R, "_mixed", weak)
    monkeypatch.setattr(R.SquareCatchers, "_again", other)
    ids = [7, 8, 9] + [1, 2, 3] * 6 + [4, 5, 6, 9, 8] * 3
    assert catch(ids) == brute_runs(ids) and weak.good


def test_long_texts_take_time_in_proportion():
    shapes = {"one word": [1] * 400_000, "three": [1, 2, 3] * 133_000, "half": list(range(100_000)) * 4,
              "sixes": [x for i in range(20_000) for x in [i % 7] * 6],
              "blocks": ([1] * 14 + [2]) * 25_000}
    for name, ids in shapes.items():
        t = time.time()
        got = catch(ids)
        assert got and time.time() - t < 10, name
    assert catch(shapes["half"]) == [(0, 400_000, 100_000)]
    assert len(catch(shapes["sixes"])) == 20_001     # the six-word runs, and all of them with period 42


ODD = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "\x0b\x0ca\r\nb\n\nb\nb ", "é\x85é\xa0é \x1c r\x1d \x1c \x1c \x1c \x1c",
       "x y " * 40, "w" * 50_000, " a  b " * 9 + "c " * 7, "日 本 " * 4, "日 本 " * 4 + "日"]


def test_digests_equal_the_definition(spark):
    r = random.Random(5)
    texts = ODD + [" ".join(r.choice("abc") for _ in range(r.randint(0, 120))) for _ in range(120)]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, "k k k k k k k", None), (3, "q q q q q q", "x"), (3, "q q q q q q", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    got = sorted(map(str, (tuple(x) for x in R.run_digests(df.repartition(3)).collect())))
    assert got == sorted(str((i, *brute_row(i, t))) for i, t, _ in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 5
    assert R.run_digests(df.limit(0)).collect() == []


def test_collapse_keeps_first_periods_and_other_texts(spark):
    df = spark.createDataFrame([(1, "go " * 9 + "on"), (2, " two  blanks "), (3, None)], "id long, text string")
    assert {r.id: r.text for r in R.collapse(df).collect()} == {1: "go on", 2: " two  blanks ", 3: None}


def test_words_split_at_ascii_blanks_only():
    texts = pa.array(["".join(chr(c) + "x" for c in range(0x300)), None, "  a b", "b "])
    code, words, size = R.words_of(texts)
    assert size.tolist() == [len(WORD.findall(texts[0].as_py())), 0, 2, 1]
    assert [words[i].as_py() for i in code][-3:] == ["a", "b", "b"]
