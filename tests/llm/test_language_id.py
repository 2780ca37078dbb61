"""Language identification: the folded weights against the kernel formula, held-out accuracy, odd rows."""

import zlib
from collections import Counter

import numpy as np
from conftest import SF01
from pyspark.sql import functions as F

from caseflow.llm import language_id as L
from caseflow.llm.common import table


def test_margins_solve_the_kernel_ridge_system():
    """All texts as landmarks: the margins are those of plain kernel ridge regression."""
    texts = [("a", "the cat and the dog"), ("a", "then the other thing"), ("a", "the dog sees another cat"),
             ("b", "der hund und die katze"), ("b", "und dann das andere ding"), ("c", "日本 の 猫"), ("c", "日本 の 犬")]
    g = L.Grams()
    m = L.fit([(l, g.set_of(t)) for l, t in texts])
    grams = [set(g.set_of(t).tolist()) for _, t in texts]
    known = {c for c in set().union(*grams) if sum(c in s for s in grams) >= 2}
    assert known == set(m["grams"].tolist())

    def kernel(x, y):
        return len(x & y & known) / np.sqrt(max(1, len(x & known)) * max(1, len(y & known)))

    k = np.array([[kernel(x, y) for y in grams] for x in grams])
    new = ["the hund", "katze and dog", "x", "猫 犬", "日"]
    k_new = np.array([[kernel(set(g.set_of(t).tolist()), y) for y in grams] for t in new])
    n, want = len(texts), []
    for lang in "abc":
        own = np.array([l == lang for l, _ in texts])
        w, y = np.where(own, .5 / own.sum(), .5 / (~own).sum()), np.where(own, 1.0, -1.0)
        system = np.zeros((n + 1, n + 1))     # w (y - K alpha - b) = ridge alpha, sum of w (y - K alpha - b) = 0
        system[:n, :n] = w[:, None] * k + np.eye(n) * L.RIDGE / 3
        system[:n, n], system[n, :n], system[n, n] = w, w @ k, w.sum() + 1e-9
        sol = np.linalg.solve(system, np.append(w * y, w @ y))
        want.append(k_new @ sol[:n] + sol[n])
    s = L.Scorer(m)
    got = s.score(new)
    x = s.x[:len(new)]
    margins = x @ s.w / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + m["bias"]
    assert np.allclose(np.array(want).T, margins, atol=1e-4)
    assert [p for p, _ in got] == ["abc"[i] for i in np.array(want).argmax(0)] and got[3][0] == got[4][0] == "c"


def test_many_labels_and_languages_with_long_texts_only(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 3)
    long = [("κόσμος καλημέρα " + str(i) + " ") * 2_000 for i in range(30)]
    rows = [(4 * i, f"the and of {i}", "en") for i in range(50)] + [(i, t, "el") for i, t in enumerate(long)]
    rows += [(i, f"мир и дом {i}", "ru") for i in range(40)] + [(1, "weg", f"dirty{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(l for l, _ in L.sample(docs))
    assert got["el"] == L.FEW and set(got) == {"en", "el", "ru"}
    new = spark.createDataFrame([(-1, "καλημέρα", None), (-2, "дом и мир", None), (-3, "the of", None)], docs.schema)
    pred = {r.doc_id: r.lang_pred for r in L.identify(docs.unionByName(new)).filter("doc_id < 0").collect()}
    assert pred == {-1: "el", -2: "ru", -3: "en"}


def test_held_out_accuracy(spark):
    docs = table(spark, SF01, "documents")
    got = L.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    test = [r for r in got if r.held_out and len(r.text or "") > 200]
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97


def test_labels_of_held_out_rows_and_sources_are_not_used(spark):
    docs = table(spark, SF01, "documents").repartition(3)
    hidden = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))) \
                 .withColumn("source", F.lit("x"))
    a = {r.doc_id: r.lang_pred for r in L.identify(docs).collect()}
    b = {r.doc_id: r.lang_pred for r in L.identify(hidden).collect()}
    assert a == b


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "de"), (None, "the the and", "en"), (None, "the the and", "en"),
            (5, "der die das und", "de"), (7, "x" * 2_500_000, None), (8, "日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("c"))
    got = L.identify(docs).collect()
    assert len(got) == 8
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3}
    assert L.identify(docs.limit(0)).count() == 0
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(none).collect()} == {"und"}


def test_sample_is_bound_by_language_whatever_the_ids_and_order(spark):
    def name(i):
        return chr(97 + i % 26) + chr(97 + i // 26)

    rows = [(None, f"the and {name(i)}", "en") for i in range(400)] + [(3, "hot row again", "fr")] * 400
    rows += [(i, f"der die {name(i)}", "de") for i in range(60)] + [(i, f"le la {name(i)}", "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a = L.sample(docs.coalesce(1), per_language=5)
    assert a == L.sample(docs.orderBy(F.desc("text")).repartition(3), per_language=5)
    assert {l: sum(x == l for x, _ in a) for l, _ in a} == {"de": 5, "en": 5, "fr": 5}
    assert len({(l, tuple(s)) for l, s in a}) == 15
