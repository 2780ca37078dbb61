"""Counts against direct definitions, and the cascade against all rules at once."""

import itertools
import random
import re

from conftest import SF01
from pyspark.sql import functions as F

from caseflow.llm import quality_rules as Q
from caseflow.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


ODD = [None, "", " \n\t", "a", "a b c a b c", "x " * 300, "\x0b\x0ca\r\nb\n\nb\nb ", "é\x85ü\xa0q \x1c r", "#*$%&|<>" * 9,
       "one two three " * 30 + "end", "\n".join(["same line here"] * 40), "w" * 100_000, " ".join(f"w{i}" for i in range(60)),
       "AB CD EF " * 5 + " ".join(f"K{i}" for i in range(60)), "日本 語"]


def texts():
    r = random.Random(4)
    return ODD + [" ".join(r.choice(["a", "b", "cd\n", "the", "#x"]) for _ in range(r.randint(0, 90))) for _ in range(60)]


def test_counts_and_any_rule_order(spark):
    rows = [(i, t, "c") for i, t in enumerate(texts())] + [(None, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in Q.judge(df.repartition(3)).collect()}
    for i, t, _ in rows:
        g, c = got[i], counts(t)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == c, t
        assert g.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert g.kept == (not any(r.rejects(Q.Doc(t)) for r in Q.RULES))
        for order in itertools.islice(itertools.permutations(Q.RULES), 0, 500, 97):
            assert Q.passes(Q.Doc(t), order) == g.kept
    kept = Q.filter_quality(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}
    assert Q.judge(df.limit(0)).count() == 0 == Q.filter_quality(df.limit(0)).count()


def test_order_is_by_rejections_per_second(spark):
    import time
    slow = Q.Rule("slow", lambda d: time.sleep(0.002) or True, "")
    fast = Q.Rule("fast", lambda d: True, "")
    never = Q.Rule("never", lambda d: False, "")
    df = spark.createDataFrame([(i, "x") for i in range(20)], "doc_id long, text string")
    assert [r.name for r in Q.ordered_rules(df, [never, slow, fast])] == ["fast", "slow", "never"]


def test_clean_documents_stay(spark):
    docs = table(spark, SF01, "documents").join(table(spark, SF01, "labels"), "doc_id")
    got = Q.judge(docs).join(docs.select("doc_id", "quality"), "doc_id").filter("n_words >= 50")
    by = {r.quality: (r.n, r.k) for r in got.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("k")).collect()}
    assert by[1][1] == by[1][0] and by[0][1] < 0.1 * by[0][0]
