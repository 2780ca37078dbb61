"""Quotation linking against a direct search through each conversation."""

import random

import pytest
from conftest import SF01
from pyspark.sql import functions as F

from caseflow.llm import chat_format as C
from caseflow.llm.common import table


def brute(rows):
    """(conv, turn, role, text) -> sorted result rows; turns are distinct here."""
    out, convs = [], {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    for conv, ms in convs.items():
        ms = sorted(ms, key=lambda r: r[1])
        seen, info = [], {}
        for _, turn, role, text in ms:
            clean, own, quotes = C.parse(text)
            best = None
            for depth, u in quotes:
                hit = [t for t, o in seen if u in o]
                if hit:
                    best = max(best or (-99, 0, 0), (-depth, len(u), max(hit)))
            parent = best[2] if best else None
            root, d = (info[parent][0], info[parent][1] + 1) if best else (turn, 0)
            info[turn] = (root, d)
            seen.append((turn, own))
            out.append((conv, turn, role, clean, len(quotes), parent, root, d))
    return out


def dialogue(seed, turns=60):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(["Yes", "no", "maybe so", "the plan", "ok.", "tomorrow"]) for _ in range(r.randint(1, 4)))
    said, rows = [], []
    for t in range(turns):
        text = "\n".join(line() if r.random() < .85 else "" for _ in range(r.randint(1, 4)))
        if said and r.random() < .7:
            q = r.choice(said)
            lines = q.split("\n")
            if r.random() < .4:
                lines = lines[:r.randint(1, len(lines))]
            text = r.choice(["", "On Monday, A wrote:\n"]) + "\n".join(r.choice(["> ", ">", " > "]) + x.upper() for x in lines) + "\n" + text
        said.append(text)
        rows.append((seed % 3, t, "user" if t % 2 else "assistant", text))
    return rows


@pytest.mark.parametrize("stretch", [7, 4096])
def test_dialogues(spark, monkeypatch, stretch):
    monkeypatch.setattr(C.latest_before, "__defaults__", (stretch,))
    rows = [(i, *r[1:]) for i in range(4) for r in dialogue(i)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x"))
    got = [tuple(r) for r in C.conversations(df.repartition(4)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert [(g[0], g[6], g[1]) for g in got] == sorted((g[0], g[6], g[1]) for g in got)


def test_parse():
    t = "Hi\nOn May 1, Bob wrote:\n> One  TWO\n>\n> three\n>> deep\nmy answer\n"
    clean, own, quotes = C.parse(t)
    assert clean == "Hi\nmy answer" and own == ["hi my answer", "hi", "my answer"]
    assert (1, "one two three") in quotes and (1, "three") in quotes and (2, "deep") in quotes
    assert C.parse(None) == ("", [], []) and C.parse("a > b")[2] == []


def test_odd_rows(spark):
    rows = [(None, 0, "user", "hello there"), (None, 1, None, "> hello there\nyes"), (1, None, "user", "late"),
            (1, 3, "user", "> late\nok"), (1, 4, "user", None), (1, 4, "user", None), (1, 5, "a", "x" * 200_000),
            (2, 0, "a", "> self\nself"), (2, 0, "a", "> self\nself"), (2, 0, "b", "other")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in C.conversations(df).collect()]
    assert len(got) == len(rows)
    assert (None, 1, None, "yes", 1, 0, 0, 1) in got
    assert [g for g in got if g[0] == 1 and g[1] == 3][0][7] == 1
    assert all(g[5] is None for g in got if g[0] == 2)
    assert C.conversations(df.limit(0)).count() == 0


def test_long_chain_and_repeated_line(spark):
    rows = [(7, t, "u", (f"> m{t - 1}\n" if t else "") + f"m{t}\nsame line") for t in range(70)]
    rows += [(8, t, "u", "> same\nsame") for t in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in C.conversations(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_table(spark):
    df = table(spark, SF01, "conversations")
    got = [tuple(r) for r in C.conversations(df).collect()]
    assert sorted(got, key=str) == sorted(brute([tuple(r) for r in df.collect()]), key=str)


def test_stretches_cut_one_hot_line_at_rows(spark, monkeypatch):
    """Messages without a conversation and turn that all own and quote one line: stretches
    hold about as many rows each, and the answers are those of a scan."""
    n = 3000
    own = spark.range(n).select(F.lit("null").alias("cid"), F.lit(None).cast("long").alias("turn"),
                                F.encode(F.lpad(F.col("id").cast("string"), 6, "0"), "utf-8").alias("mid"), F.lit(b"u").alias("unit"))
    asked = own.filter("cast(cast(mid as string) as long) % 3 = 0").withColumn("tag", F.lit(1)).unionByName(
        own.limit(5).withColumn("unit", F.lit(b"v")).withColumn("tag", F.lit(2)))
    sizes, write = [], C.written

    def spy(df):
        out = write(df)
        if "part" in df.columns:
            sizes.extend(r["count"] for r in out.groupBy("part").count().collect())
        return out

    monkeypatch.setattr(C, "written", spy)
    got = C.latest_before(own.union(own), asked, ["cid", "unit"], 500).collect()
    assert len(sizes) == 9 and max(sizes) < 3 * sorted(sizes)[4]
    assert {(int(r.mid), int(r.found.mid)) for r in got} == {(i, i - 1) for i in range(3, n, 3)}
    assert all(r.tag == 1 and r.found.turn is None for r in got)
    assert C.latest_before(own.limit(0), asked, ["cid", "unit"], 500).count() == 0
    assert C.latest_before(own, asked.limit(0), ["cid", "unit"], 500).count() == 0
