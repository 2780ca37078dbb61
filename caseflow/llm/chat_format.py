"""Chat formatting by quotation linking.

Messages are parsed into own text and quoted passages: a quoted passage is a
maximal run of lines with the same number of leading ``>`` marks. Passages are
normalised (marks off, white space collapsed, lower case) and hashed as a whole,
by paragraph and by line; so is every message's own text. A quoted unit links to
the latest earlier message of the conversation that has it as own text; a
message replies to the link of its shallowest, then longest quoted unit, then to
the latest. Replies form threads, found by pointer jumping over the replies
alone. The result is one row per message without its quotes, in reply order:
conversation, first message of the thread, turn.

"Latest earlier" is the last owner before a quote in the order of conversation, unit,
turn and message. That order is cut into stretches of about ``STRETCH`` rows wherever
they fall, and the last owner of each stretch (one row) is handed on to the next, so
neither a long conversation that repeats a line nor rows without a conversation or
turn are a single task.

Defined results: null texts count as empty; null turns come first; rows with a
null conversation form one conversation of their own; equal rows are one message
and each gets its result; messages of equal turn are ordered by their hash; a
message never replies to itself or to a later one; text without quotes is left
as it is, however long; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import small_batches, written

# Rows of one stretch: about what a task sorts.
STRETCH = 500_000

_MARKS = re.compile(r"((?:[ \t]*>)+)[ \t]?")
_SPACES = re.compile(r"\s+")
# Lines that introduce a quotation (fixed words of mail programs).
_INTRO = re.compile(r"(?:On\b.*\bwrote|Am\b.*\bschrieb\b.*|Le\b.*\ba écrit|El\b.*\bescribió)\s*:\s*")


def _normal(lines: list[str]) -> str:
    return _SPACES.sub(" ", " ".join(lines)).strip().lower()


def _units(lines: list[str]) -> list[str]:
    """The whole, its paragraphs and its lines, normalised, without repeats."""
    out, para = [_normal(lines)], []
    for x in [*lines, ""]:
        if x.strip():
            para.append(x)
            out.append(_normal([x]))
        elif para:
            out.append(_normal(para))
            para = []
    return list(dict.fromkeys(u for u in out if u))


def parse(text: str | None) -> tuple[str, list[str], list[tuple[int, str]]]:
    """(text without quotes, units of the own text, (depth, unit) of quoted passages)."""
    text = text or ""
    lines = []
    for x in text.split("\n"):
        m = _MARKS.match(x)
        lines.append((m.group(1).count(">"), x[m.end():]) if m else (0, x))
    if not any(d for d, _ in lines):
        return text, _units([x for _, x in lines]), []
    own, runs = [], []
    for i, (d, x) in enumerate(lines):
        if d == 0:
            if not (i + 1 < len(lines) and lines[i + 1][0] and _INTRO.fullmatch(x)):
                own.append(x)
        elif i and lines[i - 1][0] == d:
            runs[-1][1].append(x)
        else:
            runs.append((d, [x]))
    quoted = list(dict.fromkeys((d, u) for d, run in runs for u in _units(run)))
    return "\n".join(own).strip("\n"), _units(own), quoted


def parsed(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, cid, mid, text, own, quotes; written."""
    src = messages.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                          F.col(role).alias("role"), F.col(text).alias("text"))
    schema = T.StructType([src.schema["conv_id"], src.schema["turn"], src.schema["role"],
                           T.StructField("cid", T.StringType()), T.StructField("mid", T.BinaryType()),
                           T.StructField("text", T.StringType()), T.StructField("own", T.ArrayType(T.BinaryType())),
                           T.StructField("quotes", T.ArrayType(T.StructType([
                               T.StructField("depth", T.IntegerType()), T.StructField("size", T.IntegerType()),
                               T.StructField("unit", T.BinaryType())])))])

    def run(batches):
        import hashlib

        import pyarrow as pa

        def digest(*parts):
            h = hashlib.blake2b(digest_size=16)
            for p in parts:
                b = b"" if p is None else b"+" + str(p).encode("utf-8", "surrogatepass")
                h.update(len(b).to_bytes(8, "little") + b)
            return h.digest()

        quote = pa.struct([("depth", pa.int32()), ("size", pa.int32()), ("unit", pa.binary())])
        for b in small_batches(batches, "text"):
            cid, mid, clean, own, quotes = [], [], [], [], []
            for r in b.to_pylist():
                t, o, q = parse(r["text"])
                cid.append("null" if r["conv_id"] is None else f"={r['conv_id']}")
                mid.append(digest(r["conv_id"], r["turn"], r["role"], r["text"]))
                clean.append(t)
                own.append([digest(u) for u in o])
                quotes.append([{"depth": d, "size": len(u), "unit": digest(u)} for d, u in q])
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), b.column("role"), pa.array(cid, pa.string()),
                 pa.array(mid, pa.binary()), pa.array(clean, pa.string()), pa.array(own, pa.list_(pa.binary())),
                 pa.array(quotes, pa.list_(quote))], names=schema.names)

    return written(src.mapInArrow(run, schema))


def latest_before(own: DataFrame, asked: DataFrame, keys: list, stretch: int = STRETCH) -> DataFrame:
    """``asked`` with ``found`` = the largest (turn, mid) struct of ``own`` with the same
    keys and a smaller (turn, mid); rows without one are dropped.

    Stretches are range partitions of ``stretch`` rows, written once; what a stretch hands
    on is its last owner with its keys, which counts for the next one's first keys if
    they are the same."""
    at = F.struct("turn", "mid")
    asking = F.struct(*asked.columns)
    rows = written(own.select(*keys, at.alias("at"), F.lit(1).alias("is_own")).distinct()
                   .withColumn("row", F.lit(None).cast(asked.select(asking).schema[0].dataType))
                   .unionByName(asked.select(*keys, at.alias("at"), F.lit(0).alias("is_own"), asking.alias("row"))))
    parts = max(1, -(-rows.count() // stretch))
    # at one place the asking row comes first: it does not find itself
    order = [*keys, "at", "is_own"]
    cut = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                  .withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()))
    owner = F.when(F.col("is_own") == 1, F.struct(F.struct(*keys).alias("of"), F.col("at").alias("at")))
    w = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    near = cut.withColumn("near", F.last(owner, ignorenulls=True).over(w)).filter("is_own = 0")
    # one row a stretch
    ends = cut.groupBy("part").agg(F.max_by(owner, F.when(F.col("is_own") == 1, F.col("nth"))).alias("end"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("part", F.last("end", ignorenulls=True).over(before).alias("handed"))
    got = near.join(F.broadcast(handed), "part", "left").withColumn("last", F.coalesce("near", "handed"))
    return got.filter(F.col("last.of") == F.struct(*keys)).select("row.*", F.col("last.at").alias("found"))


def replies(messages: DataFrame) -> DataFrame:
    """mid, parent (turn, mid): one row per message that quotes an earlier one."""
    quotes = messages.filter(F.size("quotes") > 0).select("cid", "turn", "mid", F.explode("quotes").alias("q")) \
        .select("cid", "turn", "mid", F.col("q.depth").alias("depth"), F.col("q.size").alias("size"),
                F.col("q.unit").alias("unit")).distinct()
    asked = quotes.select("cid", "unit").distinct()
    own = messages.select("cid", "turn", "mid", F.explode("own").alias("unit")).join(asked, ["cid", "unit"], "left_semi")
    found = latest_before(own, quotes, ["cid", "unit"])
    best = F.struct((-F.col("depth")).alias("d"), F.col("size").alias("s"), F.col("found").alias("f"))
    return found.groupBy("mid").agg(F.max(best).alias("b")).select("mid", F.col("b.f").alias("parent"))


def threads(reply: DataFrame) -> DataFrame:
    """mid, parent, root (turn, mid of the thread's first message), depth: pointer
    jumping, one round per doubling of the longest reply chain."""
    now = written(reply.select("mid", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select(F.col("mid").alias("up"), F.col("root").alias("over"), F.col("depth").alias("more"))
        new = written(now.join(up, F.col("root.mid") == F.col("up"), "left")
                      .select("mid", "parent", F.coalesce("over", "root").alias("root"),
                              (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                              F.col("up").isNotNull().alias("moved")))
        now = new.drop("moved")
        if not new.filter("moved").take(1):
            return now


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """One row per message in reply order: conv_id, turn, role, text (without
    quotes), n_quotes (quoted units), reply_to (turn), thread (turn of its first
    message), depth (replies above it)."""
    m = parsed(messages, conv, turn, role, text)
    t = threads(replies(m))
    out = m.select("conv_id", "turn", "role", "text", "mid", F.size("quotes").cast("long").alias("n_quotes")) \
           .join(t, "mid", "left")
    first = F.coalesce("root", F.struct("turn", "mid"))
    return (out.withColumn("first", first)
            .orderBy("conv_id", "first", "turn", "mid")
            .select("conv_id", "turn", "role", "text", "n_quotes", F.col("parent.turn").alias("reply_to"),
                    F.col("first.turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth")))
