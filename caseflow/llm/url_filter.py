"""URL filters: host word segmentation and naive Bayes behind fixed rules.

1. Host, path and the longest fitting rule are column expressions.
2. Unigrams: words of hosts, paths and page titles of all pages are counted in
   Spark. The counts stay a table.
3. A unigram Viterbi splits the letters of each host label and path part into
   words. Each distinct part is joined with the counts of its substrings; known words
   of more than ``STEM`` letters are found by their first letters, which tell the
   lengths to look up. An unknown piece may have any length.
4. Multinomial naive Bayes over those words. A page teaches "block" if a word of
   its segmented host is one of the seed terms, else "allow"; counts and totals
   are those of all words of all pages, a table that the words of each distinct
   host and path are joined with. Add-one smoothing.
5. A page without a rule is blocked if its log-odds are above zero.

Defined results: null urls and urls without ``://`` have empty host and path, fit
no rule and are allowed by the empty evidence unless the prior says otherwise;
labels longer than any word are split like others, in time linear in their
length; repeated rows are judged each; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions.joins import checked_broadcast
from caseflow.llm.common import lower_ascii, written

# Fixed rules (host with path, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))
# Seed terms of unwanted hosts.
SEEDS = ("adult", "ads", "bet", "bets", "casino", "cheap", "gambling", "pills", "poker", "porn", "sex", "slots",
         "spam", "track", "viagra", "xxx")
SEED_SHARE = 1 / 16  # of all words, added to each seed term: together they weigh as much, at every size
STEM = 24            # substrings up to this length are looked up as they are, longer words by their first letters
GATHERED = 100_000   # substrings with their parts held before they travel


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        h, p = text[:text.index("/")], text[text.index("/"):]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def parts_of(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text.lower())


class Segmenter:
    """Unigram Viterbi over the letters of a name. ``total`` is that of all counts and
    ``least`` the smallest of them if ``counts`` has only some."""

    def __init__(self, counts: dict[str, float], total: float | None = None, least: float | None = None):
        total = total or sum(counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items() if n > 0}
        self.lengths = sorted({len(w) for w in self.cost}, reverse=True)
        # a word not in the list: rarer than any that is, ten times per letter
        least = least or min((n for n in counts.values() if n > 0), default=1)
        self.base, self.per_letter = math.log(total / least) + 1.0, math.log(10)
        self.known: dict[str, tuple[str, ...]] = {}

    def word_cost(self, w: str) -> float:
        got = self.cost.get(w)
        return self.base + self.per_letter * len(w) if got is None else got

    def split(self, s: str) -> tuple[str, ...]:
        got = self.known.get(s)
        if got is not None:
            return got
        n = len(s)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        start, lead = 0, 0.0      # where the best unknown piece starts, its cost without its length
        for j in range(1, n + 1):
            best[j], back[j] = lead + self.base + self.per_letter * j, start
            for k in self.lengths:
                c = self.cost.get(s[j - k:j]) if k <= j else None
                if c is not None and best[j - k] + c < best[j]:
                    best[j], back[j] = best[j - k] + c, j - k
            if best[j] - self.per_letter * j < lead:
                start, lead = j, best[j] - self.per_letter * j
        out, j = [], n
        while j:
            out.append(s[back[j]:j])
            j = back[j]
        got = tuple(reversed(out))
        if n <= 64:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[s] = got
        return got

    def words(self, text: str) -> list[str]:
        return [w for part in parts_of(text) for w in self.split(part)]


def unigrams(pages: DataFrame, seeds=SEEDS) -> tuple[DataFrame, float]:
    """(word, n: words of hosts, paths and titles with their counts over all pages, to
    which each seed adds its share; written), and the sum of n."""
    # a host label or path part counts as a word if a title also has it or if it
    # stands between hyphens; whole concatenated names would never be split
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>([^<]*)", 1)
    spaced = F.regexp_replace(F.col("host"), r"(?:^|(?<=\.))[^.\-]+(?=\.|$)", " ")
    text = F.concat_ws(" ", title, spaced, "path")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    counts = written(words.filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    extra, is_seed = SEED_SHARE * total, F.col("word").isin(list(seeds))
    there = {r["word"] for r in counts.filter(is_seed).collect()}
    rest = pages.sparkSession.createDataFrame([(s, extra) for s in sorted(set(seeds) - there)],
                                              "word string, n double")
    more = counts.select("word", (F.col("n") + F.when(is_seed, extra).otherwise(0.0)).alias("n"))
    return written(more.unionByName(rest)), total + extra * len(set(seeds))


def _named(schema):
    """Adds host_name and path_name: the letter runs of host and path with blanks between."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            cols = [pa.array([" ".join(parts_of(t)) for t in b.column(c).to_pylist()], pa.string())
                    for c in ("host", "path")]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=schema.names)
    return run


def _pieces(batches):
    """Every substring of at most ``STEM`` letters with the parts (ids) that have it, gathered
    over ``GATHERED`` of them, so a substring of very many parts travels as few rows; a part
    may come twice."""
    import pyarrow as pa

    held: dict[str, list[int]] = {}
    many = 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()),
                                           pa.array(list(held.values()), pa.list_(pa.int64()))], names=["word", "ids"])

    for b in batches:
        for part, i in zip(b.column("part").to_pylist(), b.column("part_id").to_pylist()):
            seen: set[str] = set()
            for at in range(len(part)):
                seen.update(part[at:end] for end in range(at + 1, min(len(part), at + STEM) + 1))
                if len(seen) > 20_000 or at == len(part) - 1:
                    for w in seen:
                        held.setdefault(w, []).append(i)
                    many += len(seen)
                    seen.clear()
                if many > GATHERED:
                    yield batch()
                    held.clear()
                    many = 0
    yield batch()


def _long_pieces(batches):
    """part_id with the substrings that start like a known long word and have its length."""
    import pyarrow as pa
    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("part_id", "part", "stem", "lengths")))
        for i, part, stem, lengths in rows:
            at = part.find(stem)
            while at >= 0:
                words = [part[at:at + k] for k in lengths if at + k <= len(part)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(words), pa.int64()), pa.array(words, pa.string())],
                                                 names=["part_id", "word"])
                at = part.find(stem, at + 1)


def _split(total: float, least: float):
    """The words of each part, with blanks between, from the known words in it."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            got = [" ".join(Segmenter({k["word"]: k["n"] for k in known or ()}, total, least).split(part))
                   for part, known in zip(b.column("part").to_pylist(), b.column("known").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(got, pa.string())], names=["part", "words"])
    return run


def split_names(names: DataFrame, counts: DataFrame, total: float) -> DataFrame:
    """name_id, name, words (in order, with blanks between) of each name; written. Each
    distinct part meets the counts of its own substrings, whatever their number."""
    least = counts.agg(F.min("n")).first()[0] or 1.0
    at = names.select("name_id", F.posexplode(F.split("name", " ")).alias("at", "part"))
    parts = written(at.select("part").distinct().withColumn("part_id", F.monotonically_increasing_id()))
    has = "word string, ids array<long>"
    pieces = (parts.mapInArrow(_pieces, has)
              .join(checked_broadcast(counts), "word").select(F.explode("ids").alias("part_id"), "word", "n"))
    long = counts.filter(F.length("word") > STEM)
    stems = written(long.groupBy(F.left("word", F.lit(STEM)).alias("stem"))
                    .agg(F.sort_array(F.collect_set(F.length("word"))).alias("lengths")))
    if stems.take(1):
        starts = (parts.filter(F.length("part") > STEM).mapInArrow(_pieces, has)
                  .withColumnRenamed("word", "stem").join(stems, "stem")
                  .select(F.explode("ids").alias("part_id"), "stem", "lengths").distinct())
        pieces = pieces.unionByName(starts.join(parts, "part_id").select("part_id", "part", "stem", "lengths")
                                    .mapInArrow(_long_pieces, "part_id long, word string")
                                    .join(long, "word").select("part_id", "word", "n"))
    known = pieces.groupBy("part_id").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    split = written(parts.join(known, "part_id", "left").select("part", "known")
                    .mapInArrow(_split(total, least), "part string, words string"))
    words = (at.join(checked_broadcast(split), "part").groupBy("name_id")
             .agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("w"))
             .select("name_id", F.array_join(F.col("w.words"), " ").alias("words")))
    return written(names.join(words, "name_id"))


def train(pages: DataFrame, names: DataFrame, seeds=SEEDS) -> tuple[DataFrame, float]:
    """(word, odd: log-odds of block) of every word of the pages' names, written, and the prior's."""
    words = F.split("words", " ")
    taught = names.filter(F.arrays_overlap(words, F.array(*map(F.lit, seeds)).cast("array<string>"))) \
                  .select(F.col("name").alias("host_name"), F.lit(True).alias("block"))
    pairs = pages.groupBy("host_name", "path_name").agg(F.count(F.lit(1)).alias("n"))
    pairs = written(pairs.join(checked_broadcast(taught), "host_name", "left")
                    .withColumn("bad", F.when(F.col("block"), F.col("n")).otherwise(0)))
    n, b = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    used = (pairs.select(F.col("host_name").alias("name"), "n", "bad")
            .unionByName(pairs.select(F.col("path_name").alias("name"), "n", "bad"))
            .groupBy("name").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    seen = written(used.join(names, "name").select("n", "bad", F.explode(words).alias("word"))
                   .groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    v, all_, bad = seen.agg(F.count(F.lit(1)), F.sum("n"), F.sum("bad")).first()
    v, all_, bad = v or 1, all_ or 0, bad or 0
    good = F.col("n") - F.col("bad")
    odd = F.log((F.col("bad") + 1) / F.lit(float(bad + v))) - F.log((good + 1) / F.lit(float(all_ - bad + v)))
    return written(seen.select("word", odd.alias("odd"))), math.log((b + 1) / (n - b + 1))


def judge_urls(pages: DataFrame, rules=RULES, seeds=SEEDS, id_col: str = "page_id") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_words."""
    src = pages.select(F.col(id_col).alias("page_id"), "url", "html") \
               .withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    flat = src.select("page_id", "host", "path")
    schema = T.StructType([*flat.schema, T.StructField("host_name", T.StringType()),
                           T.StructField("path_name", T.StringType())])
    named = written(flat.mapInArrow(_named(schema), schema))
    names = (named.select(F.col("host_name").alias("name")).unionByName(named.select(F.col("path_name").alias("name")))
             .filter("name <> ''").distinct().withColumn("name_id", F.monotonically_increasing_id()))
    names = split_names(written(names), *unigrams(src, seeds))
    odds, prior = train(named, names, seeds)
    # summed in the order of the words: the same sum in every run
    score = (names.select("name_id", F.posexplode(F.split("words", " ")).alias("at", "word"))
             .join(checked_broadcast(odds), "word").groupBy("name_id")
             .agg(F.sort_array(F.collect_list(F.struct("at", "odd"))).alias("o"))
             .select("name_id", F.aggregate(F.col("o.odd"), F.lit(0.0), lambda x, y: x + y).alias("score")))
    scored = checked_broadcast(written(names.join(score, "name_id").select("name", "words", "score")))
    host = scored.select(F.col("name").alias("host_name"), F.col("words").alias("host_words"),
                         F.col("score").alias("host_score"))
    path = scored.select(F.col("name").alias("path_name"), F.col("score").alias("path_score"))
    total = F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0))
    return (named.join(host, "host_name", "left").join(path, "path_name", "left")
            .withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
            .select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                    F.coalesce("r.verdict", F.when(total > 0, "block").otherwise("allow")).alias("verdict"),
                    F.coalesce("host_words", F.lit("")).alias("host_words")))
