"""Language identification with string kernels.

A text is the set of its letter n-grams (n = 1 to 3, other characters as one gap
symbol), each hashed over its whole code points into one of ``BUCKETS`` buckets, so
letters of every script count alike; the blended-spectrum presence kernel of two
texts is the share of buckets they have in common, |A n B| / sqrt(|A| |B|), over the
buckets that at least two sampled texts have. Kernel ridge regression, one language
against the rest, is fitted in the Nystroem space of some landmark texts. Its
weights fold back onto buckets, so a batch of texts is scored by one product of its
presence matrix with a bucket by language matrix.

The fit uses a bounded sample, drawn by hashes of the text alone, so neither ids nor
the order of rows matter, and equal texts of a language are one: of each language the
``PER_LANGUAGE`` texts with the smallest hashes among those of at most
``SAMPLE_CHARS`` characters; a language with fewer than ``FEW`` of them takes longer
texts, the smallest hashes first, until it has ``FEW``. Texts held out (crc32 of the
id as text, mod 4 = 2; a null id counts as empty text) are never drawn. Tasks turn
the texts into bucket numbers; no text reaches the driver. Of more than ``LANGUAGES``
labels those with most texts are learned, and there are at most ``LANDMARKS``
landmarks, so the fit is bounded whatever the labels hold. All texts are scored whole.

Defined results: null texts and texts without letters are ``und`` with score 0; a
table without any labelled text gives ``und`` throughout; equal scores go to the
first label in alphabetical order; repeated rows are scored each; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import small_batches, worker_cache, written

PER_LANGUAGE = 250
SAMPLE_CHARS = 20_000
FEW = 20
LANGUAGES = 200
LANDMARKS_PER_LANGUAGE = 40
LANDMARKS = 1_200      # of all languages
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
RIDGE = 1e-2
TEMPERATURE = 0.15     # of the softmax that turns margins into scores
BATCH = 64
SLICE = 1_000_000


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(4)) == 2


class Grams:
    """Text -> buckets of its n-grams. A symbol is the code point of a letter, else 0."""

    def __init__(self):
        import numpy as np

        every = np.arange(0x110000)
        letter = np.fromiter((chr(c).isalpha() for c in every), bool, len(every))
        self.symbol = np.where(letter, every, 0).astype("uint64")

    def codes(self, text: str):
        """(buckets with repeats, whether the text has a letter), slice by slice."""
        import numpy as np

        t = text.lower()
        for at in range(0, len(t), SLICE):
            s = self.symbol[np.frombuffer(t[at:at + SLICE + 2].encode("utf-32-le", "surrogatepass"), "<u4")]
            two = (s[:-1] << np.uint64(21)) | s[1:]
            grams = np.concatenate([s, two | np.uint64(1 << 42), (two[:-1] << np.uint64(21) | s[2:]) ^ np.uint64(1 << 63)])
            grams ^= grams >> np.uint64(29)
            grams *= np.uint64(0x9E3779B97F4A7C15)     # multiplicative hashing: the upper bits
            yield (grams >> np.uint64(64 - BUCKET_BITS)).astype("int32"), bool(s.any())

    def set_of(self, text: str):
        """Sorted buckets of a text."""
        import numpy as np

        return np.unique(np.concatenate([np.zeros(0, "int32"), *(np.unique(c) for c, _ in self.codes(text))]))


def _sets(batches):
    import pyarrow as pa
    g = Grams()
    for b in small_batches(batches, "t"):
        got = [g.set_of(t) for t in b.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("l"), b.column("h"), pa.array(got, pa.list_(pa.int32()))],
                                         names=["l", "h", "s"])


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
           lang_col: str = "lang", few: int = FEW) -> list:
    """(lang, buckets) of the labelled sample, in a fixed order."""
    fit = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter(
        F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(docs[id_col])
        & F.col("t").rlike(r"\p{L}"))
    fit = fit.withColumn("h", F.xxhash64("t")).withColumn("long", F.length("t") > SAMPLE_CHARS)
    keys = written(fit.select("l", "long", "h").distinct())   # equal texts of a language are one
    counts = (keys.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("long")).alias("m"))
              .orderBy(F.desc("n"), "l").limit(LANGUAGES).collect())
    if not counts:
        return []

    def below(most: dict) -> Column:
        """Hashes up to those of (language, long)."""
        up_to = F.create_map(*[F.lit(x) for k in sorted(most) for x in (f"{k[1]:d}{k[0]}", most[k])])
        return F.col("h") <= up_to[F.concat(F.col("long").cast("int").cast("string"), "l")]

    wanted = {}
    for r in counts:
        short = r["n"] - r["m"]
        wanted[r["l"], False] = (short, per_language)
        wanted[r["l"], True] = (r["m"], max(0, min(few, per_language) - short))
    wanted = {k: v for k, v in wanted.items() if min(v)}
    # a hash share of four times the wanted number on average holds the smallest ones
    some = keys.filter(below({k: int((1 << 64) * min(1.0, (4 * w + 40) / n)) - (1 << 63) - 1
                              for k, (n, w) in wanted.items()})).collect()
    hashes: dict = {}
    for r in some:
        hashes.setdefault((r["l"], r["long"]), []).append(r["h"])
    last = {k: sorted(h)[:wanted[k][1]][-1] for k, h in hashes.items()}
    rows = fit.filter(below(last)).groupBy("l", "h").agg(F.min("t").alias("t")) \
              .mapInArrow(_sets, "l string, h long, s array<int>").toArrow().to_pylist() if last else []
    return [(r["l"], r["s"]) for r in sorted(rows, key=lambda r: (r["l"], r["h"]))]


def fit(texts: list, landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> dict | None:
    """The model of (lang, buckets) rows: used buckets, bucket by language weights."""
    import numpy as np

    if not texts:
        return None
    sets = [np.asarray(s, "int32") for _, s in texts]
    df = np.zeros(BUCKETS, "int32")
    for s in sets:
        df[s] += 1
    grams = np.flatnonzero(df >= min(2, len(sets)))
    column = np.full(BUCKETS, -1, "int32")
    column[grams] = np.arange(len(grams))
    sets = [c[c >= 0] for c in (column[s] for s in sets)]
    size = np.sqrt([max(1, len(s)) for s in sets])
    langs = sorted({l for l, _ in texts})
    at = {l: k for k, l in enumerate(langs)}
    label = np.array([at[l] for l, _ in texts])
    landmarks = max(1, min(landmarks, LANDMARKS // len(langs)))
    picked = np.concatenate([np.flatnonzero(label == k)[:landmarks] for k in range(len(langs))])
    marks = np.zeros((len(grams), len(picked)), "uint8")
    for j, i in enumerate(picked):
        marks[sets[i], j] = 1
    kernel = np.array([marks[s].sum(0, dtype="int64") for s in sets]) / size[:, None] / size[picked]
    vals, vecs = np.linalg.eigh(kernel[picked])
    good = vals > 1e-8 * vals[-1]
    root = vecs[:, good] / np.sqrt(vals[good])            # K_mm^(-1/2)
    a = np.hstack([kernel @ root, np.ones((len(sets), 1))])
    out = np.empty((a.shape[1], len(langs)))
    reg = np.eye(a.shape[1]) * ridge / len(langs)
    reg[-1, -1] = 1e-9
    # every language weighs the same, and so does each one's rest
    for k in range(len(langs)):
        own = label == k
        w = np.where(own, 0.5 / max(1, own.sum()), 0.5 / max(1, (~own).sum()))
        out[:, k] = np.linalg.solve(a.T @ (a * w[:, None]) + reg, a.T @ (w * np.where(own, 1.0, -1.0)))
    coef = root @ out[:-1] / size[picked][:, None]
    weights = np.vstack([marks[i:i + 4096].astype("float32") @ coef.astype("float32")
                         for i in range(0, max(1, len(grams)), 4096)])
    return {"grams": grams.astype("int32"), "weights": weights, "bias": out[-1].astype("float32"), "langs": langs,
            "key": uuid.uuid4().hex}


class Scorer:
    def __init__(self, model: dict):
        import numpy as np

        self.m, self.g = model, Grams()
        self.column = np.full(BUCKETS, len(model["grams"]), "int32")   # unknown: a last column without weight
        self.column[model["grams"]] = np.arange(len(model["grams"]))
        self.x = np.zeros((BATCH, len(model["grams"]) + 1), "float32")
        self.w = np.vstack([model["weights"], np.zeros((1, model["weights"].shape[1]), "float32")])

    def score(self, texts: list):
        """(language, score) per text."""
        import numpy as np

        out = []
        for at in range(0, len(texts), BATCH):
            part = texts[at:at + BATCH]
            x = self.x[:len(part)]
            x[:] = 0
            letter = np.zeros(len(part), bool)
            for i, t in enumerate(part):
                for codes, any_letter in self.g.codes(t or ""):
                    x[i, self.column[codes]] = 1
                    letter[i] |= any_letter
            x[:, -1] = 0
            norm = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
            margin = (x @ self.w) / norm + self.m["bias"]
            e = np.exp((margin - margin.max(1, keepdims=True)) / TEMPERATURE)
            p = e / e.sum(1, keepdims=True)
            best = margin.argmax(1)
            out += [(self.m["langs"][b], float(p[i, b])) if letter[i] else ("und", 0.0) for i, b in enumerate(best)]
        return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = fit(sample(docs, per_language, id_col, text_col, lang_col))
    src = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                      F.col(text_col).alias("text"))
    schema = T.StructType([src.schema["doc_id"], src.schema["held_out"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    if model is None:
        return src.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)   # at most BUCKETS x LANGUAGES floats

    def run(batches):
        import pyarrow as pa
        cache = worker_cache("language model")
        m = sent.value
        if m["key"] not in cache:
            cache.clear()
            cache[m["key"]] = Scorer(m)
        scorer = cache[m["key"]]
        for b in small_batches(batches, "text"):
            got = scorer.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)
