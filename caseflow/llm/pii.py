"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and always stand. On
top, wider candidates (tokens of letters and digits, phone numbers without a
plus, digit groups, spelled-out mail addresses) are voted on by regex,
gazetteer and context labelers. Votes of all candidates of all documents are
counted by pattern in Spark (a bounded table); expectation-maximisation
estimates per kind how reliable each labeler is, its posteriors train a
logistic span classifier, and the classifier decides which candidates become
spans. A candidate that touches a base span is dropped.

Defined results: null and empty texts have no spans; texts are searched whole,
in linear time also for one long run of digits or letters; rows are judged each,
repeated or not; without candidates there is no model and only base spans;
an empty table gives an empty result; ``redact`` passes other columns through
untouched, whatever their names, and leaves null texts null.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
EM_ROUNDS = 50
FIT_ROUNDS = 200
THRESHOLD = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_ZONE = re.compile(r"[0-9][0-9 .()-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_TOKEN = re.compile(r"[A-Za-z0-9_+/=-]++")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){1,8}", re.I)
_SPELLED_MARK = re.compile(r"[(\[]at[)\]]", re.I)

# Cue words (gazetteers) looked up left of a candidate.
CUES = {
    "secret": {"token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "bearer", "credential"},
    "phone": {"phone", "tel", "telephone", "call", "fax", "mobile", "cell", "telefon", "teléfono", "téléphone"},
    "card": {"card", "visa", "mastercard", "amex", "iban", "account", "karte", "tarjeta", "carte"},
    "email": {"mail", "email", "contact", "write", "correo", "courriel"},
}
ANTI_CUES = {"version", "page", "chapter", "section", "isbn", "issn", "doi", "figure", "table", "order", "item",
             "license", "licensed", "volume", "vol", "no", "nr", "commit", "sha", "md5"}


def luhn(digits: str) -> bool:
    s = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        s += d
    return s % 10 == 0


def _emails(t: str):
    last, at = 0, t.find("@")
    while at >= 0:
        s = at
        while s > last and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, at + 1) if s < at else None
        if m:
            last = m.end()
            yield s, last
        at = t.find("@", max(last, at + 1))


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted. ip, card and phone live inside maximal runs of
    digits and separators, so the text is searched once for such runs."""
    out = [(s, 0, e) for s, e in _emails(t)]
    for z in _ZONE.finditer(t):
        a, run = z.start(), z.group()
        if run.count(".") >= 3:
            for m in _IP.finditer(run):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    out.append((a + m.start(), 1, a + m.end()))
        if len(run) >= 14:
            for m in _CARD.finditer(run):
                d = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((a + m.start(), 2, a + m.end()))
        if a and t[a - 1] == "+":
            body = run.rstrip(" .()-")
            if len(body) >= 3 and 10 <= sum(map(str.isdigit, body)) <= 15:
                out.append((a - 1, 3, a + len(body)))
    out.sort()
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# -- candidates and labelers

def candidates(t: str, base) -> list[tuple[int, int, int]]:
    """(start, kind, end) of wider shapes that touch no base span."""
    out, skip, seen = [], 0, 0
    for z in _ZONE.finditer(t):
        a = z.start()
        if a < skip:
            continue
        if a >= seen:       # a token is looked at once, from its first zone
            s = a
            while s > seen and (t[s - 1].isascii() and t[s - 1].isalnum() or t[s - 1] in "_+/=-"):
                s -= 1
            seen = e = _TOKEN.match(t, a).end()
            tok = t[s:e]
            if len(tok) >= 16 and any(c.isalpha() for c in tok):
                out.append((s, 4, e))
                skip = e
                continue
        run = z.group().rstrip(" .()-")
        digits = sum(map(str.isdigit, run))
        if a and t[a - 1] == "(":
            a -= 1
        if 13 <= digits <= 19 and not set(run) & set(".()"):
            out.append((a, 2, z.start() + len(run)))
        elif 7 <= digits <= 15 and set(run) & set(" -()") and (not a or t[a - 1] != "+"):
            out.append((a, 3, z.start() + len(run)))
    if "at" in t and _SPELLED_MARK.search(t):
        out += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(t)]
    if out and base:
        out.sort()
        keep, j = [], 0
        ends = sorted((s, e) for s, _, e in base)
        for c in out:
            while j < len(ends) and ends[j][1] <= c[0]:
                j += 1
            if j == len(ends) or ends[j][0] >= c[2]:
                keep.append(c)
        out = keep
    return sorted(out)


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def votes(t: str, c) -> tuple[int, ...]:
    """Votes of the labelers on a candidate: 1 personal, -1 not, 0 abstains."""
    s, k, e = c
    span, kind = t[s:e], KINDS[k]
    digits = "".join(filter(str.isdigit, span))
    left = t[max(0, s - 32):s].lower()
    words = re.findall(r"[^\W\d_]+", left)
    near = words[-3:]
    # regex labelers
    if kind == "secret":
        shape = 1 if re.fullmatch(r"[0-9A-Fa-f]{32,}|[A-Za-z0-9_-]{20,}", span) else -1
        check = 1 if _entropy(span[:256]) > 3 else -1
    elif kind == "card":
        shape = 1 if len(digits) in (15, 16) and digits[0] in "3456" else -1
        check = 1 if luhn(digits) else -1
    elif kind == "phone":
        shape = 1 if re.fullmatch(r"\(?[0-9]{2,4}\)?[ -][0-9]{3,4}[ -][0-9]{3,4}", span) else -1
        check = 1 if 10 <= len(digits) <= 12 else -1
    else:
        shape = 1 if re.search(r"(?:\.|dot[)\]]) ?[A-Za-z]{2,6}$", span) else -1
        check = 1 if re.search(r"[(\[]dot[)\]]", span, re.I) else 0
    # gazetteer labelers
    cue = 1 if CUES[kind] & set(near) else 0
    anti = -1 if ANTI_CUES & set(near) else 0
    # context labelers
    lead = left.rstrip()[-1:]
    assigned = 1 if lead in ("=", ":") or lead in ("\"", "'") and left.rstrip()[-4:-1].strip()[-1:] in ("=", ":") else 0
    alone = -1 if t[e:e + 1].isalnum() or t[max(0, s - 1):s].isalnum() else 0
    return shape, check, cue, anti, assigned, alone


def features(t: str, c, v) -> str:
    """Kind, votes and span shape as one key; the keys are a bounded set."""
    span = t[c[0]:c[2]]
    digits = sum(map(str.isdigit, span))
    return "|".join([KINDS[c[1]], ",".join(map(str, v)), str(min(5, len(span) // 8)), str(digits * 4 // len(span)),
                     str(int(any(x in " -." for x in span)))])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def vote_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key, n over the candidates of all documents."""
    def run(batches):
        import pyarrow as pa
        got = Counter()
        for b in small_batches(batches, "text"):
            for t in b.column("text").to_pylist():
                if t:
                    for c in candidates(t, base_spans(t)):
                        got[features(t, c, votes(t, c))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())],
                                         names=["key", "n"])

    return (docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key string, n long")
            .groupBy("key").agg(F.sum("n").alias("n")))


# -- the model: from the counts alone, on the driver

def _votes_of(key: str) -> tuple[int, ...]:
    return tuple(map(int, key.split("|")[1].split(",")))


def posteriors(counts: dict[str, int], rounds: int = EM_ROUNDS) -> dict[str, float]:
    """Per key the probability of personal data: EM over labeler reliabilities, by kind."""
    out = {}
    for kind in KINDS:
        own = {k: n for k, n in sorted(counts.items()) if k.startswith(kind + "|")}
        if not own:
            continue
        v = {k: _votes_of(k) for k in own}
        post = {k: 1 / (1 + math.exp(-sum(v[k]))) for k in own}   # start: the plain vote
        for _ in range(rounds):
            pos = sum(n * post[k] for k, n in own.items())
            total = sum(own.values())
            prior = (pos + 1) / (total + 2)
            width = len(next(iter(v.values())))
            table = []
            for j in range(width):
                # a labeler is assumed better than chance: pseudo-counts lean its way
                hit = {x: [1.0 + (x < 0), 1.0 + (x > 0)] for x in (-1, 0, 1)}
                for k, n in own.items():
                    hit[v[k][j]][1] += n * post[k]
                    hit[v[k][j]][0] += n * (1 - post[k])
                sums = [sum(h[i] for h in hit.values()) for i in (0, 1)]
                table.append({x: (h[0] / sums[0], h[1] / sums[1]) for x, h in hit.items()})
            for k in own:
                z = math.log(prior / (1 - prior)) + sum(math.log(table[j][x][1] / table[j][x][0])
                                                        for j, x in enumerate(v[k]))
                post[k] = 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
        out |= post
    return out


def _vector(key: str) -> list[str]:
    kind, vs, size, share, sep = key.split("|")
    return [f"{kind}", f"{kind}:len{size}", f"{kind}:dig{share}", f"{kind}:sep{sep}"] + \
           [f"{kind}:v{j}={x}" for j, x in enumerate(vs.split(","))]


def train(counts: dict[str, int], rounds: int = FIT_ROUNDS) -> dict[str, float]:
    """Weights of the final classifier: logistic regression on the posteriors, each
    key weighed by the square root of its count, by gradient steps."""
    post = posteriors(counts)
    keys = sorted(post)
    vec = {k: _vector(k) for k in keys}
    weight = {k: math.sqrt(counts[k]) for k in keys}
    total = sum(weight.values()) or 1.0
    w: Counter = Counter()
    for _ in range(rounds):
        step: Counter = Counter()
        for k in keys:
            p = 1 / (1 + math.exp(-sum(w[f] for f in vec[k])))
            for f in vec[k]:
                step[f] += weight[k] * (post[k] - p)
        for f, g in step.items():
            w[f] += 2.0 * g / total - 1e-4 * w[f]
    return dict(w)


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """key -> probability for every key met in the documents (a bounded table)."""
    counts = {r["key"]: r["n"] for r in vote_counts(docs, text_col).collect()}
    w = train(counts)
    return {k: 1 / (1 + math.exp(-sum(w.get(f, 0.0) for f in _vector(k)))) for k in counts}


def all_spans(t: str, base, model: dict[str, float], threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    more = [c for c in candidates(t, base) if model.get(features(t, c, votes(t, c)), 0.0) >= threshold] if model else []
    return sorted([*base, *more])


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               model: dict[str, float] | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans (all)."""
    model = fit(docs, text_col) if model is None else model
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]
                          + [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS]
                          + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        import pyarrow as pa
        for b in small_batches(batches, "text"):
            n, sha, said = [[] for _ in BASE_KINDS], [], []
            for t in b.column("text").to_pylist():
                base = base_spans(t) if t else []
                for k, to in enumerate(n):
                    to.append(sum(1 for s in base if s[1] == k))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                said.append(joined(all_spans(t, base, model)) if t else "")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in n],
                                              pa.array(sha, pa.string()), pa.array(said, pa.string())], names=schema.names)

    return _texts(docs, id_col, text_col).mapInArrow(run, schema)


def redacted(t: str, spans) -> str:
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [t[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, t[at:]])


def redact(docs: DataFrame, text_col: str = "text", model: dict[str, float] | None = None) -> DataFrame:
    """``docs``, all columns, each span in the text replaced by its kind in brackets."""
    model = fit(docs, text_col) if model is None else model

    def run(batches):
        import pyarrow as pa
        for b in small_batches(batches, text_col):
            new = [redacted(t, all_spans(t, base_spans(t), model)) if t else t for t in b.column(text_col).to_pylist()]
            i = b.schema.get_field_index(text_col)
            yield b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
