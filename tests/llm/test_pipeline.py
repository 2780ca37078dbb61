"""The pipeline against a brute-force version of its five stages."""

import corpus_pipeline
import numpy as np
import public_tokenizers
from conftest import SF001
from test_ngram_join import brute as near_brute
from tokenizers import Tokenizer

from caseflow.llm import pii, quality_rules
from caseflow.llm.common import table


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, model):
    rows = [(i, t) for i, t in rows if quality_rules.passes(quality_rules.Doc(t), quality_rules.RULES)]
    best = {}
    for i, t in rows:
        best[low(t)] = max(i, best.get(low(t), i))
    rows = [(i, t) for i, t in rows if best[low(t)] == i]
    cls = {i: c for i, c, _, _ in near_brute(rows)}
    rows = [(i, t) for i, t in rows if cls[i] == i]
    rows = [(i, pii.redacted(t, pii.all_spans(t, pii.base_spans(t), model))) for i, t in rows]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    return {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in rows}


def test_stages_and_result(spark):
    docs = table(spark, SF001, "documents")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF001)
        assert out.columns == docs.columns, name
        assert out.count() <= seen.count() and out.count() > 0
        seen = out
    rows = docs.select("doc_id", "text").collect()
    before = corpus_pipeline.near(spark, corpus_pipeline.exact(spark, corpus_pipeline.quality(spark, docs, SF001), SF001), SF001)
    want = brute([tuple(r) for r in rows], pii.fit(before))
    got, used = {}, {}
    for r in corpus_pipeline.run(spark, SF001).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length
        got.setdefault(r.doc_id, []).append((r.start, ids))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: sum((x for _, x in sorted(p)), []) for d, p in got.items()} == want
    for s, p in used.items():
        assert sum(n for _, n in p) == 4096 or s == max(used)


def test_empty_and_odd_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, node int")
    odd = spark.createDataFrame(
        [(None, None, None, 1), (1, None, "x", None), (2, "", None, 2), (3, "w " * 200, "en", 3),
         (None, " ".join(f"word{i}" for i in range(80)), "en", 4), (5, " ".join(f"word{i}" for i in range(80)), "en", 4),
         (5, " ".join(f"word{i}" for i in range(80)), "en", 4)], docs.schema)
    for d, rows in ((docs, 0), (odd, 1)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, SF001)
            assert d.columns == docs.columns
        d = corpus_pipeline.STAGES[-1][1](spark, d, SF001)
        n = d.count()
        assert n == rows   # the repeated row is one document
