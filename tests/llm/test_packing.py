"""Packing against the tokenizer run on whole texts, and a plain cut of the stream."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF001
from tokenizers import Tokenizer

from caseflow.llm import packing
from caseflow.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_ids(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [np.array(e.ids + [2], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(spark, docs, window):
    rows = packing.piece_digests(packing.pack(docs, PATH, window=window)).collect()
    src = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    ids = dict(zip([d for d, _ in src], brute_ids([t for _, t in src])))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(ids[d][at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids[d])
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or s == max(by_seq) and at <= window
    assert set(by_seq) == set(range(len(by_seq)))


def test_pack_whole_table(spark):
    check(spark, table(spark, SF001, "documents").repartition(5), 4096)


@pytest.mark.parametrize("window", [1, 7, 4096])
def test_pack_odd_texts(spark, window):
    texts = [None, "", " ", "a b c\x1cd", "́x é ΑΣ ΣΑΣ. It's don't", "x" * 3000, "ab " * 3000,
             "<|endoftext|> <|startoftext|>", "İstanbul\t\ttab\x0b\x0c\r\n", "same", "same", "日本語テキスト 123 4567",
             "it's WE'LL x.y a.B! e\u0301tude cafe\u0301. naïve-e\u0301 foo### bar!!. 3rd a1 ΣΑΣ, ＡＢ. Ǆ ﬁn 한국어 각.", "ß ẞ, İi."]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    check(spark, docs, window)


def test_pack_empty_and_null_id(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, PATH).count() == 0
    null = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sum(r.length for r in packing.pack(null, PATH).collect()) == 4
