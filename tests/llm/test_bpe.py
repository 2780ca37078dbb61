"""The tree codec against the tiktoken library, ids and round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st

from caseflow.llm import bpe
from caseflow.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODECS = [bpe.Codec(RANKS, public_tokenizers.PATTERN, leaf) for leaf in (1, 8)]


def same(text):
    want = TIK.encode_ordinary(text)
    for c in CODECS:
        got = np.frombuffer(c.encode(text), "<u4").tolist()
        assert got == want
        assert c.decode(got) == text.encode()


@pytest.mark.parametrize("text", [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n\n a\n", "it's we'll 'S", "x\x1cy \x85 z\xa0w", "　日本 語",
    "a" * 5000, " " * 3000, "ab" * 2500 + "!" * 700, "=" * 999 + " " + "-" * 1001, "0123456789" * 300, "éÉß🙂" * 50,
    "The " + "antidisestablishmentarianism" * 40])
def test_known_shapes(text):
    same(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab c\n'se1!é\t zthr "), max_size=120))
def test_any_text(text):
    same(text)


def test_random_bytes_like_words():
    r = random.Random(1)
    for _ in range(300):
        same("".join(r.choice("thereinonation") for _ in range(r.randint(1, 60))))


def test_query_matches_library_on_table(spark):
    docs = table(spark, SF001, "documents")
    got = {r.doc_id: r for r in bpe.round_trip_digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    for r in docs.collect():
        ids = np.array(TIK.encode_ordinary(r.text or ""), "<u4")
        g = got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_frames_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "a b", 0), (2, "", 0)],
                                 "doc_id long, text string, ids int")
    enc = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)
    back = bpe.decode_documents(enc, PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r.text) for r in back.collect()) == [b"", b"", b"", b"a b"]
    assert bpe.round_trip_digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
