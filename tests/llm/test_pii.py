"""Base spans against the plain patterns, the model's additions, redaction."""

import hashlib
import random
import re
import time

from conftest import SF001, SF01
from hypothesis import given, settings
from hypothesis import strategies as st

from caseflow.llm import pii
from caseflow.llm.common import table


def brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        dbl = [sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(dbl) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("0123456789.+-() @aZ%é"), max_size=60))
def test_base_spans_any_text(t):
    assert pii.base_spans(t) == brute(t)


def test_base_spans_cards():
    r = random.Random(3)
    for _ in range(2000):
        t = "".join(r.choice("4111 0-5") for _ in range(r.randint(14, 30)))
        assert pii.base_spans(t) == brute(t)
    assert any(k == 2 for _, k, _ in pii.base_spans("card 4111 1111 1111 1111."))


def test_long_runs_are_linear():
    for t in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "a1" * 150_000, "+1 " * 100_000, "a@" * 100_000,
              "1 (" * 100_000, "@" * 200_000):
        base = pii.base_spans(t)
        pii.candidates(t, base)


def test_long_tokens_of_digits_and_signs_are_linear():
    for c in "/_=+-":
        for end in ("", "x"):
            t = f"1{c}" * 150_000 + end
            start = time.time()
            got = pii.candidates(t, pii.base_spans(t))
            assert time.time() - start < 5, c
            if end and c != "-":
                assert (0, 4, len(t)) in got


def candidates_token_by_token(t):
    """Every token of 16 or more letters and digits with both that a digit starts a zone in."""
    return [(m.start(), 4, m.end()) for m in re.finditer(r"[A-Za-z0-9_+/=-]+", t)
            if len(m.group()) >= 16 and re.search(r"[A-Za-z]", m.group()) and re.search(r"[0-9]", m.group())]


def test_tokens_equal_a_plain_search():
    r = random.Random(11)
    for _ in range(2000):
        t = "".join(r.choice("a1/_=+-  .é(") for _ in range(r.randint(0, 80)))
        if not pii.base_spans(t):
            assert [c for c in pii.candidates(t, []) if c[1] == 4] == candidates_token_by_token(t), t


def test_table(spark):
    docs = table(spark, SF01, "documents")
    rows = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    added = 0
    for r in docs.collect():
        want, got = brute(r.text), rows[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        spans = got.spans.split(",") if got.spans else []
        assert set(pii.joined(want).split(",") if want else []) <= set(spans)
        for s in set(spans) - set(pii.joined(want).split(",")):
            kind, a, b = s.split(":")
            added += 1
            assert any(c.isdigit() for c in r.text[int(a):int(b)]) or kind == "email"
        for m in re.finditer(r"token = \"([0-9a-f]{32,})\"", r.text):
            assert f"secret:{m.start(1)}:{m.end(1)}" in spans
        if not any(c.isdigit() or c == "@" for c in r.text):
            assert spans == []
    assert added


def test_odd_rows_and_redaction(spark):
    docs = spark.createDataFrame(
        [(1, None, "k"), (1, None, "k"), (None, "", "k"), (2, "mail a.b@c.org now", None), (3, "token = \"" + "a1b2c3d4" * 5 + "\"", "k")],
        "doc_id long, text string, spans string")
    rows = pii.find_spans(docs).collect()
    assert len(rows) == 5 and sum(r.n_email for r in rows) == 1
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted((r.text or "", r.spans or "") for r in out.collect())[3:] == [
        ("mail [EMAIL] now", ""), ('token = "[SECRET]"', "k")]
    assert pii.find_spans(docs.limit(0)).count() == 0 == pii.redact(docs.limit(0)).count()


def test_em_trusts_the_labeler_that_agrees():
    counts = {"secret|1,1,1,0,1,0|4|2|0": 50, "secret|-1,-1,0,-1,0,0|4|2|0": 50, "secret|1,1,0,0,0,0|4|2|0": 5}
    post = pii.posteriors(counts)
    assert post["secret|1,1,1,0,1,0|4|2|0"] > .9 and post["secret|-1,-1,0,-1,0,0|4|2|0"] < .1


def test_smallest_table_redacts(spark):
    docs = table(spark, SF001, "documents")
    left = [t for r in pii.redact(docs).collect() for t in [r.text] if t and pii.base_spans(t)]
    assert left == []
