"""Texts of any length: no pattern may recurse, and no step may be quadratic in the text."""

import hashlib

import brute
import pytest

from ledgerloom.llm import pii

N = 200_000
EMAIL, PHONE = 0, 3
_DIGITS = "".join(str(i % 10) for i in range(N))

#: Text and its base spans, which can be told by looking: a plain regular expression takes quadratic time for some.
LONG = {
    "domain": ("x a@" + "b." * N + "c y", [(2, EMAIL, 5 + 2 * N)]),
    "domain_dots": ("x a@" + "b." * N + ".c y", [(2, EMAIL, 3 + 2 * N)]),
    "local": ("a" * N + "@b.c " + "a." * N, [(0, EMAIL, N + 4)]),
    "addresses": ("256." * N + "1", []),
    "digits": (_DIGITS, []),
    "grouped": ("4 " * N, []),
    "pluses": ("+" * N + "44 20 7946 0958" + "+" * N, [(N - 1, PHONE, N + 15)]),
    "phone": ("+1" + "(2) " * N + "3", []),
    "symbols": ("x" + "-" * N + "12345" + "=" * N + "z", []),
    "run": ("(1)-" * 3 + "1-2 " * N + "x", []),
    "letters": ("é" * N + " a.b+c@d-e.org", [(N + 1, EMAIL, N + 14)]),
}


@pytest.fixture(scope="module")
def long_frame(spark):
    rows = [(k, t) for k, (t, _) in enumerate(LONG.values())]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def test_long_parts(long_frame):
    want = [brute.rendered(spans) for _, spans in LONG.values()]
    got = pii.find_personal_data(long_frame).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.base_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest(), list(LONG)[r.doc_id]
        assert set(filter(None, want[r.doc_id].split(","))) <= set(r.spans.split(","))


def test_redaction_of_long_parts(long_frame):
    cases = list(LONG.values())
    for r in pii.redact(long_frame).collect():
        text, spans = cases[r.doc_id]
        if spans:
            assert r.text == brute.redacted(text, spans), list(LONG)[r.doc_id]


def test_many_spans_in_one_text(spark):
    text = " ".join(f"é{i} mail jo{i}@m{i}.org and +44 20 7946 {i:04}é" for i in range(9_000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert got[1].spans == brute.rendered(brute.base_spans(text)) and got[1].n_email == 9_000
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean == {1: brute.redacted(text, brute.base_spans(text)), 2: None, 3: ""}
