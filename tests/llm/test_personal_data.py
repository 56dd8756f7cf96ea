"""Personal data against the patterns of the contract, and the spans that the method adds."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tidewick.llm import personal_data  # noqa: E402
from tidewick.llm.personal_data import BASE, KINDS, find_spans  # noqa: E402


def base(text):
    return [x for x in find_spans(text) if x[1] < BASE]


@settings(max_examples=600, deadline=None)
@given(st.one_of(*(st.text(alphabet=a, max_size=80) for a in ("01.", "0123456789 -+().", "ab@.1-_+ é", "4 1-", "@.+0"))))
def test_base_spans_are_those_of_the_patterns(text):
    assert base(text) == brute.personal(text)


def test_base_spans_of_long_texts():
    rnd = random.Random(4)
    for unit in ("1.", "1 ", "a@", "a@b.", "+1 ", "4111 1111 1111 1111 ", "192.168.0.1.", "é@é.é "):
        text = unit * 300 + rnd.choice(("", "x@y.de"))
        assert base(text) == brute.personal(text)
        assert len(find_spans(unit * 40_000)) < 100_000  # in linear time


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("write to müller@firma.de now", "mail", "müller@firma.de"),
        ("at josé@exämple.org, or", "mail", "josé@exämple.org"),
        ("see https://bob:secret@host.example/x", "login", "bob:secret"),
        ("on http://[2001:db8::1]:80/", "ipv6", "2001:db8::1"),
        ("IBAN: DE89 3704 0044 0532 0130 00, thanks", "account", "DE89 3704 0044 0532 0130 00"),
        ("account no. GB82WEST12345698765432", "account", "GB82WEST12345698765432"),
    ],
)
def test_added_spans(text, kind, found):
    assert found in [text[s:e] for s, k, e in find_spans(text) if KINDS[k] == kind]


@pytest.mark.parametrize("text", ["IBAN DE89370400440532013001", "http://[1:2]/", "a@b", "version 1.2.3", "call 555-1234", "é@é", "konto offen", "4111111111111112"])
def test_what_fails_its_check_is_no_span(text):
    assert find_spans(text) == []


def test_op12(spark, tmp_path):
    texts = [None, "", "mail a.b@c.de or +49 (30) 1234-5678 x", "10.0.0.1 and 4111 1111 1111 1111", "x" * 3_000 + " é@ü.de a@b.co", "plain"] * 3
    rows = [(i // 2 if i % 5 else None, t, "de", "s", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, spans string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in personal_data.op12_personal_data(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        found = brute.personal(t or "")
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
        all_ = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in find_spans(t or ""))
        want.append((i, *(sum(x[1] == k for x in found) for k in range(4)), brute.sha(joined.encode()), all_))
    assert got == sorted(want, key=str)
    # other columns stay, those with a result's name give way
    general = personal_data.find_personal_data(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert general.columns == ["doc_id", "lang", "n_chars", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def test_masking(spark):
    docs = spark.createDataFrame([(1, "to a@b.de or müller@firma.de!", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, TEXT_ string")
    out = personal_data.mask_personal_data(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "to ****** or ***************!", 2: None, 3: ""}
