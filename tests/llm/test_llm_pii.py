import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendlens.llm import pii

# The plain patterns, searched without any help.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn_by_table(digits):
    doubled = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(doubled[int(d)] if i % 2 else int(d) for i, d in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    text = text or ""
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", CARD, 12, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or luhn_by_table(digits)):
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.BASE.index(s[0])))


def base(text):
    return [(s.kind, s.start, s.end) for s in pii.find_spans(text) if s.kind in pii.BASE]


PARTS = ["a.b", "@", "@x.org", "x-1.de", ".", "+", "-", " ", "(0)", "4111 1111 1111 1111", "4111111111111111", "192.168.0.1",
         "256.1.1.1", "1.2.3.4.5", "+49 (30) 123-456", "é", "🙂", "00", "999999999999", "\n", "%", "001.02.3.4"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text("ab0123.@+- ()", max_size=6)), max_size=12).map("".join))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert base(text) == brute(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+" * 300_000, "+1 " + " " * 300_000,
                                  "a." * 100_000 + "@", "A1" * 150_000, "0" * 5000 + ".1.1.1", "-" * 300_000 + "@a.b"])
def test_long_runs_take_linear_time(text):
    start = time.time()
    pii.find_spans(text)
    assert time.time() - start < 5


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")


def test_added_kinds_need_a_check_or_context():
    kinds = [s.kind for s in pii.find_spans("Account GB82 WEST 1234 5698 7654 32 at the bank")]
    assert "iban" in kinds
    assert "iban" not in [s.kind for s in pii.find_spans("Account GB83 WEST 1234 5698 7654 32 at the bank")]
    assert [s.kind for s in pii.find_spans("social security 123-45-6789")] == ["ssn"]
    assert pii.find_spans("part 123-45-6789") == []
    assert [s.kind for s in pii.find_spans('token = "abcdef123456789"')] == ["credential"]


@pytest.mark.parametrize("text, found", [
    ("DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", ["DE89 3704 0044 0532 0130 00"]),
    ("DE89370400440532013000 EUR 50", ["DE89370400440532013000"]),
    ("DE89370400440532013000 GB82WEST12345698765432", ["DE89370400440532013000", "GB82WEST12345698765432"]),
    ("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32", ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]),
    ("XX12 ABCD DE89 3704 0044 0532 0130 00 X", ["DE89 3704 0044 0532 0130 00"]),
    ("MT84MALT011000012345MTLCAST001S 1", ["MT84MALT011000012345MTLCAST001S"]),
    ("GB82WEST12345698765432a GB82WEST12345698765432A", []),
    ("DE89370400440532013000\u00e9 x", ["DE89370400440532013000"]),
    ("NO9386011117947", ["NO9386011117947"]),
])
def test_accounts_beside_capitals_and_numbers(text, found):
    assert [text[s.start : s.end] for s in pii.find_spans(text) if s.kind == "iban"] == found


def test_the_country_tells_the_length_of_an_account():
    account = "DE89 3704 0044 0532 0130 00"
    by_chance = next(f"{account} {i:04d}" for i in range(10_000) if pii.mod97(f"{account}{i:04d}".replace(" ", "")))
    assert [by_chance[s.start : s.end] for s in pii.find_spans(by_chance) if s.kind == "iban"] == [account]


@pytest.mark.parametrize("before", ["token=", "API_KEY=", "Password: ", "db_password=", "x-secret = '", "MY_API_KEY: \"", "\u00e9 Token="])
@pytest.mark.parametrize("size", [12, 256, 400, 5000])
def test_credentials_are_whole_whatever_their_name_looks_like(before, size):
    text = f"{before}{'aB3/' * (size // 4)} end"
    found = [(s.start, s.end) for s in pii.find_spans(text) if s.kind == "credential"]
    assert found == [(len(before), len(before) + size)]


@pytest.mark.parametrize("text", ["mytoken=abcdefghijkl", "2token=abcdefghijkl", "\u00e9token=abcdefghijkl", "token=abcdefghijk", "to\u212aen=abcdefghijkl"])
def test_other_words_name_no_credential(text):
    assert pii.find_spans(text) == []


@pytest.mark.parametrize("text", ["token=" + "a" * 300_000, "token=" * 60_000, "token_" * 60_000 + "=", "token=a " * 40_000])
def test_long_credentials_take_linear_time(text):
    start = time.time()
    pii.find_spans(text)
    assert time.time() - start < 5


def test_many_account_starts_take_linear_time():
    start = time.time()
    pii.find_spans("AB12 " * 60_000)
    assert time.time() - start < 5


def test_context_moves_the_score_but_drops_no_base_span():
    near, far, against = (pii.find_spans(f"{w} 4111111111111111")[0].score for w in ("credit card", "xx", "order"))
    assert near > far > against


def test_query_columns(spark, documents, odd_rows):
    text = "x@y.org, 10.0.0.1 and +1 (555) 123-4567 🙂 4111 1111 1111 1111"
    df = documents([*odd_rows, (50, text), (50, text)], extra=True)
    got = df.select("doc_id", "text", pii.span_digests(F.col("text")).alias("f")).select("doc_id", "text", "f.*").collect()
    assert len(got) == len(odd_rows) + 2
    for r in got:
        spans = brute(r.text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert r.base_sha256 == digest
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        assert set(f"{k}:{a}:{b}" for k, a, b in spans) <= set(r.spans.split(","))
    spans = df.filter("doc_id = 50").select(pii.pii_spans(F.col("text")).alias("s")).first().s
    assert [text[s.start : s.end] for s in spans][0] == "x@y.org"


def test_no_documents(documents):
    assert documents([]).select(pii.span_digests(F.col("text")).alias("f")).collect() == []
