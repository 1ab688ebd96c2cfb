"""Personal data in texts: patterns propose spans, checksums confirm, nearby words adjust the score.

Emails, internet addresses, card and phone numbers are the base kinds; a base span
that passes its check always stays and context only moves its score. The added
kinds (bank accounts by mod 97, social security numbers, credentials after a
naming word) stay only with a score of at least ``KEEP``.

Every pattern is anchored where a run of its own characters begins, so the time
is linear in the text, however long a run of digits or letters is. Texts are
searched whole. A NULL text is searched as an empty one; rows, repeated or not, are
independent of each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "credential")
KEEP = 0.5
NEAR = 40  # code points before and after a span in which context words count

DIGIT = re.compile("[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
CREDENTIAL = re.compile(r"(?<![^\W_])(?ai:password|passwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_/+-]{12,}+)")

#: Score of a span before its surroundings are looked at, and the words that raise it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "credential": 0.5}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "insurance"),
    "credential": ("login", "user", "access", "key"),
}
AGAINST = {"ip": ("version", "release"), "card": ("order", "serial", "isbn"), "ssn": ("order", "part")}

#: Characters of an account by country.
ACCOUNT_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
        31: "MT SC", 32: "LC",
    }.items()
    for country in countries.split()
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """From each start the end at a token border for which mod 97 holds: of the country's length, or else the furthest.

    The search goes on behind an account, and right behind the first four characters of a start that no end confirms.
    """
    m = IBAN.search(text)
    while m:
        tokens = m[0].split(" ")
        after = text[m.end() : m.end() + 1]
        if after.isascii() and after.isalnum():
            tokens.pop()
        ends, end, account = {}, m.start() - 1, ""
        for token in tokens:
            end, account = end + 1 + len(token), account + token
            if 15 <= len(account) <= 34:
                ends[end] = account
        order = sorted(ends, key=lambda end: (len(ends[end]) != ACCOUNT_LENGTHS.get(m[0][:2]), -end))
        found = next((end for end in order if mod97(ends[end])), None)
        if found:
            yield m.start(), found
        m = IBAN.search(text, found or m.start() + 4)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each @: the run of name characters before it, then the domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        else:
            free = max(free, at + 1)  # nothing before this @ can belong to a later match
        at = text.find("@", free)


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if len(m[0]) >= 12:
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in accounts(text):
        yield "iban", start, end
    if "-" in text:
        for m in SSN.finditer(text):
            yield "ssn", m.start(), m.end()


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that a pattern proposes and its check confirms."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    if DIGIT.search(text):
        yield from _numbers(text)
    if "=" in text or ":" in text:
        for m in CREDENTIAL.finditer(text):
            yield "credential", m.start(1), m.end(1)


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text by start, then by kind as listed in ``KINDS``."""
    text = text or ""
    found = []
    for kind, start, end in _proposed(text):
        near = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()
        score = PRIOR[kind] + 0.2 * any(w in near for w in CONTEXT[kind])
        score = min(1.0, max(0.0, score - 0.3 * any(w in near for w in AGAINST.get(kind, ()))))
        if kind in BASE or score >= KEEP:
            found.append(Span(kind, start, end, round(score, 2)))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def pii_spans(text: Column) -> Column:
    """Array of (kind, start, end, score) in code points, end exclusive."""

    @F.pandas_udf("array<struct<kind: string, start: int, end: int, score: double>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s._asdict() for s in find_spans(t)])

    return run(text)


def span_digests(text: Column) -> Column:
    """Struct of the counts by base kind, the digest of the base spans and all spans as text."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spans = find_spans(t)
            base = [s for s in spans if s.kind in BASE]
            counts = [sum(s.kind == k for s in base) for k in BASE]
            rows.append((*counts, sha256(joined(base).encode()).hexdigest(), joined(spans)))
        columns = [*(f"n_{k}" for k in BASE), "base_sha256", "spans"]
        return pd.DataFrame(rows, columns=columns)

    return run(text)
