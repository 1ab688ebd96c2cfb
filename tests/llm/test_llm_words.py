"""Spelling variants, byte-level BPE and lexical search against plain versions of the same."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendlens.llm import bytebpe, lexical, spelling
from spendlens.llm.queries import BYTE_VOCABULARY, op12_byte_bpe

# Spelling variants


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_groups(rows, shortest, least, ratio):
    counts = Counter()
    for doc_id, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= least}
    out, forms = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= ratio * n:
            forms[w] = best
        out[w] = (n, len(others))
    root = {}
    for w in words:
        root[w] = w
        while root[w] in forms:
            root[w] = forms[root[w]]
    return {w: (*out[w], forms.get(w), words.get(forms.get(w)), root[w]) for w in words}


def found_groups(df):
    rows = df.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


def noisy_texts(seed, n, alphabet="abcé", sizes=(2, 6)):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(*sizes))) for _ in range(40)]
    texts = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = base[min(int(rng.expovariate(0.2)), 39)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", rng.choice(alphabet)]) + w[at + rng.randint(0, 1) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append((i if i % 7 else None, " ".join(words) or None))
    return texts


@pytest.mark.parametrize(("shortest", "part"), [(1, 20_000), (1, 6), (3, 20_000), (3, 2), (4, 30)])
def test_spelling_groups_equal_plain_version(documents, shortest, part):
    rows = noisy_texts(shortest + part, 40)
    found = spelling.spelling_groups(documents(rows, extra=True), shortest, 2, 3, part)
    assert found_groups(found) == plain_groups(rows, shortest, 2, 3)


def test_spelling_of_odd_rows(documents, odd_rows):
    found = found_groups(spelling.spelling_groups(documents(odd_rows), 3, 1))
    assert found == plain_groups(odd_rows, 3, 1, 10)
    assert found_groups(spelling.spelling_groups(documents([]))) == {}
    assert found_groups(spelling.spelling_groups(documents([(1, None), (2, "")]))) == {}


def test_spelling_follows_forms_and_breaks_ties(documents):
    # kolibri <- kolibra (10 times rarer) <- kolibrax (10 times rarer again); of two equal ones the smaller is the form
    texts = ["kolibrix"] * 2 + ["kolibri"] * 20 + ["kolibrj"] * 20 + ["kolibr"] * 400
    rows = [(None, t) for t in texts]
    found = found_groups(spelling.spelling_groups(documents(rows), 6, 2))
    assert found == plain_groups(rows, 6, 2, 10)
    if {"kolibrix", "kolibri", "kolibrj", "kolibr"} == set(found):
        assert found["kolibrix"][2:] == ("kolibri", 20, "kolibr")


def test_spelling_of_very_long_words(documents):
    long = "".join(random.Random(5).choice("abcdefgh") for _ in range(20_000))
    rows = [(i, f"{w} {w}") for i, w in enumerate([long, long[:7000] + long[7001:], long[:-1] + "z", "x" + long])]
    found = found_groups(spelling.spelling_groups(documents(rows)))
    assert found == plain_groups(rows, 7, 2, 10)


@given(st.lists(st.text("ab", min_size=2, max_size=6), min_size=1, max_size=40, unique=True))
@settings(max_examples=60, deadline=None)
def test_composition_accepts_exactly_the_near_pairs(words):
    got = []
    for shorter in range(1, 7):
        part = sorted(w for w in words if len(w) in (shorter, shorter + 1))
        if part:
            got += [frozenset(p) for p in spelling.accepted_pairs(part, shorter, 0)]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("ka", "ke", "ki", "lo") for b in ("tion", "ting", "ted"))
    machine = spelling.Acceptor(words)
    assert machine.size[machine.start] == len(words)
    # k, l | a e i and o lead to one state, then the shared endings
    assert len(machine.next) == len(set(zip(machine.ends, (tuple(n.items()) for n in machine.next), strict=True)))
    assert len(machine.next) <= 11


# Byte-level BPE

PATH = public_tokenizers.path(BYTE_VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    return bytebpe.encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(encoder):
    ranks = encoder.vocabulary.ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


SIGNS = "ab 'slltdre\n\t \x1c\x85　 éж日\U0001f6421٣.,-_́\xa0"


def test_byte_bpe_query_equals_library_and_decodes(spark, documents, odd_rows, reference, tmp_path):
    rows = [*odd_rows, (9, "x" * 5000), (10, "日本" * 3000), (11, "a  b\n\n c\t\td   "), (12, "I'll we've it's 'tis")]
    documents(rows, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    found = op12_byte_bpe(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert dict(found.dtypes)["n_tokens"] == "bigint"
    want = []
    for doc_id, text in rows:
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        digests = [hashlib.sha256(b).hexdigest() for b in (ids.tobytes(), (text or "").encode())]
        want.append((doc_id, len(ids), *digests))
    assert Counter(map(tuple, found.collect())) == Counter(want)


def test_byte_bpe_of_no_rows(documents, encoder):
    ids = bytebpe.token_ids(F.col("text"), PATH, public_tokenizers.PATTERN)
    assert documents([]).select(ids).count() == 0
    both = documents(["a b", None]).select(ids.alias("ids")).select(bytebpe.decoded(F.col("ids"), PATH, public_tokenizers.PATTERN))
    assert sorted(bytes(r[0]) for r in both.collect()) == [b"", b"a b"]
    assert encoder.decode(None) == b""
    with pytest.raises(ValueError, match="no id"):
        encoder.decode(np.array([2**31], "<u4").tobytes())


@given(st.one_of(st.text(SIGNS, max_size=40), st.text(max_size=20)))
@settings(max_examples=400, deadline=None)
def test_byte_bpe_of_any_text(encoder, reference, text):
    try:
        data = text.encode()
    except UnicodeEncodeError:
        return
    ids = encoder.encode(text)
    assert list(bytebpe.unpacked(ids)) == reference.encode_ordinary(text)
    assert encoder.decode(ids) == data


@given(st.text(SIGNS, max_size=30), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 6), st.text(SIGNS, max_size=6)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_text_stays_encoded_while_it_is_edited(encoder, reference, text, edits):
    kept = bytebpe.EncodedText(encoder, text)
    for start, length, new in edits:
        start = min(start, len(text))
        end = min(len(text), start + length)
        text = text[:start] + new + text[end:]
        kept.edit(start, end, new)
        assert kept.text == text
        assert list(kept.ids()) == reference.encode_ordinary(text)


def test_prefix_table_appends_and_edits_near_the_change_only(encoder):
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcdefghijklmnop") for _ in range(5000))
    table = bytebpe.PrefixTable(encoder.vocabulary)
    for at in range(0, 5000, 700):
        table.append(data[at : at + 700])
    assert table.ids() == bytebpe.PrefixTable(encoder.vocabulary, data).ids()
    looked_at = table.edit(2000, 2003, b"zz")
    assert looked_at < 500
    whole = bytebpe.PrefixTable(encoder.vocabulary, data[:2000] + b"zz" + data[2003:])
    assert table.ids() == whole.ids()
    assert table.last == whole.last


def test_byte_bpe_cache_is_bounded_in_bytes(encoder, monkeypatch):
    monkeypatch.setattr(bytebpe, "CACHED_BYTES", 20_000)
    own = bytebpe.Encoder(encoder.vocabulary, public_tokenizers.PATTERN)
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(40)] + ["y" * 100_000]
    for text in texts:
        assert own.decode(own.encode(text)) == text.encode()
        assert sum(len(k) + len(v) for half in (own, own.older) for k, v in half.items()) < 20_000


# Lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, best=10):
    parts = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    parts = [p for p in parts if p[1]]
    n_docs, all_terms = len(parts), sum(sum(c.values()) for _, c in parts)
    df = Counter(t for _, c in parts for t in c)
    wanted = {}
    for item_id, text in items:
        wanted.setdefault(item_id, set()).update(terms_of(text))
    out = []
    for item_id, terms in wanted.items():
        scored = []
        for doc_id, counts in parts:
            m = 100 - 90 + (90 * sum(counts.values()) * n_docs) // all_terms
            score = 0
            for t in terms & set(counts):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, missing, doc_id) in enumerate(sorted(scored)[:best], 1):
            out.append((item_id, rank, None if missing else doc_id, -score))
    return sorted(out, key=str)


ITEMS = "item_id long, text string, size string"


def searched(spark, documents, docs, items, **settings):
    table = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    found = lexical.best_documents(documents(docs, extra=True), table, **settings)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert [t for _, t in found.dtypes] == ["bigint", "int", "bigint", "bigint"]
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [1, 500, 10**6])
def test_search_equals_plain_version(spark, documents, block_bytes):
    rng = random.Random(block_bytes)
    words = ["alpha", "Beta", "GAMMA", "été", "日本", "x1", "42", "İa", "be", "eta"]
    def text():
        return "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "\n", "_", "\x7f"]) for _ in range(rng.randint(0, 30)))
    docs = [(i, text()) for i in range(60)] + [(3, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (None, None), (70, " .. ")]
    items = [(i, text()) for i in range(12)] + [(1, "gamma"), (50, None), (51, ""), (52, "absent")]
    assert searched(spark, documents, docs, items, block_bytes=block_bytes, best=4) == plain_search(docs, items, 4)


def test_search_of_odd_rows_and_empty_tables(spark, documents, odd_rows):
    items = [(1, "five six words of a line"), (2, "long word Ünïcode 日本語")]
    assert searched(spark, documents, odd_rows, items) == plain_search(odd_rows, items)
    assert searched(spark, documents, [], items) == []
    assert searched(spark, documents, odd_rows, []) == []
    assert searched(spark, documents, [(1, None), (2, "...")], items) == []


def test_terms_are_whole_terms():
    scanner = lexical.TermScanner(["be", "alpha", "beta"])
    n, found = scanner.scan("Beta be-beta alphabe ALPHA")
    assert n == 5
    assert dict(found) == {0: 1, 1: 1, 2: 2}
