import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendlens.llm import packing
from spendlens.llm.queries import VOCABULARY, packed_documents
from spendlens.llm.tokens import WordIds, token_pieces

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def word_ids():
    return WordIds(PATH)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=40), st.lists(st.sampled_from(
    ["It's", "Don'T", "Straße", "ÀÉÎ", "á", "́x", "x\x1cy", "\xa0", "ΑΣ", "İ", "ﬁ", "日本", "🙂!", "...", "a.b", "123", "<|endoftext|>",
     "x<|startoftext|>y", "\r\n", " ", "\t", "A,", "é;", "_", "²"]), max_size=8).map(" ".join)))
def test_ids_are_those_of_the_whole_text(tokenizer, word_ids, text):
    whole = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(word_ids.of(text), "<u4").tolist() == whole


def layout_rows(layout):
    """Every piece of a layout as (sequence, offset, length)."""
    return [(s + i, off, n) for n, _, c, s, off in layout.placed for i in range(c)]


def check(counts, layout):
    rows, by_sequence, found = layout_rows(layout), defaultdict(list), defaultdict(int)
    for s, off, n in rows:
        by_sequence[s].append((off, n))
        found[n] += 1
    assert dict(found) == {n: c for n, c in counts.items() if c}
    for parts in by_sequence.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= layout.capacity
    return len(by_sequence)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=25), st.integers(1, 12))
def test_any_counts_are_packed_whole(counts, groups):
    used = check(counts, packing.plan_layout(counts, 64, groups))
    least = max(-(-sum(n * c for n, c in counts.items()) // 64), sum(c for n, c in counts.items() if n > 32))
    assert least <= used <= max(least + 2, 1.35 * least)


def test_known_best_packings():
    assert check({40: 100, 24: 100}, packing.plan_layout({40: 100, 24: 100}, 64, 8)) == 100
    assert check({33: 7}, packing.plan_layout({33: 7}, 64, 8)) == 7
    assert check({64: 1000, 1: 64}, packing.plan_layout({64: 1000, 1: 64}, 64, 8)) == 1001
    assert packing.plan_layout({}, 64, 8).sequences == 0


def test_few_more_sequences_than_the_words_need():
    rng = np.random.default_rng(1)
    counts = defaultdict(int)
    for n in np.clip(rng.lognormal(6.3, 0.9, 50_000), 1, 2048).astype(int):
        counts[int(n)] += 1
    used = check(counts, packing.plan_layout(counts))
    assert used <= 1.005 * sum(n * c for n, c in counts.items()) / 2048 + 1


def test_documents_round_trip(documents, odd_rows, tokenizer):
    rows = [*odd_rows, *((100 + i, f"text number {i} " * (i * 7)) for i in range(60))]
    df = documents(rows, extra=True)
    pieces = token_pieces(df, PATH, 64)
    packed = packing.pack(pieces, 64).collect()
    texts = defaultdict(list)
    for doc_id, text in rows:
        texts[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    got = defaultdict(list)
    for r in packed:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.start == 64 * r.piece
        got[r.doc_id].append((r.piece, ids))
    for doc_id, all_ids in texts.items():
        want = [(p // 64, ids[p : p + 64]) for ids in all_ids for p in range(0, len(ids), 64)]
        assert sorted(got[doc_id]) == sorted(want)
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64


def test_query_columns_and_sequences(documents):
    df = documents(["a b c " * 900, None, "x"])
    rows = packed_documents(df).collect()
    assert [(r.piece, r.start) for r in rows if r.doc_id == 0] == [(0, 0), (1, 2048)] or len(rows) == 4
    empty = next(r for r in rows if r.doc_id == 1)
    assert empty.length == 1 and empty.ids_crc32 == zlib.crc32(b"\0\0\0\0")
    pieces = token_pieces(df, PATH, 2048)
    sequences = packing.sequence_ids(packing.pack(pieces)).withColumn("n", F.octet_length("ids") / 4).collect()
    assert sum(r.n for r in sequences) == 2701 + 1 + 2


def test_no_documents(documents):
    assert packed_documents(documents([])).collect() == []
