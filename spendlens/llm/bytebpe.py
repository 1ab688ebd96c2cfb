"""Byte-level BPE by dynamic programming over prefixes, with a given vocabulary of ranks.

Merging pairs by rank never joins across a token that stays, so the tokens of a text
without the last one are exactly the tokens of that shorter text. Every prefix of the
bytes therefore has one last token, and it is enough to store that: the last token of a
prefix is the only one that ends there and follows the last token of what is before it as
merging would have it. Whether one token may follow another is learned by merging the two
alone, once. Encoding takes linear time, bytes may be appended without looking back, and
after an edit only the prefixes near it change: as soon as as many prefixes as the longest
token has bytes end in the tokens they had, all others do.

A text is first split into the matches of a pattern, each encoded by itself; a match that
is a token as a whole is that token. White space begins what follows it, so matches never
reach from the end of a run without white space into the next run, and the runs are looked
up one by one in a cache bounded by its bytes.

Defined results: a NULL or empty text has no ids; every code point of Unicode can be
encoded; very long runs are encoded like others, but are not cached; rows are independent,
so repeated rows, rows without an id, empty tables and further columns change nothing;
decoding no ids (NULL) gives no bytes and an id that the vocabulary lacks is an error.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

CACHED_BYTES = 150_000_000
CACHED_PAIRS = 500_000
SLICE = 500  # rows
LONGEST_CACHED = 256  # characters of a run
ENTRY_BYTES = 200  # what an entry of the cache takes besides its strings
NO_RANK = sys.maxsize
LOOK_AHEAD = 3  # characters after a match that can decide its end

# Code points with the property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def packed(ids: array) -> bytes:
    """Unsigned 32-bit numbers, little-endian."""
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def unpacked(data: bytes) -> array:
    ids = array("I", data)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


class Vocabulary:
    """Tokens by rank; the rank is the id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: token for token, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._follows: dict[int, bool] = {}
        # Finds all tokens in a row of bytes; a character stands for a byte.
        self.occurring = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.occurring.add_word(token.decode("latin-1"), (len(token), i))
        self.occurring.make_automaton()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merged(self, data: bytes) -> list[bytes]:
        """Tokens of a few bytes, by merging the leftmost pair of the lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        ranks = [rank(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], NO_RANK)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], NO_RANK)
        return parts

    def _learn(self, before: int, token: int, key: int) -> bool:
        """Whether merging leaves these two tokens as they are; ``before`` is -1 at the beginning."""
        if len(self._follows) >= CACHED_PAIRS:
            self._follows.clear()
        parts = [self.tokens[token]] if before < 0 else [self.tokens[before], self.tokens[token]]
        known = self._follows[key] = self.merged(b"".join(parts)) == parts
        return known

    def extend(self, data: bytes, last: list[int] | array) -> None:
        """Append to ``last`` the last tokens of all prefixes of the bytes that it does not have yet.

        ``last[n]`` is the last token of the first ``n`` bytes, and -1 for none.
        """
        known, follows, append, learn = len(last) - 1, self._follows, last.append, self._learn
        begin = max(0, known + 1 - self.longest)
        for at, (length, token) in self.occurring.iter(data[begin:].decode("latin-1")):
            end = begin + at + 1
            if end > known and end - length >= begin:
                before = last[end - length]
                key = (before + 1) << 32 | token
                fits = follows.get(key)
                if fits or (fits is None and learn(before, token, key)):
                    append(token)
                    known = end
        if known < len(data):
            raise ValueError("the vocabulary lacks a single byte")

    def ids(self, last: list[int] | array) -> array:
        """All tokens of the longest prefix."""
        tokens, at, out = self.tokens, len(last) - 1, []
        while at:
            out.append(last[at])
            at -= len(tokens[last[at]])
        out.reverse()
        return array("I", out)


class PrefixTable:
    """Bytes and the last token of each of their prefixes; may be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last = array("i", [-1])
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extend(self.data, self.last)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in the place of some bytes; gives the number of prefixes that were looked at again."""
        old, moved, step = self.last, len(new) - (end - start), self.vocabulary.longest
        self.data = self.data[:start] + new + self.data[end:]
        self.last, at = old[: start + 1], start + len(new)
        self.vocabulary.extend(self.data[:at], self.last)
        while at < len(self.data):
            at = min(at + step, len(self.data))
            self.vocabulary.extend(self.data[:at], self.last)
            # So many equal prefixes in a row decide all that follow.
            if self.last[-step:] == old[at - moved + 1 - step : at - moved + 1] and at - step >= start + len(new):
                self.last.extend(old[at - moved + 1 :])
                break
        return at - start

    def ids(self) -> array:
        return self.vocabulary.ids(self.last)


class Encoder(dict):
    """Packed ids of runs and matches, encoded when first asked for.

    When half of the room is used the entries become the older half, from which those
    still in use come back, so frequent runs stay and rare ones go.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(pattern)
        self.older: dict[str, bytes] = {}
        self.room = CACHED_BYTES // 2

    def __missing__(self, run: str) -> bytes:
        ids = self.older.get(run)
        if ids is None:
            matches = self.pattern.findall(run)
            ids = b"".join(map(self.__getitem__, matches)) if len(matches) > 1 else self._match(run)
        if len(run) <= LONGEST_CACHED:
            self.room -= ENTRY_BYTES + len(run) + len(ids)
            if self.room < 0:
                self.older = dict(self)
                self.clear()
                self.room = CACHED_BYTES // 2
            self[run] = ids
        return ids

    def _match(self, match: str) -> bytes:
        data = match.encode()
        whole = self.vocabulary.ranks.get(data)
        if whole is not None:
            return packed(array("I", [whole]))
        last = [-1] if len(data) < LONGEST_CACHED else array("i", [-1])
        self.vocabulary.extend(data, last)
        return packed(self.vocabulary.ids(last))

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, RUNS.findall(text or "")))

    def decode(self, ids: bytes | None) -> bytes:
        try:
            return b"".join(map(self.vocabulary.tokens.__getitem__, unpacked(ids or b"")))
        except KeyError as unknown:
            raise ValueError(f"the vocabulary has no id {unknown}") from None


class EncodedText:
    """A text that stays encoded while it is appended to and edited; only matches near a change are encoded again."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder = encoder
        self.text = ""
        self.bounds = [0]  # where matches begin, and the end
        self.tables: list[PrefixTable] = []
        self.append(text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of some characters."""
        old, moved = self.bounds, len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        # Matches that end well before the change cannot have been decided by it.
        kept = max(0, bisect_right(old, start - LOOK_AHEAD) - 1)
        at, bounds, tables, follow = old[kept], old[: kept + 1], self.tables[:kept], len(self.tables)
        while at < len(self.text):
            if at >= start + len(new):
                # A match that begins where one began before is the old one, and so are all after it.
                same = bisect_left(old, at - moved)
                if same < len(old) and old[same] == at - moved:
                    follow = same
                    break
            stop = self.encoder.pattern.match(self.text, at).end()
            known = bisect_left(old, at, kept)
            begun = self.tables[known] if at < start and known < len(self.tables) and old[known] == at else None
            tables.append(self._table(self.text[at:stop].encode(), begun))
            bounds.append(stop)
            at = stop
        self.bounds = bounds + [b + moved for b in old[follow + 1 :]]
        self.tables = tables + self.tables[follow:]

    def _table(self, data: bytes, begun: PrefixTable | None) -> PrefixTable:
        """A table of a match; one that began at the same place is changed where the bytes differ."""
        if begun is None:
            return PrefixTable(self.encoder.vocabulary, data)
        was, most = begun.data, min(len(begun.data), len(data))
        head = next((i for i in range(most) if was[i] != data[i]), most)
        tail = next((i for i in range(most - head) if was[-1 - i] != data[-1 - i]), most - head)
        begun.edit(head, len(was) - tail, data[head : len(data) - tail])
        return begun

    def ids(self) -> array:
        out = array("I")
        for table in self.tables:
            whole = self.encoder.vocabulary.ranks.get(table.data)
            if whole is None:
                out.extend(table.ids())
            else:
                out.append(whole)
        return out


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this process for a file of base64 tokens and ranks."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(Vocabulary.load(path), pattern)
    return _LOADED[path, pattern]


def _in_slices(batches: Iterator[pd.Series], function: Callable) -> Iterator[pd.Series]:
    """Results of a few rows at a time, so that a batch of long texts is not held twice."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield pd.Series([function(x) for x in batch.iloc[at : at + SLICE]], dtype=object)


def token_ids(text: Column, path: str, pattern: str) -> Column:
    """Ids of whole texts, as unsigned 32-bit numbers in little-endian order."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _in_slices(batches, encoder(path, pattern).encode)

    return run(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ids stand for."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _in_slices(batches, encoder(path, pattern).decode)

    return run(ids)


def there_and_back(text: Column, path: str, pattern: str) -> Column:
    """Struct of ``ids`` and of ``decoded``, the bytes that these ids stand for, by one worker."""

    @F.pandas_udf("ids binary, decoded binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path, pattern)
        for ids in _in_slices(batches, own.encode):
            yield pd.DataFrame({"ids": ids, "decoded": [own.decode(i) for i in ids]})

    return run(text)
