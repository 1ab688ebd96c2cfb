"""Token ids of whole texts by a given vocabulary file, word by word with a bounded cache."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

CACHED_WORDS = 1_000_000
TAIL_ID = 0
LATIN = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
# Latin letters and closing marks. The vocabularies split between the two and ignore case.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")


class WordIds(dict):
    """Ids of words as little-endian bytes, encoded when first asked for, by a lower-casing word vocabulary.

    The vocabulary never joins what white space separates and ignores the white
    space itself, so the ids of a text are those of its words one after the other.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self[""] = b""
        # A lower-case Latin word needs no normalizing and is one piece: its spelling in the
        # vocabulary's own letters goes straight to the merges.
        pre = self.tokenizer.pre_tokenizer
        self.letters = {ord(c): pre.pre_tokenize_str(c)[0][0] for c in LATIN}

    def __missing__(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        stem = plain[1].lower() if plain else word
        if stem != word:
            ids = self[stem] + self[plain[2]]
        elif plain:
            ids = self._packed(t.id for t in self.tokenizer.model.tokenize(word.translate(self.letters)))
        else:
            ids = self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    @staticmethod
    def _packed(ids: Iterable[int]) -> bytes:
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def of(self, text: str) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
            self[""] = b""
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, path: str, size: int) -> DataFrame:
    """Each text's ids and a closing id 0, cut into pieces of at most ``size`` ids.

    A NULL or empty text is the closing id alone. ``ids`` holds unsigned 32-bit
    numbers, little-endian; ``start`` counts the document's ids before the piece.
    """
    columns = ["doc_id", "piece", "start", "length", "ids"]
    tail = TAIL_ID.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_ids(path)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part, rows = batch.iloc[at : at + 500], []
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                    ids = encoder.of(text or "") + tail
                    for piece, start in enumerate(range(0, len(ids) // 4, size)):
                        own = ids[4 * start : 4 * (start + size)]
                        rows.append((doc_id, piece, start, len(own) // 4, own))
                yield pd.DataFrame(rows, columns=columns)

    # As text, since pandas would turn ids beside a NULL into doubles.
    schema = "doc_id string, piece int, start long, length long, ids binary"
    pieces = docs.selectExpr("cast(doc_id as string) as doc_id", "text").mapInPandas(run, schema)
    return pieces.withColumn("doc_id", pieces["doc_id"].cast("long"))
