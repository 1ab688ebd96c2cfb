"""Spelling variants of the words of a corpus, by composition of finite-state machines.

The vocabulary is counted over whole texts, summed in the tasks before anything is
shuffled. Near words are those that the composition of three machines accepts: an
acceptor of the vocabulary, a transducer that makes exactly one edit (one code point
replaced, deleted or inserted), and the acceptor again. A pair of words is a path of
that machine: both acceptors read the same symbols, then come the edit and the same
symbols again.

The machine is cut by its initial states. One edit leaves the first or the last half
of the shorter word as it is, so a word goes to the part named by its first half and,
read backwards, to the part named by its last half, for each length that the shorter
word of a pair can have. Each part is a machine of its own: a minimal acceptor of what
follows the half, composed with the one-edit transducer and itself, whose accepted
pairs are listed. The first half decides which of the two parts counts a pair. A part
of more than ``PART`` words is cut at its next symbol; pairs whose edit lies at that
very symbol have the same rest and meet in a part named by it. So no task holds more
than the words of a few parts, however common a beginning is.

A word's form is its near word of the largest count, if it is found ``RATIO`` times as
often; forms are followed by doubling steps, as counts grow with every step.

Defined results: a NULL or empty text has no words; rows that repeat a ``doc_id``
count each; a row without a ``doc_id`` is drawn with an empty id; words of any length
are compared; of equally frequent near words the smallest in code-point order is the
form; an empty table gives an empty vocabulary; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import cut

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
PART = 20_000
ONE_IN = 31  # runs that lose a code point
HELD = 200_000  # words that a task adds up before it passes them on
RUN = "[A-Za-zÀ-ÿ]"

# What a part may hold: any pair, or only pairs that differ in the first symbol that is left.
ANY, REPLACED, DELETED = 0, 1, 2


def drawn_words(doc_id: object, text: str | None, shortest: int = MIN_LENGTH) -> Counter:
    """Words of one text and how often each occurs; some runs lose a code point, as their hash has it."""
    # Lower-casing bytes changes A to Z only.
    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    out: Counter = Counter()
    base = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(re.findall(RUN + "{%d,}" % max(1, shortest), lowered)).items():
        h = zlib.crc32(run.encode(), base)
        if h % ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= shortest:
            out[run] += n
    return out


def vocabulary(docs: DataFrame, shortest: int = MIN_LENGTH, least: int = MIN_COUNT) -> DataFrame:
    """``word, n`` for every word found at least so often."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                held.update(drawn_words(doc_id, text, shortest))
                if len(held) > HELD:
                    yield pd.DataFrame(held.items(), columns=["word", "n"])
                    held = Counter()
        yield pd.DataFrame(held.items(), columns=["word", "n"]).astype({"word": object, "n": "int64"})

    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    counted = docs.select(ids.alias("doc_id"), "text").mapInPandas(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Acceptor:
    """Minimal acceptor of distinct words that come in code-point order.

    States are numbered from the ends; ``next`` has the targets of each by symbol,
    ``ends`` whether a word may end there, ``size`` how many words follow.
    """

    __slots__ = ("ends", "next", "size", "start")

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = []
        self.ends: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        # States on the path of the last word, whose targets are not all known yet.
        path: list[dict[str, int]] = [{}]
        ending, last = [False], ""

        def close(down_to: int) -> int:
            state = -1
            while len(path) > down_to:
                targets, end = path.pop(), ending.pop()
                key = (end, *targets.items())
                state = known.get(key, -1)
                if state < 0:
                    state = known[key] = len(self.next)
                    self.next.append(targets)
                    self.ends.append(end)
                    self.size.append(end + sum(map(self.size.__getitem__, targets.values())))
                if path:
                    path[-1][last[len(path) - 1]] = state
            return state

        for word in words:
            same = 0
            for a, b in zip(last, word):  # noqa: B905
                if a != b:
                    break
                same += 1
            close(same + 1)
            for _ in range(len(word) - same):
                path.append({})
                ending.append(False)
            ending[-1], last = True, word
        self.start = close(0)


def _shared(left: Acceptor, p: int, right: Acceptor, q: int, before: str = "") -> Iterator[str]:
    """What both machines accept from these states: the composition after its edit."""
    stack = [(p, q, before)]
    while stack:
        p, q, before = stack.pop()
        if left.ends[p] and right.ends[q]:
            yield before
        other = right.next[q]
        for symbol, state in left.next[p].items():
            target = other.get(symbol)
            if target is not None:
                stack.append((state, target, before + symbol))


def replaced(words: Acceptor, first_only: bool = False) -> Iterator[tuple[str, str]]:
    """Accepted pairs that differ by one replaced symbol, each once."""
    stack = [(words.start, "")]
    while stack:
        state, before = stack.pop()
        arcs = list(words.next[state].items())
        for i, (a, p) in enumerate(arcs):
            for b, q in arcs[:i]:
                for rest in _shared(words, p, words, q):
                    yield before + a + rest, before + b + rest
            if not first_only and words.size[p] > 1:
                stack.append((p, before + a))


def deleted(longer: Acceptor, shorter: Acceptor, first_only: bool = False) -> Iterator[tuple[str, str]]:
    """Accepted pairs of a word and what is left of it without one symbol, each once.

    Of several equal symbols in a row the last is the one deleted, so that a pair has one path only.
    """
    stack = [(longer.start, shorter.start, "")]
    while stack:
        p, q, before = stack.pop()
        arcs = shorter.next[q]
        for a, target in longer.next[p].items():
            if longer.ends[target] and shorter.ends[q]:
                yield before + a, before
            after = longer.next[target]
            for symbol, state in after.items():
                same = arcs.get(symbol) if symbol != a else None
                if same is not None:
                    for rest in _shared(longer, state, shorter, same, symbol):
                        yield before + a + rest, before + rest
            same = None if first_only else arcs.get(a)
            if same is not None:
                stack.append((target, same, before + a))


def accepted_pairs(words: list[str], shorter: int, skip: int, kind: int = ANY) -> Iterator[tuple[str, str]]:
    """Near pairs of one part: sorted words of length ``shorter`` or one more, of which at least one is the
    shorter; all begin with the same ``skip`` symbols."""
    begin = words[0][:skip]
    short = [w[skip:] for w in words if len(w) == shorter]
    if not short or len(words) < 2:
        return
    few = Acceptor(short)
    pairs: list[Iterator[tuple[str, str]]] = []
    if kind != DELETED and len(short) > 1:
        pairs.append(replaced(few, kind == REPLACED))
    if kind != REPLACED and len(short) < len(words):
        many = Acceptor([w[skip:] for w in words if len(w) > shorter])
        pairs.append(deleted(many, few, kind == DELETED))
    for found in pairs:
        for a, b in found:
            yield begin + a, begin + b


def _parts(words: DataFrame, shortest: int) -> DataFrame:
    """Each word in every part whose machine it belongs to: ``shorter, back, kind, skip, key, read, n``."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("shorter"))
    rows = rows.filter(F.col("shorter") >= shortest).select(
        "n", "shorter", F.posexplode(F.array("word", F.reverse("word"))).alias("back", "read")
    )
    half = F.floor(F.col("shorter") / 2).cast("int")
    return rows.select(
        "shorter", "back", F.lit(ANY).alias("kind"), half.alias("skip"), F.substring("read", F.lit(1), half).alias("key"), "read", "n"
    )


def _cut_at_next_symbol(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Rows of large parts go to parts named by one more symbol, and to those of pairs with an edit there."""
    name = ["shorter", "back", "kind", "key"]
    marked = rows.join(large.withColumn("_large", F.lit(True)), name, "left")
    skip, read = F.col("skip"), F.col("read")
    short = F.length("read") == F.col("shorter")
    rest, after = F.substring(read, skip + 1, F.length(read)), F.substring(read, skip + 2, F.length(read))

    def part(kind: int, deeper: Column, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (skip + deeper).alias("skip"), key.alias("key"))

    # A rest is set off by a sign that no word has.
    same_rest = F.when(short, part(REPLACED, F.lit(0), F.concat("key", F.lit("/"), after)))
    without = part(DELETED, F.lit(0), F.concat("key", F.lit("/"), F.when(short, rest).otherwise(after)))
    deeper = F.when(F.length(read) > skip, part(ANY, F.lit(1), F.substring(read, F.lit(1), skip + 1)))
    moved = F.when(F.col("_large"), F.array(deeper, same_rest, without)).otherwise(
        F.array(F.struct("kind", "skip", "key"))
    )
    out = marked.select("shorter", "back", "read", "n", F.explode(moved).alias("part")).filter("part is not null")
    return out.select("shorter", "back", "part.*", "read", "n")


def _near_of_parts(shortest: int):
    """Sums over the accepted pairs of each word, for rows that come sorted by part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: dict[str, list] = {}

        def note(word: str, other: str, n: int) -> None:
            own = near.get(word)
            if own is None:
                near[word] = [1, n, other]
            else:
                own[0] += 1
                if n > own[1] or (n == own[1] and other < own[2]):
                    own[1], own[2] = n, other

        def settle(name: tuple, words: list[str], counts: list[int]) -> None:
            if len(words) < 2:
                return
            shorter, back, kind, skip, _ = name
            n, half = dict(zip(words, counts, strict=True)), shorter // 2
            for a, b in accepted_pairs(words, shorter, skip, kind):
                # A pair with the same first half is counted where words are read forwards.
                if not back:
                    note(a, b, n[b])
                    note(b, a, n[a])
                elif half and a[-half:] != b[-half:]:
                    note(a[::-1], b[::-1], n[b])
                    note(b[::-1], a[::-1], n[a])

        def table() -> pd.DataFrame:
            rows = [(w, *x) for w, x in near.items()]
            near.clear()
            return pd.DataFrame(rows, columns=["word", "n_near", "form_n", "form"]).astype({"n_near": "int64", "form_n": "int64"})

        at, words, counts = None, [], []
        for batch in batches:
            names = zip(batch["shorter"], batch["back"], batch["kind"], batch["skip"], batch["key"], strict=True)
            for name, word, n in zip(names, batch["read"], batch["n"], strict=True):
                if name != at:
                    settle(at, words, counts)
                    at, words, counts = name, [], []
                words.append(word)
                counts.append(n)
            if len(near) > HELD:
                yield table()
        settle(at, words, counts)
        yield table()

    return run


def near_words(words: DataFrame, shortest: int = MIN_LENGTH, part: int = PART) -> DataFrame:
    """``word, n_near, form_n, form``: number of near words and the most frequent of them, where there are any."""
    name = ["shorter", "back", "kind", "key"]
    rows = _parts(words, shortest)
    while True:
        large = rows.filter(F.col("kind") == ANY).groupBy(*name).count().filter(F.col("count") > part).drop("count")
        large = cut(large)
        if large.isEmpty():
            break
        rows = cut(_cut_at_next_symbol(rows, large))
    dealt = rows.repartition(*name).sortWithinPartitions(*name, "read")
    found = dealt.mapInPandas(_near_of_parts(shortest), "word string, n_near long, form_n long, form string")
    first = F.min(F.struct((-F.col("form_n")).alias("rank"), F.col("form"))).alias("first")
    sums = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
    return sums.select("word", "n_near", (-F.col("first.rank")).alias("form_n"), F.col("first.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: where following the forms ends. Steps double, so few rounds do."""
    ends = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        followed = cut(ends.join(onward, "root", "left"))
        if followed.filter("_next is not null").isEmpty():
            return ends
        ends = cut(followed.select("word", F.coalesce("_next", "root").alias("root")))


def spelling_groups(
    docs: DataFrame, shortest: int = MIN_LENGTH, least: int = MIN_COUNT, ratio: int = RATIO, part: int = PART
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the whole vocabulary."""
    words = cut(vocabulary(docs, shortest, least))
    usual = F.col("form_n") >= ratio * F.col("n")
    found = cut(
        words.join(near_words(words, shortest, part), "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(usual, F.col("form")).alias("form"),
            F.when(usual, F.col("form_n")).alias("form_n"),
        )
    )
    ends = roots(found.filter("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
