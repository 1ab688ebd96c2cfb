"""Best-fit packing of pieces into sequences by linear grouping.

Large pieces are sorted and cut into groups of equal cardinality; each group is
rounded up to its largest length. For these few lengths the configurations of a
sequence are optimised as a linear program by column generation. The actual pieces
take the places of the rounded ones, and what is left over, with all small pieces,
goes best-fit into the room that remains.

All of this depends on the number of pieces per length only, at most ``capacity``
counts, and is planned in runs of equal sequences: a run is split, never listed. The
plan is therefore small whatever the number of documents. Spark counts lengths,
numbers the pieces of each length, and looks every piece up in the plan by length
and number; a length that very many pieces share is numbered in cells.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import cut

CAPACITY = 2048
GROUPS = 64
SMALL = 1 / 8  # pieces up to this part of a sequence are small
OPEN = 1 / 32  # a configuration's sequences are kept with at most this part of room
ROWS_PER_CELL = 5000


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits, by dynamic programming over the room."""
    best, taken = np.zeros(capacity + 1), []
    for j in np.flatnonzero(values > 1e-12):
        for _ in range(capacity // sizes[j]):
            more = np.full(capacity + 1, -1.0)
            more[sizes[j] :] = best[: capacity + 1 - sizes[j]] + values[j]
            better = more > best + 1e-12
            if not better.any():
                break
            best = np.where(better, more, best)
            taken.append((j, better))
    pattern, room = np.zeros(len(sizes), int), capacity
    for j, better in reversed(taken):
        if better[room]:
            pattern[j] += 1
            room -= sizes[j]
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = 1500) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each (fractions), covering the demand with the fewest sequences."""
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(steps):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, pattern = _best_pattern(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        use, enter = np.linalg.solve(basis, np.stack([demand, pattern], 1).astype(float)).T
        ratios = np.where(enter > 1e-9, np.maximum(use, 0) / np.where(enter > 1e-9, enter, 1), np.inf)
        basis[:, int(np.argmin(ratios))] = pattern
    return [(np.rint(p).astype(int), u) for p, u in zip(basis.T, np.linalg.solve(basis, demand.astype(float)), strict=True)]


@dataclass
class Layout:
    """Sequences in runs of equal fill, and where each run of equal pieces goes."""

    capacity: int
    sequences: int = 0
    rooms: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # room: (first sequence, count)
    numbered: dict[int, int] = field(default_factory=dict)  # pieces placed so far, by length
    placed: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    open_rooms: int = 0  # one bit for each room that some run has

    def new(self, count: int) -> tuple[int, int]:
        self.sequences += count
        return self.sequences - count, count

    def put(self, length: int, run: tuple[int, int], room: int) -> None:
        """One piece of this length into each sequence of the run."""
        number = self.numbered.get(length, 0)
        self.placed.append((length, number, run[1], run[0], self.capacity - room))
        self.numbered[length] = number + run[1]

    def offer(self, run: tuple[int, int], room: int) -> None:
        if room > 0:
            self.rooms.setdefault(room, []).append(run)
            self.open_rooms |= 1 << room

    def best_fit(self, length: int, count: int) -> None:
        while count:
            fitting = self.open_rooms >> length
            if not fitting:
                self.offer(self.new(-(-count // (self.capacity // length))), self.capacity)
                continue
            room = length + (fitting & -fitting).bit_length() - 1
            first, free = self.rooms[room].pop()
            here = min(free, count)
            if free > here:
                self.rooms[room].append((first + here, free - here))
            if not self.rooms[room]:
                self.open_rooms &= ~(1 << room)
            self.put(length, (first, here), room)
            self.offer((first, here), room - length)
            count -= here


class Stock:
    """Pieces not placed yet, by length; the largest that fits is found from one bit per length."""

    def __init__(self, counts: list[tuple[int, int]]):
        self.counts = dict(counts)
        self.lengths = sum(1 << n for n in self.counts)

    def largest(self, most: int) -> int:
        """The largest length up to ``most``, 0 if there is none."""
        return max(0, (self.lengths & ((2 << most) - 1)).bit_length() - 1)

    def add(self, length: int, count: int) -> None:
        self.counts[length] = self.counts.get(length, 0) + count
        if self.counts[length]:
            self.lengths |= 1 << length
        else:
            self.lengths &= ~(1 << length)


def _groups(falling: list[tuple[int, int]], groups: int) -> list[tuple[int, int, int]]:
    """Groups of equal cardinality by falling length: (smallest, largest, number of pieces)."""
    per_group = max(1, -(-sum(c for _, c in falling) // groups))
    out: list[tuple[int, int, int]] = []
    free = 0
    for length, count in falling:
        while count:
            if not free:
                out.append((length, length, 0))
                free = per_group
            here = min(count, free)
            out[-1] = (length, out[-1][1], out[-1][2] + here)
            count, free = count - here, free - here
    return out


def _substitute(layout: Layout, slots: list[tuple[int, int]], times: int, stock: Stock, least: int) -> None:
    """Sequences of one configuration, filled with actual pieces of the groups (smallest, largest) it names.

    The actual pieces are shorter than the rounded ones, so the last place takes
    the largest piece that fits into the room they leave. Sequences that still come
    out with much room are not kept; their pieces go back.
    """
    runs: list[tuple[int, list[int], int]] = [(times, [], layout.capacity)]
    for place, (low, high) in enumerate(slots):
        last, filled = place == len(slots) - 1, []
        for count, pieces, room in runs:
            while count:
                length = stock.largest(room if last else min(high, room))
                if length < (least if last else low):
                    break
                here = min(count, stock.counts[length])
                stock.add(length, -here)
                filled.append((here, [*pieces, length], room - length))
                count -= here
            if count:
                filled.append((count, pieces, room))
        runs = filled
    for count, pieces, room in runs:
        if room > layout.capacity * OPEN:
            for length in pieces:
                stock.add(length, count)
            continue
        run, before = layout.new(count), layout.capacity
        for length in pieces:
            layout.put(length, run, before)
            before -= length
        layout.offer(run, room)


def plan_layout(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> Layout:
    """A layout for so many pieces of each length."""
    layout = Layout(capacity)
    falling = sorted(((n, c) for n, c in counts.items() if c), reverse=True)
    if falling and falling[0][0] == capacity:
        layout.put(capacity, layout.new(falling[0][1]), capacity)
        falling = falling[1:]
    least = int(capacity * small) + 1
    grouped = _groups([x for x in falling if x[0] >= least], groups)
    stock = Stock(falling)
    if grouped:
        sizes, demand = np.array([g[1] for g in grouped]), np.array([g[2] for g in grouped])
        for pattern, use in sorted(configurations(sizes, demand, capacity), key=lambda x: -x[1]):
            if use >= 1 - 1e-9:
                slots = [grouped[g][:2] for g in np.repeat(np.arange(len(pattern)), pattern)]
                _substitute(layout, slots, int(use + 1e-9), stock, least)
    for length, count in sorted(stock.counts.items(), reverse=True):
        layout.best_fit(length, count)
    return layout


def _numbered(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """``_number`` from 0 for the pieces of each length, in cells of a bounded number of rows."""
    cells = F.ceil(F.col("_count") / ROWS_PER_CELL)
    # At most one row per possible length, so this side has a proven bound.
    rows = pieces.join(F.broadcast(counts), "length").withColumn("_cell", F.pmod(F.xxhash64("_row"), cells))
    sums = rows.groupBy("length", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("length", "_cell").orderBy("_row")) - 1
    return (
        rows.withColumn("_own", own)
        .join(base, ["length", "_cell"])
        .withColumn("_number", F.col("_base") + F.col("_own"))
        .drop("_cell", "_own", "_base", "_count")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Rows with a ``length`` from 1 to ``capacity``, each with its ``sequence_id`` and ``offset``.

    Every sequence is filled without gaps from 0. Rows that are equal are packed
    each on its own. The rows are written once and read twice.
    """
    pieces = cut(pieces.withColumn("_row", F.monotonically_increasing_id()))
    counts = pieces.groupBy("length").agg(F.count("*").alias("_count"))
    layout = plan_layout({int(n): int(c) for n, c in counts.collect()}, capacity, groups)
    placed = np.array(sorted(layout.placed), np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(placed)

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        plan = shared.value
        keys = (plan[:, 0] << 48) + plan[:, 1]
        wanted = (lengths.to_numpy(np.int64) << 48) + numbers.to_numpy(np.int64)
        at = np.searchsorted(keys, wanted, "right") - 1
        sequences = plan[at, 3] + numbers.to_numpy(np.int64) - plan[at, 1]
        return pd.DataFrame({"sequence_id": sequences, "offset": plan[at, 4]})

    numbered = np.array(sorted(layout.numbered.items()), np.int64).reshape(-1, 2)
    # An Arrow table needs no Python workers to become rows.
    small = pieces.sparkSession.createDataFrame(pa.table({"length": numbered[:, 0], "_count": numbered[:, 1]}))
    return _numbered(pieces, small).select(
        *[c for c in pieces.columns if c != "_row"], place(F.col("length"), F.col("_number")).alias("_at")
    ).select("*", "_at.*").drop("_at")


def sequence_ids(packed: DataFrame) -> DataFrame:
    """The sequences themselves from packed pieces that carry ``ids``: ``sequence_id, ids``, one bounded group each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
