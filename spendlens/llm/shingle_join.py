"""N-gram Jaccard join: a blocked sparse product of the document by shingle matrix.

Rows of the matrix are classes of documents with the same shingle set, columns are
shingles. Overlaps of rows are counted by the product of the matrix with its transpose,
added up over blocks of columns, for blocks of rows that can hold links; what sizes rule
out is left out on the way, without losing a link:

* A row can only link with rows whose sizes are at least four fifths of its own or at
  most five fourths, so blocks of rows are cut by bands of sizes and meet blocks of the
  same and of the next band.
* Of the shingles of a row in the order of their hashes, the first ``n - ceil(0.8 n) + 1``
  and a fifth of ``n`` more are looked at first. Two rows that link have at least a fifth
  of ``n`` of these in common. Rows that do not share so many with any others leave.
* Rows left that share one of those shingles, directly or over others, are a group, and
  only rows of a group are multiplied. Groups that are too large for one block are cut
  into blocks, each pair of blocks being a cell of the product.
* In a cell, shingles that only one row holds and rows with less than four fifths of
  their shingles left leave in turns before anything is multiplied.

Entries of the matrix travel packed, and a shingle that many rows of a task hold is passed
on once, so a very common shingle is no heavy task. A group of near copies is one
dense block or several, and no pair of its rows is ever a row of a table; rows of one cell
that link come out as a star and as counts. The work for a group of ``g`` rows that all
link is ``g * g`` times their shingles, in cells of bounded size.

Shingles and sets are named by 64-bit hashes. Overlaps are counted on whole sets.

Defined results: NULL and empty texts have no shingles and link with nothing, so they
are components of their own; a text of fewer words than a shingle is one shingle; very
long texts are rows like others; rows that repeat a ``doc_id`` are independent rows that
may link; a row without a ``doc_id`` gets the smallest known id of its component, NULL if
there is none; equal rows are links of each other; an empty table gives an empty table;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from spendlens.llm.common import by_batch, cut
from spendlens.llm.components import components
from spendlens.plans.joins import lookup_join, spread_left_join

WORDS = 5
LONGER = 5  # the part of a row, one in so many, by which its prefix is longer than needed to meet all links
PACKED = 2**19  # entries that a task holds before it passes them on, and about what a bucket of columns has
CENTRES = 2**22  # entries that a task joins into groups
CELL_ROWS, CELL_ENTRIES = 2048, 2**20  # rows and entries of a block of rows, about
DENSE = 64  # columns in which one in so many pairs of rows meet are multiplied as a dense block
COLUMNS = 2048  # of so many columns
EXPANDED = 2**19  # pairs of entries that other columns add at a time

# Link when 100 * intersection >= 80 * union, kept in whole numbers: 5 i >= 4 u.
NUM, DEN = 4, 5


FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * FACTOR
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: Iterable[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    # Bytes are split at the six blanks meant here, and lower() changes A to Z only.
    parts = [(t or "").encode().lower().split() for t in texts]
    counts = [len(p) for p in parts]
    flat = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(parts)), np.uint64, sum(counts))
    totals = {}
    for width in {min(words, n) for n in counts if n}:
        total = np.full(max(0, len(flat) - width + 1), width, np.uint64)
        for i in range(width):
            total = total * FACTOR + flat[i : i + len(total)]
        totals[width] = _mixed(total)
    out, at = [], 0
    for n in counts:
        width = min(words, n)
        out.append(np.unique(totals[width][at : at + n - width + 1]) if n else np.zeros(0, np.uint64))
        at += n
    return out


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    return shingle_sets([text], words)[0]


def _in_parts(texts: pd.Series, words: int) -> Iterator[np.ndarray]:
    for at in range(0, len(texts), 200):
        yield from shingle_sets(texts.iloc[at : at + 200], words)


def set_id(hashes: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxh3_64_intdigest(hashes.tobytes())).astype(np.int64)))


def prefix_length(n: int) -> int:
    """Shingles of a row that are looked at first."""
    return min(n, n - -(-NUM * n // DEN) + 1 + n // LONGER)


def prefix_need(n: int | Column) -> int | Column:
    """How many of them two rows that link have in common at least, for the size of either."""
    if isinstance(n, Column):
        return F.greatest(F.lit(1), F.floor(n / LONGER))
    return max(1, n // LONGER)


def _band(n: Column) -> Column:
    """Band of sizes; rows that can link are in the same or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / np.log(DEN / NUM)).cast("int")


def _rows_of(words: int):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        sizes, nodes = [], []
        for own in _in_parts(batch["text"], words):
            sizes.append(len(own))
            nodes.append(set_id(own) if len(own) else None)
        # As an array of its own kind: beside a None pandas would make doubles of the numbers.
        return batch[["doc_id", "of_text"]].assign(n_shingles=sizes, node=pd.array(nodes, "Int64"))

    return by_batch(run)


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    """Which entries are the first of their value."""
    first = np.ones(len(sorted_values), bool)
    first[1:] = sorted_values[1:] != sorted_values[:-1]
    return first


def _entry_packs(words: int, bits: int):
    """Prefix entries (column, row), packed by bucket of columns.

    Of a column with several rows among those a task holds, all entries are known to be
    shared and only the first goes on to meet those of other tasks.
    """

    def packs(nodes: list[int], prefixes: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        column = np.concatenate(prefixes)
        node = np.repeat(np.array(nodes, np.int64), [len(p) for p in prefixes])
        order = np.argsort(column, kind="stable")
        column, node = column[order], node[order]
        first = _starts(column)
        many = np.diff(np.append(np.flatnonzero(first), len(column))) > 1
        shared = np.repeat(many, np.diff(np.append(np.flatnonzero(first), len(column))))
        rows = []
        if shared.any():
            # Settled here, so any bucket will do.
            rows.append((nodes[0] & (2**bits - 1), True, column[shared].tobytes(), node[shared].tobytes(), b""))
        column, node = column[first], node[first]
        bucket = (column >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(column), np.int64)
        ends = np.searchsorted(bucket, np.arange(2**bits + 1))
        for b in np.flatnonzero(np.diff(ends)):
            own = slice(ends[b], ends[b + 1])
            rows.append((int(b), False, column[own].tobytes(), node[own].tobytes(), many[own].tobytes()))
        yield pd.DataFrame(rows, columns=["bucket", "settled", "columns", "nodes", "known"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, prefixes, seen, held = [], [], set(), 0
        for batch in batches:
            for own in _in_parts(batch["text"], words):
                node = set_id(own) if len(own) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                prefixes.append(own[: prefix_length(len(own))].copy())
                held += len(prefixes[-1])
                if held > PACKED:
                    yield from packs(nodes, prefixes)
                    nodes, prefixes, seen, held = [], [], set(), 0
        if nodes:
            yield from packs(nodes, prefixes)

    return run


def _shared_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of the columns that several rows hold. The packs come sorted by bucket."""

    def settle(packs: list[tuple]) -> pd.DataFrame:
        column = np.concatenate([np.frombuffer(p[0], np.uint64) for p in packs])
        node = np.concatenate([np.frombuffer(p[1], np.int64) for p in packs])
        known = np.concatenate([np.frombuffer(p[2], bool) for p in packs])
        order = np.lexsort((node, column))
        column, node, known = column[order], node[order], known[order]
        # A row that two tasks or two flushes of one have seen is one row.
        again = ~_starts(column) & ~_starts(node)
        pair = np.cumsum(~again) - 1
        known = np.bincount(pair, known) > 0
        column, node = column[~again], node[~again]
        first = np.flatnonzero(_starts(column))
        count = np.diff(np.append(first, len(column)))
        new = np.repeat(count > 1, count) & ~known
        return pd.DataFrame([(column[new].tobytes(), node[new].tobytes())], columns=["columns", "nodes"])

    at, packs = None, []
    for batch in batches:
        done = batch[batch["settled"]]
        if len(done):
            yield done[["columns", "nodes"]]
        for bucket, *pack in batch.loc[~batch["settled"], ["bucket", "columns", "nodes", "known"]].itertuples(index=False):
            if bucket != at and packs:
                yield settle(packs)
                packs = []
            at = bucket
            packs.append(pack)
    if packs:
        yield settle(packs)


def _dealt_by_row(bits: int):
    """Rows of shared entries, packed by part of rows, so that the columns of a row are counted in one task."""

    def packs(parts: list[np.ndarray]) -> pd.DataFrame:
        # Sorted, so that the entries of a row stand together and travel compressed.
        node = np.sort(np.concatenate(parts))
        part = (node >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(node), np.int64)
        ends = np.searchsorted(part, np.arange(2**bits + 1))
        rows = [(int(p), node[ends[p] : ends[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(ends))]
        return pd.DataFrame(rows, columns=["part", "nodes"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for batch in batches:
            for own in batch["nodes"]:
                parts.append(np.frombuffer(own, np.uint64))
                held += len(parts[-1])
                if held > PACKED:
                    yield packs(parts)
                    parts, held = [], 0
        if held:
            yield packs(parts)

    return run


def _held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many shared columns each row is, added up over the packs of a task: ``node, held``."""

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        node, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return node, np.bincount(at, np.concatenate([p[1] for p in parts]), len(node)).astype(np.int64)

    parts, held = [], 0
    for batch in batches:
        for own in batch["nodes"]:
            # A row that several tasks have seen may count a column more than once, which only keeps more rows.
            parts.append(np.unique(np.frombuffer(own, np.int64), return_counts=True))
            held += len(parts[-1][0])
            if held > PACKED:
                parts = [added(parts)]
                held = len(parts[0][0])
                if held > PACKED // 2:  # so that adding up is rare
                    yield pd.DataFrame(dict(zip(("node", "held"), parts[0], strict=True)))
                    parts, held = [], 0
    if parts:
        yield pd.DataFrame(dict(zip(("node", "held"), added(parts), strict=True)))


def held_columns(shared: DataFrame, bits: int) -> DataFrame:
    """``node, held``: in how many shared columns each row is.

    Entries are dealt to ``2**bits`` parts of rows, as many as there are buckets of columns, so a row is counted
    by one task and mostly comes once; a task that holds too many rows passes on what it has, to be added up.
    """
    packs = shared.select("nodes").mapInPandas(_dealt_by_row(bits), "part int, nodes binary")
    return packs.repartition(2**bits, "part").select("nodes").mapInPandas(_held, "node long, held long")


def _plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of each pack as rows."""
    for batch in batches:
        for columns, nodes in batch[["columns", "nodes"]].itertuples(index=False):
            if len(nodes):
                yield pd.DataFrame({"column": np.frombuffer(columns, np.int64), "node": np.frombuffer(nodes, np.int64)})


def _local_stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For the entries of a task: edges ``a, b`` to the first row of each column, and that row (``b`` NULL) to meet other tasks."""

    def stars(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts)
        column, node = rows["column"].to_numpy(np.int64), rows["node"].to_numpy(np.int64)
        order = np.argsort(column, kind="stable")
        column, node = column[order], node[order]
        first = _starts(column)
        centre = node[first][np.cumsum(first) - 1]
        edges = pd.DataFrame({"a": node, "b": centre}).loc[node != centre].drop_duplicates()
        yield edges.assign(column=0).astype({"b": "Int64"})
        yield pd.DataFrame({"a": node[first], "b": None, "column": column[first]}).astype({"b": "Int64"})

    parts, held = [], 0
    for batch in batches:
        parts.append(batch)
        held += len(batch)
        if held > PACKED:
            yield from stars(parts)
            parts, held = [], 0
    if parts:
        yield from stars(parts)


def _stars_across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges ``a, b`` between rows of the same column, for rows that come sorted by column; none that others of the task imply.

    A task so passes on fewer edges than it has rows, however many columns these share.
    """
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    last_column, last_centre = None, None
    for batch in batches:
        column, node = batch["column"].to_numpy(np.int64), batch["a"].to_numpy(np.int64)
        if not len(column):
            continue
        first = _starts(column)
        number = np.cumsum(first) - 1
        centres = node[first].copy()
        if column[0] == last_column:
            centres[0] = last_centre
        last_column, last_centre = column[-1], centres[-1]
        edges = pd.DataFrame({"a": node, "b": centres[number]}).drop_duplicates()
        joins = []
        for x, y in zip(edges["a"].tolist(), edges["b"].tolist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                joins.append((x, y))
        yield pd.DataFrame(joins, columns=["a", "b"]).astype("int64")


def _groups(shared: DataFrame, alive: DataFrame) -> DataFrame:
    """``node, root``: rows that share a column of their prefixes, directly or over others."""
    entries = shared.mapInPandas(_plain, "column long, node long").join(alive.select("node"), "node")
    # Written in between: two Python functions in one task take two workers, which executors then keep.
    entries = cut(entries.select("column", "node"))
    stars = cut(entries.mapInPandas(_local_stars, "column long, a long, b long"))
    # Each task names a column once, so a column has no more rows than there are tasks.
    centres = stars.filter("b is null").select("column", "a")
    parts = 1 + centres.count() // CENTRES
    centres = centres.repartition(parts, "column").sortWithinPartitions("column", "a")
    across = centres.mapInPandas(_stars_across, "a long, b long")
    return components(stars.filter("b is not null").select("a", "b").union(across))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """One row with the whole set for each wanted class; only the texts that stand for one are read as shingles."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        sets = [own.tobytes() for own in _in_parts(batch["text"], words)]
        return batch[["node"]].assign(hashes=sets).drop_duplicates("node")

    texts = lookup_join(docs.select("of_text", "text"), wanted.select("of_text", "node"), ["of_text"])
    found = texts.filter("node is not null").select("node", "text").mapInPandas(by_batch(run), "node long, hashes binary")
    return wanted.drop("of_text").join(found.groupBy("node").agg(F.first("hashes").alias("hashes")), "node")


def _cells(rows: DataFrame) -> DataFrame:
    """Rows in every cell of the product that they take part in. Cells are made of blocks on the cluster, as a table."""
    n = F.octet_length("hashes") / 8
    rows = rows.withColumn("band", _band(n))
    whole = rows.groupBy("root").agg(F.count("*").alias("r"), F.sum(n).alias("e"))
    small = (F.col("r") <= CELL_ROWS) & (F.col("e") <= CELL_ENTRIES)
    large = cut(whole.filter(~small).select("root"))
    if large.isEmpty():
        return rows.withColumns({"band": F.lit(0), "part": F.lit(0), "cell": F.lit(0), "across": F.lit(False)})
    # A group that fits into one block is one cell whatever its bands.
    rows = rows.join(large.withColumn("_large", F.lit(True)), "root", "left")
    few = rows.filter("_large is null").drop("_large").withColumns(
        {"band": F.lit(0), "part": F.lit(0), "cell": F.lit(0), "across": F.lit(False)}
    )
    many = rows.filter("_large").drop("_large")
    most = F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum(n) / CELL_ENTRIES)).cast("int")
    parts = cut(many.groupBy("root", "band").agg(most.alias("parts")))
    blocks = parts.select("root", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    one = blocks.withColumn("other_band", F.explode(F.array("band", F.col("band") + 1)))
    two = blocks.select("root", F.col("band").alias("other_band"), F.col("part").alias("other_part"))
    pairs = one.join(two, ["root", "other_band"]).filter("band < other_band or part <= other_part")
    cell = F.xxhash64("band", "part", "other_band", "other_part").alias("cell")
    other = F.struct(F.col("other_band").alias("band"), F.col("other_part").alias("part"))
    side = F.explode(F.array_distinct(F.array(F.struct("band", "part"), other))).alias("side")
    across = ((F.col("band") != F.col("other_band")) | (F.col("part") != F.col("other_part"))).alias("across")
    sides = pairs.select("root", cell, across, side).select("root", "cell", "across", "side.*")
    placed = many.join(parts, ["root", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).drop("parts")
    return few.unionByName(placed.join(sides, ["root", "band", "part"]))


def _entries(sets: list[np.ndarray], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column of the entries in the given columns, by column, and where each column begins."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.searchsorted(columns, flat)
    held = columns[np.minimum(column, len(columns) - 1)] == flat
    row, column = row[held], column[held]
    order = np.argsort(column, kind="stable")
    return row[order], column[order], np.searchsorted(column[order], np.arange(len(columns) + 1))


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shingles that each set of one list shares with each of the other: their product, added up over blocks of columns."""
    total = np.zeros((len(a), len(b)), np.int32)
    columns = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    if not len(columns):
        return total
    (row_a, column_a, start_a), (row_b, column_b, start_b) = _entries(a, columns), _entries(b, columns)
    wide = np.diff(start_b)
    pairs = np.diff(start_a) * wide
    dense = pairs * DENSE >= len(a) * len(b)
    many = np.flatnonzero(dense)
    for at in range(0, len(many), COLUMNS):
        place = np.full(len(columns), -1)
        place[many[at : at + COLUMNS]] = np.arange(len(many[at : at + COLUMNS]))
        sides = []
        for rows, row, column in ((len(a), row_a, column_a), (len(b), row_b, column_b)):
            own = place[column] >= 0
            sides.append(np.zeros((rows, min(COLUMNS, len(many) - at)), np.float32))
            sides[-1][row[own], place[column[own]]] = 1
        total += (sides[0] @ sides[1].T).astype(np.int32)
    few = np.flatnonzero(~dense)
    ends = np.cumsum(pairs[few])
    for at in range(0, int(ends[-1]) if len(few) else 0, EXPANDED):
        number = np.arange(at, min(at + EXPANDED, int(ends[-1])))
        which = np.searchsorted(ends, number, side="right")
        step = number - (ends - pairs[few])[which]
        x = row_a[start_a[few[which]] + step // wide[few[which]]]
        y = row_b[start_b[few[which]] + step % wide[few[which]]]
        np.add.at(total.reshape(-1), x * len(b) + y, 1)
    return total


def _left_in_cell(sets: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Rows of one block or two that can still link in this cell: those that keep four fifths of their shingles when
    shingles without a second row to meet are left out, again and again."""
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in sets]
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in sets]
    size = [np.array([len(s) for s in x], np.int64) for x in sets]
    column = np.unique(np.concatenate(flat), return_inverse=True)[1]
    columns = np.split(column, [len(flat[0])])[: len(sets)]
    width = int(column.max(initial=-1)) + 1
    alive = [np.ones(len(x), bool) for x in sets]
    while True:
        entries = [a[r] for a, r in zip(alive, row, strict=True)]
        counts = [np.bincount(c[e], minlength=width) for c, e in zip(columns, entries, strict=True)]
        meets = counts[0] > 1 if len(sets) == 1 else (counts[0] > 0) & (counts[1] > 0)
        kept = [np.bincount(r[e & meets[c]], minlength=len(a)) for r, e, c, a in zip(row, entries, columns, alive, strict=True)]
        now = [a & (DEN * k >= NUM * n) for a, k, n in zip(alive, kept, size, strict=True)]
        if all((x == y).all() for x, y in zip(now, alive, strict=True)):
            return [np.flatnonzero(a) for a in alive]
        alive = now


def _labels(linked: np.ndarray, alone: bool) -> np.ndarray:
    """The first row that links reach from each row; the rows of two blocks are numbered one after the other."""
    n, m = linked.shape
    label = np.arange(n if alone else n + m)
    far = len(label)
    while True:
        of_columns = label[:n] if alone else label[n:]
        new = label.copy()
        for at in range(0, n, 256):
            own = slice(at, min(at + 256, n))
            part = linked[own]
            new[own] = np.minimum(new[own], np.where(part, of_columns, far).min(axis=1, initial=far))
            if not alone:
                new[n:] = np.minimum(new[n:], np.where(part, label[own, None], far).min(axis=0, initial=far))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _cell_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links of the rows of a block with each other, or of two blocks across: how many, and one row of each linked set."""
    blocks = [own for _, own in group.groupby(["band", "part"])]
    alone = not group["across"].iloc[0]
    if not alone and len(blocks) < 2:  # the other block has no rows
        return pd.DataFrame({"node": [], "links": [], "near": []}).astype("int64")
    sets = [[np.frombuffer(h, np.uint64) for h in own["hashes"]] for own in blocks]
    left = _left_in_cell(sets)
    if not all(len(x) for x in left) or (alone and len(left[0]) < 2):
        return pd.DataFrame({"node": [], "links": [], "near": []}).astype("int64")
    sets = [[own[i] for i in x] for own, x in zip(sets, left, strict=True)]
    sizes = [np.array([len(x) for x in own]) for own in sets]
    copies = [own["copies"].to_numpy(np.int64)[x] for own, x in zip(blocks, left, strict=True)]
    node = np.concatenate([own["node"].to_numpy(np.int64)[x] for own, x in zip(blocks, left, strict=True)])
    both = overlaps(sets[0], sets[-1])
    linked = np.zeros(both.shape, bool)
    links = [np.zeros(len(x), np.int64) for x in copies]
    for at in range(0, len(both), 256):
        part = both[at : at + 256].astype(np.int64)
        own = DEN * part >= NUM * (np.add.outer(sizes[0][at : at + 256], sizes[-1]) - part)
        if alone:  # a row is not linked with itself; every pair is met from both sides
            own[np.arange(len(part)), at + np.arange(len(part))] = False
        links[0][at : at + 256] = own @ copies[-1]
        if not alone:
            links[1] += copies[0][at : at + 256] @ own
        linked[at : at + 256] = own
    total = np.concatenate(links)
    found = pd.DataFrame({"node": node, "links": total, "near": node[_labels(linked, alone)]})
    return found[total > 0]


def linked_classes(docs: DataFrame, classes: DataFrame, words: int = WORDS) -> DataFrame:
    """``node, links, root`` for the classes that link with others: with how many documents, and the group they are in."""
    entries = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (1 - NUM / DEN + 1 / LONGER)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = int(np.ceil(np.log2(max(1, parts, entries / PACKED))))
    schema = "bucket int, settled boolean, columns binary, nodes binary, known binary"
    packs = docs.select("text").mapInPandas(_entry_packs(words, bits), schema)
    dealt = packs.repartition(2**bits, "bucket").sortWithinPartitions("bucket")
    shared = cut(dealt.mapInPandas(_shared_entries, "columns binary, nodes binary"))
    held = held_columns(shared, bits).groupBy("node").agg(F.sum("held").alias("held"))
    alive = cut(classes.join(held, "node").filter(F.col("held") >= prefix_need(F.col("n"))).drop("held"))
    wanted = cut(alive.join(_groups(shared, alive), "node").select("node", "copies", "of_text", "root"))
    cells = _cells(cut(_sets(docs, wanted, words)))
    found = cut(cells.groupBy("root", "cell").applyInPandas(_cell_links, "node long, links long, near long"))
    roots = components(found.select(F.col("node").alias("a"), F.col("near").alias("b")))
    return roots.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node")


def shingle_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, n_links`` for every row of ``docs``.

    ``class_id`` is the smallest ``doc_id`` with the same shingle set, ``component_id``
    the smallest that links reach, and ``n_links`` the number of other rows that the
    row links with, equal ones included.
    """
    # Ids go through as text, since pandas would turn those beside a NULL into doubles.
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("of_text"), "text")
    rows = cut(docs.mapInPandas(_rows_of(words), "doc_id string, of_text long, n_shingles long, node long"))
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    classes = rows.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.min("of_text").alias("of_text")
    )
    classes = cut(classes)
    linked = linked_classes(docs, classes.select("node", "n", "copies", "of_text"), words)
    named = cut(classes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")))
    lowest = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    named = cut(named.join(lowest, "root").select("node", "class_id", "component_id", links))
    own = F.col("doc_id")
    return spread_left_join(rows.drop("of_text"), named, ["node"]).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), own).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("node").isNull(), own).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def link_counts(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_links`` for every row of ``docs``: with how many other rows it links, equal ones included."""
    return shingle_components(docs, words).select("doc_id", "n_links")
