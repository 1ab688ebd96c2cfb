"""Near-duplicate vectors: all pairs above a cosine, by dual traversal of cover trees.

Equal vectors are one row with a multiplicity. The upper levels of the tree come
from a bounded sample: nested nets of halving radius, as long as they have few
centres. Every row is assigned to its nearest centre; cells whose centres lie further
apart than their radii and the threshold allow are never compared. Cells are cut
into blocks of bounded size, and each block gets a cover tree of its own: a node's
children are centres at half its radius, and all rows of a node lie within its
measured radius.

Two blocks are compared by walking both trees together. A pair of nodes is dropped
when even their nearest rows would be too far, taken whole when even their farthest
are near enough, and opened otherwise; single rows are compared exactly. A group of
very many near copies is so counted by nodes instead of pairs. A task returns sums
and a spanning star per row, never the pairs.

Data without any structure in high dimensions can't be pruned above the rows; then
every block meets every other, as any exact method must.

Defined results: unusable vectors link with nothing and are their own component;
vectors of different length do not link; equal rows, also of one ``vec_id``, link.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import by_batch, cut
from spendlens.llm.components import components
from spendlens.llm.vectors import matrix, packed_vectors, precision, unit, usable
from spendlens.plans.joins import spread_left_join

COSINE = 0.95
SAMPLE = 2048  # rows that the upper levels are made from
CELLS = 64  # most centres of the upper levels
BLOCK = 4096  # rows of a block, about
LEAF = 8  # a node of so few rows is not opened further
SLACK = 1e-7  # a node of this radius is not opened further; products can't tell rows apart much below it
ROUNDING = 1e-5  # more than a product of unit vectors in single precision can be off
PAIRS = 2**17  # row pairs that are compared exactly at a time


@dataclass
class Tree:
    """Nodes in arrays. A node's rows are ``start`` to ``end``, its children the nodes ``first`` to ``last``."""

    order: np.ndarray  # the rows in the order that start and end count in
    radius: np.ndarray
    centre: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def packed(self) -> dict[str, bytes]:
        nodes = np.stack([self.centre, self.start, self.end, self.first, self.last])
        return {"nodes": nodes.tobytes(), "radius": self.radius.tobytes()}

    @staticmethod
    def unpacked(nodes: bytes, radius: bytes) -> Tree:
        """A tree over rows that are stored in its order."""
        radius = np.frombuffer(radius)
        fields = np.frombuffer(nodes, np.int64).reshape(5, len(radius))
        return Tree(np.arange(fields[2].max(initial=0)), radius, *fields)

    def children(self, node: int) -> np.ndarray:
        """The node itself if it has none."""
        return np.arange(self.first[node], self.last[node]) if self.last[node] else np.array([node])


def _net(rows: np.ndarray, members: np.ndarray, centre: int, radius: float) -> list[tuple[int, np.ndarray]]:
    """Centres further apart than the radius, the given one first, and the rows each is the first to cover."""
    near, out = 1 - radius * radius / 2, []
    free = np.concatenate([[centre], members[members != centre]])
    while len(free):
        # A batch of candidates in order: one is a centre unless an earlier centre covers it.
        batch = free[:256]
        covers = rows[batch] @ rows[batch].T >= near
        chosen: list[int] = []
        for i in range(len(batch)):
            if not covers[i, chosen].any():
                chosen.append(i)
        reached = rows[free] @ rows[batch[chosen]].T >= near
        reached[chosen, np.arange(len(chosen))] = True
        owner = np.where(reached.any(axis=1), reached.argmax(axis=1), len(chosen))
        owner[chosen] = np.arange(len(chosen))
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(chosen) + 1))
        out += [(int(batch[c]), free[order[x:y]]) for c, x, y in zip(chosen, cuts[:-1], cuts[1:], strict=True)]
        free = free[order[cuts[-1] :]]
    return out


def cover_tree(rows: np.ndarray) -> Tree:
    """A cover tree over unit vectors, from the radius 2 that holds all of them downwards."""
    order: list[int] = []
    centre, radius, start, end, first, last = [], [], [], [], [], []

    def add(middle: int, members: np.ndarray) -> int:
        far = float(np.linalg.norm(rows[members] - rows[middle], axis=1).max()) if len(members) > 1 else 0.0
        for values, value in zip((centre, radius, start, end, first, last), (middle, far, -1, -1, 0, 0), strict=True):
            values.append(value)
        return len(centre) - 1

    todo = [(add(0, np.arange(len(rows))), np.arange(len(rows)), 2.0, False)] if len(rows) else []
    while todo:
        node, members, level, closing = todo.pop()
        if closing:
            end[node] = len(order)
            continue
        start[node] = len(order)
        # The level halves each time, so this ends even where rounding leaves the radius as it was.
        if len(members) <= LEAF or min(radius[node], level) <= SLACK:
            order.extend(members.tolist())
            end[node] = len(order)
            continue
        todo.append((node, members, level, True))  # closed when its children are done
        half = level / 2
        while radius[node] <= half:
            half /= 2
        first[node] = len(centre)
        todo += [(add(middle, own), own, half, False) for middle, own in _net(rows, members, centre[node], half)]
        last[node] = len(centre)
    fields = [np.array(x, np.int64) for x in (centre, start, end, first, last)]
    return Tree(np.array(order, np.int64), np.array(radius), *fields)


def _exact(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the row pairs that are linked, in double precision."""
    keep = np.einsum("ij,ij->i", a[x], b[y]) >= cosine
    return x[keep], y[keep]


def _row_pairs(tree_a: Tree, n: np.ndarray, tree_b: Tree, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every row of a node with every row of its partner, for pairs of closed nodes, at most ``PAIRS`` at a time."""
    wide = tree_b.end[m] - tree_b.start[m]
    ends = np.cumsum((tree_a.end[n] - tree_a.start[n]) * wide)
    for at in range(0, int(ends[-1]), PAIRS):
        number = np.arange(at, min(at + PAIRS, int(ends[-1])))
        pair = np.searchsorted(ends, number, side="right")
        place = number - np.concatenate([[0], ends])[pair]
        yield tree_a.start[n][pair] + place // wide[pair], tree_b.start[m][pair] + place % wide[pair]


def walk(a: np.ndarray, tree_a: Tree, b: np.ndarray, tree_b: Tree, cosine: float = COSINE):
    """Yields ``(rows of a, rows of b, whole)``: whole when every such pair is linked, else one by one.

    Rows are in the order of their tree. Products are taken in single precision, and
    ``ROUNDING`` keeps every decision that they can't make for the exact one.
    """
    reach = float(np.sqrt(2 - 2 * cosine))
    low_a, low_b = a.astype(np.float32), b.astype(np.float32)
    todo = [(0, 0)] if len(a) and len(b) else []
    while todo:
        i, j = todo.pop()
        left, right = tree_a.children(i), tree_b.children(j)
        alone_a, alone_b = (t.end[n] - t.start[n] == 1 for t, n in ((tree_a, left), (tree_b, right)))
        # Single rows against single rows need no radius: one product and one comparison.
        rows_a, rows_b = tree_a.start[left[alone_a]], tree_b.start[right[alone_b]]
        for at in range(0, len(rows_a), 1024):
            part = rows_a[at : at + 1024]
            x, y = np.nonzero(low_a[part] @ low_b[rows_b].T >= cosine - ROUNDING)
            if len(x):
                yield *_exact(a, b, part[x], rows_b[y], cosine), False
        for some, others in ((left[~alone_a], right), (left[alone_a], right[~alone_b])):
            for at in range(0, len(some), 1024):
                part = some[at : at + 1024]
                product = low_a[tree_a.centre[part]] @ low_b[tree_b.centre[others]].T
                span = np.add.outer(tree_a.radius[part], tree_b.radius[others])
                far = 1 - np.minimum(2, reach + span) ** 2 / 2 - ROUNDING
                inside = np.where(span <= reach, 1 - (reach - span) ** 2 / 2 + ROUNDING, np.inf)
                x, y = np.nonzero(product >= far)
                whole = product[x, y] >= inside[x, y]
                n, m = part[x], others[y]
                closed = (tree_a.last[n] == 0) & (tree_b.last[m] == 0) & ~whole
                if closed.any():
                    for p, q in _row_pairs(tree_a, n[closed], tree_b, m[closed]):
                        yield *_exact(a, b, p, q, cosine), False
                for i, j in zip(n[whole].tolist(), m[whole].tolist(), strict=True):
                    yield np.arange(tree_a.start[i], tree_a.end[i]), np.arange(tree_b.start[j], tree_b.end[j]), True
                todo += zip(n[~whole & ~closed].tolist(), m[~whole & ~closed].tolist(), strict=True)


def _local_roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index that links reach, for n rows."""
    root = np.arange(n)
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    return root


def block_links(a: pd.Series, b: pd.Series | None, kind: str, cosine: float) -> pd.DataFrame:
    """Linked vectors of each row within a block, or across two, and a node to join it with."""
    sides = [a] if b is None else [a, b]
    nodes = [np.frombuffer(s["ids"], np.int64) for s in sides]
    copies = [np.frombuffer(s["copies"], np.int64) for s in sides]
    rows = [unit(matrix(s["vectors"], kind, len(n))) for s, n in zip(sides, nodes, strict=True)]
    trees = [Tree.unpacked(s["nodes"], s["radius"]) for s in sides]
    other, shift = (0, 0) if b is None else (1, len(nodes[0]))
    links = [np.zeros(len(n), np.int64) for n in nodes]
    pairs = []
    for x, y, whole in walk(rows[0], trees[0], rows[other], trees[other], cosine):
        if whole:
            links[0][x] += copies[other][y].sum()
            if b is not None:
                links[1][y] += copies[0][x].sum()
            pairs.append((x, np.full(len(x), y[0] + shift)))
            pairs.append((np.full(len(y), x[0]), y + shift))
        else:
            np.add.at(links[0], x, copies[other][y])
            if b is not None:
                np.add.at(links[1], y, copies[0][x])
            pairs.append((x, y + shift))
    node = np.concatenate(nodes)
    out = pd.DataFrame({"node": node, "links": np.concatenate(links), "root": node[_local_roots(len(node), pairs)]})
    return out[out["links"] > 0]


def _centres(sample: np.ndarray) -> np.ndarray:
    """The finest of the nested nets of halving radius that has at most ``CELLS`` centres."""
    if not len(sample):
        return sample
    chosen, radius = sample[:1], 2.0
    while radius > 1e-3:
        radius /= 2
        net = list(chosen)
        free = sample
        for c in chosen:
            free = free[np.linalg.norm(free - c, axis=1) > radius]
        while len(free) and len(net) <= CELLS:
            net.append(free[0])
            free = free[np.linalg.norm(free - free[0], axis=1) > radius]
        if len(net) > CELLS:
            break
        chosen = np.array(net)
    return chosen


def _in_cells(centres: dict[int, np.ndarray], kind: str):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        cells, far = np.zeros(len(batch), np.int64), np.zeros(len(batch))
        width = batch["vector"].map(len).to_numpy()
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            rows = unit(matrix(b"".join(batch["vector"].iloc[at]), kind, len(at)))
            apart = np.sqrt(np.maximum(0, 2 - 2 * rows @ centres[w].T)) if w in centres else np.zeros((len(at), 1))
            cells[at] = apart.argmin(axis=1)
            # Vectors of a length that the sample missed are one cell, held to be as wide as can be.
            far[at] = apart.min(axis=1) if w in centres else 2.0
        return batch.assign(width=width, cell=cells, far=far)

    return by_batch(run)


def _near_cells(cells: pd.DataFrame, centres: dict[int, np.ndarray], cosine: float) -> list[tuple[int, int, int]]:
    """Pairs of cells (width, a <= b) that some linked pair may lie across."""
    angle, out = np.arccos(cosine), []
    reach = 2 * np.sin(angle / 2)
    for w, group in cells.groupby("width"):
        for x in group.itertuples():
            for y in group.itertuples():
                if x.cell <= y.cell:
                    c = centres.get(w)
                    apart = 0.0 if c is None else float(np.linalg.norm(c[x.cell] - c[y.cell]))
                    if x.cell == y.cell or apart <= x.far + y.far + reach + 1e-6:
                        out.append((int(w), int(x.cell), int(y.cell)))
    return out


def _block(kind: str):
    """A block in one row: its classes in the order of its tree, and the tree."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        tree = cover_tree(unit(matrix(b"".join(group["vector"]), kind, len(group))))
        place = np.empty(len(group), np.int64)
        place[tree.order] = np.arange(len(group))
        tree.centre = place[tree.centre]
        group = group.iloc[tree.order]
        row = {c: group[c].iloc[0] for c in ("width", "cell", "part")}
        row |= {"ids": group["node"].to_numpy(np.int64).tobytes(), "copies": group["copies"].to_numpy(np.int64).tobytes()}
        return pd.DataFrame([row | {"vectors": b"".join(group["vector"]), **tree.packed()}])

    return run


def class_links(classes: DataFrame, kind: str, cosine: float = COSINE) -> DataFrame:
    """``node, links, root`` from every pair of blocks, for classes ``node, copies, vector``."""
    spark = classes.sparkSession
    # The names are hashes, so the smallest are a sample that does not depend on order.
    sample = classes.orderBy("node").limit(SAMPLE).select("vector").toPandas()["vector"]
    centres = {}
    for w in sorted(set(sample.map(len))):
        own = [v for v in sample if len(v) == w]
        centres[w] = _centres(unit(matrix(b"".join(own), kind, len(own))))
    schema = "node long, copies long, vector binary, width int, cell int, far double"
    placed = cut(classes.select("node", "copies", "vector").mapInPandas(_in_cells(centres, kind), schema))
    cells = placed.groupBy("width", "cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).toPandas()
    if not len(cells):
        return spark.createDataFrame([], "node long, links long, root long")
    # One row per cell and length, at most ``CELLS`` for each length of vector.
    counts = [(int(r.width), int(r.cell), -(-int(r.n) // BLOCK)) for r in cells.itertuples()]
    parts = spark.createDataFrame(counts, "width int, cell int, parts int")
    rows = placed.join(F.broadcast(parts), ["width", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    schema = "width int, cell int, part int, ids binary, copies binary, vectors binary, nodes binary, radius binary"
    blocks = cut(rows.drop("far", "parts").groupBy("width", "cell", "part").applyInPandas(_block(kind), schema))
    blocks = blocks.withColumn("block", F.struct("cell", "part"))
    near = spark.createDataFrame(_near_cells(cells, centres, cosine), "width int, cell int, cell_b int")
    ids = blocks.select("width", "cell", F.col("block").alias("a"))
    twins = blocks.select("width", F.col("cell").alias("cell_b"), F.col("block").alias("b"))
    pairs = ids.join(near, ["width", "cell"]).join(twins, ["width", "cell_b"]).filter("a <= b").select("width", "a", "b")
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("a", "b"))))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["cell", "part"])
        return block_links(group.iloc[0], group.iloc[1] if len(group) > 1 else None, kind, cosine)

    held = sides.join(blocks, ["width", "block"]).drop("block")
    return held.groupBy("width", "a", "b").applyInPandas(compare, "node long, links long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    named = cut(packed_vectors(vectors))
    classes = named.groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("lowest"), F.first("vector").alias("vector"))
    classes = cut(classes)
    found = cut(class_links(classes, precision(vectors), cosine))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = classes.select("node", "lowest").join(links, "node", "left").join(roots.select("node", "root"), "node", "left")
    nodes = cut(nodes.withColumn("root", F.coalesce("root", "node")))
    smallest = nodes.groupBy("root").agg(F.min("lowest").alias("component_id"))
    # A row counts itself among the links of its class.
    result = cut(nodes.join(smallest, "root").select("node", (F.coalesce("links", F.lit(1)) - 1).alias("n_links"), "component_id"))
    linked = spread_left_join(named.select("vec_id", "node"), result, ["node"]).select("vec_id", "n_links", "component_id")
    alone = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(~usable(F.col("embedding")))
    rows = linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
