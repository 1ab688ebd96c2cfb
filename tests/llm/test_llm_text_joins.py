import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlens.llm import bloom, line_dedup, mixing, shingle_join
from spendlens.llm.components import components
from spendlens.llm.oracle import oracle

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def grouped(rows, linked):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]

    def linked(i, j):
        return sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])

    root = grouped(rows, linked)
    low = {}
    for (doc_id, _), r in zip(rows, root, strict=True):
        low[r] = min((x for x in (low.get(r), doc_id) if x is not None), default=None)
    return sorted(((d, len(s), low[r]) for (d, _), s, r in zip(rows, sets, root, strict=True)), key=str)


def near_copies(seed, n=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for base in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        if base % 2:
            words = words[:40] + common + words[40:]
        for _ in range(rng.randint(1, 5)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(documents, seed):
    rows = near_copies(seed)
    got = shingle_join.shingle_components(documents(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    return sorted(((d, sum(i != j and bool(s and o) and 100 * len(s & o) >= 80 * len(s | o) for j, o in enumerate(sets)))
                   for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_overlaps_are_those_of_the_sets(monkeypatch):
    monkeypatch.setattr(shingle_join, "COLUMNS", 7)
    monkeypatch.setattr(shingle_join, "EXPANDED", 50)
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 3000, 60) ** 2 // 3000).astype(np.uint64) for _ in range(n)] for n in (40, 30))
    for dense in (1, 64, 10_000):
        monkeypatch.setattr(shingle_join, "DENSE", dense)
        assert (shingle_join.overlaps(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
    assert not shingle_join.overlaps(a, [np.array([2**63], np.uint64)]).any()


def test_links_inside_a_group_are_all_counted(documents, odd_rows, monkeypatch):
    monkeypatch.setattr(shingle_join, "CELL_ROWS", 16)
    rng, group = random.Random(5), []
    for i in range(60):
        copy = [f"y{k}" for k in range(80)]
        for at in rng.sample(range(80), rng.randint(0, 2)):
            copy[at] = f"z{i}"
        group.append((1000 + i, " ".join(copy)))
    rows = near_copies(4) + group + [(2000 + i, t) if d is not None else (d, t) for i, (d, t) in enumerate(odd_rows)]
    got = shingle_join.link_counts(documents(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_links(rows)
    assert shingle_join.link_counts(documents([])).collect() == []


def test_chains_and_a_large_group(documents):
    """Neighbours link, the ends do not: pivots alone would not join them."""
    words = [f"x{i}" for i in range(200)]
    chain = [(i, " ".join(words[2 * i : 2 * i + 100])) for i in range(30)]
    rng = random.Random(5)
    group = []
    for i in range(120):
        copy = [f"y{k}" for k in range(80)]
        copy[rng.randrange(80)] = f"z{i}"
        group.append((100 + i, " ".join(copy)))
    got = shingle_join.shingle_components(documents(chain + group)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(chain + group)


def test_large_ids_beside_a_null_stay_exact(documents):
    rows = [(2**62 + 1, "a b c d e f"), (None, "x"), (2**62 + 3, "a b c d e f")]
    got = shingle_join.shingle_components(documents(rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (2**62 + 1, 2**62 + 1), (2**62 + 3, 2**62 + 1)]


def test_odd_documents(documents, odd_rows):
    got = shingle_join.shingle_components(documents(odd_rows, extra=True)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(odd_rows)
    assert shingle_join.shingle_components(documents([])).collect() == []
    assert [tuple(r) for r in shingle_join.shingle_components(documents([None])).collect()] == [(0, 0, 0, 0, 0)]


def test_prefixes_of_linked_rows_share_enough():
    for n in range(1, 400):
        for m in range(-(-4 * n // 5), n + 1):
            least = max(-(-4 * (n + m) // 9), -(-4 * n // 5))
            # So many can be outside of either prefix and still be shared.
            inside = least - max(n - shingle_join.prefix_length(n), m - shingle_join.prefix_length(m))
            assert inside >= max(shingle_join.prefix_need(n), shingle_join.prefix_need(m)), (n, m)


def test_blocks_of_large_groups_and_small_buckets_change_nothing(documents, monkeypatch):
    rows = near_copies(7)
    words = [f"q{k}" for k in range(200)]
    # One group whose sizes run over many bands.
    rows += [(5000 + i, " ".join(words[: 20 + 3 * i])) for i in range(60)]
    rows += [(6000 + i, " ".join(words[:50])) for i in range(40)]
    want, links = brute_components(rows), brute_links(rows)
    for settings in ({"CELL_ROWS": 3}, {"CELL_ENTRIES": 150, "PACKED": 400}, {"PACKED": 60}):
        for name, value in settings.items():
            monkeypatch.setattr(shingle_join, name, value)
        got = shingle_join.shingle_components(documents(rows)).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
        assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == links


def test_no_pair_of_rows_is_a_row_of_a_table(spark, documents):
    """A group of near copies and one of exact copies: joins and shuffles stay within the entries of the rows."""
    rng, rows = random.Random(8), []
    for i in range(300):
        copy = [f"y{k}" for k in range(60)]
        copy[rng.randrange(60)] = f"z{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(f"e{k}" for k in range(60))) for i in range(300)]
    got = {r.doc_id: r for r in shingle_join.shingle_components(documents(rows)).collect()}
    assert sorted(((d, r.n_shingles, r.component_id) for d, r in got.items()), key=str) == brute_components(rows)
    assert {got[1000 + i].n_links for i in range(300)} == {299}
    assert sorted((d, r.n_links) for d, r in got.items()) == brute_links(rows)


def test_components_of_edges(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    edges += [(2000, i) for i in range(2001, 2300)]
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    pairs = {frozenset(e) for e in edges}
    root = grouped(nodes, lambda i, j: frozenset((nodes[i], nodes[j])) in pairs)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(n, nodes[r]) for n, r in zip(nodes, root, strict=True)]
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_lines(rows):
    blanks = " \t\n\x0b\x0c\r"
    last = line_dedup.LAST_ID
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(blanks).translate(A_TO_Z)
            if len(key) >= 10:
                holders.setdefault(key, set()).add(last if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            own = holders.get(line.strip(blanks).translate(A_TO_Z), ())
            if len(own) < 2 or min(own) == (last if doc_id is None else doc_id):
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_are_those_of_brute_force(documents, odd_rows):
    rng = random.Random(1)
    lines = ["Subscribe to us NOW", "  subscribe to us now\t", "short", "exactly10!", "nine char", "Ä line with Ümlaut", "ä line with ümlaut",
             "", " ", "\x0bodd blanks here\x0c", "odd blanks here", "nbsp\xa0stays here\xa0", "nbsp\xa0stays here", "x" * 5000]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 6)) + [f"line only of {i}"])) for i in range(40)]
    rows += [*odd_rows, (3, rows[3][1]), (None, "Subscribe to us NOW"), (900, "a\r\nsubscribe to us now\r\n")]
    got = line_dedup.without_repeated_lines(documents(rows, extra=True)).select("row.doc_id", "n_lines", "n_dropped", "text")
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines(rows)


def test_no_row_gathers_the_lines_of_others(documents):
    lines = [f"a line that two rows hold, number {i}" for i in range(30)]
    rows = [(1, "\n".join(lines))] + [(None, x) for x in lines] + [(7, f"{x}\nonly here {i}") for i, x in enumerate(lines)]
    gone = line_dedup.repeated_lines(documents(rows)).collect()
    assert sorted(len(r["_gone"]) for r in gone) == [1] * 60
    got = line_dedup.without_repeated_lines(documents(rows)).select("row.doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)


def test_no_lines(documents):
    assert line_dedup.without_repeated_lines(documents([])).collect() == []
    (row,) = line_dedup.without_repeated_lines(documents([None])).collect()
    assert (row.text, row.n_lines, row.n_dropped) == ("", 1, 0)


def test_bloom_filters_miss_nothing(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h")).repartition(7)
    held = bloom.filter_of(rows, "h", 5000)
    values = np.array([r.h for r in rows.collect()], np.int64).view(np.uint64)
    assert held.has(values).all()
    assert held.has(np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.01
    docs = spark.createDataFrame([(f"line number {i % 3000}\nonly here {i}",) for i in range(4000)], "text string").repartition(5)
    again = line_dedup.seen_again(docs, 2**19)
    digests = [line_dedup.line_digests(f"line number {i}")[0] for i in range(1000)]
    assert again.has(np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)).all()


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    clamped, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(clamped.values())
        give = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if give[s] > 2 * sizes[s]]
        if not over:
            return {**clamped, **give}
        clamped |= {s: 2.0 * sizes[s] for s in over}


def test_targets_and_taken_words(documents):
    rng = random.Random(2)
    names = ["b", "a", "Z", None, "é", "\U0001f642", "￿", "-", "+", ""]
    rows = [(i, "w " * rng.randint(0, 60), names[min(9, int(rng.expovariate(0.5)))]) for i in range(900)]
    got = mixing.with_repeats(documents(rows, extra=True)).select("row.doc_id", "row.source", "size", "source_size", "target", "repeats").collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = brute_targets(sizes)
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r["size"] * r.repeats <= 2 * r["size"]
        taken[r.source] += r["size"] * r.repeats
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.with_repeats(documents(rows, extra=True).repartition(5)).select("row.doc_id", "repeats").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.repeats) for r in got)


@pytest.mark.parametrize("kind", ["different, no id", "equal, no id", "equal, one id", "different, one id", "equal and some others"])
def test_rows_without_an_id_or_of_one_id_are_drawn_one_by_one(spark, documents, kind, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    doc_id = 5 if "one id" in kind else None
    text = (lambda i: "w x y z") if "equal" in kind else (lambda i: f"w x y z{i}")
    rows = [(doc_id, text(i), "a") for i in range(200)] + [(1000 + i, "w x y z", "b") for i in range(300)]
    if "others" in kind:
        rows += [(i, f"{i} " * (i % 9), "a") for i in range(60)]
    docs = documents(rows, extra=True)
    taken = mixing.with_repeats(docs).cache()
    assert taken.count() == len(rows)
    for r in taken.groupBy("row.source").agg(F.sum(F.col("size") * F.col("repeats")).alias("n"), F.first("target").alias("t")).collect():
        assert abs(r.n - r.t) <= 9
    assert {r.repeats for r in taken.select("repeats").distinct().collect()} <= {0, 1, 2}
    got = Counter(map(tuple, taken.select("row.doc_id", "row.source", "size", "source_size", "target", "repeats").collect()))
    again = mixing.with_repeats(docs.repartition(7)).select("row.doc_id", "row.source", "size", "source_size", "target", "repeats")
    assert Counter(map(tuple, again.collect())) == got
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(f"SELECT doc_id, source, size, source_size, target, repeats FROM ({oracle()['op10_mixing']})").fetchall()
    near = lambda rows: Counter((*r[:4], round(r[4], 6), r[5]) for r in rows)
    assert near(got.elements()) == near(want)


def test_mix_without_python(spark, documents):
    docs = documents([(None, "w x", "a")] * 50 + [(1, "w", "b")])
    plan = mixing.with_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mix_repeats_rows_with_their_own_columns(documents, odd_rows):
    docs = documents(odd_rows, extra=True)
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    counts = mixing.with_repeats(docs).agg(F.sum("repeats")).first()[0]
    assert mix.count() == counts
    assert mixing.mixed(documents([])).collect() == []
    assert [r.target for r in mixing.with_repeats(documents([None, ""])).collect()] == [0, 0]


def test_digest_of_kept_text_matches_sql_rule(documents):
    left = line_dedup.without_repeated_lines(documents(["first shared line\nx", "First shared LINE"]))
    digests = {r.d for r in left.select(F.sha2("text", 256).alias("d")).collect()}
    assert digests == {hashlib.sha256(t).hexdigest() for t in (b"first shared line\nx", b"")}


def test_counts_of_rows_are_added_up_over_the_packs_of_a_task(monkeypatch):
    """However many buckets of columns there are, a task passes on one count for each row."""
    rng = np.random.default_rng(4)
    packs = [rng.integers(0, 50, rng.integers(0, 40)) for _ in range(200)]
    batches = [pd.DataFrame({"nodes": [p.astype(np.int64).tobytes() for p in packs[i : i + 30]]}) for i in range(0, 200, 30)]
    want = Counter(np.concatenate(packs).tolist())
    got = pd.concat(shingle_join._held(iter(batches)))
    assert len(got) == len(want) and dict(zip(got["node"], got["held"], strict=True)) == want
    monkeypatch.setattr(shingle_join, "PACKED", 20)  # what is held is bounded
    parts = list(shingle_join._held(iter(batches)))
    assert max(map(len, parts)) <= 60 and pd.concat(parts).groupby("node")["held"].sum().to_dict() == want
    assert list(shingle_join._held(iter([]))) == []


def test_a_row_is_counted_by_one_task_however_many_buckets_hold_its_columns(spark, monkeypatch):
    rng = np.random.default_rng(6)
    names = rng.integers(-(2**63), 2**63, 300)
    packs = [rng.choice(names, rng.integers(0, 90)) for _ in range(64)]
    want = Counter(np.concatenate(packs).tolist())
    table = spark.createDataFrame([(p.tobytes(),) for p in packs], "nodes binary")
    for tasks in (1, 5, 64):
        for bits in (0, 3):
            got = shingle_join.held_columns(table.repartition(tasks), bits).collect()
            assert len(got) == len(want) and {r.node: r.held for r in got} == want
    monkeypatch.setattr(shingle_join, "PACKED", 50)  # what is held is bounded
    dealt = list(shingle_join._dealt_by_row(3)(iter([pd.DataFrame({"nodes": [p.tobytes() for p in packs]})])))
    assert max(sum(map(len, x["nodes"])) // 8 for x in dealt) <= 50 + 90
    assert Counter(np.frombuffer(b"".join(n for x in dealt for n in x["nodes"]), np.int64).tolist()) == want
    assert list(shingle_join._dealt_by_row(3)(iter([pd.DataFrame({"nodes": [b""]})]))) == []
    assert shingle_join.held_columns(table.limit(0), 3).collect() == []
