"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Every source gets a share of the wanted words by its weight. A source that would
have to be repeated more often than allowed is clamped at that, and what it
cannot give is shared among the others by weight, until none is above.

A document is then taken as many whole times as its source needs, and a seeded
part of the documents once more: those with the smallest hashes, up to the word
count still missing. The hash is of the id and the text, so rows that share an id or
have none are drawn one by one. Rows with the same id and text share a hash: they are
counted, and where the part ends among them as many are taken once more as fit in. The
same rows always give the same mix.

Defined results: a NULL source is a source of its own, after all others; a NULL
or empty text has size 0; a source without words has target 0; rows that repeat a
``doc_id`` or lack one are documents of their own; very long texts count like others, so
a source of few long ones meets its target within half a document; ties do not occur but
among equal rows, of which any may be the one taken; an empty table gives an empty table;
other columns are passed on, and must be of kinds that can be grouped where equal rows
are to be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import cut
from spendlens.plans.joins import lookup_join

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix"
# A hash has 15 hexadecimal digits. Its first three name a bucket, so that even the
# one bucket of a hot source that is sorted holds a 4096th of the source's rows.
BUCKET = 16**12
CHUNK = 4096  # equal rows that are unfolded together


def words(text: Column) -> Column:
    """Number of runs without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_hash(doc_id: Column, text: Column, seed: str) -> Column:
    known = F.coalesce(doc_id.cast("string"), F.lit("null"))
    named = F.concat(F.lit(f"{seed}:"), known, F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def _known(source: Column) -> Column:
    """A join key that is never NULL and keeps a NULL source apart from every text."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS
) -> DataFrame:
    """Words to take of each source, from rows (source, size). One row per source.

    Sources are served by cap per weight: one is clamped when its cap lies below
    what the words not yet given away grant it by weight. As the order is by that
    very ratio, the running sums settle all rounds of clamping at once. Only the
    aggregated table of sources goes through this one window.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    )
    everything = Window.partitionBy()
    served = Window.orderBy(F.col("_cap") / F.col("_weight"))
    earlier = served.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tied = Window.partitionBy(F.col("_cap") / F.col("_weight"))
    wanted = F.sum("source_size").over(everything) * F.lit(float(share))
    cap_before = F.sum("_cap").over(earlier) - F.sum("_cap").over(tied)
    weight_before = F.sum("_weight").over(earlier) - F.sum("_weight").over(tied)
    level = sources.select(
        "*",
        (wanted - cap_before).alias("_left"),
        (F.sum("_weight").over(everything) - weight_before).alias("_weights"),
    ).withColumn("_clamped", F.col("_cap") * F.col("_weights") <= F.col("_left") * F.col("_weight"))
    # What the clamped sources leave, shared by weight among the rest.
    clamped = F.col("_clamped")
    given = F.sum(F.when(clamped, F.col("_cap")).otherwise(0.0)).over(everything)
    sharing = F.sum(F.when(~clamped, F.col("_weight")).otherwise(0.0)).over(everything)
    rest = F.try_divide(wanted - given, sharing)
    return level.select(
        "source", "source_size", F.when(clamped, F.col("_cap")).otherwise(F.col("_weight") * rest).alias("target")
    )


def mixing_cuts(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Whole repetitions of each source, and the last hash of which rows are taken once more: how many it has and gives.

    The fractional part is filled in order of the hashes; a document belongs to
    it while its middle lies inside. Sums by bucket find the one bucket in which
    the part ends, and only that bucket's rows are summed one by one.
    """
    plan = plan.withColumn("_key", _known(F.col("source"))).withColumn(
        "_whole",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
    )
    plan = plan.withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size"))
    rows = sizes.groupBy(_known(F.col("source")).alias("_key"), "_hash").agg(
        F.sum("size").alias("_size"), F.max("size").alias("_each"), F.count("*").alias("_copies")
    )
    rows = rows.withColumn("_bucket", F.floor(F.col("_hash") / BUCKET).cast("long"))
    buckets = rows.groupBy("_key", "_bucket").agg(F.sum("_size").alias("_size"))
    below = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        buckets.withColumn("_base", F.coalesce(F.sum("_size").over(below), F.lit(0)))
        .join(plan.select("_key", "_part"), "_key")
        .filter(F.col("_base") <= F.col("_part"))
        .groupBy("_key")
        .agg(F.max(F.struct("_bucket", "_base", "_part")).alias("_last"))
        .select("_key", "_last.*")
    )
    running = Window.partitionBy("_key", "_bucket").orderBy("_hash")
    # What is left of the part where the first row of a hash has its middle.
    room = F.col("_part") - (F.col("_end") - F.col("_size") + F.col("_each") / 2)
    fitting = F.when(F.col("_each") == 0, F.col("_copies")).otherwise(F.floor(room / F.col("_each")) + 1)
    inside = (
        lookup_join(rows, last, ["_key", "_bucket"])
        .filter(F.col("_base").isNotNull())
        .withColumn("_end", F.col("_base") + F.sum("_size").over(running))
        .withColumn("_taken", F.least(F.col("_copies"), fitting.cast("long")))
        .groupBy("_key", "_bucket")
        .agg(F.max(F.when(room >= 0, F.struct("_hash", "_taken", "_copies"))).alias("_at"))
        .select("_key", F.coalesce("_at._hash", F.col("_bucket") * BUCKET - 1).alias("_cut"), "_at._taken", "_at._copies")
    )
    return plan.join(inside, "_key", "left").select("_key", "source_size", "target", "_whole", "_cut", "_taken", "_copies")


def _part_of_equals(rows: DataFrame) -> DataFrame:
    """Equal rows of which only ``_taken`` are taken once more: counted before they are shuffled, and unfolded again.

    They are unfolded in chunks that are dealt out, so a row with very many copies is the work of many tasks.
    """
    same = rows.groupBy("row", "size", "_key", "source_size", "target", "_whole", "_taken").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_key").orderBy(F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, 0))
    same = same.withColumn("_before", upto - F.col("_n"))
    more = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_taken") - F.col("_before")))
    kinds = F.array(
        F.struct((F.col("_whole") + 1).alias("repeats"), more.alias("_rows")),
        F.struct(F.col("_whole").alias("repeats"), (F.col("_n") - more).alias("_rows")),
    )
    kept = ["row", "size", "source_size", "target", "repeats"]
    counted = same.withColumn("_kind", F.explode(kinds)).select(*kept[:-1], "_kind.*").filter("_rows > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1, F.lit(CHUNK).cast("long"))).alias("_start")
    chunks = counted.select(*kept, "_rows", starts).repartition(F.col("_start"), F.col("repeats"))
    left = F.least(F.lit(CHUNK), F.col("_rows") - F.col("_start")).cast("int")
    return chunks.select(*kept, F.explode(F.array_repeat(F.lit(1), left))).select(*kept)


def with_repeats(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """Each row of ``docs`` as ``row``, with ``size``, ``source_size``, ``target`` and ``repeats``.

    The texts are read twice and never shuffled: sizes and hashes are written
    once, all sums come from that narrow table, and the per-source result is
    joined back, broadcast only after its bytes have been counted.
    """
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        words(F.col("text")).alias("size"),
        _known(F.col("source")).alias("_key"),
        seeded_hash(F.col("doc_id"), F.col("text"), seed).alias("_hash"),
    )
    sizes = cut(rows.select("row.source", "size", "_hash"))
    plan = cut(mixing_cuts(sizes, targets(sizes, weights, share, max_epochs)))
    may = F.coalesce(F.col("_whole") < F.lit(float(max_epochs)), F.lit(False))
    split = may & F.coalesce((F.col("_hash") == F.col("_cut")) & (F.col("_taken") < F.col("_copies")), F.lit(False))
    once_more = may & F.coalesce(F.col("_hash") <= F.col("_cut"), F.lit(False))
    planned = lookup_join(rows, plan, ["_key"])
    mix = planned.filter(~split).withColumn("repeats", F.col("_whole") + once_more.cast("long"))
    mix = mix.select("row", "size", "source_size", "target", "repeats")
    if plan.filter("_taken < _copies").isEmpty():  # no part ends among equal rows
        return mix
    return mix.unionByName(_part_of_equals(planned.filter(split)))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with their own columns."""
    taken = with_repeats(docs, **settings).filter(F.col("repeats") > 0)
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("repeats").cast("int")))).select("row.*")
