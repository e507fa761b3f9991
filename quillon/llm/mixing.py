"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in doc_id order, form blocks of about `block_chars` code points (whole documents; a document belongs to
the block in which it begins). A source of share w of all weights may have block j (from 0) placed from slot floor(j / w) on and
must have it placed before slot ceil((j + 1) / w), in exact rational arithmetic over the whole schedule; earliest deadline first
fills the slots and meets every deadline, so at any slot a source that has blocks left has been given less than one block more or
less than its share. A source that has run out leaves its slots empty, so every document is scheduled once. A source of weight
zero comes after all others, without release and deadline. With `period`, the weights are first rounded to whole slots of a
period, at least one each.

The blocks come from a distributed prefix sum, so that no source has to fit one task; one task schedules, a step a block.
Null sources are one more source, null texts count no code points, null doc_ids come first; rows that repeat a doc_id each keep
their place, by text hash. A source that given weights don't name has weight zero. Ties of deadlines go to the source of lesser
name. Very long texts count whole; one of many blocks' length leaves the blocks it covers empty. Further columns may have any name;
an empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import named, prefix_sums, text_hash
from quillon.shared import fresh, written

BLOCK_CHARS, PERIOD, POWER = 65_536, 1000, 0.5
LAST = (1 << 63) - 1  # numbers of slots beyond are written as this one
PLAN = "_source string, _block long, _release long, _deadline long, _slot long"


def slots_of(weights: dict[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Whole slots by largest remainder, at least one each."""
    if not weights:
        return {}
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of as many slots; it has {period}")
    if min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights are at least zero, and one is above")
    names = sorted(weights, key=lambda s: (s is not None, s))
    total, spare = sum(weights.values()), period - len(names)
    exact = {s: 1 + spare * weights[s] / total for s in names}
    slots = {s: int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: slots[s] - exact[s])[: period - sum(slots.values())]:
        slots[s] += 1
    return slots


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = [Fraction(w) for w in weights]
    scale = max((x.denominator for x in exact), default=1)  # of floats: powers of two
    return [int(x * scale) for x in exact]


def scheduled(shares: list[int], counts: list[int]) -> Iterator[tuple[int, int, int | None, int | None, int]]:
    """(source, block, release, deadline, slot), earliest deadline first among released blocks; memory goes with the sources."""
    total, t = sum(shares), 0
    due: list[tuple[int, int, int]] = []
    later = [(0, k, 0) for k, n in enumerate(counts) if n and shares[k]]
    while due or later:
        if not due:
            t = max(t, later[0][0])
        while later and later[0][0] <= t:
            _, k, j = heapq.heappop(later)
            heapq.heappush(due, (-(-(j + 1) * total // shares[k]), k, j))
        deadline, k, j = heapq.heappop(due)
        yield k, j, j * total // shares[k], deadline, t
        t += 1
        if j + 1 < counts[k]:
            heapq.heappush(later, ((j + 1) * total // shares[k], k, j + 1))
    for k, n in enumerate(counts):
        for j in range(0 if shares[k] else n):
            yield k, j, None, None, t
            t += 1


def timetable(slots: dict[str | None, int], period: int = PERIOD) -> list[tuple[str | None, int, int, int, int]]:
    """(source, block of the period from 0, release, deadline, slot) of one period whose slots are all given."""
    names, counts = list(slots), list(slots.values())
    return [(names[k], *rest) for k, *rest in scheduled(counts, counts)]


def plan(sources: DataFrame) -> DataFrame:
    """A row for each block of sources (source, weight, blocks), made by one task that keeps the sources and streams the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0] is not None, r[0]))
        names, weights, counts = zip(*rows) if rows else ((), (), ())
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            of, *numbers = zip(*held)
            cut = [[x if x is None else min(x, LAST) for x in c] for c in numbers]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([names[k] for k in of], pa.string()), *[pa.array(c, pa.int64()) for c in cut]], ["_source", "_block", "_release", "_deadline", "_slot"])

        for row in scheduled(whole(weights), counts):
            held.append(row)
            if len(held) == 16_384:
                yield batch()
        if held:
            yield batch()

    return written(sources.coalesce(1).mapInArrow(run, PLAN), "mixing-plan")


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, period: int | None = None) -> DataFrame:
    """(doc_id, source, block, release, deadline, slot, position): position numbers the rows in schedule order from 0.

    Without weights, a source's weight is its code points (one more a document) to a power below one, which lifts small sources;
    there may be any number of sources. Only given weights can be rounded to a period."""
    return _placed(docs, weights, block_chars, period).drop("tie")


def _placed(docs: DataFrame, weights: dict[str | None, float] | None, block_chars: int, period: int | None) -> DataFrame:
    """The same, with the hash of each row's text as `tie`."""
    spark = docs.sparkSession
    if weights and (min(weights.values()) < 0 or sum(weights.values()) <= 0):
        raise ValueError("weights are at least zero, and one is above")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"), text_hash(docs).alias("tie")]
    begun = prefix_sums(docs.select(*columns), ["doc_id", "tie"], "n", "source", "mixing-blocks")
    blocks = begun.withColumn("block", F.floor(F.col("before") / F.lit(block_chars)).cast("long"))
    sources = blocks.groupBy("source").agg(F.pow(F.sum(F.col("n") + 1), F.lit(POWER)).alias("weight"), (F.max("block") + 1).alias("blocks"))
    if weights is not None:
        shares = slots_of(weights, period) if period else weights
        given = spark.createDataFrame([(s, float(w)) for s, w in shares.items()], "_of string, _weight double")
        sources = sources.join(given, sources["source"].eqNullSafe(given["_of"]), "left").select("source", F.coalesce("_weight", F.lit(0.0)).alias("weight"), "blocks")
    times = plan(sources)
    met = blocks.join(times, blocks["source"].eqNullSafe(times["_source"]) & (blocks["block"] == times["_block"]))
    timed = met.select("_slot", F.col("before").alias("at"), "doc_id", "tie", "source", "block", "_release", "_deadline", F.lit(1).cast("long").alias("one"))
    placed = prefix_sums(timed, ["_slot", "at", "doc_id", "tie"], "one", name="mixing-order")
    return placed.select("doc_id", "tie", "source", "block", F.col("_release").alias("release"), F.col("_deadline").alias("deadline"), F.col("_slot").alias("slot"), F.col("before").alias("position"))


def in_order(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, period: int | None = None) -> DataFrame:
    """docs, each row once, range-sorted by the schedule; a source without documents left gives its slots to none. Rows meet
    their place by doc_id and text hash, and rows that share both stand together."""
    doc, tie, position, at = fresh(docs.columns, "_doc", "_tie", "_position", "_at")
    order = _placed(docs, weights, block_chars, period).groupBy(F.col("doc_id").alias(doc), F.col("tie").alias(tie)).agg(F.min("position").alias(position))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & F.col(at).eqNullSafe(F.col(tie))
    met = docs.withColumn(at, text_hash(docs)).join(order.hint("shuffle_hash"), on, "left")
    return met.repartitionByRange(position).sortWithinPartitions(position).select(*map(named, docs.columns))
