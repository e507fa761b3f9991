"""SimHash near-duplicate groups by a segment-popcount embedding.

A 64-bit fingerprint becomes the 16 bit counts of its 4-bit segments. The Manhattan distance of two such points is at most the
Hamming distance of the fingerprints, so all pairs within 2 bits lie within 2 steps on the grid: each point enters its own cell
and the 32 cells one step away, any such pair meets in a cell, and the pairs of a cell are verified exactly. A cell with more
than `cell_limit` different fingerprints is not compared pair by pair: its fingerprints enter their own and their 64 bit-flip
neighbours instead (once each, however many such cells hold them), where two meet exactly when they differ in at most 2 bits,
and a star per neighbour joins them. Nothing is dropped and work grows with the rows, also where all cells are over the limit. Equal fingerprints are one node.

Null texts count as empty; an empty text has fingerprint zero; very long texts are hashed whole, in portions. Bits that tie at half
the shingles are 0. Repeated rows and doc_ids keep one result row each. A null doc_id takes part in linking but never names a
component; a component of null ids only has component_id null. Further columns may have any name; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillon.llm.common import named, octets, text_hash
from quillon.llm.graph import components
from quillon.shared import fresh, written

SEED, LONG = 42, 1 << 16


def fingerprint(text: bytes, words_each: int = 3) -> int:
    """The SimHash of one UTF-8 text, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= words_each:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_each))))
    n = max(1, len(words) - words_each + 1)
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, LONG):
        counts += np.unpackbits(h[i : i + LONG].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """(doc_id, at, fp): hash of each row's text, and the signed 64-bit form of its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, words_each) for t in octets(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], ["doc_id", "at", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash(docs).alias("at")).mapInArrow(run, "doc_id long, at long, fp long")


def nibble_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 16 segments, packed as nibbles."""
    m = np.uint64(0x5555555555555555)
    two = (fp & m) + ((fp >> np.uint64(1)) & m)
    m = np.uint64(0x3333333333333333)
    return (two & m) + ((two >> np.uint64(2)) & m)


_STEPS = np.array([0, *(1 << 4 * i for i in range(16))], np.uint64)
_STEPS = np.concatenate([_STEPS, (-_STEPS[1:].astype(object) % (1 << 64)).astype(np.uint64)])
_FLIPS = np.array([0, *(1 << i for i in range(64))], np.uint64)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own cell and the 32 next to it; every count is raised by one, so that none falls below zero."""
    for b in batches:
        fp = np.asarray(b.column(0)).view(np.uint64)
        cell = (nibble_counts(fp) + np.uint64(0x1111111111111111))[:, None] + _STEPS[None, :]
        yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().view(np.int64)), pa.array(np.repeat(fp, len(_STEPS)).view(np.int64))], ["cell", "fp"])


def _meet(batches: Iterator[pa.RecordBatch], cell_limit: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of the cells of one sorted partition, and for cells over the limit their members (a = b), marked as crowded.

    Holds one Arrow batch and at most one cell's first cell_limit rows more."""
    cell, fp, hot = np.empty(0, np.int64), np.empty(0, np.uint64), None

    def out(a: np.ndarray, b: np.ndarray, crowded: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), crowded))], ["a", "b", "crowded"])

    def pairs(c: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(c)])
        big = np.repeat(sizes > cell_limit, sizes)
        if big.any():
            yield out(f[big], f[big], True)
        c, f = c[~big], f[~big]
        for d in range(1, cell_limit):
            at = np.flatnonzero(c[d:] == c[:-d]) if d < len(c) else ()
            if not len(at):
                break
            a, b = f[at], f[at + d]
            near = np.bitwise_count(a ^ b) <= bits
            if near.any():
                yield out(a[near], b[near], False)

    for b in batches:
        c, f = np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64)
        if hot is not None:
            same = c == hot
            yield out(f[same], f[same], True)
            if same.all():
                continue
            c, f, hot = c[~same], f[~same], None
        cell, fp = np.r_[cell, c], np.r_[fp, f]
        if not len(cell):
            continue
        tail = np.searchsorted(cell, cell[-1])
        yield from pairs(cell[:tail], fp[:tail])
        cell, fp = cell[tail:], fp[tail:]
        if len(cell) > cell_limit:
            yield out(fp, fp, True)
            cell, fp, hot = cell[:0], fp[:0], cell[0]
    yield from pairs(cell, fp)


def _flips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 4096):
            fp = np.asarray(whole.column(0).slice(i, 4096)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ _FLIPS[None, :]).ravel().view(np.int64)), pa.array(np.repeat(fp, len(_FLIPS)).view(np.int64))], ["flip", "fp"])


def links(fps: DataFrame, bits: int = 2, cell_limit: int = 64) -> DataFrame:
    """(src, dst): edges between different fingerprints whose components are those of all links at 2 or fewer bits."""
    if bits != 2:
        raise ValueError("next cells and bit flips are made for two bits")
    met = written(
        fps.select("fp").mapInArrow(_cells, "cell long, fp long").repartition("cell").sortWithinPartitions("cell", "fp")
        .mapInArrow(lambda it: _meet(it, cell_limit, bits), "a long, b long, crowded boolean"),
        "simhash-met",
    )
    flips = met.filter("crowded").select("a").distinct().mapInArrow(_flips, "flip long, fp long")
    least = flips.groupBy("flip").agg(F.min("fp").alias("low"), F.count("*").alias("n")).filter("n > 1")
    star = flips.join(least, "flip").select(F.col("fp").alias("src"), F.col("low").alias("dst"))
    return met.filter("not crowded").select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(star).filter("src <> dst").distinct()


def _grouped(docs: DataFrame, words_each: int, bits: int, cell_limit: int) -> DataFrame:
    """(doc_id, at, fp, root, component_id) for each row."""
    fps = written(fingerprints(docs, words_each), "simhash-fps")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(links(nodes, bits, cell_limit))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def simhash_groups(docs: DataFrame, words_each: int = 3, bits: int = 2, cell_limit: int = 64) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text)."""
    return _grouped(docs, words_each, bits, cell_limit).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words_each: int = 3, bits: int = 2, cell_limit: int = 64) -> DataFrame:
    """docs with one row of each near-duplicate group: the row of least doc_id, then of least text hash, then of least hash of
    all columns that have one. A decision can't be addressed to a row without doc_id, so such rows all stay."""
    rows = _grouped(docs, words_each, bits, cell_limit).filter("doc_id IS NOT NULL")
    kept_id, kept_at, at, nth = fresh(docs.columns, "_kept_id", "_kept_at", "_at", "_nth")
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias(kept_id), F.col("first.at").alias(kept_at))
    met = docs.withColumn(at, text_hash(docs)).join(kept, (F.col("doc_id").cast("long") == F.col(kept_id)) & F.col(at).eqNullSafe(F.col(kept_at)))
    plain = [named(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    order = Window.partitionBy(kept_id, kept_at).orderBy(F.xxhash64(*plain))
    return met.withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1).select(*map(named, docs.columns)).unionByName(docs.filter("doc_id IS NULL"))
