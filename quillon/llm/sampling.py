"""Document fingerprints by consistent weighted sampling.

A document is its words (ASCII lower case) weighted by how often they occur. For each of 128 samples a word of weight w gets
t = floor(ln w / r + b) and the value ln c - r (t + 1 - b), with r, c ~ Gamma(2, 1) and b uniform, all from a hash of the word and
the sample; the least value is the sample. Two documents have the same least value with a probability equal to the generalised
Jaccard similarity of their weights, sum of minima over sum of maxima. A fingerprint is 16 bits of each least value, in hex.

Null texts count as empty; documents without a word share one fingerprint; very long texts are sampled whole, in chunks of words. In
the order of with_next, rows that repeat a doc_id follow each other by text hash (rows that share both are alike, so their order
doesn't matter), and rows without doc_id come last, by text hash. Further columns may have any name; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillon.llm.common import cut_points, octets

SAMPLES, CHUNK, BATCH_DOCS, BATCH_BYTES = 128, 8192, 512, 2_000_000
#: Where rows without doc_id come, and the most ranges that the driver keeps the ends of.
NO_ID, MOST_RANGES = (1 << 63) - 1, 20_000
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(31)
    return x


def variates(hashes: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word and sample: the value at weight one, r, and b."""
    salt = _mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(MIX[2]))
    x = _mixed(hashes[:, None] ^ salt[None, :])
    low = np.uint64((1 << 21) - 1)
    unit = np.float32(1 / (1 << 21))
    part = lambda y, s: ((y >> np.uint64(s)) & low).astype(np.float32) * unit + unit / 2
    r = -np.log(part(x, 0) * part(x, 21))
    b = part(x, 42)
    x = _mixed(x + np.uint64(MIX[2]))
    c = -np.log(part(x, 0) * part(x, 21))
    return np.log(c) - r + r * b, r, b


def least(of: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    one, r, b = of
    out = np.full(one.shape[1], np.inf, np.float32)
    single = rows[counts == 1]
    for i in range(0, len(single), CHUNK):
        np.minimum(out, one.take(single[i : i + CHUNK], axis=0).min(axis=0), out=out)
    many = counts > 1
    rows, logs = rows[many], np.log(counts[many]).astype(np.float32)
    for i in range(0, len(rows), CHUNK):
        at = rows[i : i + CHUNK]
        rr = r.take(at, axis=0)
        t = np.floor(logs[i : i + CHUNK, None] / rr + b.take(at, axis=0))
        np.minimum(out, (one.take(at, axis=0) - rr * t).min(axis=0), out=out)
    return out


def shortened(values: np.ndarray) -> np.ndarray:
    return ((np.ascontiguousarray(values, np.float32).view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def sketches(texts: list[bytes], samples: int = SAMPLES) -> list[np.ndarray]:
    """The fingerprint of each text as 16-bit numbers. Variates of a word are made once for all the texts, in chunks."""
    number: dict[bytes, int] = {}
    bags = []
    for t in texts:
        words = t.lower().split() or [b""]
        bags.append(np.unique(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), return_counts=True))
    hashes = np.fromiter(map(xxh64_intdigest, number), np.uint64, len(number))
    if len(hashes) <= 16 * CHUNK:
        parts = [variates(hashes[i : i + 1024], samples) for i in range(0, len(hashes), 1024)]
        of = tuple(np.concatenate(x) for x in zip(*parts)) if parts else ()
        return [shortened(least(of, *bag)) for bag in bags]
    out = []
    for rows, counts in bags:
        values = np.full(samples, np.inf, np.float32)
        for i in range(0, len(rows), CHUNK):
            at = rows[i : i + CHUNK]
            np.minimum(values, least(variates(hashes[at], samples), np.arange(len(at)), counts[i : i + CHUNK]), out=values)
        out.append(shortened(values))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), "<u2")


def _portions(texts: list[bytes]) -> Iterator[slice]:
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_BYTES or i - first >= BATCH_DOCS - 1 or i == len(texts) - 1:
            yield slice(first, i + 1)
            first, size = i + 1, 0


def fingerprinted(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) for each row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = octets(b.column(1))
            for s in _portions(raw):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.start, s.stop - s.start), pa.array([x.tobytes().hex() for x in sketches(raw[s], samples)])], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the start of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


WITH_NEXT = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each row, of its edited text and of the next row by descending doc_id (after the last: the first).

    Rows are cut into ranges of doc_id, those without one into ranges of text hash; compressed texts move once, each range's first
    row also to the range before it, and neighbours meet in the sorted ranges. The driver holds one (doc_id, hash) a range."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, docs.rdd.getNumPartitions()))
    place = F.coalesce(F.bitwise_not("doc_id"), F.lit(NO_ID))
    cuts = cut_points(docs.select(F.bitwise_not("doc_id").alias("p")), "p", ranges)
    counts = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    without = 1 + ranges * (counts["n"] - counts["known"]) // max(1, counts["n"])  # ranges for rows without doc_id
    hash_cuts = [int(-(1 << 63) + (i + 1) * ((1 << 64) // without)) for i in range(without - 1)]
    placed = docs.select(place.alias("_p"), F.xxhash64("text").alias("_h"))

    def range_of(p: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(cuts, p)
        return np.where(p == NO_ID, len(cuts) + np.searchsorted(np.array(hash_cuts, np.int64), h, side="right"), at).astype(np.int32)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64))), *b.columns], ["range", "p", "h"])

    numbered = placed.mapInArrow(ranged, "range int, p long, h long")
    heads = sorted((r["range"], r["head"]["p"], r["head"]["h"]) for r in numbered.groupBy("range").agg(F.min(F.struct("p", "h")).alias("head")).collect())
    to = {(p, h): heads[i - 1][0] for i, (_, p, h) in enumerate(heads)}

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            ids, p, h = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            part = range_of(np.asarray(b.column(1), np.int64), np.asarray(b.column(2), np.int64)).tolist()
            packed = [z.compress(t) for t in octets(b.column(3))]
            also = [i for i in range(len(ids)) if (p[i], h[i]) in to]
            every = [*range(len(ids)), *also]
            where = [*part, *(to[p[i], h[i]] for i in also)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int32()), pa.array([False] * len(ids) + [True] * len(also)), pa.array([p[i] for i in every], pa.int64()), pa.array([h[i] for i in every], pa.int64()), pa.array([ids[i] for i in every], pa.int64()), pa.array([packed[i] for i in every], pa.binary())],
                ["range", "tail", "p", "h", "doc_id", "z"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        carry: tuple | None = None  # range, doc_id, text, sketch of the row whose next is to come
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH_DOCS):
                b = whole.slice(first, BATCH_DOCS)
                part, tail, ids = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist()
                raw = [z.decompress(x) for x in b.column(5).to_pylist()]
                for s in _portions(raw):
                    rows = list(zip(part[s], tail[s], ids[s], raw[s]))
                    pairs, prior = [], carry
                    for r in rows:
                        if prior is not None and prior[0] == r[0] and not prior[1]:
                            pairs.append((prior, r))
                        prior = r
                    new = [edited(a[3].decode("utf-8", "replace"), n[3].decode("utf-8", "replace")) for a, n in pairs]
                    own = [carry] * (carry is not None) + rows
                    all_of = sketches([*(r[3] for r in own), *(e.encode() for e in new)], samples)
                    mine, theirs = dict(zip(map(id, own), all_of)), all_of[len(own) :]
                    if pairs:
                        out = [(a[2], len(a[3].decode("utf-8", "replace")), e, (x := mine[id(a)]).tobytes().hex(), f.tobytes().hex(), likeness(x, f), likeness(x, mine[id(n)])) for (a, n), e, f in zip(pairs, new, theirs)]
                        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in WITH_NEXT.split(", ")])
                    carry = rows[-1] if rows else carry

    moved = docs.select("doc_id", place.alias("p"), F.xxhash64("text").alias("h"), "text").mapInArrow(move, "range int, tail boolean, p long, h long, doc_id long, z binary")
    return moved.repartitionById(len(cuts) + without, F.col("range")).sortWithinPartitions("range", "tail", "p", "h").mapInArrow(meet, WITH_NEXT)
