"""Packing in the order of a space-filling curve.

Each document's ids are projected through hashed Gaussian rows, one a token id, to four dimensions; the direction's Hilbert key
puts similar documents near each other. The keys (not the texts) are range-sorted, a prefix sum of token counts gives each
document its place in one long row of tokens, and every 4096 tokens of that row are a sequence. Only the last sequence can need
padding. The ids are written once, and join their document's place by row number.

Null texts count as empty and are one end-of-document id; very long texts fill as many sequences as they need. Repeated rows and
doc_ids are packed each for itself; null doc_ids too. Equal keys are ordered by doc_id, then by row. Further columns may have any name;
an empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import prefix_sums, texts
from quillon.llm.tokens import WORD_BPE, word_bpe
from quillon.shared import written

LENGTH, END_ID, DIMS, BITS = 4096, 2, 4, 15
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def hashed_rows(n: int, dims: int = DIMS) -> np.ndarray:
    """A Gaussian row for each id, from a hash of it; rarer (later merged) ids weigh more."""
    x = np.arange(1, n * dims + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(31)
    u, v = (x >> np.uint64(40)).astype(np.float64) + 1, (x & np.uint64(0xFFFFFF)).astype(np.float64)
    g = np.sqrt(-2 * np.log(u / (1 << 24))) * np.cos(2 * np.pi * v / (1 << 24))
    return (g.reshape(n, dims) * np.log1p(np.arange(n))[:, None] / 10).astype(np.float32)


def hilbert_keys(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of unsigned coordinates below 2**bits."""
    x = x.astype(np.uint64).copy()
    n, one = x.shape[1], np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        p = q - one
        for i in range(n):
            high = (x[:, i] & q) != 0
            t = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] ^= t if i else np.uint64(0)
        q >>= one
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t, q = np.zeros(len(x), np.uint64), np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where(x[:, n - 1] & q, t ^ (q - one), t)
        q >>= one
    x ^= t[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[:, i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


_ROWS: dict[int, np.ndarray] = {}


def direction(ids: np.ndarray, n: int) -> np.ndarray:
    if n not in _ROWS:
        _ROWS[n] = hashed_rows(n)
    v = np.zeros(DIMS)
    for i in range(0, len(ids), 1 << 16):
        v += _ROWS[n].take(ids[i : i + (1 << 16)], axis=0).sum(axis=0)
    return v / (np.linalg.norm(v) or 1.0)


def tokenised(docs: DataFrame, name: str = WORD_BPE, end_id: int = END_ID, along: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, n, key, ids, *along): ids as 16-bit integers with the end-of-document id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = word_bpe(name), np.uint16(end_id).tobytes()
        size = max(bpe.whole.get_vocab_size(), end_id + 1)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ids = [bpe.ids(t) + end for t in texts(b.column(2))]
                v = np.array([direction(np.frombuffer(x, np.uint16)[:-1], size) for x in ids]).reshape(-1, DIMS)
                keys = hilbert_keys(np.floor((v + 1) / 2 * ((1 << BITS) - 1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array([len(x) // 2 for x in ids], np.int64)), pa.array(keys), pa.array(ids, pa.binary()), *b.columns[3:]], out.names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *along)
    out = T.StructType(T.StructType.fromDDL("row long, doc_id long, n long, key long, ids binary").fields + rows.select(*along).schema.fields)
    return rows.mapInArrow(run, out)


def pack(docs: DataFrame, name: str = WORD_BPE, length: int = LENGTH, end_id: int = END_ID, window: int | None = None, along: tuple[str, ...] = ()) -> DataFrame:
    """The pieces of docs (doc_id, text): sequence `sequence_id` has `ids` (unsigned little-endian 32-bit) from `offset` on,
    which are the document's from `start` on. With a window, the rows are first taken in the order of the columns `along`, and
    each part of about `window` tokens of that order is packed along the curve for itself."""
    ids = written(tokenised(docs, name, end_id, along), "packing-ids")
    order, rows = ["key", "doc_id", "row"], ids.select("key", "doc_id", "row", "n", *along)
    if window:
        rows = prefix_sums(rows, [*along, "row"], "n", name="packing-windows").select("key", "doc_id", "row", "n", F.expr(f"before div {int(window)}").alias("window"))
        order = ["window", *order]
    places = prefix_sums(rows.select(*order, "n"), order, "n", name="packing-order").select(F.col("row").alias("_row"), "before")
    placed = ids.select("row", "doc_id", "n", "ids").join(places.hint("shuffle_hash"), F.col("row") == F.col("_row")).select("doc_id", "n", "before", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                out: list[tuple] = []
                for doc_id, n, before, raw in zip(*(c.to_pylist() for c in whole.slice(first, 512).columns)):
                    wide, at = np.frombuffer(raw, np.uint16).astype("<u4"), 0
                    while at < n:
                        sequence, offset = divmod(before + at, length)
                        take = min(length - offset, n - at)
                        out.append((doc_id, at, take, n, sequence, offset, wide[at : at + take].tobytes()))
                        at += take
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 6 + [pa.binary()])], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(cut, PIECES)
