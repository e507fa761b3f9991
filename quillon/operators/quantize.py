"""Product quantization: codebooks, codes, query tables and table-lookup distances."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import as_vector, slice_squared_l2
from quillon.operators.blocks import distances, matrix, nearest

SUBSPACES, CODEWORDS, ROUNDS = 16, 256, 15
BOOK = "m int, k int, values array<float>"


def width(dim: int, subspaces: int) -> int:
    if dim <= 0 or dim % subspaces:
        raise ValueError(f"{dim} dimensions can't be cut into {subspaces} sub-vectors")
    return dim // subspaces


def lloyd(x: np.ndarray, codewords: int, rounds: int) -> np.ndarray:
    """Codewords that begin as the first rows (zeros if there are too few); each round moves them to the means of their rows,
    and one without rows stays."""
    points = np.zeros((codewords, x.shape[1]))
    points[: min(codewords, len(x))] = x[:codewords]
    for _ in range(rounds):
        at = nearest(x, points)
        n = np.bincount(at, minlength=codewords)
        sums = np.stack([np.bincount(at, weights=x[:, d], minlength=codewords) for d in range(x.shape[1])], axis=1)
        points[n > 0] = sums[n > 0] / n[n > 0, None]
        points = points.astype(np.float32).astype(np.float64)
    return points


def train_codebooks(training: DataFrame, dim: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS, rounds: int = ROUNDS, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(m, k, values), one task a subspace. The training rows are a bounded sample (see plans.index), taken in id order, so
    that the result doesn't depend on how they are partitioned."""
    w = width(dim, subspaces)
    parts = training.select(F.col(id_col).cast("bigint").alias("id"), F.posexplode(F.array(*[F.slice(as_vector(F.col(vec_col)), m * w + 1, w) for m in range(subspaces)])).alias("m", "part"))

    def run(rows: pa.Table) -> pa.Table:
        x = matrix(rows["part"], w)[np.argsort(np.asarray(rows["id"]), kind="stable")]
        points = lloyd(x, codewords, rounds).astype(np.float32)
        m = np.full(codewords, rows["m"][0].as_py(), np.int32)
        return pa.table({"m": m, "k": np.arange(codewords, dtype=np.int32), "values": pa.array(list(points), pa.list_(pa.float32()))})

    return parts.groupBy("m").applyInArrow(run, BOOK)


def seed_codebooks(base: DataFrame, dim: int, subspaces: int, codewords: int, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """The codebooks before any round: sub-vectors of the rows with ids below `codewords`."""
    w = width(dim, subspaces)
    first = base.filter((F.col(id_col) >= 0) & (F.col(id_col) < codewords))
    return first.select(F.col(id_col).cast("int").alias("k"), F.posexplode(F.array(*[F.slice(as_vector(F.col(vec_col)), m * w + 1, w) for m in range(subspaces)])).alias("m", "values")).select("m", "k", "values")


def book_array(codebooks: DataFrame) -> np.ndarray:
    """(M, K, width) in double; M * K rows, which the parameters bound."""
    rows = sorted((r["m"], r["k"], r["values"]) for r in codebooks.collect())
    m, k = 1 + max(r[0] for r in rows), 1 + max(r[1] for r in rows)
    out = np.zeros((m, k, len(rows[0][2])))
    for i, j, v in rows:
        out[i, j] = v
    return out


def codes_of(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    w = book.shape[2]
    return np.stack([nearest(x[:, m * w : (m + 1) * w], book[m]) for m in range(len(book))], axis=1)


def decoded(code: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The vectors that codes (rows, M) stand for."""
    return np.concatenate([words[code[:, m]] for m, words in enumerate(book)], axis=1)


def encode(base: DataFrame, book: np.ndarray, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, code array<smallint>): the nearest codeword of each sub-vector, the lower index among equals. Arrow batches."""
    dim = book.shape[0] * book.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = codes_of(matrix(b.column(1), dim), book).astype(np.int16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(code), pa.list_(pa.int16()))], ["id", "code"])

    return base.select(F.col(id_col).cast("bigint").alias("id"), as_vector(F.col(vec_col)).alias("vec")).mapInArrow(run, "id bigint, code array<smallint>")


def nearest_codeword(v: Column, m: int, words: Column, w: int) -> Column:
    """The same for one sub-vector in column functions; words: array of a subspace's codewords in order of k."""
    found = F.transform(words, lambda c, k: F.struct(slice_squared_l2(v, c, m, w).alias("d"), k.alias("k")))
    return F.array_min(found)["k"]


def query_table(book: np.ndarray, query: Sequence[float]) -> np.ndarray:
    """(M, K) squared distances of the query's sub-vectors to the codewords."""
    w = book.shape[2]
    q = np.array(query, np.float64)
    return np.stack([distances(q[None, m * w : (m + 1) * w], book[m])[0] for m in range(len(book))])


def table_column(table: np.ndarray) -> Column:
    """The query table as a constant of array<array<double>>."""
    return F.from_json(F.lit(str(table.tolist())), "array<array<double>>")


def lookup_distance(code: Column, table: np.ndarray) -> Column:
    """Sum over subspaces of the table's entry for the code, a compiled array access each; null for a null code or one outside
    the table."""
    whole = table_column(table)
    entries = [F.get(F.get(whole, F.lit(m)), F.get(code, F.lit(m)).cast("int")) for m in range(len(table))]
    return reduce(lambda s, x: s + x, entries, F.lit(0.0))


def lookup_distances(codes: pa.Array, tables: np.ndarray) -> np.ndarray:
    """(rows, queries) of a column of codes, from (M, K, queries) tables; NaN for a null code or one outside the tables."""
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    m, k, n = tables.shape
    at = np.asarray(codes.offsets, np.int64)
    good = np.asarray(codes.is_valid()) & (np.diff(at) == m)
    code = np.zeros((len(codes), m), np.int64)
    if good.any():
        code[good] = codes.values.to_numpy(zero_copy_only=False)[at[:-1][good][:, None] + np.arange(m)]
    good &= ((code >= 0) & (code < k)).all(axis=1)
    code[~good] = 0
    out = np.zeros((len(code), n))
    for i in range(m):
        out += tables[i].take(code[:, i], axis=0)
    out[~good] = np.nan
    return out


def least_distances(found: np.ndarray, off: np.ndarray) -> np.ndarray:
    """What exact squared distances can't be below, by the triangle inequality: from lookup distances (rows, queries) and how far
    each row is off the vector that its code stands for. 0 where either is unknown."""
    low = np.maximum(np.sqrt(found) - off[:, None], 0.0) ** 2 - 1e-9 * (found + off[:, None] ** 2)
    return np.where(np.isnan(low), 0.0, low)
