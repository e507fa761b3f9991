"""Exact nearest neighbours: each task keeps its best rows, for one query or a block of them, and only those are shuffled."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.vectors import as_vector, squared_l2_to
from quillon.operators.blocks import Best, finite_rows, pair_distances, products
from quillon.shared import scratch, ship

#: Queries that go to the executors at once; more are searched in further blocks, one after another.
QUERY_BLOCK = 1024
#: Allowed ids up to here become an IN list, more a semi join.
IN_LIST = 1000
FOUND = "query_id bigint, id bigint, score double"


def checked_k(k: int) -> int:
    if k < 0:
        raise ValueError("k is negative")
    return k


def restricted(base: DataFrame, id_col: str, where: Column | str | None = None, allowed: Sequence[int] | DataFrame | None = None) -> DataFrame:
    """base before the search: only rows that satisfy `where` (text may name the base `s`) and whose id is allowed.
    An empty sequence of ids allows none. Unparsable predicates raise."""
    out = base.alias("s")
    if where is not None:
        out = out.filter(where)
    if isinstance(allowed, DataFrame):
        ids = allowed.select(F.col(allowed.columns[0]).cast("bigint").alias("_allowed"))
        return out.join(ids, F.col(f"s.{id_col}") == F.col("_allowed"), "left_semi")
    if allowed is not None:
        ids = [int(i) for i in allowed]
        if len(ids) <= IN_LIST:
            return out.filter(F.col(f"s.{id_col}").isin(ids) if ids else F.lit(False))
        listed = base.sparkSession.createDataFrame([(i,) for i in ids], "_allowed bigint")
        return out.join(listed, F.col(f"s.{id_col}") == F.col("_allowed"), "left_semi")
    return out


def query_vector(query: Sequence[float], dim: int | None = None) -> list[float]:
    """The query in single precision, as stored vectors are."""
    v = [float(np.float32(x)) for x in query]
    if not v or not np.isfinite(v).all():
        raise ValueError("a query has numbers, and all are finite")
    if dim is not None and len(v) != dim:
        raise ValueError(f"the query has {len(v)} dimensions, the vectors {dim}")
    return v


def scored(base: DataFrame, query: Sequence[float], id_col: str = "id", vec_col: str = "vec", keep: Sequence[str] = ()) -> DataFrame:
    """(id, score, *keep): squared distance to the query of all vectors of its size, in column functions; null, NaN or infinite if
    an entry is."""
    q = query_vector(query)
    vec = as_vector(F.col(vec_col))
    rows = base.filter(F.col(id_col).isNotNull() & (F.size(vec) == len(q)))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), squared_l2_to(vec, q).alias("score"), *keep)


def first_k(rows: DataFrame, k: int) -> DataFrame:
    """The k least scores. What can't be measured sorts last and is dropped after the limit, so that the distance is computed
    once a row and not in a filter too."""
    return rows.orderBy(F.col("score").asc_nulls_last(), "id").limit(checked_k(k)).filter(F.col("score") < float("inf"))


def exact_knn(base: DataFrame, query: Sequence[float], k: int, id_col: str = "id", vec_col: str = "vec", where: Column | str | None = None, allowed: Sequence[int] | DataFrame | None = None) -> DataFrame:
    """(id, score) of the k nearest, nearest first, the lower id first among equals."""
    point, k = np.array([query_vector(query)]), checked_k(k)
    rows = _vectors(restricted(base, id_col, where, allowed), id_col, vec_col)
    return first_k(rows.mapInArrow(lambda it: best_exact(it, np.zeros(1, np.int64), point, k), FOUND).select("id", "score"), k)


def _vectors(base: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    ship(base.sparkSession)
    return base.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), as_vector(F.col(vec_col)).alias("vec"))


def query_blocks(queries: Sequence[tuple[int, Sequence[float]]] | DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query ids, vectors) of at most `size` queries at a time; of a DataFrame, the first two columns, never all on the driver."""
    if isinstance(queries, DataFrame):
        a, b = queries.columns[:2]
        rows = queries.select(F.col(a).cast("bigint"), as_vector(F.col(b))).toLocalIterator()
    else:
        rows = iter(queries)
    dim, held = None, []
    for i, v in rows:
        held.append((int(i), query_vector(v, dim)))
        dim = dim or len(held[0][1])
        if len(held) == size:
            yield np.array([i for i, _ in held]), np.array([v for _, v in held])
            held = []
    if held:
        yield np.array([i for i, _ in held]), np.array([v for _, v in held])


def topmost(found: DataFrame, k: int) -> DataFrame:
    rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score, id)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def in_blocks(spark: SparkSession, blocks: Iterator[tuple[np.ndarray, np.ndarray]], search: Callable[[np.ndarray, np.ndarray], DataFrame]) -> DataFrame:
    """The rows that search(ids, vectors) gives for all blocks. One block is a lazy plan; with more, each one's result is written
    to the shared folder before the next block is taken, so that neither the driver nor the plan grows with the queries."""
    empty = spark.createDataFrame([], FOUND).withColumn("rank", F.lit(0))
    first = next(blocks, None)
    if first is None:
        return empty
    second = next(blocks, None)
    if second is None:
        return search(*first)
    at = scratch(spark, "found")
    for part in itertools.chain((first, second), blocks):
        search(*part).write.mode("append").parquet(at)
    return spark.read.schema(empty.schema).parquet(at)


def exact_knn_batch(base: DataFrame, queries: Sequence[tuple[int, Sequence[float]]] | DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", where: Column | str | None = None, allowed: Sequence[int] | DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) for each query. Each task keeps k rows a query of its partition, so that only those are
    shuffled; queries go out in blocks of QUERY_BLOCK, with a scan for each."""
    k = checked_k(k)
    rows = _vectors(restricted(base, id_col, where, allowed), id_col, vec_col)
    blocks = query_blocks(queries, QUERY_BLOCK) if k else iter(())
    return in_blocks(base.sparkSession, blocks, lambda names, points: topmost(rows.mapInArrow(lambda it: best_exact(it, names, points, k), FOUND), k))


def best_exact(batches: Iterator[pa.RecordBatch], names: np.ndarray, points: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest rows of one partition for each query. Distances come from matrix products, and are summed up exactly for the
    few that may be among the best; holds those and one block of distances."""
    best, step = Best(len(names), k), max(64, (1 << 21) // max(1, len(names)))
    for b in batches if k else ():
        for first in range(0, b.num_rows, step):
            part = b.slice(first, step)
            x, at = finite_rows(part.column(1), points.shape[1])
            if not len(x):
                continue
            r, q = best.candidates(*products(x, points))
            d = pair_distances(x[r], points[q])
            best.add(q, d, np.asarray(part.column(0), np.int64)[at[r]], d)
    if len(best.id):
        yield pa.RecordBatch.from_arrays([pa.array(names[best.query]), pa.array(best.id), pa.array(best.key)], ["query_id", "id", "score"])
