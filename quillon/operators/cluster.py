"""Coarse clusters: training, assignment, inverted lists, ranking and probing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import as_vector, squared_l2
from quillon.operators.blocks import distances, matrix, nearest


def kmeans(x: np.ndarray, clusters: int, seed: int, rounds: int) -> np.ndarray:
    """k-means++ and Lloyd rounds until nothing moves, over rows in an order of their own; fewer centroids if there are fewer
    different rows."""
    x = x[np.lexsort(x.T[::-1])]
    rng = np.random.default_rng(seed)
    points, columns = [x[rng.integers(len(x))]], np.ascontiguousarray(x.T)

    def off(point: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for c, p in zip(columns, point):
            out += (c - p) ** 2
        return out

    left = off(points[0])
    while len(points) < clusters and (total := left.sum()) > 0:
        points.append(x[min(len(x) - 1, int(np.searchsorted(np.cumsum(left), rng.random() * total, side="right")))])
        left = np.minimum(left, off(points[-1]))
    return lloyd(x, np.array(points), rounds)


def lloyd(x: np.ndarray, centers: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd rounds until no row changes its center; a center without rows stays."""
    centers, old = centers.copy(), None
    for _ in range(rounds):
        at = nearest(x, centers)
        if old is not None and (at == old).all():
            break
        old, n = at, np.bincount(at, minlength=len(centers))
        sums = np.stack([np.bincount(at, weights=x[:, d], minlength=len(centers)) for d in range(x.shape[1])], axis=1)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def train_centroids(training: DataFrame, clusters: int, seed: int = 42, rounds: int = 20, vec_col: str = "vec") -> DataFrame:
    """(cluster_id, centroid) from a bounded sample (see plans.index), which one task holds whatever its size. Not more clusters
    than different rows."""
    if clusters < 1:
        raise ValueError("at least one cluster is needed")
    rows = training.select(as_vector(F.col(vec_col)).alias("vec"))
    dim = rows.select(F.max(F.size("vec"))).first()[0]
    if dim is None:
        raise ValueError("no vector to train on")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [matrix(b.column(0), dim) for b in batches if b.num_rows]
        if parts:
            centers = kmeans(np.concatenate(parts), clusters, seed, rounds).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centers), dtype=np.int32)), pa.array(list(centers), pa.list_(pa.float32()))], ["cluster_id", "centroid"])

    return rows.repartition(1).mapInArrow(run, "cluster_id int, centroid array<float>")  # not coalesce, which would read the base in one task


def lloyd_step(base: DataFrame, centroids: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(cluster_id, pos, mean): one refinement in DataFrame operations; clusters without rows give none."""
    at = assigned(base, centroid_array(centroids), id_col, vec_col).withColumnRenamed("id", "_id")
    rows = base.select(F.col(id_col).cast("bigint").alias("id"), as_vector(F.col(vec_col)).alias("vec"))
    each = rows.join(at, rows["id"] == at["_id"]).select("cluster_id", F.posexplode("vec").alias("pos", "x"))
    return each.groupBy("cluster_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centroid_array(centroids: DataFrame) -> np.ndarray:
    """Centroids in order of cluster_id, which counts from 0; the number of clusters bounds them."""
    rows = sorted((r["cluster_id"], r["centroid"]) for r in centroids.select("cluster_id", "centroid").collect())
    if [i for i, _ in rows] != list(range(len(rows))):
        raise ValueError("cluster ids don't count from 0")
    return np.array([c for _, c in rows], np.float64)


def assigned(base: DataFrame, points: np.ndarray, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, cluster_id): the nearest centroid, the lower id among equals. Arrow batches, no join and no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nearest(matrix(b.column(1), points.shape[1]), points).astype(np.int32))], ["id", "cluster_id"])

    return base.select(F.col(id_col).cast("bigint").alias("id"), as_vector(F.col(vec_col)).alias("vec")).mapInArrow(run, "id bigint, cluster_id int")


def assigned_in_columns(base: DataFrame, centroids: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """The same in column functions, over one constant array of centroids; the form that the tests hold the other against."""
    points = centroid_array(centroids)
    words = F.from_json(F.lit(str(points.tolist())), "array<array<float>>")
    best = F.array_min(F.transform(words, lambda c, k: F.struct(squared_l2(as_vector(F.col(vec_col)), c).alias("d"), k.alias("k"))))
    return base.select(F.col(id_col).cast("bigint").alias("id"), best["k"].cast("int").alias("cluster_id"))


def postings(assignment: DataFrame) -> DataFrame:
    """(cluster_id, ids): inverted lists in id order, for export. The index itself keeps flat rows."""
    return assignment.groupBy("cluster_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def ranked(points: np.ndarray, query: Sequence[float]) -> list[tuple[int, float]]:
    """(cluster_id, distance), nearest first, the lower id among equals."""
    d = distances(np.array([query], np.float64), points)[0]
    return [(int(i), float(d[i])) for i in np.lexsort((np.arange(len(d)), d))]


def among(clusters: Iterable[int]) -> Column:
    """Whether cluster_id is one of them, as ranges: Parquet skips by those however many there are, and not by long IN lists."""
    ids = np.unique(np.fromiter(clusters, np.int64))
    if not len(ids):
        return F.lit(False)
    runs = np.split(ids, np.flatnonzero(np.diff(ids) > 1) + 1)
    return F.expr(" OR ".join(f"(cluster_id >= {r[0]} AND cluster_id <= {r[-1]})" for r in runs))


def probed(points: np.ndarray, query: Sequence[float], nprobe: int) -> list[int]:
    """The nprobe nearest clusters."""
    if nprobe < 0:
        raise ValueError("nprobe is negative")
    return [i for i, _ in ranked(points, query)[:nprobe]]
