"""Recall, latency and size of an index on given queries."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors
from quillon.operators import knn
from quillon.plans.index import Index

STUDY = "k int, nprobe int, n_queries int, avg_exact_ms double, avg_ann_ms double, recall double"


def _lists(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("query_id").agg(F.collect_list("id").alias(name))


def batch_recall(index: Index, queries: Sequence[tuple[int, Sequence[float]]] | DataFrame, k: int, rerank: int = 200, nprobe: int | None = None, probe_mode: str = "exhaustive") -> DataFrame:
    """(query_id, recall) of search_batch against the exact top k."""
    s = index.settings
    exact = _lists(knn.exact_knn_batch(index.base, queries, k, s.id_col, s.vec_col), "exact")
    found = _lists(index.search_batch(queries, k, rerank, nprobe, probe_mode=probe_mode), "found")
    return exact.join(found, "query_id", "left").select("query_id", F.coalesce(vectors.recall(F.col("exact"), F.col("found")), F.lit(0.0)).alias("recall"))


def study(index: Index, queries: Sequence[Sequence[float]], ks: Sequence[int] = (1, 10, 100), nprobes: Sequence[int] = (32, 64, 128, 256), probe_mode: str = "limit") -> DataFrame:
    """One row a (k, nprobe): mean milliseconds of single exact and approximate searches, and mean recall of the latter."""
    s, rows = index.settings, []
    index.cached().entries.count()
    for k in ks:
        truth, began = [], time.perf_counter()
        for q in queries:
            truth.append({r["id"] for r in knn.exact_knn(index.base, q, k, s.id_col, s.vec_col).collect()})
        exact_ms = (time.perf_counter() - began) * 1000 / max(1, len(queries))
        for nprobe in nprobes:
            began, recalls = time.perf_counter(), []
            for q, want in zip(queries, truth):
                got = {r["id"] for r in index.search(q, k, nprobe, probe_mode=probe_mode).collect()}
                recalls.append(len(got & want) / len(want) if want else 1.0)
            rows.append((k, nprobe, len(queries), exact_ms, (time.perf_counter() - began) * 1000 / max(1, len(queries)), sum(recalls) / max(1, len(recalls))))
    return index.base.sparkSession.createDataFrame(rows, STUDY)


def filter_study(index: Index, query: Sequence[float], filters: Sequence[str], k: int = 10) -> DataFrame:
    """(filter, seconds, result_count, speed_up): each filter's search against that without one."""
    def timed(where: str | None) -> tuple[float, int]:
        began = time.perf_counter()
        n = len(index.search(query, k, where=where).collect())
        return time.perf_counter() - began, n

    index.cached().entries.count()
    plain, _ = timed(None)
    rows = [(w, *timed(w)) for w in filters]
    df = index.base.sparkSession.createDataFrame(rows, "filter string, seconds double, result_count int")
    return df.withColumn("speed_up", vectors.speed_up(F.lit(plain), F.col("seconds")))


def code_compression(index: Index) -> DataFrame:
    """(n_rows, code_bytes, ratio) of the vectors' 32-bit payload to a byte a sub-vector."""
    sizes = index.entries.agg(F.count("*").alias("n_rows"), F.sum(F.size("code")).alias("code_bytes"))
    return sizes.select("n_rows", "code_bytes", vectors.compression_ratio(F.col("n_rows"), index.settings.dim, F.col("code_bytes")).alias("ratio"))
