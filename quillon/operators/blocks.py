"""numpy kernels over Arrow batches; they accumulate from the first dimension to the last in double, like the column functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without nulls and of equal size, in double."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if len(flat) != dim * len(column):
        raise ValueError(f"a vector's size isn't {dim}")
    return np.asarray(flat, np.float64).reshape(-1, dim)


def finite_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, places) of the rows of a list column that can be measured: of that size, with finite numbers only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.asarray(column.offsets, np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    good = np.flatnonzero((np.diff(at) == dim) & np.asarray(column.is_valid()))
    if len(good) == len(column) and at[-1] - at[0] == dim * len(column):
        x = np.asarray(values[at[0] : at[-1]], np.float64).reshape(-1, dim)
    else:
        x = np.asarray(values[at[good][:, None] + np.arange(dim)], np.float64).reshape(-1, dim)
    fine = np.isfinite(x).all(axis=1)
    return (x, good) if fine.all() else (x[fine], good[fine])


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(rows, points) squared distances."""
    out = np.zeros((len(rows), len(points)))
    for d in range(rows.shape[1]):
        step = rows[:, d, None] - points[None, :, d]
        step *= step
        out += step
    return out


def pair_distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the point of the same place."""
    out = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        step = rows[:, d] - points[:, d]
        step *= step
        out += step
    return out


def products(rows: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, points) squared distances by a matrix product, and for each row how far they can be from the exact sums."""
    a, b = (rows * rows).sum(axis=1), (points * points).sum(axis=1)
    return a[:, None] + b[None, :] - 2 * rows @ points.T, 1e-9 * (a + b.max(initial=0.0) + 1e-30)


def nearest(rows: np.ndarray, points: np.ndarray, block: int = 2048) -> np.ndarray:
    """Index of the nearest point, the first among equals.

    A matrix product finds the distances fast; rows whose best two are too near each other for it are decided exactly."""
    out = np.empty(len(rows), np.int64)
    for i in range(0, len(rows), block):
        part = rows[i : i + block]
        d, slack = products(part, points)
        best = d.argmin(axis=1)
        close = np.flatnonzero((d <= (d[np.arange(len(part)), best] + slack)[:, None]).sum(axis=1) > 1)
        if len(close):
            best[close] = distances(part[close], points).argmin(axis=1)
        out[i : i + block] = best
    return out


class Best:
    """For each of n queries the k rows of least (key, id) seen so far, each with a second value."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.query, self.key, self.id, self.value = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0)
        self.worst = np.full(n, np.inf)  # the k-th key of each query, once it has k

    def add(self, query: np.ndarray, key: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        query, key, ids, value = np.r_[self.query, query], np.r_[self.key, key], np.r_[self.id, ids], np.r_[self.value, value]
        order = np.lexsort((ids, key, query))
        query = query[order]
        begin = np.searchsorted(query, np.arange(self.n))
        order = order[np.arange(len(query)) - begin[query] < self.k]
        self.key, self.id, self.value = key[order], ids[order], value[order]
        self.query = np.sort(query)[np.arange(len(query)) - begin[query] < self.k]
        ends = np.searchsorted(self.query, np.arange(self.n), side="right")
        full = ends - np.searchsorted(self.query, np.arange(self.n)) == self.k
        self.worst = np.full(self.n, np.inf)
        if self.k:
            self.worst[full] = self.key[ends[full] - 1]

    def candidates(self, keys: np.ndarray, slack: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(rows, queries) that may be among the best, by keys (rows, queries) that are right but for the slack of a row."""
        bound = self.worst
        if len(keys) > self.k:
            bound = np.minimum(bound, np.partition(keys + np.reshape(slack, (-1, 1)), self.k - 1, axis=0)[self.k - 1])
        return np.nonzero(keys - np.reshape(slack, (-1, 1)) <= bound[None, :])
