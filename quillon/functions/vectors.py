"""Distances and vector expressions of built-in functions, for any engine-side plan and for the oracles.

Distances add up in double from the first dimension to the last, so they are the same in every plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

def as_vector(v: Column) -> Column:
    return v.cast("array<float>")


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; null if a vector is null or their sizes differ in the longer one's rest."""
    steps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def squared_l2_to(v: Column, point: Sequence[float]) -> Column:
    """The same to a constant point."""
    return squared_l2(v, F.expr(f"array({', '.join(f'{float(x)!r}D' for x in point)})"))


def guarded_squared_l2(a: Column, b: Column) -> Column:
    """Infinity where the sizes differ."""
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).otherwise(squared_l2(a, b))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def subvector(v: Column, m: Column | int, width: int) -> Column:
    """The m-th run of `width` entries, from 0."""
    start = (F.lit(m) if isinstance(m, int) else m) * width + 1
    return F.slice(v, start, width)


def slice_squared_l2(a: Column, b: Column, m: Column | int, width: int) -> Column:
    """Squared distance of a's m-th sub-vector to b."""
    return squared_l2(subvector(a, m, width), b)


def flattened(v: Column) -> Column:
    return F.flatten(v)


def usable(v: Column, dim: int | None = None) -> Column:
    """Whether a vector can be searched: not null, of the dimension, and all entries finite numbers."""
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return ok & (F.size(v) == dim) if dim is not None else ok & (F.size(v) > 0)


def recall(exact: Column, found: Column) -> Column:
    """Share of the exact ids that were found; null if there are none."""
    return F.when(F.size(exact) > 0, F.size(F.array_intersect(exact, found)) / F.size(exact))


def compression_ratio(n_rows: Column, dim: Column | int, code_bytes: Column) -> Column:
    """Bytes of the raw 32-bit vectors over bytes of the codes."""
    dim = F.lit(dim) if isinstance(dim, int) else dim
    return n_rows * dim * 4 / code_bytes


def speed_up(base_seconds: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, base_seconds / seconds).otherwise(F.lit(float("inf")))
