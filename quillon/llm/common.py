"""Tables, distributed prefix sums and other pieces that several operators use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.shared import fresh, ship, written

SPACE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def octets(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def prefix_sums(df: DataFrame, order: list[str], value: str, group: str | None = None, name: str = "prefix") -> DataFrame:
    """Adds `before`: the sum of `value` over the rows that come earlier in `order` (in the row's group, if one is given).

    Rows are range-sorted by (group, order), each partition sums its own run, and the totals of the partitions (one row for
    each partition and group in it) are scanned apart; no group has to fit one task. Written to the shared folder."""
    keys = ([group] if group else []) + order
    runs = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    columns = df.columns
    at, run, own, of, total, base = fresh(columns, "_pid", "_run", "_local", "_of", "_sum", "_base")
    schema = T.StructType([*df.schema.fields, T.StructField(at, T.IntegerType()), T.StructField(own, T.LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, so_far, last = TaskContext.get().partitionId(), 0, object()
        for b in batches:
            v = np.asarray(b.column(columns.index(value)).fill_null(0), dtype=np.int64)
            sums = np.cumsum(v)
            start = np.full(len(v), so_far, dtype=np.int64)
            if group and len(v):
                g = b.column(columns.index(group)).to_pylist()
                new = np.fromiter((x != y for x, y in zip(g, [last, *g[:-1]])), bool, len(g))
                first = np.flatnonzero(new)
                if len(first):
                    start[first[0] :] = np.repeat(-(sums[first] - v[first]), np.diff(np.r_[first, len(v)]))
                last = g[-1]
            out = start + sums - v
            so_far = int(start[-1] + sums[-1]) if len(v) else so_far
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), pid, np.int32)), pa.array(out)], [*columns, at, own])

    kept = written(runs.mapInArrow(local, schema), name)
    named = [F.col(group).alias(of)] if group else []
    totals = kept.groupBy(F.col(at).alias(run), *named).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias(total))
    part = f"PARTITION BY {of}" if group else ""
    totals = totals.withColumn(base, F.coalesce(F.expr(f"sum({total}) OVER ({part} ORDER BY {run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0)))
    on = F.col(at) == F.col(run)
    if group:
        on &= F.col(group).eqNullSafe(F.col(of))
    return kept.join(totals.drop(total), on, "left").select(*columns, (F.col(base) + F.col(own)).alias("before"))


def cut_points(df: DataFrame, column: str, ranges: int) -> list[int]:
    """At most ranges - 1 rising values that part a long column into about equal ranges; nulls don't count."""
    shares = [(i + 1) / ranges for i in range(ranges - 1)]
    found = df.agg(F.percentile_approx(F.col(column).cast("long"), shares, max(1000, 10 * ranges)).alias("at")).first()["at"] if shares else None
    return sorted(set(found or []))


def named(column: str) -> Column:
    """A column by its exact name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_hash(docs: DataFrame) -> Column:
    """With doc_id, the address of a row: doc_ids may be null or repeat, but rows that share both are the same document."""
    return F.xxhash64(docs["text"].cast("string"))
