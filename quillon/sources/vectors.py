"""Vector files and repeatable samples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.shared import ship

#: A multiplier that spreads consecutive ids over 32 bits; any SQL engine can compute it.
SPREAD = 2_654_435_761


#: Bytes of a file that a task reads at a time, about.
RANGE = 64 << 20


def _opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """A file by the path that Spark shows, where local ones are file:/…."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def read_fvecs(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """(id, vec) of .fvecs files: records of an int32 dimension and as many float32. Ids count the records of all files from 0
    in order of path. Files of any size are read in ranges of whole records, each by a task."""
    files = ship(spark).read.format("binaryFile").load(path).select("path", "length").filter("length > 0")

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = _opened(name)
                with fs.open_input_file(at) as f:
                    width = int(np.frombuffer(f.read(4), "<i4")[0]) if length >= 4 else 0
                if width <= 0 or length % (4 + 4 * width) or dim not in (None, width):
                    raise ValueError(f"{name} isn't made of {dim or width}-dimensional records")
                out.append(width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], ["path", "length", "width"])

    measured = files.repartition("path").mapInArrow(widths, "path string, length bigint, width bigint")
    measured = measured.selectExpr("path", "width", "length DIV (4 + 4 * width) AS n")
    numbered = measured.selectExpr("*", "coalesce(sum(n) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS base")
    ranges = numbered.selectExpr("path", "width", "n", "base", f"explode(sequence(0L, n - 1, greatest(1L, {RANGE} DIV (4 + 4 * width)))) AS first")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, width, n, base, first in zip(*(c.to_pylist() for c in b.columns)):
                fs, at = _opened(name)
                size, many = 4 + 4 * width, max(1, RANGE // (4 + 4 * width))
                with fs.open_input_file(at) as f:
                    for i in range(first, min(n, first + many), 8192):
                        f.seek(i * size)
                        rows = np.frombuffer(f.read(size * min(8192, n - i, first + many - i)), "<i4").reshape(-1, width + 1)
                        if (rows[:, 0] != width).any():
                            raise ValueError(f"{name} has records of several dimensions")
                        x = np.ascontiguousarray(rows[:, 1:]).view("<f4")
                        vec = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width, dtype=np.int32)), pa.array(x.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(base + i, base + i + len(x))), vec], ["id", "vec"])

    return ranges.repartition("path", "first").mapInArrow(decode, "id bigint, vec array<float>")


def write_fvecs(rows: DataFrame, folder: str) -> None:
    """(id, vec) as .fvecs files in order of id, whose paths sort alike; vectors are not null and of one size."""
    ship(rows.sparkSession)
    place = folder if "://" in folder else f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{place}/part-{TaskContext.get().partitionId():07d}.fvecs"
        fs, at = pa.fs.FileSystem.from_uri(name)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        n = 0
        with fs.open_output_stream(at) as out:  # an attempt that is repeated writes the same file again
            for b in batches:
                x = np.stack([np.asarray(v, "<f4") for v in b.column(0).to_pylist()]) if b.num_rows else np.empty((0, 0), "<f4")
                if len(x):
                    out.write(np.concatenate([np.full((len(x), 1), x.shape[1], "<i4").view("<f4"), x], axis=1).tobytes())
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["path", "n"])

    ordered = rows.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<float>").alias("vec")).repartitionByRange("id").sortWithinPartitions("id")
    ordered.select("vec").mapInArrow(run, "path string, n bigint").agg(F.sum("n")).collect()


def write_vectors(rows: DataFrame, path: str) -> None:
    """(id, vec) as Parquet, replacing what is there."""
    rows.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)


def spread(id_col: str, seed: int = 0) -> Column:
    """A number below 2**32 that looks random but is fixed by the id, of whatever size and sign."""
    low, two = F.pmod(F.pmod(F.col(id_col).cast("bigint"), F.lit(1 << 32)) + F.lit(seed % (1 << 32)), F.lit(1 << 32)), F.lit(1 << 16)
    high = F.pmod(F.floor(low / two).cast("bigint") * F.lit(SPREAD), two) * two  # the product's halves, so that none overflows
    return F.pmod(high + F.pmod(low, two) * F.lit(SPREAD), F.lit(1 << 32))


def bernoulli_sample(df: DataFrame, percent: float, id_col: str, seed: int = 0) -> DataFrame:
    """Each row with a probability of percent / 100, decided by its id; the same rows on every read."""
    return df.filter(spread(id_col, seed) < int((1 << 32) * percent / 100))


def bernoulli_or_all(df: DataFrame, percent: float, id_col: str, seed: int = 0) -> DataFrame:
    """The sample, or all rows if it is empty."""
    some = bernoulli_sample(df, percent, id_col, seed)
    return df if some.isEmpty() else some


def reservoir_sample(df: DataFrame, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """n rows, any n alike: those of the least spread numbers (a top-k, not a full sort)."""
    return df.orderBy(spread(id_col, seed), id_col).limit(n)


def vector_table_info(df: DataFrame) -> DataFrame:
    """(position, name, type) of a table's columns."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def table_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes) of each index table below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(name.alias("name")).agg(F.sum("length").alias("bytes"))
