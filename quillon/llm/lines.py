"""Line deduplication against levelled sorted runs of line hashes.

Documents arrive in batches of ascending doc_id. A batch's distinct line keys, as 128-bit hashes with the smallest doc_id that
holds each, are merge-anti-joined with the runs of earlier batches; what is left becomes a new run, sorted in hash buckets, so
that these joins move and sort no run. When `fanout` runs have gathered on a level, they are compacted to one of the next level.
At the end the runs hold each key once, with its owner, and a line goes if another document owns its key.

Null and empty texts are one empty line. Rows that repeat a doc_id are one document in several rows; rows without doc_id are
together one last document. What a row loses is addressed by doc_id and text hash, so neither a doc_id that repeats often nor many
rows without one gather in a task. Very long texts are split whole. Among documents that tie for a key the smallest doc_id keeps it.
Further columns may have any name; an empty table gives no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from quillon.llm.common import SPACE, cut_points, named, octets, text_hash
from quillon.shared import fresh, remove, scratch

LAST = (1 << 63) - 1
PAIRS = "h1 long, h2 long, doc long, at long"
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def key_of(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def pairs(docs: DataFrame, least: int, edges: list[int]) -> DataFrame:
    """(h1, h2, doc, at, batch): each row's distinct keys of at least `least` code points, with the hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                b = whole.slice(first, 2048)
                ids = np.asarray(b.column(0).fill_null(LAST), np.int64)
                keys, counts = [], []
                for t in octets(b.column(1)):
                    own = {k for k in map(key_of, t.split(b"\n")) if long_enough(k, least)}
                    keys.append(b"".join(map(xxh3_128_digest, own)))
                    counts.append(len(own))
                h = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype(np.int64)
                doc, at = np.repeat(ids, counts), np.repeat(np.asarray(b.column(2)), counts)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(doc), pa.array(at), pa.array(np.searchsorted(edges, doc).astype(np.int32))], ["h1", "h2", "doc", "at", "batch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash(docs).alias("at")).mapInArrow(run, PAIRS + ", batch int")


class SortedRuns:
    """Runs (h1, h2, owner) by level, each bucketed and sorted by the hash."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int) -> None:
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[tuple[str, str]]] = [[]]

    def _write(self, rows: DataFrame, level: int) -> None:
        name, at = f"line_run_{uuid.uuid4().hex}", scratch(self.spark, "line-run")
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", at).option("compression", "zstd").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, at))

    def _drop(self, name: str, at: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, at)

    def add(self, firsts: DataFrame) -> None:
        """Takes a batch's (h1, h2, owner), one row a key, with owners above those of all earlier batches."""
        before = self.spark.conf.get(ORDERED)
        self.spark.conf.set(ORDERED, "true")
        try:
            for name, _ in (run for level in self.levels for run in level):
                firsts = firsts.join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
            self._write(firsts.select("h1", "h2", "owner"), 0)
            for level in range(len(self.levels)):
                if len(old := self.levels[level]) >= self.fanout:
                    self._write(self._union(old).repartition(self.buckets, "h1", "h2"), level + 1)
                    self.levels[level] = []
                    for run in old:
                        self._drop(*run)
        finally:
            self.spark.conf.set(ORDERED, before)

    def _union(self, runs: list[tuple[str, str]]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, owner long").parquet(*(at for _, at in runs))

    def owners(self) -> DataFrame:
        return self._union([run for level in self.levels for run in level])

    def close(self) -> None:
        """Forgets the names; the files stay, since owners() reads them when the result is computed."""
        for name, _ in (run for level in self.levels for run in level):
            self.spark.sql(f"DROP TABLE {name}")


def drops(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(doc, at, gone): the key hashes that the rows of a doc_id and text hash lose."""
    spark = docs.sparkSession
    edges = cut_points(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", batches)
    at = scratch(spark, "line-pairs")
    pairs(docs, least, edges).write.partitionBy("batch").option("compression", "zstd").parquet(at)
    arrived = spark.read.schema(PAIRS + ", batch int").parquet(at)
    runs = SortedRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    for batch in range(batches):
        runs.add(arrived.filter(F.col("batch") == batch).groupBy("h1", "h2").agg(F.min("doc").alias("owner")))
    runs.close()
    lost = arrived.drop("batch").join(runs.owners(), ["h1", "h2"]).filter("doc > owner")
    return lost.groupBy("doc", "at").agg(F.collect_set("h1").alias("gone"))


def dedup_lines(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 3, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with `text` reduced to the lines that stay, and with two more columns of those names (lengthened where docs has
    them; none without `counts`): lines before, and lines that went. All other columns stay as they are. Texts are moved once,
    compressed, to meet what they lose."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    columns, at = docs.columns, docs.columns.index("text")
    more = fresh(columns, *(counts or ()))
    plain = [f"c{i}" for i in range(len(columns))]  # names of any kind can't pass through Python
    lost = drops(docs, least, batches, fanout)
    fields = [T.StructField(p, T.BinaryType() if i == at else f.dataType) for i, (p, f) in enumerate(zip(plain, docs.schema))]
    squeezed = T.StructType([*fields, T.StructField("own", T.LongType()), T.StructField("hash", T.LongType())])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            yield b.set_column(at, plain[at], pa.array([z.compress(t) for t in octets(b.column(at))], pa.binary()))

    fields[at] = T.StructField(plain[at], T.StringType())
    out = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in more)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                b = whole.slice(first, 1024)
                kept, lines, dropped = [], [], []
                for raw, out_of in zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist()):
                    own = z.decompress(raw).split(b"\n")
                    stay = own
                    if out_of:
                        bad = {x.to_bytes(8, "big", signed=True) for x in out_of}
                        stay = [x for x in own if not (long_enough(k := key_of(x), least) and xxh3_128_digest(k)[:8] in bad)]
                    kept.append(b"\n".join(stay))
                    lines.append(len(own))
                    dropped.append(len(own) - len(stay))
                arrays = [*b.columns[: len(columns)], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())][: len(columns) + len(more)]
                arrays[at] = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, out.names)

    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("own")
    moved = docs.select(*(named(c).alias(p) for c, p in zip(columns, plain)), own, text_hash(docs).alias("hash")).mapInArrow(squeeze, squeezed)
    met = moved.join(lost.hint("shuffle_hash"), (F.col("own") == F.col("doc")) & (F.col("hash") == F.col("at")), "left")
    return met.select(*plain, "gone").mapInArrow(apply, out).toDF(*columns, *more)
