"""Token counts by scanning flat token files for separators.

`write_tokens` leaves one flat file of unsigned 16-bit ids a partition, with no index: the documents' ids, each ended by the
separator. `count_tokens` cuts the files into blocks of bytes, finds the separators of a block with one vectorised comparison,
and stitches the blocks: a prefix scan over the block summaries gives each block the number of separators and the last
separator before it, so a document that spans blocks (or fills many) is counted right. A document's count leaves its separator
out; ids after a file's last separator are no document. Files are written under a new name by each attempt, and only those
that the written list names are read, so lost executors leave at most files without use.

Null and empty texts have count 0; very long texts span blocks. Repeated rows and doc_ids, and null doc_ids, are counted row by row;
rows have no order to tie in, as each has its place in its file. Further columns may have any name; an empty table gives no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import texts
from quillon.llm.tokens import WORD_BPE, word_bpe
from quillon.shared import scratch, written

SEPARATOR, BLOCK_TOKENS = 49407, 1 << 20
LISTED = "file string, ordinal long, doc_id long, bytes long"


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_tokens(docs: DataFrame, name: str = WORD_BPE, separator: int = SEPARATOR) -> DataFrame:
    """(file, ordinal, doc_id, bytes): the flat files, and which document stands where in each. A text's own ids never equal
    the separator: an id that does is written as 0."""
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, ordinal, uri = word_bpe(name), np.uint16(separator).tobytes(), 0, f"{folder}/{uuid.uuid4().hex}.u16"
        fs, path = opened(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        ids = []
        with fs.open_output_stream(path) as out:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    raw = list(map(bpe.ids, texts(b.column(1))))
                    for i, x in enumerate(raw):
                        if end in x and (own := np.frombuffer(x, np.uint16) == separator).any():
                            raw[i] = np.where(own, 0, np.frombuffer(x, np.uint16)).astype(np.uint16).tobytes()
                    out.write(b"".join(x + end for x in raw))
                    ids.append(b.column(0))
                    ordinal += b.num_rows
            size = out.tell()
        first = 0
        for column in ids:
            n = len(column)
            yield pa.RecordBatch.from_arrays([pa.array([uri] * n, pa.string()), pa.array(np.arange(first, first + n)), column, pa.array(np.full(n, size))], ["file", "ordinal", "doc_id", "bytes"])
            first += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, LISTED), "token-list")


def count_tokens(spark: SparkSession, files: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens) of each document in files (file, bytes)."""
    step = 2 * block_tokens
    blocks = files.select("file", F.col("bytes").cast("long").alias("bytes")).withColumn("block", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L) div {step}L)")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = opened(uri)
                with fs.open_input_file(path) as f:
                    f.seek(block * step)
                    ids = np.frombuffer(f.read(step), "<u2")
                at = np.flatnonzero(ids == separator) + block * block_tokens
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([block], pa.int64()), pa.array([at], pa.list_(pa.int64()))], ["file", "block", "at"])

    found = blocks.select("file", "block").repartition("file", "block").mapInArrow(scan, "file string, block long, at array<long>")
    earlier = "OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    stitched = found.selectExpr("file", "at", f"coalesce(sum(size(at)) {earlier}, 0L) AS seen", f"coalesce(max(array_max(at)) {earlier}, -1L) AS last")
    each = stitched.selectExpr("file", "seen", "last", "at", "posexplode(at) AS (k, stop)")
    start = "if(k = 0, last, at[k - 1]) + 1"
    return each.selectExpr("file", "seen + k AS ordinal", f"{start} AS start", f"stop - ({start}) AS n_tokens")


def document_tokens(docs: DataFrame, name: str = WORD_BPE, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens) for each row of docs (doc_id, text)."""
    listed = write_tokens(docs, name, separator)
    files = listed.groupBy("file").agg(F.first("bytes").alias("bytes"))
    counts = count_tokens(docs.sparkSession, files, separator, block_tokens)
    # the list compresses to little, which must not make it look small enough to broadcast
    return listed.join(counts.hint("shuffle_hash"), ["file", "ordinal"]).select("doc_id", F.element_at(F.split("file", "/"), -1).alias("file"), "ordinal", "start", "n_tokens")
