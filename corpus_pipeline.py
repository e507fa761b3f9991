"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Quality rules drop what they reject; line dedup shortens texts (n_chars
follows); near-dedup keeps one document of each group; mixing orders the rows by its schedule; packing returns the pieces of
the sequences, packed along the curve within one window of the mix after another, so that the mix holds in the sequences too.

Further columns of documents, of any name, go through the stages as they are (the last reads doc_id and text only). Nulls, empty
texts, ties and repeated rows are as each operator states; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import lines, mixing, packing, quality, simhash
from quillon.llm.common import named, table
from quillon.shared import remove, scope, scratch

#: Tokens of the mix that are packed along the curve at a time.
WINDOW = 1 << 22


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs, counts=None)
    return out.select(*(F.length("text").cast(f.dataType).alias(f.name) if f.name == "n_chars" else named(f.name) for f in docs.schema))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs is read from the files of the mix: the number of the task that wrote a file, that of the file in its task, and the
    row's in the file give its order."""
    of = docs.metadataColumn("_metadata")
    number = lambda pattern: F.regexp_extract(of["file_name"], pattern, 1).try_cast("long")
    ordered = docs.select("doc_id", "text", number(r"part-(\d+)").alias("mix_task"), number(r"-c(\d+)\.").alias("mix_nth"), of["file_path"].alias("mix_file"), of["row_index"].alias("mix_row"))
    pieces = packing.pack(ordered, window=WINDOW, along=("mix_task", "mix_nth", "mix_file", "mix_row"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: The vocabularies, hashes and curve of the stages have no SQL form; tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages wrote on the way is removed as soon as the next stage is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = scratch(spark, f"pipeline-{name}")
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(at)
        docs = spark.read.schema(out.schema).parquet(at)
        if before:
            remove(spark, before)
        before = at
    return docs
