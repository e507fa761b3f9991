"""Arriving vectors against a fixed index: the same one-pass encoding on a stream, appended beside its entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions.vectors import as_vector, usable
from quillon.plans.index import Index, entries


def encoded_stream(index: Index, arriving: DataFrame) -> DataFrame:
    """Entries of a stream with the base's columns; unusable rows are left out. Stateless."""
    s = index.settings
    vec = as_vector(F.col(s.vec_col))
    kept = [f.name for f in index.entries.schema["kept"].dataType.fields]
    one = F.struct(*(F.col(f"`{c}`") if c != "_" else F.lit(None).cast("boolean").alias("_") for c in kept))
    rows = arriving.filter(F.col(s.id_col).isNotNull() & usable(vec, s.dim)).select(F.col(s.id_col).cast("bigint").alias("id"), vec.alias("vec"), one.alias("kept"))
    return entries(rows, index.book, index.points)


def append_stream(index: Index, arriving: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends to `folder`/streamed, exactly once by the file sink's log. `folder` may be that of a saved index, which load_index
    then reads with its streamed entries; saving that one to another folder takes them into the entries' layout."""
    out = encoded_stream(index, arriving).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/streamed").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
