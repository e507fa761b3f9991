"""Quality rules: plain counts, and tokeniser fertility against bands of the corpus.

Two public vocabularies measure every word of a text: one with byte fallback gives tokens per word, characters per token, the
share of tokens that spell a word in bytes, and the mean entropy of the tokens in blocks of 64 (so that it doesn't rise with the
length); a byte-level one gives a second figure of characters per token. The bands are medians of all documents of 50 or more words (the
others fail the base rules) of a language (lang; the script of the
text where it is null) plus and minus a wide number of median deviations, but never narrower than fixed margins, so that
ordinary prose stays and symbol noise, shouting, tables and repetition go. Every language is judged by its own documents alone,
however few; as few say little about the spread, a band of n documents is 1 + least_docs / n times as wide, which has no step at
any size. A language of one or two documents is thus hardly judged beyond the base rules.

Texts and words are measured whole, however long. A value that ties with the edge of its band is inside. Null texts have no word;
repeated rows and doc_ids are judged row by row. Further columns may have any name; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import octets, text_hash
from quillon.llm.tokens import fertility
from quillon.shared import written

PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["pieces_per_word", "chars_per_piece", "chars_per_byte_token", "fallback_share", "piece_entropy"]
BLOCK = 64
#: For each edge of a band: median deviations from the median, and the least distance from it; None: no such edge. A text of
#: under a block of tokens has no entropy, and is not judged by it.
BANDS = {
    "pieces_per_word": ((18.0, 0.9), (18.0, 0.9)),
    "chars_per_piece": ((20.0, 0.5), (20.0, 0.8)),
    "chars_per_byte_token": ((20.0, 0.5), (20.0, 0.8)),
    "fallback_share": (None, (15.0, 0.05)),
    "piece_entropy": ((9.0, 0.25), None),
}
_C = np.arange(1, BLOCK + 1)
C_LOG_C = np.r_[0, _C * np.log2(_C)]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur more than once."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    two = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1_000_000:
        two = np.unique(two, return_inverse=True)[1].astype(np.int64)
    _, back, count = np.unique(two[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    if len(count) == n:
        return 0
    inside = np.zeros(len(words), bool)
    again = count[back] > 1
    for k in range(3):
        inside[k : k + n] |= again
    return int(inside.sum())


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    chars = len(b"".join(words).decode("utf-8", "replace"))
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def block_entropy(ids: np.ndarray) -> float | None:
    """Mean bits of the tokens of each whole block."""
    m = len(ids) // BLOCK
    if not m:
        return None
    rows = np.sort(ids[: m * BLOCK].reshape(m, BLOCK), axis=1)
    first = np.ones((m, BLOCK), bool)
    first[:, 1:] = rows[:, 1:] != rows[:, :-1]
    runs = np.diff(np.r_[np.flatnonzero(first), m * BLOCK])
    return float(np.log2(BLOCK) - C_LOG_C[runs].sum() / (m * BLOCK))


def measures(words: list[bytes], chars: int, table: dict) -> tuple[float, float, float, float, float | None]:
    """Zeros for a text without a word."""
    pieces, tokens = zip(*map(table.__getitem__, words)) if words else ((), ())
    ids = np.frombuffer(b"".join(pieces), np.uint16)
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0, 0.0, None
    return n / len(words), chars / n, chars / max(1, sum(tokens)), float(table.fallback[ids].mean()), block_entropy(ids)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("band", T.StringType()), *[T.StructField(c, T.LongType()) for c in COUNTS], *[T.StructField(c, T.DoubleType()) for c in MEASURES]])


def script(text: bytes) -> str:
    """A rough script, for texts without lang: the block of most of the first letters beyond ASCII, if they are many."""
    high = np.frombuffer(text, np.uint8)
    lead = high[high >= 0xC0]
    if not len(lead) or len(lead) * 4 < len(high):
        return "script-latin"
    return f"script-{np.bincount(lead >> 2).argmax():02x}"


def measured(docs: DataFrame, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """(doc_id, band, counts, measures) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fertility(pieces, ranks)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                rows, bands = [], []
                every = [(raw, raw.split()) for raw in octets(b.column(1))]
                table.learn({w for _, words in every for w in words})
                for (raw, words), lang in zip(every, b.column(2).to_pylist()):
                    counts = base_counts(raw, words)
                    rows.append((*counts, *measures(words, counts[1], table)))
                    bands.append(script(raw) if lang is None else f"lang-{lang}")
                arrays = [pa.array(list(c), f.dataType.typeName() == "long" and pa.int64() or pa.float64()) for c, f in zip(zip(*rows), SCHEMA.fields[3:])]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(bands, pa.string()), *arrays], SCHEMA.names)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"), text_hash(docs).alias("text_hash")).mapInArrow(run, SCHEMA)


def bands(rows: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """(of, n, <measure>_mid, <measure>_dev) for each band: medians and median deviations over the documents of 50 words or more."""
    rows = rows.filter("n_words >= 50").select(F.col("band").alias("of"), *MEASURES)
    mids = [F.percentile_approx(m, 0.5, accuracy).alias(f"{m}_mid") for m in MEASURES]
    mid = rows.groupBy("of").agg(*mids, F.count("*").alias("n"))
    devs = [F.percentile_approx(F.abs(F.col(m) - F.col(f"{m}_mid")), 0.5, accuracy).alias(f"{m}_dev") for m in MEASURES]
    return rows.join(mid, "of").groupBy("of").agg(*[F.first(f"{m}_mid").alias(f"{m}_mid") for m in MEASURES], F.first("n").alias("n"), *devs)


def judged(docs: DataFrame, least_docs: int = 10, limits: dict = BANDS) -> DataFrame:
    """Counts, measures, base_failed and kept for each row of docs (doc_id, text, lang)."""
    rows = written(measured(docs), "quality-rows")
    of = written(bands(rows), "quality-bands").withColumn("_wide", 1 + F.lit(least_docs) / F.col("n")).withColumnRenamed("of", "band")
    met = rows.join(of, "band", "left")
    ok = F.lit(True)
    for m, (low, high) in limits.items():
        mid, dev = F.col(f"{m}_mid"), F.col(f"{m}_dev")
        if low:
            ok &= F.col(m).isNull() | (F.col(m) >= mid - F.col("_wide") * F.greatest(dev * low[0], F.lit(low[1])))
        if high:
            ok &= F.col(m).isNull() | (F.col(m) <= mid + F.col("_wide") * F.greatest(dev * high[0], F.lit(high[1])))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return met.select("doc_id", "text_hash", *COUNTS, *MEASURES, failed.alias("base_failed"), (~failed & F.coalesce(ok, F.lit(True))).alias("kept"))


def keep(docs: DataFrame, **params: object) -> DataFrame:
    """docs without the rows that are rejected; what goes is known by doc_id and text hash."""
    gone = judged(docs, **params).filter("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & text_hash(docs).eqNullSafe(gone["_gone_hash"]), "left_anti")
