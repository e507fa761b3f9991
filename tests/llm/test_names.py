"""Extra columns named like the code's own, with dots, spaces and in other case, go through every stage as they are."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from quillon.llm import counting, html, lines, mixing, packing, quality, sampling, sharding, simhash, toxicity

NAMES = """_gone _doc _at _hash n_lines n_dropped _n_lines _kept_id _kept_at _nth _id _position _tie tie _gone_id _gone_hash _pid _run _local _of _sum _base
before at doc gone h1 h2 batch fp root component_id row key n ids window mix_file mix_row mix_task mix_nth range tail p h z arrival _arrival _file first
fingerprint release deadline slot position block band of n_words kept base_failed text_hash score held_out toxic _toxic _text _order file ordinal bytes run shard tier version""".split()


@pytest.fixture(scope="module")
def wide(spark, docs, tmp_path_factory):
    df = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for i, c in enumerate([*NAMES, "a.b", "with space", "tick`s", "_TIE_", "Gone.x"]):
        df = df.withColumn(c, F.concat(F.lit(f"{i}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    at = f"{tmp_path_factory.mktemp('wide')}/documents.parquet"
    df.write.parquet(at)
    return spark.read.parquet(at)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:4])
def test_stages_keep_columns_and_values(spark, wide, name, stage):
    out = stage(spark, wide, "")
    assert out.columns == wide.columns and out.dtypes == wide.dtypes
    extra = [c for c in wide.columns if c not in ("text", "n_chars")]
    pick = lambda df: Counter(tuple(r[c] for c in extra) for r in df.collect())
    got, every = pick(out), pick(wide)
    assert got and not got - every
    if name in ("line_dedup", "mix_sources"):
        assert got == every


def test_operators_run_and_give_their_own_columns(spark, wide):
    labels = wide.filter("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), "_id", "_toxic", "_order")
    pages = wide.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *(F.col(c) for c in NAMES))
    n = wide.count()
    for out in (sampling.with_next(wide), sampling.fingerprinted(wide), simhash.simhash_groups(wide), mixing.mixed(wide), counting.document_tokens(wide), sharding.shard_of_documents(wide), quality.judged(wide), html.extracted(pages), toxicity.scored(wide, labels)):
        assert len(set(out.columns)) == len(out.columns) and out.count() == n
    assert packing.pack(wide).filter("start = 0").count() == n
    assert lines.dedup_lines(wide).columns == [*wide.columns, "n_lines_", "n_dropped_"]
