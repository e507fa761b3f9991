from collections import Counter

import numpy as np
import pytest
from quillon.llm import counting
from quillon.llm.tokens import word_bpe


@pytest.mark.parametrize("block", [1 << 20, 64, 1])
def test_counts_against_the_tokenizer(docs, rows, block):
    if block == 1:
        docs, rows = docs.filter("doc_id < 6"), [r for r in rows if r[0] is not None and r[0] < 6]
    bpe = word_bpe()
    got = counting.document_tokens(docs, block_tokens=block).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r[0], len(bpe.ids(r[1] or "")) // 2) for r in rows)
    for f in {r.file for r in got}:
        own = sorted((r.ordinal, r.start, r.n_tokens) for r in got if r.file == f)
        assert [o for o, _, _ in own] == list(range(len(own)))
        assert all(a[1] + a[2] + 1 == b[1] for a, b in zip(own, own[1:]))


def test_stitching_of_a_file_written_by_hand(spark, tmp_path):
    ids = np.array([9, 9, 9, 5, 5, 1, 9, 2, 2, 2, 2, 2, 2, 2, 2, 9, 3], "<u2")
    (tmp_path / "x.u16").write_bytes(ids.tobytes())
    files = spark.createDataFrame([(f"file://{tmp_path}/x.u16", ids.nbytes)], "file string, bytes long")
    for block in (1, 2, 3, 5, 100):
        got = sorted((r.ordinal, r.start, r.n_tokens) for r in counting.count_tokens(spark, files, 9, block).collect())
        assert got == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 3), (4, 7, 8)]


def test_empty_table(none):
    assert counting.document_tokens(none).count() == 0
