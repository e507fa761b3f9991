import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from quillon.llm import packing, queries
from quillon.llm.tokens import PLAIN, byte_characters, vocabulary, word_bpe
from tokenizers import Tokenizer

HARD = [
    "", " ", "It's we'll I'd they've O'S'T", "a b", "café café ﬁ", "İstanbul ΣΑΣ ς", "x<|endoftext|>y", "tab\tnew\nline\x0bvt\x0cff", "\x1c\x1d\x85 z",
    "12345 ½ ² ٣ 东京", "🙂🙂 👩‍👩‍👧", "a" * 3000, "!?!?" * 400, "Ünï-cødé…“quote”—dash", "\x00nul \x7fdel", "ª º ŉ ſ Ĳ", "</w> ##w</w>", "… …",
]


def plain(texts):
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_librarys(rows):
    texts = [r[1] or "" for r in rows] + HARD
    bpe = word_bpe()
    assert [np.frombuffer(bpe.ids(t), np.uint16).tolist() for t in texts] == plain(texts)


def test_each_plain_character():
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x250) if not PLAIN.search(chr(c))] + [f"x{chr(c)}" for c in range(0x2000, 0x2030)]
    bpe = word_bpe()
    assert [np.frombuffer(bpe.ids(t), np.uint16).tolist() for t in texts] == plain(texts)


def test_each_token_of_the_vocabulary():
    bpe = word_bpe()
    words = [t.removesuffix("</w>") for t in bpe.whole.get_vocab() if not t.startswith("<|")]
    of = byte_characters()
    words = [w for w in (bytes(of[c] for c in w).decode("utf-8", "ignore") for w in words) if w]
    assert [np.frombuffer(bpe.ids(w), np.uint16).tolist() for w in words] == plain(words)


def test_hilbert_curve_visits_each_cell_next_to_the_last():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        x = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = packing.hilbert_keys(x, bits)
        assert sorted(keys) == list(range(len(x)))
        assert (np.abs(np.diff(x[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("length", [4096, 64])
def test_pieces_give_back_every_document(docs, rows, length):
    pieces = packing.pack(docs, length=length).collect()
    by_place, whole = sorted((p.sequence_id, p.offset, p) for p in pieces), defaultdict(list)
    row, begun = [], {}
    for s, o, p in by_place:
        assert s * length + o == len(row) and o + p.length <= length and len(p.ids) == 4 * p.length
        begun.setdefault((p.doc_id, s * length + o - p.start), []).append(p)
        row += np.frombuffer(p.ids, "<u4").tolist()
    for (doc_id, at), own in begun.items():
        n = own[0].doc_tokens
        assert sum(p.length for p in own) == n and row[at + n - 1] == 2
        whole[doc_id].append(tuple(row[at : at + n - 1]))
    want = defaultdict(list)
    for (d, *_), ids in zip(rows, plain([r[1] or "" for r in rows])):
        want[d].append(tuple(ids))
    assert {k: Counter(v) for k, v in whole.items()} == {k: Counter(v) for k, v in want.items()}


def test_query_and_empty_table(spark, rows, none, tmp_path):
    assert packing.pack(none).count() == 0
    spark.createDataFrame(rows, none.schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op10_packing(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = dict(zip([r[0] for r in rows], plain([r[1] or "" for r in rows])))
    for p in out.collect():
        if p.doc_id not in (3, None):
            part = [*ids[p.doc_id], 2][p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())


def test_windows_follow_the_given_order(spark, rows, none):
    numbered = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, text string").withColumn("mix", -packing.F.col("doc_id"))
    place = {p.doc_id: p.sequence_id * 4096 + p.offset for p in packing.pack(numbered, window=2000, along=("mix",)).collect() if p.start == 0}
    n = [len(x) + 1 for x in plain([r[1] or "" for r in rows])]
    window = {i: sum(n[i + 1 :]) // 2000 for i in range(len(n))}
    order = sorted(place, key=place.get)
    assert [window[i] for i in order] == sorted(window.values()) and len(set(window.values())) > 3
