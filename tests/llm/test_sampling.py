import hashlib
from collections import Counter

import numpy as np
from quillon.llm import queries, sampling


def bag(text):
    return Counter((text or "").encode().lower().split()) or Counter([b""])


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def test_collisions_follow_generalised_jaccard():
    rng = np.random.default_rng(3)
    texts = [b" ".join(b"w%d" % k for k in rng.zipf(1.3, 400) % (200 + 40 * (i % 3))) for i in range(40)]
    prints = sampling.sketches(texts, 8192)
    off = [sampling.likeness(prints[i], prints[j]) - jaccard(bag(texts[i].decode()), bag(texts[j].decode())) for i in range(40) for j in range(i)]
    assert abs(np.mean(off)) < 0.01 and np.abs(off).max() < 0.03


def test_integer_weights_are_consistent():
    """A part of a document never gets a smaller least value, and texts alone or together have the same fingerprint."""
    a = b"a a a b c c d d d d d e"
    of = sampling.variates(np.arange(5, dtype=np.uint64))
    whole = sampling.least(of, np.arange(5), np.array([3, 1, 2, 5, 1]))
    part = sampling.least(of, np.arange(5), np.array([1, 1, 2, 4, 1]))
    assert (part >= whole).all() and (part == whole).any()
    assert (sampling.sketches([a])[0] == sampling.sketches([b"x y z " * 50, a, b""])[1]).all()


def test_chunks_and_shared_words_give_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [b" ".join(b"v%d" % k for k in rng.integers(0, 500, 800)) for _ in range(4)]
    want = sampling.sketches(texts)
    monkeypatch.setattr(sampling, "CHUNK", 7)
    assert all((x == y).all() for x, y in zip(want, sampling.sketches(texts)))


def brute(rows):
    import xxhash

    signed = lambda t: (h := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (1 << 64) * (h >> 63)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    one = {t: sampling.sketches([t.encode()])[0] for t in {r[1] or "" for r in rows}}
    want = Counter()
    for r, n in zip(order, [*order[1:], order[0]]):
        e = sampling.edited(r[1] or "", n[1] or "")
        a, b = one[r[1] or ""], sampling.sketches([e.encode()])[0]
        want[r[0], len(r[1] or ""), hashlib.sha256(e.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), sampling.likeness(a, b), sampling.likeness(a, one[n[1] or ""])] += 1
    return want


def test_query_against_brute_force(spark, rows, none, tmp_path):
    spark.createDataFrame(rows, none.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_sampling(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)
    plain = {(r.doc_id, r.fingerprint) for r in sampling.fingerprinted(spark.createDataFrame(rows, none.schema)).collect()}
    assert plain == {(r.doc_id, r.fingerprint) for r in got}
    assert (sampling.decoded(got[0].fingerprint) >= 0).all()


def test_most_rows_without_doc_id(spark, none, tmp_path):
    rows = [(i if i % 3 == 0 else None, f"text {i} of some words {i % 5}", "en", "s", 0) for i in range(90)] + [(None, None, None, None, None)] * 3
    spark.createDataFrame(rows, none.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(tuple(r) for r in queries.op2_sampling(spark, str(tmp_path)).collect()) == brute(rows)


def test_one_row_and_none(spark, none):
    assert sampling.with_next(none).count() == 0
    one = sampling.with_next(spark.createDataFrame([(5, "a b c d e f", "en", "s", 0)], none.schema)).collect()
    assert [(r.doc_id, r.edited, r.near_next) for r in one] == [(5, "a b c d a b", 1.0)]
