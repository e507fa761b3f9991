import random
from collections import Counter

import xxhash
from quillon.llm import simhash


def roots(nodes, near):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def expect(pairs):
    root = roots({f for _, f in pairs}, lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for d, f in pairs:
        if d is not None:
            first[root[f]] = min(d, first.get(root[f], d))
    return Counter((d, f"{f:016x}", first.get(root[f])) for d, f in pairs)


def test_rows_against_brute_force(docs, rows):
    got = Counter(tuple(r) for r in simhash.simhash_groups(docs).collect())
    assert got == expect([(r[0], plain(r[1])) for r in rows])


def test_hashes_as_the_engine_does(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("a b é".encode(), 42)


def test_links_are_complete_in_hot_and_cool_cells(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(signed, "first_id long, fp long")
    want = roots([f for _, f in signed], lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    from quillon.llm.graph import components

    for limit in (2, 5, 64):
        got = {r.node: r.root for r in components(simhash.links(df, cell_limit=limit)).collect()}
        assert {f: got.get(f, f) for f in want} == want


def test_keeps_one_row_of_each_group(docs, rows, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = expect([(r[0], plain(r[1])) for r in rows])
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in want if c is not None})
    assert ids.count(None) == sum(r[0] is None for r in rows)
    assert simhash.simhash_groups(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_one_doc_id_with_several_texts(spark):
    a, b, c = ("the %s word one two three four five six seven" % x for x in ("red", "blue", "green"))
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "y"), (2, b, "x"), (3, c, "x"), (None, c, "x"), (4, c, "x")]
    assert len({plain(t) for _, t, _ in rows}) == 3
    kept = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert sorted((d or 0, t) for d, t, _ in kept) == sorted([(1, a), (1, b), (3, c), (0, c)])


def test_rounds_leave_one_table(spark, tmp_path):
    from quillon import shared
    from quillon.llm.graph import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)], "src long, dst long")
    made = []
    with shared.scope(spark):
        got = {r.node: r.root for r in components(edges).collect()}
        made += shared._OPEN.get()[-1]
        fs = spark._jvm.org.apache.hadoop.fs.Path(made[0]).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        there = lambda: sum(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x)) for x in made)
        assert len(made) > 2 and there() == 1
    assert there() == 0
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert components(edges.filter("false")).count() == 0
