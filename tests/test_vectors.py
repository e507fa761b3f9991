import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillon.functions import vectors
from quillon.operators import blocks, cluster, knn, quantize
from quillon.plans import evaluate, session
from quillon.plans.index import STATUS, build_index, load_index, training_rows
from quillon.sources import vectors as source

SCHEMA = "id bigint, vec array<float>, region string"
RNG = random.Random(4)
ROWS = [(i * 3 - 30, [float(np.float32(RNG.gauss(0, 1))) for _ in range(16)], RNG.choice(["US", "EU"])) for i in range(120)]
ROWS += [(1000, ROWS[5][1], "US"), (1001, ROWS[5][1], "EU")]
BAD = [(None, ROWS[0][1], "US"), (2000, None, "US"), (2001, [1.0] * 15, "US"), (2002, [float("nan")] * 16, "US"), (2003, [float("inf")] * 16, "EU"), (2004, [], "EU")]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(ROWS + BAD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def index(base):
    out = build_index(base, "t", 5, subspaces=4, codewords=32)
    out.entries = out.entries.cache()
    return out


def exact(q, k, rows=ROWS):
    d = [(sum((np.float64(np.float32(a)) - np.float64(np.float32(b))) ** 2 for a, b in zip(v, q)), i) for i, v, _ in rows]
    return [(i, s) for s, i in sorted(d)[:k]]


def same(got, want):
    assert [r.id for r in got] == [i for i, _ in want]
    assert all(math.isclose(r.score, s, rel_tol=1e-6, abs_tol=1e-9) for r, (_, s) in zip(got, want))


def test_distances_by_hand(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [0.0, 2.0, 1.0, 0.0], [1.0])], "a array<float>, b array<float>, c array<float>")
    r = df.select(
        vectors.squared_l2(F.col("a"), F.col("b")), vectors.l2(F.col("a"), F.col("b")), vectors.guarded_squared_l2(F.col("a"), F.col("c")),
        vectors.subvector(F.col("a"), 1, 2), vectors.slice_squared_l2(F.col("a"), F.array(F.lit(0.0), F.lit(0.0)), 1, 2), vectors.flattened(F.array("a", "c")),
    ).first()
    assert tuple(r) == (21.0, math.sqrt(21), math.inf, [3.0, 4.0], 25.0, [1.0, 2.0, 3.0, 4.0, 1.0])


def test_ratios(spark):
    r = spark.range(1).select(vectors.recall(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(9))), vectors.recall(F.array().cast("array<int>"), F.array(F.lit(2))), vectors.compression_ratio(F.lit(10), 128, F.lit(160)), vectors.speed_up(F.lit(2.0), F.lit(0.5)), vectors.speed_up(F.lit(2.0), F.lit(0.0))).first()
    assert tuple(r) == (0.5, None, 32.0, 4.0, math.inf)


def test_exact_search(base):
    q = ROWS[5][1]
    same(knn.exact_knn(base, q, 7).collect(), exact(q, 7))
    assert knn.exact_knn(base, q, 0).count() == 0 and knn.exact_knn(base, q, 10_000).count() == len(ROWS)
    for bad in ([], [math.nan] * 16, [math.inf] * 16):
        with pytest.raises(ValueError):
            knn.exact_knn(base, bad, 3)
    with pytest.raises(ValueError):
        knn.exact_knn(base, q, -1)


def test_restrictions_come_before_the_top_k(base):
    q = ROWS[9][1]
    us = [r for r in ROWS if r[2] == "US"]
    same(knn.exact_knn(base, q, 5, where="s.region = 'US'").collect(), exact(q, 5, us))
    same(knn.exact_knn(base, q, 5, where=F.col("region") == "US", allowed=[r[0] for r in ROWS[:40]]).collect(), exact(q, 5, [r for r in ROWS[:40] if r[2] == "US"]))
    assert knn.exact_knn(base, q, 5, allowed=[]).count() == 0
    after = knn.exact_knn(base, q, 5).join(base.filter("region = 'US'").select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_semi")
    assert after.count() < 5
    many = [*range(5000, 7000), *(r[0] for r in ROWS[:20])]
    same(knn.exact_knn(base, q, 3, allowed=many).collect(), exact(q, 3, ROWS[:20]))
    with pytest.raises(Exception):
        knn.exact_knn(base, q, 5, where="nothing ~ here").collect()


def test_batch_search(base, monkeypatch):
    asked = [(i, ROWS[i][1]) for i in range(9)]
    monkeypatch.setattr(knn, "QUERY_BLOCK", 4)
    got = knn.exact_knn_batch(base, asked, 6).orderBy("query_id", "rank").collect()
    for i, q in asked:
        same([r for r in got if r.query_id == i], exact(q, 6))
    assert knn.exact_knn_batch(base, [], 5).count() == 0 and knn.exact_knn_batch(base, asked, 0).count() == 0
    from_table = base.filter("id IN (-30, -27)").select("id", "vec")
    assert {r.query_id for r in knn.exact_knn_batch(base, from_table, 2).collect()} == {-30, -27}


def test_nearest_takes_the_first_of_equals():
    rng = np.random.default_rng(0)
    points = rng.integers(-2, 3, (30, 4)).astype(float)
    rows = rng.integers(-2, 3, (500, 4)).astype(float)
    assert (blocks.nearest(rows, points, 64) == blocks.distances(rows, points).argmin(axis=1)).all()


def test_clusters(base):
    good = base.filter(vectors.usable(F.col("vec"), 16) & F.col("id").isNotNull())
    centroids = cluster.train_centroids(good, 6)
    assert centroids.count() == 6
    points = cluster.centroid_array(centroids)
    fast = {tuple(r) for r in cluster.assigned(good, points).collect()}
    assert fast == {tuple(r) for r in cluster.assigned_in_columns(good, centroids).collect()}
    lists = cluster.postings(cluster.assigned(good, points)).collect()
    assert sorted(i for r in lists for i in r.ids) == sorted(r[0] for r in ROWS) and all(r.ids == sorted(r.ids) for r in lists)
    ranked = cluster.ranked(points, ROWS[0][1])
    assert [d for _, d in ranked] == sorted(d for _, d in ranked) and cluster.probed(points, ROWS[0][1], 2) == [i for i, _ in ranked[:2]]
    assert cluster.train_centroids(good.limit(3), 10).count() == 3 and cluster.train_centroids(good.limit(1), 4).count() == 1
    with pytest.raises(ValueError):
        cluster.train_centroids(good.filter("false"), 2)
    with pytest.raises(ValueError):
        cluster.probed(points, ROWS[0][1], -1)


def plain_lloyd(rows, points, rounds, single=False):
    """Lloyd rounds one vector at a time, with means in double (or kept in single precision after each round)."""
    points = [list(p) for p in points]
    for _ in range(rounds):
        members = [[] for _ in points]
        for v in rows:
            members[min(range(len(points)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(v, points[k])), k))].append(v)
        for k, own in enumerate(members):
            if own:
                points[k] = [sum(c) / len(own) for c in zip(*own)]
                if single:
                    points[k] = [float(np.float32(x)) for x in points[k]]
    return points


def test_centroids_by_brute_force_and_against_spark_ml(spark, base):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    good = base.filter(vectors.usable(F.col("vec"), 16) & F.col("id").isNotNull())
    x = np.array([v for _, v, _ in ROWS])
    cost = lambda c: blocks.distances(x, c).min(axis=1).sum()
    ours = cluster.centroid_array(cluster.train_centroids(good, 6))
    assert (ours == cluster.centroid_array(cluster.train_centroids(good.repartition(7), 6))).all()
    start = cluster.kmeans(x, 6, 42, 0)
    assert np.allclose(ours, plain_lloyd(x.tolist(), start.tolist(), 20), atol=1e-6)
    theirs = np.array(KMeans(k=6, seed=42, maxIter=20, featuresCol="v").fit(good.select(array_to_vector("vec").alias("v"))).clusterCenters())
    assert cost(ours) < 1.1 * cost(theirs) and cluster.train_centroids(good.limit(1), 4).count() == 1


def test_codebooks_by_brute_force(base):
    good = base.filter(vectors.usable(F.col("vec"), 16) & F.col("id").isNotNull())
    book = quantize.book_array(quantize.train_codebooks(good, 16, 4, 16))
    rows = [v for _, v, _ in sorted(ROWS)]
    for m in range(4):
        part = [v[4 * m : 4 * m + 4] for v in rows]
        assert np.allclose(book[m], plain_lloyd(part, part[:16], 15, single=True), atol=1e-5)


def test_codebooks_don_t_depend_on_partitions(base):
    good = base.filter(vectors.usable(F.col("vec"), 16) & F.col("id").isNotNull())
    books = [quantize.book_array(quantize.train_codebooks(good.repartition(n), 16, 4, 16, 5)) for n in (1, 7)]
    assert (books[0] == books[1]).all() and books[0].shape == (4, 16, 4)
    few = quantize.book_array(quantize.train_codebooks(good.filter("id < -20"), 16, 4, 16, 5))
    assert (few[:, 4:] == 0).all()
    with pytest.raises(ValueError):
        quantize.train_codebooks(good, 16, 5)


def test_codes_and_lookups(base, spark):
    good = base.filter(vectors.usable(F.col("vec"), 16) & F.col("id").isNotNull())
    book = quantize.book_array(quantize.train_codebooks(good, 16, 4, 16, 5))
    codes = {r.id: r.code for r in quantize.encode(good, book).collect()}
    words = F.from_json(F.lit(str(book[2].tolist())), "array<array<float>>")
    column = good.select("id", quantize.nearest_codeword(F.col("vec"), 2, words, 4).alias("k")).collect()
    assert all(codes[r.id][2] == r.k for r in column)
    again = spark.createDataFrame([(k, [float(x) for m in range(4) for x in book[m, k]]) for k in range(16)], "id bigint, vec array<float>")
    for r in quantize.encode(again, book).collect():
        assert all((book[m, c] == book[m, r.id]).all() for m, c in enumerate(r.code))
    table = quantize.query_table(book, ROWS[0][1])
    got = quantize.encode(good, book).select("id", quantize.lookup_distance(F.col("code"), table).alias("d")).collect()
    assert all(math.isclose(r.d, sum(table[m][c] for m, c in enumerate(codes[r.id])), rel_tol=1e-12) for r in got)
    assert spark.range(1).select(quantize.lookup_distance(F.array(F.lit(99), F.lit(0), F.lit(0), F.lit(0)), table)).first()[0] is None


def test_index_search(index):
    q = ROWS[5][1]
    assert index.entries.count() == len(ROWS)
    same(index.search(q, 10).collect(), exact(q, 10))
    assert dict(index.search(q, 3).dtypes) == {"id": "bigint", "score": "float"}
    assert index.search(q, 500).count() == len(ROWS) and index.search(q, 500, rerank=20).count() == 20
    us = [r for r in ROWS if r[2] == "US"]
    same(index.query(q).where("region = 'US'").ids([r[0] for r in ROWS[:60]]).topk(4).collect(), exact(q, 4, [r for r in ROWS[:60] if r[2] == "US"]))
    same(index.search(q, 4, where="s.region = 'US'").collect(), exact(q, 4, us))
    assert index.search(q, 4, allowed_ids=[]).count() == 0
    assert index.search(q, 4, 0, probe_mode="limit").count() == 0
    few = index.query(q).probe(1).candidates().count()
    assert 0 < few < len(ROWS) and index.query(q).probe(5).candidates().count() == len(ROWS)
    for call in (lambda: index.search(q, -1), lambda: index.search(q, 1, -1), lambda: index.search(q[:3], 1), lambda: index.search(q, 1, probe_mode="x")):
        with pytest.raises(ValueError):
            call()


def test_batch_index_search_and_recall(index):
    asked = [(i, ROWS[i][1]) for i in range(0, 100, 7)]
    got = index.search_batch(asked, 10).collect()
    hits = sum(len({r.id for r in got if r.query_id == i} & {x for x, _ in exact(q, 10)}) for i, q in asked)
    assert hits / (10 * len(asked)) >= 0.9
    for i, q in asked:
        own = sorted((r.rank, r.score) for r in got if r.query_id == i)
        assert [s for _, s in own] == sorted(s for _, s in own) and len(own) == 10
    assert index.search_batch([], 3).count() == 0


def test_entry_without_code(index):
    other = build_index(index.base, "u", 5, subspaces=4, codewords=32, centroids=index.centroids, codebooks=index.codebooks)
    other.entries = other.entries.withColumn("code", F.when(F.col("id") != 1000, F.col("code")))
    q = ROWS[5][1]
    got = {r.id: r.approximate for r in other.query(q).exact_without_code().candidates().collect()}
    assert got[1000] == 0.0 and len(got) == len(ROWS)
    assert {r.id: r.approximate for r in other.query(q).candidates().collect()}[1000] is None


def test_save_load_and_rebuild(spark, base, index, tmp_path):
    q = ROWS[3][1]
    for _ in range(2):
        index.save(f"{tmp_path}/x")
    back = load_index(spark, f"{tmp_path}/x", base)
    assert back.settings == index.settings and back.entries.count() == len(ROWS)
    same(back.search(q, 5).collect(), exact(q, 5))
    later = back.base.filter("id <> 1000")
    back.base = later
    assert 1000 not in {r.id for r in back.search(ROWS[5][1], 3, current=True).collect()}
    assert 1000 in {r.id for r in back.search(ROWS[5][1], 3).collect()}  # of the snapshot


def test_by_name_and_in_sql(spark, base, index, tmp_path):
    spark.conf.set(session.FOLDER, f"file://{tmp_path}/named")
    base.filter("id IS NOT NULL").write.parquet(f"{tmp_path}/base")
    try:
        assert session.create_index(spark, "mine", f"{tmp_path}/base", "vec", 5, subspaces=4, codewords=32) == STATUS
        same(session.ann_search(spark, "mine", ROWS[5][1], 5, 3).collect(), exact(ROWS[5][1], 5))
        assert [tuple(r)[:3] for r in session.list_indexes(spark).collect()] == [("mine", f"{tmp_path}/base", "vec")]
        with pytest.raises(ValueError):
            session.ann_search(spark, "nowhere", ROWS[5][1], 5)
        assert session.ann_search(spark, "nowhere", ROWS[5][1], 5, lenient=True).count() == 0
        assert {"centroids", "codebooks", "entries", "metadata"} <= {r.name for r in source.table_sizes(spark, f"{tmp_path}/named/mine").collect()}
    finally:
        spark.conf.unset(session.FOLDER)
    for _ in range(2):
        session.register_search(spark, index, "find")
    q = ", ".join(f"CAST({x!r} AS FLOAT)" for x in ROWS[5][1])
    same(spark.sql(f"SELECT * FROM find(array({q}), 6) ORDER BY score, id").collect(), exact(ROWS[5][1], 6))
    assert spark.sql(f"SELECT * FROM find(array({q}), 6) WHERE id = 1000").count() == 1


def test_build_refuses(spark, base):
    with pytest.raises(ValueError):
        build_index(base.filter("false"), "e", 2)
    with pytest.raises(ValueError):
        build_index(base, "e", 2, subspaces=5)
    with pytest.raises(ValueError):
        build_index(base.unionByName(base), "e", 2, subspaces=4, validate=True)
    assert training_rows(base, "id", 0.1).count() == base.count()
    assert training_rows(base, "id", 0.1, least=10, most=20).count() < 60


def test_fvecs(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(20, 8)).astype("<f4")
    for n, part in (("a", x[:13]), ("b", x[13:]), ("c", x[:0])):
        (tmp_path / f"{n}.fvecs").write_bytes(b"".join(np.int32(8).tobytes() + r.tobytes() for r in part))
    got = sorted((r.id, r.vec) for r in source.read_fvecs(spark, f"{tmp_path}/*.fvecs", 8).collect())
    assert [i for i, _ in got] == list(range(20)) and np.array_equal(np.array([v for _, v in got], "<f4"), x)
    source.write_vectors(source.read_fvecs(spark, f"{tmp_path}/*.fvecs"), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
    (tmp_path / "a.fvecs").write_bytes(b"\x08\0\0\0abc")
    with pytest.raises(Exception):
        source.read_fvecs(spark, f"{tmp_path}/a.fvecs").collect()


def test_samples(spark):
    df = spark.range(20_000)
    some = source.bernoulli_sample(df, 10, "id")
    assert 1800 < some.count() < 2200 and {r.id for r in some.collect()} == {r.id for r in source.bernoulli_sample(df.repartition(7), 10, "id").collect()}
    assert source.bernoulli_or_all(df.filter("id = 1"), 0.0, "id").count() == 1
    assert source.reservoir_sample(df, 50, "id").count() == 50


def test_samples_of_ids_of_any_size(spark):
    for first in (0, 1 << 40, -(1 << 40), (1 << 63) - 20_001, -(1 << 63)):
        df = spark.range(20_000).selectExpr(f"CAST(id + CAST('{first}' AS DECIMAL(38, 0)) AS LONG) AS id")
        got = {r.id for r in source.bernoulli_sample(df, 10, "id").collect()}
        assert got == {i for i in range(first, first + 20_000) if (i % (1 << 32)) * source.SPREAD % (1 << 32) < int((1 << 32) / 10)}
        assert source.reservoir_sample(df, 50, "id", seed=-7).count() == 50


def test_filters_over_kept_columns_need_no_base(spark, base):
    kept = build_index(base, "k", 5, subspaces=4, codewords=32, keep=["region"]).cached()
    q, us = ROWS[5][1], [r for r in ROWS if r[2] == "US"]
    kept.base = base.filter("false")
    same(kept.search(q, 4, where="s.region = 'US' AND id < 2000").collect(), exact(q, 4, us))
    assert kept.query(q).where("region = 'US'").candidates().count() == len(us)
    with pytest.raises(Exception):
        kept.search(q, 4, where="nothing = 1").collect()


def test_batches_with_filters_and_probes(index, monkeypatch):
    import quillon.plans.index as plans

    monkeypatch.setattr(plans, "LOOKUP_BLOCK", 4)
    asked = [(i, ROWS[i][1]) for i in range(0, 100, 9)]
    us = [r for r in ROWS if r[2] == "US"]
    got = index.search_batch(asked, 5, where="region = 'US'").collect()
    for i, q in asked:
        same(sorted((r for r in got if r.query_id == i), key=lambda r: r.rank), exact(q, 5, us))
    got = index.search_batch(asked, 5, nprobe=2, probe_mode="limit", allowed_ids=[r[0] for r in ROWS[:80]]).collect()
    for i, q in asked:
        one = index.search(q, 5, 2, allowed_ids=[r[0] for r in ROWS[:80]], probe_mode="limit").collect()
        own = sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)
        assert [r.id for r in own] == [r.id for r in one]
    assert index.search_batch(asked, 5, nprobe=0, probe_mode="limit").count() == 0
    short = index.search_batch(asked[:3], 3, rerank=10).collect()
    for i, q in asked[:3]:
        assert [r.id for r in sorted((r for r in short if r.query_id == i), key=lambda r: r.rank)] == [r.id for r in index.search(q, 3, rerank=10).collect()]


def test_search_plans_leave_the_base_alone(spark, index, tmp_path):
    index.save(f"{tmp_path}/x")
    back = load_index(spark, f"{tmp_path}/x", spark.range(3).withColumn("vec", F.array(F.lit(1.0))))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (back.search(ROWS[0][1], 3), back.search(ROWS[0][1], 3, 2, probe_mode="limit"), back.search_batch([(1, ROWS[0][1])], 3)):
        assert "Range" not in plan(df) and "Join" not in plan(df) and plan(df).count("FileScan parquet") == 1
    limited = plan(back.search(ROWS[0][1], 3, 2, probe_mode="limit"))
    assert "PushedFilters: [" in limited and "GreaterThanOrEqual(cluster_id" in limited.split("PushedFilters: [")[1].split("]")[0] and "Exchange hashpartitioning" not in limited


def test_sql_surface(spark, base, tmp_path):
    spark.conf.set(session.FOLDER, f"file://{tmp_path}/named")
    base.filter("id IS NOT NULL").write.parquet(f"{tmp_path}/base")
    spark.read.parquet(f"{tmp_path}/base").createOrReplaceTempView("items")
    q = ", ".join(f"CAST({x!r} AS FLOAT)" for x in ROWS[5][1])
    us = [r for r in ROWS if r[2] == "US"]
    find = lambda rest: session.sql(spark, f"SELECT id, score FROM {rest} ORDER BY score, id").collect()
    try:
        assert session.sql(spark, "SELECT create_ivf_index('one', 'items', 'vec', 5, subspaces => 4, codewords => 32) AS done").first().done == STATUS
        same(find(f"ann_search('one', array({q}), 5, 8)"), exact(ROWS[5][1], 5))
        same(find("ann_search('one', (SELECT vec FROM items WHERE id = -15), 5, 8, where_clause => \"s.region = 'US'\")"), exact(ROWS[5][1], 5, us))
        same(find(f"ann_search('one', array({q}), 4, 8, allowed_ids => array(0, 3, 6, 9, 1000, 1001))"), exact(ROWS[5][1], 4, [r for r in ROWS if r[0] in (0, 3, 6, 9, 1000, 1001)]))
        same(find(f"ann_search('one', array({q}), 4, 8) WHERE id IN (0, 3, 6, 9)"), exact(ROWS[5][1], 4, [r for r in ROWS if r[0] in (0, 3, 6, 9)]))
        same(find(f"ann_search('one', array({q}), 4, 8) AS f WHERE f.id > 100 AND score < 1000"), exact(ROWS[5][1], 4, [r for r in ROWS if r[0] > 100]))
        near = exact(ROWS[5][1], 4)
        same(find(f"ann_search('one', array({q}), 4, 8) WHERE score > 0.001"), [x for x in near if x[1] > 0.001])
        joined = session.sql(spark, f"/* ann_search('x') */ WITH f AS (SELECT * FROM ann_search('one', array({q}), 6, 8)) SELECT f.id, region, 'ann_search(1)' AS t FROM f JOIN items i ON f.id = i.id").collect()
        assert {(r.id, r.region) for r in joined} == {(i, dict((a, c) for a, _, c in ROWS)[i]) for i, _ in exact(ROWS[5][1], 6)}
        assert len(find(f"ann_search('one', array({q}), 500, 8, rerank => 20)")) == 20
        assert find(f"ann_search('one', array({q}), 5, 0, probe_mode => 'limit')") == []
        for bad in ("ann_search('two', array(1.0F), 5, 8)", f"ann_search('one', array({q}), 5, -1)", f"ann_search('one', array({q}), -5, 1)", "ann_search('one', array(1.0F), 5, 8)", f"ann_search('one', array({q}), 5, 8, 9)"):
            with pytest.raises(ValueError):
                find(bad)
        assert session.sql(spark, "SELECT count(*) AS n FROM items").first().n > 100
    finally:
        spark.conf.unset(session.FOLDER)


def test_temporary_folders_only_in_local_mode():
    from types import SimpleNamespace

    from quillon import shared

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            shared.temporary(SimpleNamespace(sparkContext=SimpleNamespace(master=master)), "x", "spark.checkpoint.dir")


def test_streamed_vectors_get_the_batch_codes(spark, base, index, tmp_path):
    from quillon.streaming.encode import append_stream

    base.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(base.schema).parquet(f"{tmp_path}/in")
    append_stream(index, stream, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination(120)
    key = lambda rows: sorted((r.cluster_id, r.id, tuple(r.code)) for r in rows)
    assert key(spark.read.parquet(f"{tmp_path}/out/streamed").collect()) == key(index.entries.collect())
    few = build_index(base.filter("id < 1000"), "few", 5, subspaces=4, codewords=32)
    few.save(f"{tmp_path}/few")
    late = spark.readStream.schema(base.schema).parquet(f"{tmp_path}/in").filter("id >= 1000")
    append_stream(few, late, f"{tmp_path}/few", f"{tmp_path}/log2").awaitTermination(120)
    same(load_index(spark, f"{tmp_path}/few", base).search(ROWS[5][1], 4).collect(), exact(ROWS[5][1], 4))
    load_index(spark, f"{tmp_path}/few", base).save(f"{tmp_path}/again")
    assert load_index(spark, f"{tmp_path}/again", base).entries.count() == len(ROWS)


def test_evaluation(index):
    queries = [ROWS[i][1] for i in (0, 8)]
    rows = evaluate.study(index, queries, (1, 5), (1, 5)).collect()
    assert [(r.k, r.nprobe) for r in rows] == [(1, 1), (1, 5), (5, 1), (5, 5)] and all(r.avg_exact_ms > 0 and 0 <= r.recall <= 1 for r in rows)
    assert [r.recall for r in rows if r.nprobe == 5] == [1.0, 1.0]
    assert [r.recall for r in evaluate.batch_recall(index, list(enumerate(queries)), 5).collect()] == [1.0, 1.0]
    found = evaluate.filter_study(index, queries[0], ["region = 'US'", "region = 'nowhere'"]).collect()
    assert [r.result_count for r in found] == [10, 0] and all(r.speed_up > 0 for r in found)
    assert tuple(evaluate.code_compression(index).first()) == (len(ROWS), 4 * len(ROWS), 16.0)


def test_complete_batches_miss_nothing_that_a_shortlist_does(base, index, monkeypatch):
    """One entry re-ranked a query isn't enough for five; a complete search finds all, over several blocks of queries, with entries
    that have no code, and within the probed clusters alone."""
    asked = [(i, [x + 0.3 for x in ROWS[i][1]]) for i in range(12)]
    assert index.search_batch(asked, 5, 1).count() == 12
    monkeypatch.setattr("quillon.plans.index.LOOKUP_BLOCK", 5)
    stripped = load_like(index, index.entries.withColumn("code", F.when(F.col("id") % 2 == 0, F.col("code"))).withColumn("off", F.when(F.col("id") % 3 != 0, F.col("off"))))
    at = {r.id: r.cluster_id for r in index.entries.select("id", "cluster_id").collect()}
    for one in (index, stripped):
        for limit in (None, 2):
            got = one.search_batch(asked, 5, 1, limit, probe_mode="limit" if limit else "exhaustive", complete=True).orderBy("query_id", "rank").collect()
            for i, q in asked:
                q = [float(np.float32(x)) for x in q]
                rows = [r for r in ROWS if limit is None or at[r[0]] in cluster.probed(index.points, q, limit)]
                same([r for r in got if r.query_id == i], exact(q, 5, rows))


def test_a_complete_search_with_restrictions_misses_nothing(index):
    q = [float(np.float32(x + 0.3)) for x in ROWS[9][1]]
    some = [r for r in ROWS[:80] if r[2] == "US"]
    search = index.query(q).where("region = 'US'").ids([r[0] for r in ROWS[:80]]).rerank(2)
    assert search.nearest(6).count() == 2
    same(search.complete().nearest(6).collect(), exact(q, 6, some))
    assert search.complete().nearest(0).count() == 0 and search.complete().nearest(1000).count() == len(some)
    at = {r.id: r.cluster_id for r in index.entries.select("id", "cluster_id").collect()}
    near = cluster.probed(index.points, q, 2)
    same(search.probe(2).complete().nearest(6).collect(), exact(q, 6, [r for r in some if at[r[0]] in near]))
    with pytest.raises(ValueError):
        search.current().complete().nearest(3)


def test_a_complete_search_finds_copies_of_one_code(spark):
    """Many rows with one code fill a shortlist by their ids; the nearest of them has the greatest id."""
    rows = [(i, [1.0 + (200 - i) / 1000, 0.0, 0.0, 0.0], "US") for i in range(200)] + [(200, [-9.0, 4.0, 4.0, 4.0], "US")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    book = spark.createDataFrame([(m, k, [float(k * 5)] * 2) for m in range(2) for k in range(2)], "m int, k int, values array<float>")
    search = build_index(df, "copies", 2, subspaces=2, codewords=2, codebooks=book).query([1.0, 0.0, 0.0, 0.0]).rerank(50)
    assert [r.id for r in search.nearest(3).collect()] == [49, 48, 47]
    assert [r.id for r in search.complete().nearest(3).collect()] == [199, 198, 197]


def test_a_complete_search_in_sql_misses_nothing(spark, index):
    q = [float(np.float32(x + 0.3)) for x in ROWS[9][1]]
    call = f"SELECT * FROM near_by(array({', '.join(f'CAST({x!r} AS FLOAT)' for x in q)}), %d) ORDER BY score, id"
    stripped = load_like(index, index.entries.withColumn("code", F.when(F.col("id") % 2 == 0, F.col("code"))))
    session.register_search(spark, index, "near_by", rerank=2)
    assert len(spark.sql(call % 6).collect()) == 2
    for one in (index, stripped):
        for rerank in (8, 2, 0):
            session.register_search(spark, one, "near_by", rerank=rerank, complete=True)
            same(spark.sql(call % 6).collect(), exact(q, 6))
            assert not spark.sql(call % 0).collect()


def test_a_complete_search_of_a_saved_index_misses_nothing(spark, base, index, tmp_path, monkeypatch):
    """Whether the entries within reach are few or many, the shortlist smaller than k, or the index one that was saved without `off`."""
    index.save(f"file://{tmp_path}/new")
    load_like(index, index.entries.drop("off")).save(f"file://{tmp_path}/old")
    q = [float(np.float32(x + 0.3)) for x in ROWS[9][1]]
    for name in ("new", "old"):
        saved = load_index(spark, f"file://{tmp_path}/{name}", base)
        assert saved.search(q, 6, rerank=2).count() == 2
        for most, rerank in ((1000, 8), (20, 8), (1000, 2), (1000, 0)):
            monkeypatch.setattr("quillon.plans.index.IN_LIST", most)
            same(saved.search(q, 6, rerank=rerank, complete=True).collect(), exact(q, 6))
            same(saved.search(q, 6, where="region = 'EU'", rerank=rerank, complete=True).collect(), exact(q, 6, [r for r in ROWS if r[2] == "EU"]))
        assert saved.search(q, 0, complete=True).count() == 0 and saved.search(q, 1000, complete=True).count() == len(ROWS)
    with pytest.raises(ValueError):
        saved.search(q, 3, current=True, complete=True)


def load_like(index, entries):
    return type(index)(index.settings, index.base, index.centroids, index.codebooks, entries)


def test_least_distances_are_never_above_the_distance():
    rng = np.random.default_rng(3)
    x, book, q = rng.normal(size=(400, 8)).astype(np.float32).astype(float), rng.normal(size=(2, 5, 4)), rng.normal(size=(7, 8))
    x[:5], q[0] = quantize.decoded(np.arange(5)[:, None].repeat(2, 1), book), x[9]
    code = quantize.codes_of(x, book)
    tables = np.stack([quantize.query_table(book, v) for v in q], axis=2)
    found = tables[0][code[:, 0]] + tables[1][code[:, 1]]
    low = quantize.least_distances(found, np.sqrt(blocks.pair_distances(x, quantize.decoded(code, book))))
    d = blocks.distances(x, q)
    assert (low <= d).all() and (low[5:] > 0.1 * d[5:]).any()
    assert (quantize.least_distances(np.array([[np.nan], [4.0]]), np.array([1.0, np.nan])) == 0).all()
