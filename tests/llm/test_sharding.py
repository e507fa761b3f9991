from collections import Counter

import pytest
from quillon.llm import sharding


def test_every_row_is_in_one_live_shard(docs, rows, none):
    params = {"arrivals": 9, "fanout": 3, "target_bytes": 20_000, "least_bytes": 1000}
    got = sharding.shard_of_documents(docs, **params).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((r[0], len(r[1] or "")) for r in rows)
    assert {r.tier for r in got} - {0} and len({r.version for r in got}) == 1
    assert sharding.shard_of_documents(none).count() == 0


def test_merges_leave_few_runs_and_no_old_folder(spark, docs, rows, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", fanout=2, target_bytes=1 << 20, least_bytes=1 << 20)
    for k in range(5):
        store.append(docs.filter(f"pmod(coalesce(doc_id, 0), 5) = {k}"))
        assert len(Counter(r["tier"] for r in store.manifest())) == len(store.manifest())
    assert sorted(r["tier"] for r in store.manifest()) == [0, 2]
    assert Counter(r.text for r in store.read().collect()) == Counter(r[1] for r in rows)
    assert store.read().columns == docs.columns
    live = {r["name"] for r in store.manifest()}
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} > live | {"manifest"}
    store.vacuum(1)
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == live | {"manifest"}


def test_one_writer_wins_a_version(spark, tmp_path):
    a = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    b = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    v = a.version()
    assert a.commit([], v) == 1
    with pytest.raises(RuntimeError):
        b.commit([{"name": "x", "tier": 0, "bytes": 1, "files": []}], v)
    assert b.version() == 1 and b.manifest() == []


def test_a_reader_is_not_disturbed(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", fanout=2, least_bytes=1 << 20)
    part = lambda k: docs.filter(f"pmod(coalesce(doc_id, 0), 4) = {k}")
    store.append(part(0))
    held, n = store.read(), part(0).count()
    for k in (1, 2, 3):
        store.append(part(k))
        store.vacuum()
        assert held.count() == n
    store.vacuum(1)
    assert store.read().count() == docs.count() and store.version() > 4
    with pytest.raises(Exception):
        held.count()
    (tmp_path / "s/run-failed").mkdir()
    store.vacuum(1)
    assert (tmp_path / "s/run-failed").exists()
    store.vacuum(1, hours=-1)
    assert not (tmp_path / "s/run-failed").exists() and store.read().count() == docs.count()


def test_racing_writers_lose_nothing(spark, docs, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def write(k):
        store = sharding.ShardStore(spark, f"file://{tmp_path}/s", fanout=2, least_bytes=1 << 20)
        for j in range(2):
            store.append(docs.filter(f"pmod(coalesce(doc_id, 0), 6) = {2 * k + j}"))

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    assert Counter(r.doc_id for r in store.read().collect()) == Counter(r.doc_id for r in docs.collect())
    versions = [store.manifest(v) for v in range(1, store.version() + 1)]
    assert all(len({r["name"] for r in m}) == len(m) for m in versions)


def test_plan_has_no_python(docs):
    plan = sharding.shard_of_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))
