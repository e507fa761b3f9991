import math
from collections import Counter, defaultdict

import pytest
from quillon.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 5.0, "b": 3.0, "c": 2.0}, {"a": 900.0, None: 1.0, "z": 99.0}, {f"s{i}": 1.0 + i * i for i in range(37)}, {"a": 0.0, "b": 1.0}])
def test_never_a_block_from_the_target(weights):
    for period in (40, 1000):
        slots = mixing.slots_of(weights, period)
        assert sum(slots.values()) == period and min(slots.values()) >= 1
        plan = mixing.timetable(slots, period)
        assert sorted(t for *_, t in plan) == list(range(period))
        given = Counter()
        for source, j, release, deadline, t in plan:
            assert j == given[source] and release <= t < deadline
            given[source] += 1
            for s, w in slots.items():
                assert abs(given[s] - w * (t + 1) / period) < 1


def test_schedule_against_brute_force(docs, rows):
    weights = {s: 1.0 for s in {r[3] for r in rows}}
    got = mixing.mixed(docs, weights, block_chars=500, period=20).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert sorted(r.position for r in got) == list(range(len(rows)))
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.position):
        by[r.source].append(r)
        assert r.release <= r.slot < r.deadline
    size = {r[0]: len(r[1] or "") for r in rows}
    slots = mixing.slots_of(weights, 20)
    for s, own in by.items():
        if s is not None and None not in [r.doc_id for r in own]:
            ids = [r.doc_id for r in own]
            assert ids == sorted(ids)
        at = 0
        for r in own:
            assert r.block == at // 500
            at += size[r.doc_id] if r.doc_id is not None else 0
            if r.doc_id is None:
                break
        assert all(math.floor(r.block % slots[s] * 20 / slots[s]) + r.block // slots[s] * 20 == r.release for r in own)
    order = [(r.slot) for r in sorted(got, key=lambda r: r.position)]
    assert order == sorted(order)


def test_rows_stay_whole(docs, rows, none, tmp_path):
    out = mixing.in_order(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in rows)
    assert mixing.mixed(none).count() == 0 and mixing.in_order(none).count() == 0


def test_too_many_sources():
    with pytest.raises(ValueError):
        mixing.slots_of({str(i): 1.0 for i in range(11)}, 10)


def test_never_a_block_from_the_given_weights(spark, none):
    weights = {"a": 14.0, None: 0.3, "z": 1.0, **{f"s{i}": 1.0 + i for i in range(9)}}
    total = sum(weights.values())
    rows = [(i, "x" * 10, "en", s, 10) for s, w in weights.items() for i in range(int(60 * w))] + [(i, "x" * 10, "en", "zero", 10) for i in range(3)]
    got = sorted(mixing.mixed(spark.createDataFrame(rows, none.schema), {**weights, "zero": 0.0}, block_chars=10).collect(), key=lambda r: r.position)
    assert len(got) == len(rows) and [r.source for r in got[-3:]] == ["zero"] * 3
    left, given = Counter(r[3] for r in rows), Counter()
    for r in got[:-3]:
        assert r.block == given[r.source] and r.release <= r.slot < r.deadline
        given[r.source] += 1
        for s, w in weights.items():
            assert given[s] == left[s] or abs(given[s] - w / total * (r.slot + 1)) < 1 + 1e-6


def test_more_sources_than_a_period(spark, none):
    rows = [(i, "x" * (1 + i % 7), "en", f"s{i % 1500}", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, none.schema)
    got = mixing.mixed(docs, block_chars=4).collect()
    assert sorted(r.position for r in got) == list(range(3000)) and {r.doc_id for r in got} == set(range(3000))
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert mixing.in_order(docs).count() == 3000


def test_five_thousand_sources_and_sources_without_a_weight(spark):
    weights = [1.0 + i % 31 for i in range(5000)]
    shares, counts = mixing.whole(weights), [1 + int(w) for w in weights]
    total, given = sum(shares), Counter()
    slots = 0
    for k, j, release, deadline, t in mixing.scheduled(shares, counts):
        assert j == given[k] and release <= t < deadline
        given[k] += 1
        slots += 1
        if slots % 10_000 == 1:
            assert all(abs(given[i] - (t + 1) * shares[i] / total) < 1 for i in range(5000) if given[i] < counts[i])
    assert slots == sum(counts)
    df = spark.range(6000).selectExpr("id AS doc_id", "repeat('x', 10) AS text", "concat('s', id % 3000) AS source")
    got = mixing.mixed(df, {f"s{i}": 1.0 + i for i in range(2999)}).collect()
    assert sorted(r.position for r in got) == list(range(6000))
    last = [r for r in got if r.source == "s2999"]
    assert len(last) == 2 and all(r.release is None for r in last) and {r.position for r in last} == {5998, 5999}


def test_rows_without_doc_id_keep_their_own_place(spark):
    df = spark.range(300).selectExpr("CAST(NULL AS LONG) AS doc_id", "repeat(CAST(id AS STRING), 50) AS text", "concat('s', id % 3) AS source")
    assert Counter(r.text for r in mixing.in_order(df, block_chars=200).collect()) == Counter(r.text for r in df.collect())
