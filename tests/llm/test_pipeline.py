import random
from collections import Counter

import corpus_pipeline
import pytest
from quillon.llm import lines, packing, quality, simhash
from quillon.llm.tokens import word_bpe
from test_lines import brute as lines_brute
from test_simhash import plain as plain_fingerprint
from test_simhash import roots


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Prose with a hot source, exact and near copies, shared lines, short texts and symbol noise."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice(["an", "the", "re", "ous", "ing", "co", "er", "th"]) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, rows = words(60), []
    for i in range(260):
        text = "\n".join(words(rng.randint(20, 60)) for _ in range(rng.randint(3, 6)))
        rows.append((i, text + ("\n" + shared) * (i % 5 == 0), "en", "hot" if i % 3 == 0 else f"s{i % 6}", len(text)))
    rows += [(260 + i, rows[7][1], "en", "hot", 0) for i in range(12)]
    rows += [(252 + i, rows[i][1][:-1] + "x", "en", "s1", 0) for i in range(20, 30)]
    rows += [(290 + i, "too short to stay", "en", "s1", 0) for i in range(5)]
    rows += [(300 + i, " ".join(w + rng.choice(["$$$", "###", "&&&"]) for w in rng.sample(vocab, 90)), "en", "s2", 0) for i in range(5)]
    rows += [(None, None, None, None, None), (400, None, "en", None, None), (401, "", None, "s1", 0), (402, words(9000), "fr", "hot", 0), rows[3]]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    return rows, str(at)


def test_each_stage_against_brute_force(spark, corpus, tmp_path):
    rows, at = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, at).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = [tuple(r) for r in docs.collect()]
        if k < 4:
            assert docs.columns == columns
    judged = {r.doc_id: r.kept for r in quality.judged(spark.read.parquet(f"{at}/documents.parquet")).collect()}
    kept = seen["quality_rules"]
    assert Counter(kept) == Counter(r for r in rows if judged[r[0]])
    assert not {r[0] for r in kept} & {*range(290, 295), *range(300, 305), 400, 401, None} and {r[0] for r in kept} >= {*range(282)}
    cut = seen["line_dedup"]
    want = {d: gone for d, _, gone, _ in lines_brute(kept)}
    assert Counter(r[0] for r in cut) == Counter(r[0] for r in kept)
    assert all(len(r[1].split("\n")) == len(next(x for x in kept if x[0] == r[0])[1].split("\n")) - want[r[0]] or want[r[0]] and not r[1] for r in cut)
    assert all(r[4] == len(r[1]) for r in cut)
    fps = {r[0]: plain_fingerprint(r[1]) for r in cut}
    root = roots(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, f in fps.items():
        least[root[f]] = min(d, least.get(root[f], d))
    one = seen["simhash_near_dedup"]
    assert sorted(r[0] for r in one) == sorted(least.values())
    assert Counter(seen["mix_sources"]) == Counter(one)
    bpe = word_bpe()
    tokens = Counter()
    for doc_id, start, length, *_ in seen["pack_sequences"]:
        tokens[doc_id] += length
    assert tokens == Counter({r[0]: len(bpe.ids(r[1])) // 2 + 1 for r in one})


def test_run_gives_the_last_stage(spark, corpus):
    rows, at = corpus
    out = corpus_pipeline.run(spark, at)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    places = sorted((r.sequence_id * packing.LENGTH + r.offset, r.length) for r in out.collect())
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert lines.LAST > 0 and simhash.SEED == 42
