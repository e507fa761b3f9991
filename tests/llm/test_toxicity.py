import random
import zlib

import numpy as np
from quillon.llm import queries, toxicity


def made(n, seed=0):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["an", "the", "re", "ous", "ing", "co"]) for _ in range(rng.randint(1, 4))) for _ in range(800)]
    out = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiota", "Scumm,", "wretch"]))
        out.append((i, " ".join(words), toxic))
    return out


def test_pooling_against_plain_convolution():
    rng = np.random.default_rng(0)
    d, f = toxicity.DIM, toxicity.FILTERS
    e = rng.normal(size=(50, d)).astype(np.float32)
    e[0] = 0
    net = toxicity.Network(e, [rng.normal(size=(w * d, f)).astype(np.float32) for w in toxicity.WIDTHS], np.zeros(f * 3, np.float32), np.ones(f * 3, np.float32), 0.0)
    for n in (0, 1, 2, 40, toxicity.BLOCK + 5):
        rows = rng.integers(0, 50, n)
        x = e[np.r_[0, 0, rows, 0, 0]]
        want = np.concatenate([np.max([x[i : i + w].ravel() @ net.filters[k] for i in range(n + 2)], axis=0) for k, w in enumerate(toxicity.WIDTHS)])
        assert np.allclose(net.pooled(rows)[0], want, atol=1e-4)


def test_threshold_parts_the_labels():
    assert 1 < toxicity.threshold(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 0, 1, 1])) < 2
    assert toxicity.threshold(np.array([1.0]), np.array([1])) == 0.0


def test_held_out_accuracy(spark, tmp_path):
    rows = made(900)
    spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (7, rows[7][1]), (5000, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = queries.op5_toxicity(spark, str(tmp_path))
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    got = df.collect()
    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.doc_id is not None and r.held_out and r.doc_id < 900]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_without_labels(spark, rows, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.scored(spark.createDataFrame(rows, none.schema), labels).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.0}
    assert toxicity.scored(none, labels).count() == 0


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    d, f = toxicity.DIM, toxicity.FILTERS
    e = rng.normal(size=(12, d))
    e[0] = 0
    net = toxicity.Network(e, [rng.normal(size=(w * d, f)) for w in toxicity.WIDTHS], rng.normal(size=f * 3), rng.normal(size=f * 3), 0.3)
    rows, label = rng.integers(1, 12, 9), 1.0

    def loss():
        x = np.concatenate([np.zeros((2, d)), net.e[rows], np.zeros((2, d))])
        best = np.concatenate([np.max([x[i : i + w].ravel() @ net.filters[k] for i in range(len(x) - 2)], axis=0) for k, w in enumerate(toxicity.WIDTHS)]) + net.bias
        return np.log1p(np.exp(-(np.maximum(best, 0) @ net.out + net.out_bias)))

    params = {"e": net.e, **{f"f{i}": x for i, x in enumerate(net.filters)}, "bias": net.bias, "out": net.out}
    g = {k: np.zeros_like(p) for k, p in params.items()} | {"out_bias": np.zeros(1)}
    toxicity.add_gradient(net, rows, label, g)
    for k, p in params.items():
        for at in rng.permutation(p.size)[:25]:
            i = np.unravel_index(at, p.shape)
            if k == "e" and i[0] == 0:
                continue
            old, both = p[i], []
            for h in (1e-5, -1e-5):
                p[i] = old + h
                both.append(loss())
            p[i] = old
            assert abs((both[0] - both[1]) / 2e-5 - g[k][i]) < 1e-3 * max(1, abs(g[k][i]))


def test_training_ranks_as_a_plain_trainer_does():
    """Against logistic regression on word presence by plain gradient descent: on words that tell, both rank held-out texts alike."""
    data = [(t.encode(), y) for _, t, y in made(500, seed=4)]
    train, held = data[:400], data[400:]
    known, net = toxicity.train([t for t, _ in train], np.array([y for _, y in train], float))
    words = toxicity.Words(known)
    score = [net.logit(toxicity.codes(t, words)[0]) for t, _ in held]
    vocab = {w: i for i, w in enumerate(sorted({w for t, _ in train for w in t.lower().split()}))}
    x = np.zeros((len(data), len(vocab)))
    for i, (t, _) in enumerate(data):
        x[i, [vocab[w] for w in t.lower().split() if w in vocab]] = 1
    y, w = np.array([y for _, y in data], float), np.zeros(len(vocab))
    for _ in range(300):
        w -= 0.5 * x[:400].T @ (1 / (1 + np.exp(-(x[:400] @ w - 1))) - y[:400]) / 400
    plain = x[400:] @ w
    auc = lambda s: np.mean([a > b for a, l in zip(s, y[400:]) if l for b, m in zip(s, y[400:]) if not m])
    assert auc(score) > 0.97 and auc(score) > auc(plain) - 0.02


def test_a_sample_has_a_bound_of_bytes(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat(concat('word', id % 7, ' '), 100) AS text")
    labels = spark.range(200).selectExpr("id AS doc_id", "CAST(id % 7 = 0 AS INT) AS toxic")
    seen = []
    real, toxicity.fit = toxicity.fit, lambda texts, *rest: (seen.append(texts), real(texts, *rest))[1]
    try:
        toxicity.learn(docs, labels)
        toxicity.learn(docs, labels, sample_bytes=20_000)
        toxicity.learn(docs, labels, sample_bytes=10)
    finally:
        toxicity.fit = real
    sizes = [sum(map(len, s)) for s in seen]
    assert sizes[0] > 60_000 and 15_000 < sizes[1] <= 20_000 and sizes[2] == 0
