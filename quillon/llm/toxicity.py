"""Toxicity by a small convolutional text classifier, trained in numpy.

Words (ASCII lower case, ASCII punctuation at the ends dropped) are hashed to 32 bits; hashes that at least `least_docs` training
documents hold have an embedding, other words take that of their longest such beginning (of 6 to 10 bytes), or zero. Filters of width one to three run over the whole text, the largest
response of each filter is kept, and a logistic layer scores them. An embedding's first entry begins as the word's smoothed log
odds, the rest at random. Training sees at most `sample` labelled rows, at most 35 % of it with label 1 and
65 % without (those of least hash), since the rarer label teaches more; a fifth of them is kept for calibration: there each language, as the text's own common words tell it, gets a threshold, to which the score is shifted, so
that 0.5 is the threshold everywhere. labels, lang, source and doc_id are no input of a score.

Scoring adds up, for each filter, precomputed responses of the word at each offset, so its cost is a few table rows a word.
The sampled rows come to the driver, where training runs; their texts together have at most `sample_bytes`, beyond which the rows of
larger hash stay out. Scoring takes every text whole, in portions if it is long.
Null texts count as empty; a text without a known word has a score of its own like any other. Labels that are null or belong to no
document teach nothing; of labels that contradict each other for one doc_id the larger counts, and of several rows of one doc_id the
one of least text hash. A score that ties with the threshold is 0.5 and predicts 1. Further columns may have any name. An empty table
gives no row; without a labelled row of both kinds every score is the share of label 1 seen.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from quillon.llm.common import octets
from quillon.shared import written

SAMPLE, SAMPLE_BYTES, TOXIC_SHARE, LEAST_DOCS, DIM, WIDTHS, FILTERS = 6000, 256 << 20, 0.35, 6, 8, (1, 2, 3), 8
EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Common words by which a text shows its language; the rest is "other".
COMMON = {
    "en": b"the and of to in is that it with for was on are as by this be from or at an", "de": b"der die das und ist nicht ein eine von mit den dem zu des sich auf im",
    "fr": b"le la les et des une est que dans pour qui pas sur par au avec du", "es": b"el los las y una es por con para del se su lo como al no",
}
LANGUAGES = [*COMMON, "other"]
_LANGUAGE = {w: i for i, (_, ws) in enumerate(COMMON.items()) for w in ws.split()}
BLOCK = 1 << 14


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


PREFIXES = (10, 9, 8, 7, 6)


def hashed(word: bytes) -> int:
    return xxh32_intdigest(word)


def prefixes(word: bytes) -> list[int]:
    """Hashes of a word's beginnings, the longest first."""
    return [xxh32_intdigest(word[:n], 1) for n in PREFIXES if len(word) > n]


class Words(dict):
    """Word as written to 8 * (row of the embeddings) + language; row 0 is no word. A word without a row of its own has that of
    its longest known beginning."""

    def __init__(self, known: np.ndarray) -> None:
        self.row = {int(h): i + 1 for i, h in enumerate(known)}

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(EDGE)
        row = self.row.get(hashed(bare)) or next((r for h in prefixes(bare) if (r := self.row.get(h))), 0)
        out = row * 8 + _LANGUAGE.get(bare, 7)
        if len(word) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[word] = out
        return out


def codes(text: bytes, words: Words) -> tuple[np.ndarray, int]:
    """Embedding rows of a text, and its language's number."""
    own = text.lower().split()
    both = np.fromiter(map(words.__getitem__, own), np.int64, len(own))
    seen = np.bincount(both & 7, minlength=8)[: len(COMMON)]
    return both >> 3, int(seen.argmax()) if seen.any() else len(COMMON)


class Network:
    """Embeddings E (row 0 is zero), a filter bank for each width, and the logistic layer."""

    def __init__(self, e: np.ndarray, filters: list[np.ndarray], bias: np.ndarray, out: np.ndarray, out_bias: float) -> None:
        self.e, self.filters, self.bias, self.out, self.out_bias = e, filters, bias, out, out_bias
        self._tables: list[list[np.ndarray]] | None = None

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and offset: the response of every word."""
        if self._tables is None:
            d = self.e.shape[1]
            self._tables = [[np.ascontiguousarray(self.e @ f[j * d : (j + 1) * d], np.float32) for j in range(len(f) // d)] for f in self.filters]
        return self._tables

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter and where its window begins. Texts are taken as if zeros surrounded them."""
        best = np.full(len(self.bias), -np.inf, np.float32)
        where = np.zeros(len(self.bias), np.int64)
        pad = max(WIDTHS) - 1
        rows = np.concatenate([np.zeros(pad, np.int64), rows, np.zeros(pad, np.int64)])
        n = len(rows) - pad
        for first in range(0, n, BLOCK):
            part = rows[first : first + BLOCK + pad]
            k = 0
            for t in self.tables():
                size, m = len(t), min(BLOCK, n - first)
                r = t[0].take(part[:m], axis=0)
                for j in range(1, size):
                    r += t[j].take(part[j : j + m], axis=0)
                top = r.max(axis=0)
                better = top > best[k : k + r.shape[1]]
                if better.any():
                    at = r.argmax(axis=0) + first
                    best[k : k + r.shape[1]] = np.where(better, top, best[k : k + r.shape[1]])
                    where[k : k + r.shape[1]] = np.where(better, at, where[k : k + r.shape[1]])
                k += r.shape[1]
        return best + self.bias, where

    def logit(self, rows: np.ndarray) -> float:
        best, _ = self.pooled(rows)
        return float(np.maximum(best, 0) @ self.out + self.out_bias)


def log_odds(bags: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    pos, neg = np.zeros(size), np.zeros(size)
    for b, y in zip(bags, labels):
        (pos if y else neg)[b] += 1
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    prior = n1 / len(labels)
    strength = 4.0
    rate1, rate0 = (pos + strength * prior) / (n1 + strength), (neg + strength * (1 - prior)) / (n0 + strength)
    z = np.log(rate1 / rate0) * np.sqrt((pos + neg) / (pos + neg + 8))
    z[0] = 0
    return z


def add_gradient(net: Network, rows: np.ndarray, label: float, g: dict[str, np.ndarray]) -> None:
    """Adds a text's gradient of the log loss; it passes the pools to the winning windows only."""
    pad, dim = max(WIDTHS) - 1, net.e.shape[1]
    best, where = net.pooled(rows)
    on = best > 0
    act = best * on
    err = 1 / (1 + np.exp(-float(act @ net.out + net.out_bias))) - label
    g["out"] += err * act
    g["out_bias"] += err
    d = err * net.out * on
    g["bias"] += d
    padded = np.concatenate([np.zeros(pad, np.int64), rows, np.zeros(pad, np.int64)])
    for x, w in enumerate(WIDTHS):
        for k in range(FILTERS):
            q = x * FILTERS + k
            if d[q]:
                own = padded[where[q] : where[q] + w]
                g[f"f{x}"][:, k] += d[q] * net.e[own].ravel()
                np.add.at(g["e"], own, d[q] * net.filters[x][:, k].reshape(w, dim))


def train(texts: list[bytes], labels: np.ndarray, least_docs: int = LEAST_DOCS, dim: int = DIM, epochs: int = 6, seed: int = 5) -> tuple[np.ndarray, Network]:
    """(known hashes, network), by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    bags = [{w.strip(EDGE) for w in set(t.lower().split())} for t in texts]
    seen = Counter(h for bag in bags for h in {hashed(w) for w in bag})
    often = {h for h, n in seen.items() if n >= least_docs}
    begun = Counter(h for bag in bags for h in {h for w in bag if hashed(w) not in often for h in prefixes(w)})
    known = np.array(sorted(often | {h for h, n in begun.items() if n >= least_docs}), np.int64)
    words = Words(known)
    rows = [codes(t, words)[0] for t in texts]
    size, bank = len(known) + 1, FILTERS * len(WIDTHS)
    e = rng.normal(0, 0.1, (size, dim)).astype(np.float32)
    e[:, 0] = log_odds([np.unique(r) for r in rows], labels, size)
    e[0] = 0
    filters = [rng.normal(0, 0.1, (w * dim, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f, w in zip(filters, WIDTHS):
        f[[j * dim for j in range(w)], : FILTERS // 2] += 0.7 / w
    net = Network(e, filters, np.full(bank, -0.5, np.float32), np.full(bank, 0.2, np.float32), float(np.log(labels.mean() / (1 - labels.mean()))))
    params = {"e": net.e, **{f"f{i}": f for i, f in enumerate(filters)}, "bias": net.bias, "out": net.out, "out_bias": np.array([net.out_bias])}
    m, v, step = {k: np.zeros_like(p) for k, p in params.items()}, {k: np.zeros_like(p) for k, p in params.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            net._tables = None
            net.out_bias = float(params["out_bias"][0])
            g = {k: np.zeros_like(p) for k, p in params.items()}
            batch = order[at : at + 64]
            for i in batch:
                add_gradient(net, rows[i], labels[i], g)
            step += 1
            for k, p in params.items():
                g[k] /= len(batch)
                if k in ("e", *(f"f{i}" for i in range(len(WIDTHS)))):
                    g[k] += 1e-4 * p
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                p -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
            net.e[0] = 0
    net._tables, net.out_bias = None, float(params["out_bias"][0])
    return known, net


def threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The midpoint of the gap with the fewest errors of both kinds, each kind weighed by its size's root."""
    if not len(logits) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(logits)
    x, y = logits[order], labels[order]
    w1, w0 = 1 / np.sqrt(y.sum()), 1 / np.sqrt((1 - y).sum())
    wrong = np.r_[0, np.cumsum(y * w1)] + np.r_[np.cumsum(((1 - y) * w0)[::-1])[::-1], 0]
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    k = int(best[len(best) // 2])
    low, high = x[k - 1] if k else x[0] - 1, x[k] if k < len(x) else x[-1] + 1
    return float((low + high) / 2)


class Model:
    """What the executors get: known hashes, network, and a threshold for each language."""

    def __init__(self, known: np.ndarray, net: Network | None, cuts: list[float], share: float) -> None:
        self.known, self.net, self.cuts, self.share = known, net, cuts, share
        self._words: Words | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_words": None}  # each worker gathers its own

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.share)
        words = self._words = self._words or Words(self.known)
        x = np.empty(len(texts))
        for i, t in enumerate(texts):
            rows, language = codes(t, words)
            x[i] = self.net.logit(rows) - self.cuts[language]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[bytes], labels: list[int], calibrate: list[bool], least: int = 12) -> Model:
    """Trains on one part and sets the languages' thresholds on the other; languages with fewer than `least` calibration rows
    of either label share that of all."""
    y, c = np.array(labels, np.float64), np.array(calibrate, bool)
    part = y[~c]
    if not len(part) or part.min() == part.max():
        return Model(np.empty(0, np.int64), None, [0.0] * len(LANGUAGES), float(y.mean()) if len(y) else 0.0)
    known, net = train([t for t, k in zip(texts, c) if not k], part)
    words = Words(known)
    held = [codes(t, words) for t, k in zip(texts, c) if k]
    logits, of, yc = np.array([net.logit(r) for r, _ in held]), np.array([g for _, g in held], int), y[c]
    every = threshold(logits, yc)
    cuts = []
    for g in range(len(LANGUAGES)):
        own = of == g
        cuts.append(threshold(logits[own], yc[own]) if min(yc[own].sum(), (1 - yc[own]).sum()) >= least else every)
    return Model(known, net, cuts, float(y.mean()))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most `sample` labelled rows that aren't held out, of at most `sample_bytes` together."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).dropna().filter(~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).withColumn("_order", F.xxhash64("_id"))
    ones = int(sample * TOXIC_SHARE)
    first = lambda rows, n: rows.orderBy("_order", "_id").limit(n)
    known = first(known.filter("_toxic > 0"), ones).unionByName(first(known.filter("_toxic <= 0"), sample - ones))
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    met = rows.join(F.broadcast(known), rows["_doc"] == known["_id"])  # sample rows at most
    one = met.groupBy("_doc").agg(F.min(F.struct(F.xxhash64("_text"), "_text")).alias("_one"), F.first("_toxic").alias("_toxic"), F.first("_order").alias("_order"))
    got = written(one.select("_doc", F.col("_one._text").alias("_text"), "_toxic", "_order"), "toxicity-sample")
    size, last = 0, None
    for r in got.select("_order", F.octet_length("_text").alias("n")).orderBy("_order", "_doc").collect():  # sample rows at most
        size += r["n"]
        if size > sample_bytes:
            break
        last = r["_order"]
    got = sorted((r["_doc"], r["_text"].encode(), int(r["_toxic"] > 0)) for r in got.filter(F.col("_order") <= F.lit(last)).toLocalIterator())
    return fit([t for _, t, _ in got], [y for _, _, y in got], [zlib.crc32(f"calibrate {d}".encode()) % 5 == 0 for d, _, _ in got])


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample, sample_bytes))  # bounded by sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.scores(octets(b.column(1))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
