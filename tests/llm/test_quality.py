import math
import re
from collections import Counter

import numpy as np
from quillon.llm import queries, quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_counts_against_brute_force(docs, rows):
    more = ["a b c a b c a b", "x # | <>\n\ny\ny \ny\n \n", "same same same same", "# é" * 40]
    for t in more:
        raw = t.encode()
        assert quality.base_counts(raw, raw.split()) == brute(t)
    got = quality.judged(docs, least_docs=5).collect()
    assert Counter((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in got) == Counter((r[0], *brute(r[1])) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_measures_against_the_vocabularies(rows):
    import sentencepiece
    from quillon.llm.tokens import fertility, vocabulary

    table = fertility(quality.PIECES, quality.RANKS)
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(quality.PIECES))
    for _, t, *_ in rows[:8]:
        words = t.encode().split()
        table.learn(set(words))
        chars = sum(len(w.decode()) for w in words)
        per_word, a, _, share, entropy = quality.measures(words, chars, table)
        ids = sp.encode(" ".join(t.split()))
        assert abs(a - chars / len(ids)) < 1e-9 and abs(per_word - len(ids) / len(words)) < 1e-9
        assert abs(share - sum(map(sp.is_byte, ids)) / len(ids)) < 1e-9
        blocks = [Counter(ids[i : i + 64]) for i in range(0, len(ids) - 63, 64)]
        if blocks:
            assert abs(entropy - sum(-c / 64 * math.log2(c / 64) for b in blocks for c in b.values()) / len(blocks)) < 1e-9
    assert quality.measures([], 0, table) == (0.0, 0.0, 0.0, 0.0, None)


def test_long_words_are_measured_whole():
    import random

    import sentencepiece
    from quillon.llm import tokens

    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh0123456789é+/") for _ in range(10_000))
    table = tokens.fertility(quality.PIECES, quality.RANKS)
    table.learn({long.encode()})
    ids, n = table[long.encode()]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary(quality.PIECES))
    assert np.frombuffer(ids, np.uint16).tolist() == sp.encode(long)
    assert n == len(table.bpe.encode_ordinary(" " + long))


def test_kept_against_brute_force(spark, none):
    import random
    from statistics import median_low

    rng = random.Random(9)
    vocab = ["".join(rng.choice(["an", "the", "re", "ous", "ing", "co"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    data = [(i, " ".join(rng.choice(vocab) + rng.choice(["", "", "###"]) * (i % 9 == 0) for _ in range(rng.randint(30, 200))), rng.choice(["en", "fr", None]), "s", 0) for i in range(150)]
    rows = [r.asDict() for r in quality.judged(spark.createDataFrame(data, none.schema)).collect()]
    lang = {d: l for d, _, l, *_ in data}
    for r in rows:
        own = [x for x in rows if lang[x["doc_id"]] == lang[r["doc_id"]] and x["n_words"] >= 50]  # all texts here are of one script
        ok = True
        for m, (low, high) in quality.BANDS.items():
            values = [x[m] for x in own if x[m] is not None]
            if r[m] is None:
                continue
            mid = median_low(values)
            dev, wide = median_low([abs(v - mid) for v in values]), 1 + 10 / len(own)
            ok &= not low or r[m] >= mid - wide * max(dev * low[0], low[1])
            ok &= not high or r[m] <= mid + wide * max(dev * high[0], high[1])
        assert r["kept"] == (ok and not r["base_failed"])
    assert 0 < sum(r["kept"] for r in rows) < len(rows)


def test_prose_stays_and_noise_goes(spark, none):
    import random

    rng = random.Random(2)
    vocab = ["".join(rng.choice(["an", "the", "re", "ous", "ing", "co", "er", "th"]) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    prose = [" ".join(rng.choice(vocab) for _ in range(rng.randint(60, 300))) for _ in range(300)]
    noise = ["".join(w + rng.choice(["$$$ ", "### ", "&&& ", "*** "]) for w in rng.sample(vocab, 120)), " | ".join(rng.sample(vocab, 120)), " ".join(rng.choice("ꙮ𓂀ꔮ") * 3 + str(i) for i in range(100))]
    data = [(i, t, "en", "s", 0) for i, t in enumerate([*prose, *noise])]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(data, none.schema)).collect()}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(300, 303))


def test_small_languages_have_their_own_bands(spark, none):
    import random

    rng = random.Random(3)
    made = lambda parts: ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    prose = lambda vocab: " ".join(rng.choice(vocab) for _ in range(rng.randint(60, 120)))
    latin, other = made(["an", "the", "re", "ous", "ing", "co", "er", "th"]), made(["კა", "ში", "მო", "რე", "ბა", "ლი", "თა", "ვის"])
    data = [(i, prose(latin), "en", "s", 0) for i in range(400)]
    for few, lang in ((1, "k1"), (2, "k2"), (5, "k5"), (40, "k40"), (60, "k60"), (30, None)):
        data += [(len(data) + i, prose(other), lang, "s", 0) for i in range(few)]
    noise = len(data)
    data += [(noise, "".join(w + rng.choice(["$$$ ", "### ", "&&& ", "*** "]) for w in rng.sample(latin, 120)), "k40", "s", 0), (noise + 1, " | ".join(rng.sample(latin, 120)), "k60", "s", 0)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(data, none.schema)).collect()}
    assert all(got[i] for i in range(noise)) and not got[noise] and not got[noise + 1]


def test_keep_and_empty(docs, none):
    kept = quality.keep(docs, least_docs=5)
    want = Counter((r.doc_id, r.n_words) for r in quality.judged(docs, least_docs=5).collect() if r.kept)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, len((r.text or "").encode().split())) for r in kept.collect()) == want
    assert quality.judged(none).count() == 0 and quality.keep(none).count() == 0


def test_query_columns(spark, rows, none, tmp_path):
    spark.createDataFrame(rows, none.schema).write.parquet(f"{tmp_path}/documents.parquet")
    names = queries.op9_quality(spark, str(tmp_path)).columns
    assert {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"} <= set(names)
