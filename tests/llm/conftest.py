import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice(["an", "the", "re", "é", "ous", "ing", "ß", "co"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = words(60)
    out = []
    for i in range(60):
        lines = [words(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))]
        if i % 7 == 0:
            lines.insert(rng.randint(0, len(lines)), shared)
        out.append([i, "\n".join(lines), rng.choice(["en", "fr"]), "hot" if i % 3 == 0 else f"s{i % 5}", 0])
    for i in range(60, 70):
        out.append([i, out[4][1], "en", "hot", 0])
    out.append([70, out[5][1] + " " + vocab[3], "en", "hot", 0])
    out.append([71, words(9000) + "\n" + shared + "\n  " + shared.upper() + "\t", "en", "hot", 0])
    out += [[72, "", "en", "s1", 0], [73, None, None, None, None], [74, " \n\t\n ", "de", "s1", 0], [75, "word", "de", "s1", 0], [76, "<|endoftext|> a\x00b 　c İΣ é", "de", "s1", 0]]
    out += [list(out[3]), list(out[3]), [None, "no id " + shared, "en", "s2", 0], [None, out[4][1], "en", "s2", 0]]
    return [tuple(x) for x in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with further columns whose names an operator might use itself."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("fp", "key", "component_id", "_pid", "before", "ids", "batch", "block", "root", "n_words"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
