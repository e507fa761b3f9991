import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from quillon.llm import lines, queries


def brute(rows, least=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\r\x0b\x0c"))
    owner = {}
    for d, t, *_ in rows:
        d = lines.LAST if d is None else d
        for x in (t or "").split("\n"):
            owner[key(x)] = min(d, owner.get(key(x), d))
    out = []
    for d, t, *_ in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if len(key(x)) < least or owner[key(x)] == (lines.LAST if d is None else d)]
        out.append((d, len(own), len(own) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect())


def test_against_brute_force(docs, rows):
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert got(out) == brute(rows)
    assert any(r[2] for r in brute(rows))


def test_many_batches_and_compactions(docs, rows):
    assert got(lines.dedup_lines(docs, batches=9, fanout=2)) == brute(rows)
    assert got(lines.dedup_lines(docs, batches=1)) == brute(rows)


def test_compaction_keeps_each_key_once(spark):
    runs = lines.SortedRuns(spark, 3, 2)
    want = defaultdict(int)
    for b in range(7):
        part = [(k, k * 3, 100 * b + k) for k in range(b, b + 5)]
        for h1, h2, d in part:
            want.setdefault((h1, h2), d)
        runs.add(spark.createDataFrame(part, "h1 long, h2 long, owner long"))
    assert max(map(len, runs.levels)) < 2
    assert Counter(tuple(r) for r in runs.owners().collect()) == Counter((*k, d) for k, d in want.items())
    runs.close()


def test_empty_table(none):
    assert lines.dedup_lines(none).count() == 0


def test_query_gives_the_rows_of_its_sql(spark, rows, tmp_path):
    import duckdb

    spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op3_lines"])
    df = queries.op3_lines(spark, str(tmp_path))
    assert df.columns == want.columns
    assert Counter(tuple(r) for r in df.collect()) == Counter(want.fetchall())
