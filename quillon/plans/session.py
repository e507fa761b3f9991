"""SQL names: building and searching an index by name, through a catalog folder."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.knn import checked_k
from quillon.plans.index import RERANK, STATUS, Index, build_index, load_index
from quillon.shared import temporary

FOLDER = "quillon.index.folder"
VERSION = "1.1.0"


def index_folder(spark: SparkSession) -> str:
    """Where indexes are kept: the setting quillon.index.folder, or below the shared checkpoint folder, or in local mode a
    temporary one."""
    at = spark.conf.get(FOLDER, None)
    if not at:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        at = f"{shared.rstrip('/')}/indexes" if shared else temporary(spark, "quillon-indexes-", FOLDER)
        spark.conf.set(FOLDER, at)
    return at


def create_index(spark: SparkSession, name: str, table: str, column: str, clusters: int, id_col: str = "id", **params: object) -> str:
    """Builds an index of a table's column and keeps it under its name, in place of an older one. Failures raise."""
    base = spark.read.parquet(table) if "/" in table else spark.table(table)
    build_index(base, name, clusters, id_col, column, table, **params).save(f"{index_folder(spark)}/{name}")
    return STATUS


def open_index(spark: SparkSession, name: str) -> Index:
    try:
        return load_index(spark, f"{index_folder(spark)}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise ValueError(f"there is no index {name}") from e
        raise


def ann_search(spark: SparkSession, name: str, query: list[float], k: int, nprobe: int | None = None, lenient: bool = False, **params: object) -> DataFrame:
    """(id, score) from an index by name; see Index.search. A missing index raises, or gives no row if lenient."""
    try:
        index = open_index(spark, name)
    except ValueError:
        if not lenient:
            raise
        return spark.createDataFrame([], "id bigint, score float")
    return index.search(query, checked_k(k), nprobe, **params)


def list_indexes(spark: SparkSession) -> DataFrame:
    """(index_name, table_name, column_name, settings) of the folder's indexes; only their metadata is read."""
    schema = "name string, base string, vec_col string"
    files = spark.read.text(f"{index_folder(spark)}/*/metadata")
    parsed = files.select(F.from_json("value", schema).alias("s"), F.col("value").alias("settings"))
    return parsed.select(F.col("s.name").alias("index_name"), F.col("s.base").alias("table_name"), F.col("s.vec_col").alias("column_name"), "settings")


def register(spark: SparkSession) -> None:
    """SQL functions vector_l2sq(a, b) and vector_l2(a, b). Safe to repeat."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_l2sq(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> (CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))), CAST(0 AS DOUBLE), (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_l2(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN sqrt(vector_l2sq(a, b))")


def register_search(spark: SparkSession, index: Index, name: str = "ann_search", rerank: int = RERANK, complete: bool = False) -> None:
    """Makes index.search a SQL table function name(query, k) of plain spark.sql: a projection and two row numbers over the
    entries, whose filters above the call are ordinary filters on its rows. `sql` has the whole surface. A `complete` one measures,
    after the shortlist, all entries that may be as near as its k-th by their code, in a second pass."""
    index.entries.createOrReplaceTempView(f"{name}_entries")
    book, w = json.dumps(index.book.tolist()), index.book.shape[2]
    register(spark)
    more = """,
        reach AS (SELECT coalesce(max(CASE WHEN nth = most THEN d END), double('Infinity')) AS far FROM (SELECT d, most, row_number() OVER (ORDER BY d, id) AS nth FROM (SELECT id, most, vector_l2sq(vec, query) AS d FROM short))),
        whole AS (SELECT id, vec, query FROM coded CROSS JOIN reach WHERE coalesce(pow(greatest(sqrt(found) - off, 0D), 2) - 1e-9D * (found + off * off), 0D) <= far)"""
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<FLOAT>, k INT) RETURNS TABLE (id BIGINT, score FLOAT) RETURN
        WITH q AS (SELECT query AS query, k AS most, transform(from_json('{book}', 'array<array<array<float>>>'),
                          (words, m) -> transform(words, c -> aggregate(zip_with(slice(query, m * {w} + 1, {w}), c, (x, y) -> (CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)), CAST(0 AS DOUBLE), (a, x) -> a + x))) AS lut),
        coded AS (SELECT e.id, e.vec, e.off, q.query, q.most, aggregate(zip_with(e.code, q.lut, (c, row) -> get(row, CAST(c AS INT))), CAST(0 AS DOUBLE), (a, x) -> a + x) AS found FROM {name}_entries e CROSS JOIN q),
        short AS (SELECT id, vec, query, most FROM (SELECT *, row_number() OVER (ORDER BY found, id) AS nth FROM coded) WHERE nth <= {checked_k(rerank)}){more if complete else ''}
        SELECT id, CAST(d AS FLOAT) FROM (SELECT id, d, row_number() OVER (ORDER BY d, id) AS nth FROM (SELECT id, vector_l2sq(vec, query) AS d FROM {'whole' if complete else 'short'})) WHERE nth <= k"""
    )


CALL = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\b(create_ivf_index|ann_search)\s*\(", re.S | re.I)
PART = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[()\[\],]", re.S)
NAMED = re.compile(r"\s*([a-z_]+)\s*(?:=>|:=)(.*)", re.S | re.I)


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose parenthesis opens before `at`, and where it ends."""
    depth, begin, out = 1, at, []
    for m in PART.finditer(text, at):
        if m[0] in "([":
            depth += 1
        elif m[0] in ")]":
            depth -= 1
        if m[0] == "," and depth == 1 or not depth:
            out.append(text[begin : m.start()])
            begin = m.end()
        if not depth:
            return [a for a in out if a.strip()], m.end()
    raise ValueError("a call isn't closed")


def _values(spark: SparkSession, arguments: list[str], names: list[str]) -> dict[str, object]:
    """Arguments by name, evaluated as the constants or scalar subqueries that they are."""
    pairs = []
    for i, a in enumerate(arguments):
        m = NAMED.fullmatch(a)
        if not m and i >= len(names):
            raise ValueError(f"too many arguments: {a.strip()}")
        pairs.append((m[1].lower(), m[2]) if m else (names[i], a))
    row = spark.sql("SELECT " + ", ".join(f"({e}) AS `{n}`" for n, e in pairs)).first()
    return {n: row[i] for i, (n, _) in enumerate(pairs)}


def _nodes(plan: object) -> list[object]:
    """A parsed plan's nodes, those of WITH clauses and of subqueries included."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p)
        for inner in (p.children(), p.innerChildren()) + ((p.subqueries(),) if hasattr(p, "subqueries") else ()):
            todo += [inner.apply(i) for i in range(inner.size())]
    return out


def _over(filter_node: object) -> str | None:
    """The relation that a filter stands right above."""
    child = filter_node.child()
    while child.nodeName() == "SubqueryAlias":
        child = child.child()
    return child.tableName().strip("`") if child.nodeName() == "UnresolvedRelation" else None


def _on_id(condition: object, id_col: str) -> list[str]:
    """The conjuncts of a parsed condition that speak of nothing but the id, as text over the base's id column."""
    if condition.nodeName() == "And":
        return _on_id(condition.left(), id_col) + _on_id(condition.right(), id_col)
    todo, attributes = [condition], set()
    while todo:
        e = todo.pop()
        if e.nodeName() == "UnresolvedAttribute":
            parts = e.nameParts()
            if parts.apply(parts.size() - 1).lower() != "id":
                return []
            attributes.add(e.sql())
        elif not e.deterministic() or "Subquery" in e.nodeName() or "Function" in e.nodeName():
            return []
        todo += [e.children().apply(i) for i in range(e.children().size())]
    text = condition.sql()
    for a in sorted(attributes, key=len, reverse=True):
        text = re.sub(rf"(?<![\w.`]){re.escape(a)}(?![\w.`])", f"`{id_col}`", text)
    return [text] if attributes else []


def sql(spark: SparkSession, text: str) -> DataFrame:
    """spark.sql with two more functions.

    create_ivf_index(index_name, table_name, column_name, clusters [, id_col => …]) builds an index at once, and is its status.
    ann_search(index_name, query, k, nprobe [, allowed_ids => …, where_clause => …, probe_mode => …, rerank => …]) is a table
    (id, score): arguments are constants or scalar subqueries, and what a WHERE right above it says of the id alone restricts the
    candidates before any are ranked, as allowed_ids and where_clause do (all other predicates filter the rows that were found)."""
    out, at, calls = [], 0, []
    while m := CALL.search(text, at):
        if not m[1]:
            out.append(text[at : m.end()])
            at = m.end()
            continue
        out.append(text[at : m.start()])
        arguments, at = _arguments(text, m.end())
        if m[1].lower() == "create_ivf_index":
            v = _values(spark, arguments, ["index_name", "table_name", "column_name", "clusters"])
            status = create_index(spark, v.pop("index_name"), v.pop("table_name"), v.pop("column_name"), v.pop("clusters"), **v)
            out.append(f"'{status}'")
        else:
            view = f"ann_search_{uuid.uuid4().hex}"
            calls.append((view, _values(spark, arguments, ["index_name", "query", "k", "nprobe"])))
            out.append(view)
    whole = "".join([*out, text[at:]])
    if not calls:
        return spark.sql(whole)
    filters = [n for n in _nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(whole)) if n.nodeName() == "Filter"]
    for view, v in calls:
        index = open_index(spark, v["index_name"])
        s = index.query(v["query"]).rerank(v.get("rerank") or RERANK)
        for p in [v["where_clause"]] if v.get("where_clause") else []:
            s = s.where(p)
        for f in filters:
            if _over(f) == view:
                for p in _on_id(f.condition(), index.settings.id_col):
                    s = s.where(p)
        if v.get("allowed_ids") is not None:
            s = s.ids(v["allowed_ids"])
        if (v.get("nprobe") or 0) < 0:
            raise ValueError("nprobe is negative")
        if v.get("probe_mode", "exhaustive") not in ("exhaustive", "limit"):
            raise ValueError(f"probe mode {v['probe_mode']}")
        if v.get("probe_mode") == "limit" and v.get("nprobe") is not None:
            s = s.probe(v["nprobe"])
        s.topk(v["k"]).createOrReplaceTempView(view)
    found = spark.sql(whole)
    for view, _ in calls:
        spark.catalog.dropTempView(view)
    return found
