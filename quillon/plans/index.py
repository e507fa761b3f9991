"""Building, keeping and searching an index of coarse clusters and product-quantized codes.

The index is one table (cluster_id, id, code, vec, off, kept columns), laid out by cluster, and three small ones (centroids, codebooks,
metadata). A search ranks entries by table-lookup distance, takes the `rerank` best and orders those by exact distance; it reads the
entries only, and of them only the probed clusters in the mode "limit". A `complete` search gives the true nearest of the entries that
it searches: it leaves out only entries that their code and their distance `off` what it stands for prove too far. The index is a snapshot: rows that the base gains, loses or
changes later don't count, unless a search asks to be `current`, which joins its candidates with the base: lost rows drop out, and
changed vectors are re-ranked by their new value under their old code."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillon.functions.vectors import as_vector, squared_l2_to, usable
from quillon.operators import cluster, quantize
from quillon.operators.blocks import Best, distances, finite_rows, matrix, nearest, pair_distances, products
from quillon.operators.knn import FOUND, IN_LIST, best_exact, checked_k, first_k, in_blocks, query_blocks, query_vector, restricted, scored, topmost
from quillon.shared import exists, fresh, remove, ship

RERANK, TRAIN_SHARE, LEAST_TRAINING, MOST_TRAINING = 200, 0.1, 4096, 262_144
#: Bytes of a row group and rows of a page of the entries: what a search skips as a whole.
ROW_GROUP, PAGE_ROWS = 32 << 20, 1024
LOOKUP_BLOCK = 512
STATUS = "Index created successfully"


@dataclass(frozen=True)
class Settings:
    name: str
    base: str
    id_col: str
    vec_col: str
    dim: int
    clusters: int
    subspaces: int = quantize.SUBSPACES
    codewords: int = quantize.CODEWORDS


def hashed_share(id_col: str, share: float, seed: int = 0) -> Column:
    """Whether a row is in a repeatable sample of about that share."""
    mixed = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("bigint")), F.lit(1_000_000))
    return mixed < int(round(share * 1_000_000))


def training_rows(base: DataFrame, id_col: str, share: float = TRAIN_SHARE, seed: int = 0, least: int = LEAST_TRAINING, most: int = MOST_TRAINING) -> DataFrame:
    """A repeatable sample for training: `share` of the rows, but at least `least` (all, if there are fewer) and at most `most`."""
    n = base.count()
    share = min(1.0, max(share, least / n if n else 1.0), most / n if n else 1.0)
    return base if share >= 1 else base.filter(hashed_share(id_col, share, seed))


class Index:
    def __init__(self, settings: Settings, base: DataFrame, centroids: DataFrame, codebooks: DataFrame, entries: DataFrame, stored: bool = False) -> None:
        self.settings, self.base, self.centroids, self.codebooks, self.entries, self.stored = settings, base, centroids, codebooks, entries, stored
        self._book: np.ndarray | None = None
        self._points: np.ndarray | None = None

    @property
    def book(self) -> np.ndarray:
        if self._book is None:
            self._book = quantize.book_array(self.codebooks)
        return self._book

    @property
    def points(self) -> np.ndarray:
        if self._points is None:
            self._points = cluster.centroid_array(self.centroids)
        return self._points

    def cached(self) -> Index:
        """The same index with its entries in executor memory (and on disk beyond it), for many searches without saving it."""
        self.entries = self.entries.persist()
        self.stored = True
        return self

    def postings(self) -> DataFrame:
        return cluster.postings(self.entries)

    def query(self, vector: Sequence[float]) -> Search:
        return Search(self, tuple(query_vector(vector, self.settings.dim)))

    def search(self, vector: Sequence[float], k: int, nprobe: int | None = None, where: Column | str | None = None, allowed_ids: Sequence[int] | DataFrame | None = None, rerank: int = RERANK, probe_mode: str = "exhaustive", current: bool = False, complete: bool = False) -> DataFrame:
        """(id, score float), nearest first. `where` and `allowed_ids` restrict the candidates before any are ranked; a filter on
        the result restricts it afterwards. In the exhaustive mode every cluster is searched whatever nprobe is; in the mode
        "limit" only the nprobe nearest are (0: none)."""
        s = self.query(vector).rerank(rerank)
        if where is not None:
            s = s.where(where)
        if allowed_ids is not None:
            s = s.ids(allowed_ids)
        if checked_probe(nprobe, probe_mode) is not None:
            s = s.probe(nprobe)
        s = s.complete() if complete else s
        return (s.current() if current else s).topk(k)

    def allowed(self, where: Sequence[Column | str] = (), ids: Sequence[Sequence[int] | DataFrame] = ()) -> DataFrame:
        """The entries that satisfy all predicates and have an allowed id. Predicates over kept columns, the id or the vector filter
        the entries themselves; any other takes a semi join with the base."""
        s, rows = self.settings, self.entries
        for x in ids:
            rows = restricted(rows, "id", allowed=x)
        for p in where:
            kept = [f.name for f in self.entries.schema["kept"].dataType.fields]
            own, *hidden = fresh([s.id_col, s.vec_col, *kept], "_entry", *("_cluster", "_code"))
            view = rows.select(F.struct("cluster_id", "id", "code", "vec", "off", "kept").alias(own), F.col("id").alias(s.id_col), F.col("vec").alias(s.vec_col), *(F.col(f"kept.`{c}`") for c in kept))
            try:
                rows = restricted(view, s.id_col, where=p).select(f"{own}.*")
            except AnalysisException as e:
                if "UNRESOLVED_COLUMN" not in str(e):
                    raise
                base = restricted(self.base, s.id_col, where=p).select(F.col(s.id_col).cast("bigint").alias("_id"))
                rows = rows.join(base, F.col("id") == F.col("_id"), "left_semi")
        return rows

    def search_batch(self, queries: Sequence[tuple[int, Sequence[float]]] | DataFrame, k: int, rerank: int = RERANK, nprobe: int | None = None, where: Column | str | None = None, allowed_ids: Sequence[int] | DataFrame | None = None, probe_mode: str = "exhaustive", complete: bool = False) -> DataFrame:
        """(query_id, id, score, rank) for many queries in one pass over the entries (in the mode "limit": those of the clusters
        that any query probes) for each block of LOOKUP_BLOCK queries. Each task keeps its `rerank` best a query with their exact
        distances, so no join follows, and only those are shuffled. A `complete` search has no shortlist: each task keeps the k
        nearest."""
        k, rerank, limit = checked_k(k), checked_k(rerank), checked_probe(nprobe, probe_mode)
        rows = self.allowed([] if where is None else [where], [] if allowed_ids is None else [allowed_ids])
        ship(rows.sparkSession)
        book, points = self.book, self.points

        def block(names: np.ndarray, vectors: np.ndarray) -> DataFrame:
            if vectors.shape[1] != self.settings.dim:
                raise ValueError(f"queries have {vectors.shape[1]} dimensions, the vectors {self.settings.dim}")
            tables = np.stack([quantize.query_table(book, v) for v in vectors], axis=2)
            probes, some = None, rows
            if limit is not None:
                order = np.argsort(distances(vectors, points), axis=1, kind="stable")[:, :limit]
                probes = np.zeros((len(points), len(names)), bool)
                probes[order, np.arange(len(names))[:, None]] = True
                some = rows.filter(cluster.among(np.flatnonzero(probes.any(axis=1))))
            if complete:
                return topmost(some.select("cluster_id", "id", "code", "vec", "off").mapInArrow(lambda it: certain(it, names, vectors, tables, probes, k), FOUND), k)
            short = some.select("cluster_id", "id", "code", "vec").mapInArrow(lambda it: shortlisted(it, names, vectors, tables, probes, rerank), FOUND + ", approximate double")
            nth = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY approximate, id)")
            return topmost(short.withColumn("_nth", nth).filter(F.col("_nth") <= rerank).select("query_id", "id", "score"), k)

        return in_blocks(rows.sparkSession, query_blocks(queries, LOOKUP_BLOCK) if k and (rerank or complete) else iter(()), block)

    def save(self, folder: str) -> None:
        """Replaces what the folder holds; entries are laid out by cluster, so that a limited search reads only its clusters."""
        self.centroids.coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
        self.codebooks.coalesce(1).write.mode("overwrite").parquet(f"{folder}/codebooks")
        laid = self.entries.repartitionByRange("cluster_id", "id").sortWithinPartitions("cluster_id", "id")
        laid.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{folder}/entries")
        spark = self.entries.sparkSession
        remove(spark, f"{folder}/streamed")  # entries of an older index of that name
        spark.createDataFrame([(json.dumps(asdict(self.settings)),)], "settings string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def checked_probe(nprobe: int | None, probe_mode: str) -> int | None:
    """The number of clusters that a search is limited to, if it is."""
    if probe_mode not in ("exhaustive", "limit"):
        raise ValueError(f"probe mode {probe_mode}")
    if nprobe is not None and nprobe < 0:
        raise ValueError("nprobe is negative")
    return nprobe if probe_mode == "limit" else None


#: Lookup distance of entries that have none: they come last.
UNCODED = 1e300


def shortlisted(batches: Iterator[pa.RecordBatch], names: np.ndarray, vectors: np.ndarray, tables: np.ndarray, probes: np.ndarray | None, rerank: int, fallback: bool = False) -> Iterator[pa.RecordBatch]:
    """For each query the `rerank` entries (cluster_id, id, code, vec) of one partition of least lookup distance, of the clusters it
    probes, with their exact distances; holds those and one block of distances."""
    best, step = Best(len(names), rerank), max(64, (1 << 20) // max(1, len(names)))
    for b in batches if rerank else ():
        for first in range(0, b.num_rows, step):
            part = b.slice(first, step)
            x, at = finite_rows(part.column(3), vectors.shape[1])
            if not len(x):
                continue
            keys = quantize.lookup_distances(part.column(2), tables)[at]
            lost = np.isnan(keys[:, 0])
            if lost.any():
                keys[lost] = distances(x[lost], vectors) if fallback else UNCODED
            if probes is not None:
                keys[~probes[np.asarray(part.column(0))[at]]] = np.inf
            r, q = best.candidates(keys)
            fine = np.isfinite(keys[r, q])
            r, q = r[fine], q[fine]
            best.add(q, keys[r, q], np.asarray(part.column(1), np.int64)[at[r]], pair_distances(x[r], vectors[q]))
    if len(best.id):
        yield pa.RecordBatch.from_arrays([pa.array(names[best.query]), pa.array(best.id), pa.array(best.value), pa.array(best.key)], ["query_id", "id", "score", "approximate"])


def certain(batches: Iterator[pa.RecordBatch], names: np.ndarray, vectors: np.ndarray, tables: np.ndarray, probes: np.ndarray | None, k: int, reach: float = np.inf) -> Iterator[pa.RecordBatch]:
    """For each query the k nearest entries (cluster_id, id, code, vec, off) of one partition, of the clusters it probes, none missed:
    an entry is left unmeasured only if it can't be as near as the k-th so far, or as `reach`. Holds those and one block of distances."""
    best, step = Best(len(names), k), max(64, (1 << 20) // max(1, len(names)))
    for b in batches if k else ():
        for first in range(0, b.num_rows, step):
            part = b.slice(first, step)
            x, at = finite_rows(part.column(3), vectors.shape[1])
            if not len(x):
                continue
            low = quantize.least_distances(quantize.lookup_distances(part.column(2), tables)[at], part.column(4).to_numpy(zero_copy_only=False).astype(np.float64)[at])
            far = low > np.minimum(best.worst, reach)
            if probes is not None:
                far |= ~probes[np.asarray(part.column(0))[at]]
            left = np.flatnonzero(~far.all(axis=1))
            if not len(left):
                continue
            keys, slack = products(x[left], vectors)
            keys[far[left]] = np.inf
            r, q = best.candidates(keys, slack)
            fine = np.isfinite(keys[r, q])
            r, q = left[r[fine]], q[fine]
            d = pair_distances(x[r], vectors[q])
            best.add(q, d, np.asarray(part.column(1), np.int64)[at[r]], d)
    if len(best.id):
        yield pa.RecordBatch.from_arrays([pa.array(names[best.query]), pa.array(best.id), pa.array(best.key)], ["query_id", "id", "score"])


def nominated(batches: Iterator[pa.RecordBatch], tables: np.ndarray, rerank: int) -> Iterator[pa.RecordBatch]:
    """(cluster_id, id, approximate) of the `rerank` entries (cluster_id, id, code) of one partition that are nearest by their codes."""
    best = Best(1, rerank)
    for b in batches if rerank else ():
        keys = np.nan_to_num(quantize.lookup_distances(b.column(2), tables), nan=UNCODED)
        r, q = best.candidates(keys)
        best.add(q, keys[r, 0], np.asarray(b.column(1), np.int64)[r], np.asarray(b.column(0), np.float64)[r])
    if len(best.id):
        yield pa.RecordBatch.from_arrays([pa.array(best.value.astype(np.int32)), pa.array(best.id), pa.array(best.key)], ["cluster_id", "id", "approximate"])


def reachable(batches: Iterator[pa.RecordBatch], tables: np.ndarray, reach: float) -> Iterator[pa.RecordBatch]:
    """(cluster_id, id) of the entries (cluster_id, id, code, off) that may be as near as `reach`."""
    for b in batches:
        low = quantize.least_distances(quantize.lookup_distances(b.column(2), tables), b.column(3).to_numpy(zero_copy_only=False).astype(np.float64))
        near = pa.array(low[:, 0] <= reach)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], ["cluster_id", "id"])


def load_index(spark: SparkSession, folder: str, base: DataFrame | None = None) -> Index:
    """An index as saved, with entries that streams have added; without `base`, its settings' table or Parquet path is read. A
    missing index raises."""
    settings = Settings(**json.loads(spark.read.text(f"{folder}/metadata").first()[0]))
    if base is None:
        base = spark.read.parquet(settings.base) if "/" in settings.base else spark.table(settings.base)
    part = lambda x: spark.read.parquet(f"{folder}/{x}")
    entries = part("entries")
    if exists(spark, f"{folder}/streamed"):
        entries = entries.unionByName(part("streamed"), allowMissingColumns=True)
    if "off" not in entries.columns:  # saved before there was one
        entries = entries.withColumn("off", F.lit(None).cast("double"))
    return Index(settings, base, part("centroids"), part("codebooks"), entries, stored=True)


def build_index(base: DataFrame, name: str, clusters: int, id_col: str = "id", vec_col: str = "vec", base_name: str = "", subspaces: int = quantize.SUBSPACES, codewords: int = quantize.CODEWORDS, seed: int = 42, share: float = TRAIN_SHARE, least: int = LEAST_TRAINING, most: int = MOST_TRAINING, validate: bool = False, centroids: DataFrame | None = None, codebooks: DataFrame | None = None, keep: Sequence[str] = ()) -> Index:
    """Trains on a sample and encodes every row. Rows with a null id or an unusable vector, or of another dimension than the
    first trained one, raise nothing and are left out; `validate` makes repeated ids an error. Training can be skipped by giving
    centroids or codebooks. Columns to `keep` are stored with the entries, so that predicates over them need no join."""
    ship(base.sparkSession)
    vec = as_vector(F.col(vec_col))
    first = base.filter(usable(vec)).select(F.size(vec)).first()
    if first is None:
        raise ValueError("there is no vector to index")
    dim = int(first[0])
    quantize.width(dim, subspaces)
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(None).cast("boolean").alias("_"))
    rows = base.filter(F.col(id_col).isNotNull() & usable(vec, dim)).select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"), kept.alias("kept"))
    if validate and rows.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("ids repeat")
    training = training_rows(rows, "id", share, seed, least, most).persist()  # at most about `most` rows
    if centroids is None:
        centroids = cluster.train_centroids(training, clusters, seed)
    if codebooks is None:
        codebooks = quantize.train_codebooks(training, dim, subspaces, codewords)
    spark = base.sparkSession
    book, points = quantize.book_array(codebooks), cluster.centroid_array(centroids)
    training.unpersist()
    centroids = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(points)], "cluster_id int, centroid array<float>")
    fixed = spark.createDataFrame([(m, k, [float(x) for x in v]) for m, ks in enumerate(book) for k, v in enumerate(ks)], quantize.BOOK)
    index = Index(Settings(name, base_name, id_col, vec_col, dim, len(points), subspaces, book.shape[1]), base, centroids, fixed, entries(rows, book, points))
    index._book, index._points = book, points
    return index


def entries(rows: DataFrame, book: np.ndarray, points: np.ndarray) -> DataFrame:
    """(cluster_id, id, code, vec, off, kept) of rows (id, vec, kept), in one pass over the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), points.shape[1])
            at, code = nearest(x, points).astype(np.int32), quantize.codes_of(x, book).astype(np.int16)
            off = np.sqrt(pair_distances(x, quantize.decoded(code, book)))
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0), pa.array(list(code), pa.list_(pa.int16())), b.column(1), pa.array(off), b.column(2)], ["cluster_id", "id", "code", "vec", "off", "kept"])

    kind = rows.schema["kept"].dataType.simpleString()
    return rows.select("id", "vec", "kept").mapInArrow(run, f"cluster_id int, id bigint, code array<smallint>, vec array<float>, off double, kept {kind}")


@dataclass(frozen=True)
class Search:
    """A search in the making: predicates are recorded, and restrict the candidates when topk makes the plan."""

    index: Index
    vector: tuple[float, ...]
    predicates: tuple[Column | str, ...] = ()
    allowed: tuple[Sequence[int] | DataFrame, ...] = ()
    clusters: int | None = None
    shortlist: int = RERANK
    fallback: bool = False
    joined: bool = False
    whole: bool = False

    def where(self, predicate: Column | str) -> Search:
        return replace(self, predicates=(*self.predicates, predicate))

    def ids(self, allowed: Sequence[int] | DataFrame) -> Search:
        return replace(self, allowed=(*self.allowed, allowed))

    def probe(self, clusters: int) -> Search:
        if clusters < 0:
            raise ValueError("nprobe is negative")
        return replace(self, clusters=clusters)

    def rerank(self, shortlist: int) -> Search:
        return replace(self, shortlist=checked_k(shortlist))

    def exact_without_code(self) -> Search:
        """Entries whose code is null or outside the codebooks take part by their exact distance; otherwise they come last."""
        return replace(self, fallback=True)

    def current(self) -> Search:
        """The shortlist is re-ranked by the base as it is now: rows that it has lost drop out, changed vectors count as they are."""
        return replace(self, joined=True)

    def complete(self) -> Search:
        """The true nearest of the entries that the search allows, whatever the shortlist: see certain. Not together with current,
        as codes say nothing of changed vectors (there is exact_knn for that)."""
        return replace(self, whole=True)

    def _allowed(self) -> DataFrame:
        rows = self.index.allowed(self.predicates, self.allowed)
        if self.clusters is not None:
            rows = rows.filter(cluster.among(cluster.probed(self.index.points, self.vector, self.clusters)))
        return rows

    def candidates(self) -> DataFrame:
        """(id, approximate): table-lookup distance of each entry that the search allows, in column functions."""
        approximate = quantize.lookup_distance(F.col("code"), quantize.query_table(self.index.book, self.vector))
        if self.fallback:
            approximate = F.coalesce(approximate, squared_l2_to(F.col("vec"), self.vector))
        return self._allowed().select("id", approximate.alias("approximate"))

    def nearest(self, k: int) -> DataFrame:
        """(id, score double), nearest first, the lower id first among equals.

        Each task keeps the best of its entries by code, with their exact distances, so that one plan does it. A search of all
        clusters of a stored index reads the codes alone first (that job runs at once), and then the vectors of its shortlist by
        cluster and id. If it is complete, the k-th of these is a bound, and the codes are read again for the entries that may be as
        near: up to IN_LIST are read by cluster and id too, and for more the entries are read once, with their vectors."""
        s, rows = self.index.settings, self._allowed()
        table, point, one, most = quantize.query_table(self.index.book, self.vector)[:, :, None], np.array([self.vector]), np.zeros(1, np.int64), self.shortlist
        ship(rows.sparkSession)
        if self.whole and self.joined:
            raise ValueError("a complete search can't be current")
        reach = np.inf
        if self.clusters is None and self.index.stored and most <= IN_LIST and not (self.joined or self.fallback):
            named = rows.select("cluster_id", "id", "code").mapInArrow(lambda it: nominated(it, table, most), "cluster_id int, id bigint, approximate double")
            few = self._named(named.orderBy("approximate", "id").limit(most).collect(), one, point, k)
            if not self.whole:
                return few
            if 0 < k <= most and len(known := few.collect()) == k:
                reach = known[-1]["score"]
                near = rows.select("cluster_id", "id", "code", "off").mapInArrow(lambda it: reachable(it, table, reach), "cluster_id int, id bigint").limit(IN_LIST + 1).collect()
                if len(near) <= IN_LIST:
                    return self._named(near, one, point, k)
        if self.whole:
            return first_k(rows.select("cluster_id", "id", "code", "vec", "off").mapInArrow(lambda it: certain(it, one, point, table, None, k, reach), FOUND).select("id", "score"), k)
        fallback = self.fallback
        short = rows.select("cluster_id", "id", "code", "vec").mapInArrow(lambda it: shortlisted(it, one, point, table, None, most, fallback), FOUND + ", approximate double")
        short = short.orderBy("approximate", "id").limit(most)
        if self.joined:
            ids = short.select(F.col("id").alias("_short"))
            met = self.index.base.join(F.broadcast(ids), F.col(s.id_col).cast("bigint") == F.col("_short"), "left_semi")  # the shortlist bounds it
            return first_k(scored(met, self.vector, s.id_col, s.vec_col), k)
        return first_k(short.select("id", "score"), k)

    def _named(self, found: Sequence[Row], one: np.ndarray, point: np.ndarray, k: int) -> DataFrame:
        """The k nearest of the entries (cluster_id, id) that were found, which are read by cluster and id."""
        few = self.index.entries.filter(cluster.among(r["cluster_id"] for r in found)).filter(f"id IN ({', '.join(str(r['id']) for r in found) or 'NULL'})")
        return first_k(few.select("id", "vec").mapInArrow(lambda it: best_exact(it, one, point, k), FOUND).select("id", "score"), checked_k(k))

    def topk(self, k: int) -> DataFrame:
        """The same with the score in single precision."""
        return self.nearest(k).select("id", F.col("score").cast("float").alias("score"))
