"""Sharding by size-tiered compaction, in DataFrame operations only.

Arrivals are appended as small immutable shards (Parquet files of a folder each). A shard's tier is the power of `fanout` in its
size over the smallest shard size; whenever a tier holds `fanout` runs, they are merged into one run, cut into files of about
the target size. Each step commits a manifest version that lists the live runs and their files. The manifest is written beside its
place and then moved there by an operation that fails if the place is taken, so that one writer wins a version and the others
take up its manifest and try the next: a hard link on a local disk, a rename without overwriting where the file system has it
(HDFS and stores with atomic renames). On object stores without one a commit raises. Readers take the highest version, and see all
of a step or nothing. Old runs stay for readers of older versions until `vacuum` removes them.

All rows and columns are kept as they are, with nulls, repeated rows, empty and very long texts; rows have no order in which they
could tie. Further columns may have any name. An empty table leaves no shard, and the query no row.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import text_hash
from quillon.shared import fresh, remove, scratch

ARRIVALS, FANOUT, TARGET_BYTES, LEAST_BYTES = 8, 4, 128 << 20, 1 << 20
#: File systems whose rename is atomic and can refuse to overwrite.
ATOMIC = {"hdfs", "viewfs", "abfs", "abfss", "wasb", "wasbs"}


class Taken(RuntimeError):
    """Another writer has made the version."""


class ShardStore:
    """A folder of immutable runs with a versioned manifest."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, target_bytes: int = TARGET_BYTES, least_bytes: int = LEAST_BYTES) -> None:
        self.spark, self.root, self.fanout, self.target, self.least = spark, root.rstrip("/"), fanout, target_bytes, least_bytes
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> list[dict]:
        """The live runs of a version, or of the last: name, tier, bytes, files."""
        v = self.version() if version is None else version
        if not v:
            return []
        text = self.spark.read.text(f"{self.root}/manifest/v{v:08d}.json", wholetext=True).first()[0]
        return json.loads(text)["runs"]

    def commit(self, runs: list[dict], after: int) -> int:
        """Version after + 1; raises Taken if another writer has made it."""
        v = after + 1
        draft, place = self._path(f"{self.root}/manifest/.draft-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/v{v:08d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": v, "runs": runs}).encode()))
        out.close()
        try:
            self._publish(draft, place)
        except FileExistsError:
            raise Taken(f"version {v} is there already") from None
        finally:
            self._fs.delete(draft, False)
        return v

    def _publish(self, draft: object, place: object) -> None:
        kind = self._fs.getUri().getScheme()
        if kind == "file":
            os.link(draft.toUri().getPath(), place.toUri().getPath())
        elif kind in ATOMIC:
            fs = self.spark._jvm.org.apache.hadoop.fs
            none = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
            try:
                fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf()).rename(draft, place, none)
            except Exception as e:
                if self._fs.exists(place):
                    raise FileExistsError from e
                raise
        else:
            raise ValueError(f"{kind} has no rename that refuses to overwrite; keep the shards where manifests can be committed")

    def _update(self, change: Callable[[list[dict]], list[dict] | None], tries: int = 100) -> bool:
        """Commits what change makes of the manifest, again on the new one if another writer was first; False if it gives None."""
        for _ in range(tries):
            version = self.version()
            runs = change(self.manifest(version))
            if runs is None:
                return False
            try:
                self.commit(runs, version)
                return True
            except Taken:
                continue
        raise RuntimeError(f"no version could be committed in {tries} tries")

    def _run(self, name: str) -> dict | None:
        """The description of a written folder; none if it has no rows' file."""
        files = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(f"{self.root}/{name}")) if s.getPath().getName().endswith(".parquet")]
        if not files:
            return None
        size = sum(n for _, n in files)
        return {"name": name, "tier": max(0, math.floor(math.log(max(size, self.least) / self.least, self.fanout))), "bytes": size, "files": sorted(f for f, _ in files)}

    def append(self, arrival: DataFrame) -> None:
        """An arrival becomes a run; then tiers that are full are merged."""
        name = f"run-{uuid.uuid4().hex}"
        arrival.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        self.adopt(name)

    def adopt(self, name: str) -> None:
        """Takes a folder that is already written below the root."""
        if run := self._run(name):
            self._update(lambda runs: [*runs, run])
        self.compact()

    def compact(self) -> None:
        while True:
            tiers: dict[int, list[dict]] = {}
            for r in self.manifest():
                tiers.setdefault(r["tier"], []).append(r)
            full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
            if full is None:
                return
            old = tiers[full][: self.fanout]
            name, files = f"run-{uuid.uuid4().hex}", max(1, round(sum(r["bytes"] for r in old) / self.target))
            self.read(old).coalesce(files).write.option("compression", "zstd").parquet(f"{self.root}/{name}")
            gone = {r["name"] for r in old}
            merged = self._run(name)
            merged["tier"] = max(merged["tier"], full + 1)

            def swap(runs: list[dict]) -> list[dict] | None:
                left = [r for r in runs if r["name"] not in gone]
                return [*left, merged] if len(left) == len(runs) - len(gone) else None

            if not self._update(swap):  # another writer has merged some of them
                remove(self.spark, f"{self.root}/{name}")

    def vacuum(self, versions: int = 10, hours: float = 24.0) -> None:
        """Removes what none of the last `versions` versions lists, so readers of those aren't disturbed: older manifests, their
        runs, and folders of at least `hours` of age that no manifest ever listed (attempts that failed)."""
        last = self.version()
        keep = [v for v in range(max(1, last - versions + 1), last + 1)]
        live = {r["name"] for v in keep for r in self.manifest(v)}
        known: set[str] = set()
        for s in self._fs.listStatus(self._path(f"{self.root}/manifest")):
            n = s.getPath().getName()
            if n.startswith("v") and n.endswith(".json") and int(n[1:-5]) not in keep:
                known |= {r["name"] for r in self.manifest(int(n[1:-5]))}
                self._fs.delete(s.getPath(), False)
        old = {s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("run-") and s.getModificationTime() < (time.time() - hours * 3600) * 1000}
        for name in (known | old) - live:
            remove(self.spark, f"{self.root}/{name}")

    def read(self, runs: list[dict] | None = None) -> DataFrame | None:
        runs = self.manifest() if runs is None else runs
        return self.spark.read.parquet(*(f"{self.root}/{r['name']}/{f}" for r in runs for f in r["files"])) if runs else None


def sharded(docs: DataFrame, arrivals: int = ARRIVALS, fanout: int = FANOUT, target_bytes: int = TARGET_BYTES, least_bytes: int = LEAST_BYTES) -> ShardStore:
    """A store that docs came to in `arrivals` parts, by a hash of doc_id and text; parts are written in one pass."""
    spark = docs.sparkSession
    root = scratch(spark, "shards")
    store = ShardStore(spark, root, fanout, target_bytes, least_bytes)
    part = F.pmod(F.hash("doc_id", text_hash(docs)), F.lit(arrivals)).cast("int")
    (arrival,) = fresh(docs.columns, "arrival")
    docs.withColumn(arrival, part).write.partitionBy(arrival).option("compression", "zstd").parquet(f"{root}/arrived")
    for k in range(arrivals):
        name = f"arrived/{arrival}={k}"
        if store._fs.exists(store._path(f"{root}/{name}")):
            store.adopt(name)
            store.vacuum(1)  # nobody else reads this store yet
    return store


def shard_of_documents(docs: DataFrame, **params: int) -> DataFrame:
    """(doc_id, n_chars, tier, shard, run, version): the live shard of each row, read back through the manifest."""
    store = sharded(docs, **params)
    runs = store.manifest()
    live = store.read(runs)
    spark = docs.sparkSession
    if live is None:
        return spark.createDataFrame([], "doc_id long, n_chars long, tier int, shard string, run string, version int")
    kind = "version int, runs array<struct<name string, tier int, files array<string>>>"
    listed = spark.read.schema(kind).json(f"{store.root}/manifest/v{store.version():08d}.json", multiLine=True)
    files = listed.selectExpr("version", "explode(runs) AS r").selectExpr("version", "r.tier AS tier", "element_at(split(r.name, '/'), -1) AS run", "explode(r.files) AS shard")
    at = F.substring_index(live.metadataColumn("_metadata")["file_path"], "/", -2)
    rows = live.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), at.alias("_file"))
    return rows.join(files, F.col("_file") == F.concat_ws("/", "run", "shard")).select("doc_id", "n_chars", "tier", "shard", "run", "version")
