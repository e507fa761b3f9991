"""The folder that all executors share, the tables written there and their removal, and the package's code for the executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("quillon_scopes", default=())
_LEFT: list[tuple[SparkSession, str]] = []


def one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def temporary(spark: SparkSession, prefix: str, setting: str) -> str:
    """A new folder of this machine for local mode; on a cluster other executors couldn't read it, so there it raises."""
    if not one_machine(spark):
        raise ValueError(f"set {setting} to a folder that all executors of this cluster share")
    return f"file://{tempfile.mkdtemp(prefix=prefix)}"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one in local mode's temporary folder."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or temporary(spark, "quillon-", "spark.checkpoint.dir")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses. It is removed when the innermost open scope ends, or with the driver."""
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if scopes := _OPEN.get():
        scopes[-1].append(at)
    else:
        _LEFT.append((spark, at))
    return at


def _opened(spark: SparkSession, at: str) -> tuple[object, object]:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def exists(spark: SparkSession, at: str) -> bool:
    fs, path = _opened(spark, at)
    return fs.exists(path)


def remove(spark: SparkSession, at: str) -> None:
    fs, path = _opened(spark, at)
    fs.delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what operators wrote to the shared folder inside. Their results read those tables lazily, so they are
    to be written elsewhere, or collected, before it ends."""
    own: list[str] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for at in own:
            remove(spark, at)


@atexit.register
def _release() -> None:
    for spark, at in _LEFT:
        try:
            remove(spark, at)
        except Exception:  # noqa: BLE001  the session has ended before the interpreter
            return


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    at = scratch(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(at)
    return spark.read.schema(df.schema).parquet(at) if not by else spark.read.parquet(at)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package: on a cluster always, in local mode where it isn't on their path. The archive is
    made in the driver's temporary folder, from where Spark itself sends it to the executors."""
    known = [os.path.realpath(p or ".") for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]]
    sc = spark.sparkContext
    if (str(ROOT) not in known or not sc.master.startswith("local[")) and getattr(sc, "_quillon_shipped", None) is None:
        at = os.path.join(tempfile.mkdtemp(prefix="quillon-src-"), "quillon_src.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted((ROOT / "quillon").rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
        sc.addPyFile(at)
        sc._quillon_shipped = at
    return spark


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it, in whatever case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
