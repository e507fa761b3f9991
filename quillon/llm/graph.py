"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.shared import remove, scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    return both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).filter("src <> dst").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("low"))
    moved = down.join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(least.select("src", F.col("low").alias("dst"))).filter("src <> dst").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (src, dst): root is the least node that it reaches; nodes without an edge to
    another are left out. Each round is a table in the shared folder, so lineage stays short and a lost executor costs one round;
    the table of the round before goes as soon as the next is there. Without an edge there is no round."""
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[str, DataFrame, tuple]:
        at = scratch(spark, "components")
        df.write.option("compression", "zstd").parquet(at)
        df = spark.read.schema(df.schema).parquet(at)
        return at, df, tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0))).first())

    at, now, seen = kept(edges.select("src", "dst").filter("src <> dst").distinct())
    for _ in range(rounds if seen[0] else 0):
        old, before = at, seen
        at, now, seen = kept(_small(_large(now)))
        remove(spark, old)
        if seen == before:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
