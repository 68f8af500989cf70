"""What the operators share: rows with keys of their own, checked broadcasts, and connected components."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.shared import drop, remember, shared_root, staged

__all__ = ["bounded", "components", "drop", "keyed", "remember", "rested", "shared_root", "staged"]

#: Rows and bytes up to which a side of a join is broadcast; it is measured first, and beyond this the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000


def keyed(df: DataFrame, name: str = "rows", key: str = "row_key") -> DataFrame:
    """df, staged, with a key of its own for every row (a long made of partition and position). Operators tell rows
    apart by it, so null ids, repeated ids and ids that stand for different texts are rows like any others."""
    return staged(df.withColumn(key, F.monotonically_increasing_id()), name)


def rested(spark: SparkSession) -> None:
    """Between steps of many plans: have Python and the driver's JVM give back memory of plans that are done; Spark
    then also deletes the shuffle files and broadcasts that no plan needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if it has at most that many rows and bytes (as JSON), else df as it is; and whether it
    was hinted."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.select(width.alias("width")).limit(rows + 1).agg(F.count("*"), F.sum("width")).first()
    small = n <= rows and (total or 0) <= size
    return (F.broadcast(df) if small else df), small


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) for every vertex of an edge: component_id is the least vertex that can be reached.

    Alternating large-star and small-star steps; each keeps at most as many edges as it got, so a hub of any degree
    stays a set of rows, and the number of rounds is logarithmic. Every round is written to the shared folder."""
    e = staged(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v <> u").distinct(), "edges")
    seen = None
    while True:
        large = _large_star(e)
        nxt = staged(_small_star(large), "edges")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        drop(e)
        e = nxt
        if tuple(now) == seen:
            break
        seen = tuple(now)
    # a forest of stars: every v points at its root
    roots = e.select(F.col("u").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    out = e.select(F.col("v").alias("id"), F.col("u").alias("component_id")).unionByName(roots)
    out._quarry_path = e._quarry_path  # for drop()
    return out


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("v", "u").unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
    return both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("v").agg(F.min("u").alias("m"))
    moved = e.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.unionByName(least.select("v", F.col("m").alias("u"))).distinct()
