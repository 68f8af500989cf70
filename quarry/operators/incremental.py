"""Updates of an index by content: what changed between two manifests, and tables with the change applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(before: DataFrame, after: DataFrame, key: str = "file_path", sha: str = "content_sha") -> DataFrame:
    """(key, change): added, modified or deleted."""
    a, b = before.select(key, F.col(sha).alias("_a")), after.select(key, F.col(sha).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def git_changes(lines: DataFrame, line: str = "value") -> DataFrame:
    """(file_path, change) of lines as `git diff --name-status` writes them; a rename deletes one file and adds another,
    a copy adds one."""
    p = F.split(line, "\t")
    status = F.substring(F.get(p, F.lit(0)), 1, 1)
    pair = lambda i, change: F.struct(F.get(p, F.lit(i)).alias("file_path"), F.lit(change).alias("change"))
    rows = (
        F.when(status == "A", F.array(pair(1, "added")))
        .when(status.isin("M", "T"), F.array(pair(1, "modified")))
        .when(status == "D", F.array(pair(1, "deleted")))
        .when(status == "R", F.array(pair(1, "deleted"), pair(2, "added")))
        .when(status == "C", F.array(pair(2, "added")))
    )
    return lines.select(F.explode(rows).alias("r")).select("r.*").where("file_path IS NOT NULL")


def apply(table: DataFrame, diff: DataFrame, fresh: DataFrame, key: str = "file_path") -> DataFrame:
    """table without rows of changed keys, with those of fresh whose key was added or modified."""
    left = table.join(diff.select(key), key, "left_anti")
    return left.unionByName(fresh.join(diff.where("change <> 'deleted'").select(key), key, "left_semi"))


def latest(manifest: DataFrame, key: str = "file_path", at: str = "version") -> DataFrame:
    """The last row of each key."""
    columns = [c for c in manifest.columns if c != key]
    best = manifest.groupBy(key).agg(F.max_by(F.struct(*columns), at).alias("r"))
    return best.select(key, *[F.col("r")[c].alias(c) for c in columns])


def summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"))
