"""An index as a directory of Parquet tables, and evaluation results as files."""

from __future__ import annotations

import datetime
import json
import os
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from quarry.settings import Settings

VERSION = 1
TABLES = ("chunks", "manifest", "symbols", "calls", "imports", "vectors", "postings", "docs", "terms", "nodes", "edges")


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], settings: Settings, repo: str = "repo", git_sha: str = "nogit") -> None:
    """Postings are sorted by term within files, so that a look-up skips most row groups."""
    for name, df in tables.items():
        out = df.sortWithinPartitions("term") if name in ("postings", "terms") else df
        out.write.mode("overwrite").parquet(f"{path}/{name}")
    meta = spark.createDataFrame([(VERSION, repo, git_sha, json.dumps(asdict(settings)))], "version int, repo string, git_sha string, settings string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, settings: Settings | None = None) -> tuple[dict[str, DataFrame], Settings]:
    """The tables (read when used) and the settings they were built with, unless others are given."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != VERSION:
        raise RuntimeError(f"index version {meta['version']}; this library reads {VERSION}. Build the index again.")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [t for t in TABLES if fs_path(f"{path}/{t}").getFileSystem(conf).exists(fs_path(f"{path}/{t}"))]
    return {t: spark.read.parquet(f"{path}/{t}") for t in there}, settings or Settings(**json.loads(meta["settings"]))


def save_results(root: str, summary: str, results: list[dict], stamp: str | None = None) -> str:
    """summary.md and results.json in a folder named by the time; returns the folder. For the driver's own disk."""
    out = os.path.join(root, stamp or datetime.datetime.now(datetime.UTC).strftime("%Y%m%d-%H%M%S"))
    os.makedirs(out, exist_ok=True)
    with open(os.path.join(out, "summary.md"), "w", encoding="utf-8") as f:
        f.write(summary)
    with open(os.path.join(out, "results.json"), "w", encoding="utf-8") as f:
        json.dump(results, f, indent=1)
    return out


MARKER = "// ---- scaffolded below; edits are replaced ----"


def update_golden(path: str, rows: list[dict]) -> None:
    """Replace what follows the marker of a question file, keeping what precedes it; the file changes at once or not."""
    kept = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            kept = f.read().split(MARKER)[0].rstrip("\n")
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write("\n".join([*([kept] if kept else []), MARKER, *(json.dumps(r, ensure_ascii=False) for r in rows)]) + "\n")
    os.replace(tmp, path)
