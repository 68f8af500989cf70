"""A small local session, and a comparison of a query with its SQL in DuckDB."""

import os
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def session(warehouse: str, cores: int = 4) -> SparkSession:
    here = Path(__file__).resolve()
    os.environ["PYTHONPATH"] = f"{here.parents[1]}:{here.parent}:{os.environ.get('PYTHONPATH', '')}"
    s = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", warehouse)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def oracle(sql: str, sf: str = SF) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(sql).fetchdf()


def _plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
        return _plain(x) if not isinstance(x, list) else str([_plain(v) for v in x])
    if isinstance(x, (list, tuple)):
        return str([_plain(v) for v in x])
    if x is pd.NaT:
        return None
    return x


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(_plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=str)


def same(spark_df, sql: str, sf: str = SF) -> int:
    """Compare, and return the number of rows."""
    got, want = spark_df.toPandas(), oracle(sql, sf)
    assert sorted(got.columns) == sorted(want.columns), (sorted(got.columns), sorted(want.columns))
    a, b = rows(got), rows(want)
    assert len(a) == len(b), f"{len(a)} rows, not {len(b)}"
    for x, y in zip(a, b, strict=True):
        assert x == y, f"{x} is not {y}"
    return len(a)
