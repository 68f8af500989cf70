"""The folder that all executors share, and tables written to it."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or what the context was given. Where neither is set, a
    local session gets a temporary one; on a cluster no machine's own folder would do, so that is an error."""
    sc = spark.sparkContext
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not sc.getCheckpointDir():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return sc.getCheckpointDir().rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """shared_root(), set as the context's checkpoint folder if it has none."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return spark.sparkContext.getCheckpointDir()


def remember(path: str, spark: SparkSession) -> None:
    """Have a folder deleted when the program ends, if drop() does not do so before."""
    _WRITTEN[path] = spark


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: what several plans start from is computed once,
    lineage ends here, and a lost executor costs no recomputation. The files go by drop(), or when the program ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    remember(path, spark)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that no plan still to be run reads."""
    for df in tables:
        if path := getattr(df, "_quarry_path", None):
            _delete(path, df.sparkSession)
            _WRITTEN.pop(path, None)


def _delete(path: str, spark: SparkSession) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_WRITTEN.items()):
        with contextlib.suppress(Exception):  # the session may be gone already
            _delete(path, spark)
