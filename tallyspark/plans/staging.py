"""Written intermediate tables: the shared folder of a cluster, and lineage cut by Parquet."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a folder of our own.

    The fallback is a temporary folder in local mode (one machine, as in tests). A cluster that names no folder is refused: a
    path that every machine has for itself would lose data without an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tally-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_forget)
    _made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def _forget() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone already; the shared folder's owner clears it
            return


@contextlib.contextmanager
def intermediates():
    """What is written within it is deleted when it ends: for work whose result has been written by then."""
    before = len(_made)
    yield
    for spark, path in _made[before:]:
        _delete(spark, path)
    del _made[before:]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back. Survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file through the file system of its path."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data))
    out.close()
