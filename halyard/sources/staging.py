"""Tables written between stages: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir. Where it is unset a local session gets a
    temporary one; a cluster gets an error, as its machines don't see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='halyard-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as a table in the shared folder and read from it. The table stays until `discard` or the end of the process."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(discard_all)
    _WRITTEN[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._halyard_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes staged tables that nothing will read any more."""
    for df in tables:
        path = getattr(df, "_halyard_path", None)
        if path in _WRITTEN:
            _remove(_WRITTEN.pop(path), path)


def discard_all() -> None:
    """Removes all that was staged, as far as the sessions still live."""
    while _WRITTEN:
        path, spark = _WRITTEN.popitem()
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
