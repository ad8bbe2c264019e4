"""Session helpers: table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir; a folder of our own only where none is set (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or own_folder(spark, "checkpoint"))


def own_folder(spark: SparkSession, name: str) -> str:
    """A temporary folder of this machine, removed when the process ends; only for a local master, as no other machine could read it."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    path = tempfile.mkdtemp(prefix=f"tessera-{name}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table of passing use: in the shared checkpoint folder where the cluster names one, else a local one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    root = f"{shared.rstrip('/')}/scratch" if shared else own_folder(spark, "scratch")
    return f"{root}/{name}-{os.urandom(4).hex()}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder, so that later jobs neither recompute it nor lose it with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def attach(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row DataFrame, as a scalar subquery (null where it has no row): no join at all."""
    row = one.select(F.struct("*").alias("__one")).scalar()
    return df.withColumn("__one", row).withColumns({c: F.col(f"__one.{c}") for c in one.columns}).drop("__one")


_KEPT: dict[tuple, DataFrame] = {}


def fingerprint(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, newest change) of the files under a path, on whatever file system it is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    size, newest = 0, fs.getFileStatus(hadoop).getModificationTime()
    files = fs.listFiles(hadoop, True)
    while files.hasNext():
        f = files.next()
        size, newest = size + f.getLen(), max(newest, f.getModificationTime())
    return size, newest


def remembered(spark: SparkSession, name: str, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, made once for as long as the files under ``path`` stay as they are, and kept in the checkpoint folder.

    For small lookup relations that many queries share; an older form is dropped when the files change."""
    key, state = (spark.sparkContext.applicationId, name, path), fingerprint(spark, path)
    for old in [k for k in _KEPT if k[:3] == key and k[3] != state or k[0] != key[0]]:
        del _KEPT[old]
    if (*key, state) not in _KEPT:
        _KEPT[*key, state] = cut(build())
    return _KEPT[*key, state]
