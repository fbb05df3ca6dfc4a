"""Intermediate tables in the folder that driver and executors share, and joins on keys that may be hot."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_swept: set[str] = set()

#: A key is hot if it has more than this part of all rows, so there are no more hot keys than this number.
HOT_PARTS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where none is named, which is an error on a cluster, local sessions get a temporary folder of
    their own, removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.applicationId not in _own_dirs:
        _own_dirs[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="basketry-")
        atexit.register(shutil.rmtree, _own_dirs[spark.sparkContext.applicationId], ignore_errors=True)
    return _own_dirs[spark.sparkContext.applicationId]


def _path(spark: SparkSession, path: str):
    """The JVM's path object and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what an application left there goes when it ends."""
    home = f"{shared_dir(spark)}/basketry/{spark.sparkContext.applicationId}"
    if home not in _swept:
        where, files = _path(spark, home)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _swept.add(home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage.

    Lost executors cost no recomputation of what is written.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for ``df``, when nothing reads it any more."""
    if path := getattr(df, "_stored_at", None):
        where, files = _path(df.sparkSession, path)
        files.delete(where, True)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, one row per key, that no hot key sends to one task.

    ``weight``, a column of ``table``, says how many of ``total`` rows have the key; it is dropped.
    Keys with more than a ``HOT_PARTS``-th of all rows are ``HOT_PARTS`` at most, so their part of
    the table is broadcast; the other rows are shuffled. The table is written, if it isn't, so that
    it is made once.
    """
    table = table if getattr(table, "_stored_at", None) else materialize(table, "keys")
    is_hot = F.col(weight) * HOT_PARTS > total
    hot, cold = table.filter(is_hot).drop(weight), table.filter(~is_hot).drop(weight)
    if not hot.take(1):
        return rows.join(cold, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)
