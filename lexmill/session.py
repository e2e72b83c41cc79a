"""Session helpers: lineage cuts in the folder all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a context, unless it stands on their path or came in an archive itself."""
    context, root = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_lexmill_shipped", False):
        return
    context._lexmill_shipped = True
    if not os.path.isdir(root) or os.path.dirname(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="lexmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "lexmill.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for where, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(where, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)  # the driver serves it to the executors


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode when the setting is absent."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lexmill-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def spread(df: DataFrame) -> DataFrame:
    """df itself, or, where it arrives in fewer partitions than there are cores (one small file), spread over all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): survives the loss of executors."""
    ship(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back: a columnar, compressed lineage cut.

    The files stay until release() is called or the driver's process ends, as lazy results read them.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _STORED:
        atexit.register(_drop_all, spark)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Settings of stored_by(): rows arrive bucket by bucket, so that no sort is needed before they are written.
_BUCKETED = {"spark.sql.maxConcurrentOutputFileWriters": "4", "spark.sql.parquet.compression.codec": "zstd"}


def stored_by(df: DataFrame, key: str) -> DataFrame:
    """stored(), in as many buckets by key as a shuffle has partitions: groups and windows by key read it without a shuffle.

    df should come from rows repartitioned by key into that many. The table stands in the session's catalog until it is dropped.
    """
    spark = df.sparkSession
    ship(spark)
    name = f"lexmill_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    with setting(spark, _BUCKETED):
        df.write.bucketBy(buckets(spark), key).format("parquet").option("path", path).saveAsTable(name)
    if not _STORED:
        atexit.register(_drop_all, spark)
    _STORED.append(path)
    return spark.table(name)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def setting(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings, put back at the end."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written() -> set[str]:
    """Where the tables lie that are stored at the moment."""
    return set(_STORED)


def drop(spark: SparkSession, paths: set[str]) -> None:
    """Drop some of written(), once no lazy result reads them any more."""
    for path in paths:
        _STORED.remove(path)
        _remove(spark, path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """stored() of what is made, without the tables that were stored on the way to it."""
    before = written()
    rows = make()
    way = written() - before
    out = stored(rows)
    drop(rows.sparkSession, way)
    return out


def release(spark: SparkSession) -> int:
    """Drop all tables that stored() has written and the checkpoints of this session; returns the number of tables.

    To be called between queries of a long session, once their results have been taken: lazy results made before it fail.
    """
    dropped = len(_STORED)
    _drop_all(spark)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(known.get())
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(path):
            for one in system.listStatus(path):
                if one.getPath().getName().startswith("rdd-"):
                    system.delete(one.getPath(), True)
    return dropped


def _drop_all(spark: SparkSession) -> None:
    while _STORED:
        _remove(spark, _STORED.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        if (name := path.rsplit("/", 1)[-1]).startswith("lexmill_"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone by then
        if path.startswith("file://"):
            shutil.rmtree(path[7:], ignore_errors=True)
