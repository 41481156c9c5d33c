"""Tables between stages: the folder that driver and executors share, and what is written there."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "lectern-"
_local: dict[str, str] = {}
#: Paths handed out in the innermost lifetime of the running thread.
_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, or one of our own where none is set and all run in one process (tests)."""
    if known := spark.conf.get("spark.checkpoint.dir", None):
        return known.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: operators write tables to a folder that driver and executors share")
    return _local.setdefault("dir", tempfile.mkdtemp(prefix=_PREFIX))


def new_path(spark: SparkSession) -> str:
    """A path of this application that nothing has; it goes with the ``lifetime`` that it is made in."""
    path = f"{shared_dir(spark)}/{_PREFIX}{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    if (owned := _owned.get()) is not None:
        owned.append(path)
    return path


@contextmanager
def lifetime(spark: SparkSession, keep: bool = False) -> Iterator[list[str]]:
    """Deletes what was written inside when it ends, however it ends, unless it is to be kept.

    Results are lazy and read such tables, so they are consumed inside. Lifetimes may be
    nested: what is kept by an inner one belongs to the outer one. Threads have their own.
    """
    outer, paths = _owned.get(), []
    token = _owned.set(paths)
    try:
        yield paths
    finally:
        _owned.reset(token)
        if not keep:
            for path in paths:
                delete(spark, path)
        elif outer is not None:
            outer.extend(paths)


def sweep(spark: SparkSession, idle: float) -> int:
    """Deletes what other applications left in the shared folder and nobody has changed for so many seconds; how many tables.

    For what is left by drivers that were killed; ``idle`` has to exceed the run time of any that is alive.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    own, n = f"{_PREFIX}{spark.sparkContext.applicationId}-", 0
    for found in files.listStatus(place) if files.exists(place) else ():
        name = found.getPath().getName()
        if name.startswith(_PREFIX) and not name.startswith(own) and found.getModificationTime() < (time.time() - idle) * 1000:
            files.delete(found.getPath(), True)
            n += 1
    return n


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame, keep: bool = False) -> None:
    """Deletes tables that were ``written`` and that no later result reads, unless they are to be kept."""
    for table in () if keep else tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if folder.rpartition("/")[2].startswith(_PREFIX):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole, unless there is one of that name: of several writers one succeeds.

    A local file is linked to its name, elsewhere it is renamed by the file system's own
    rename that replaces nothing.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    place, new = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    files = place.getFileSystem(conf)
    files.mkdirs(place.getParent())
    out = files.create(new, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if files.getScheme() == "file":
            local = [unquote(urlparse(files.makeQualified(p).toString()).path) for p in (new, place)]
            try:
                os.link(*local)
            except FileExistsError:
                return False
            return True
        try:
            # Without options the rename replaces nothing.
            hadoop.FileContext.getFileContext(place.toUri(), conf).rename(new, place, spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:  # noqa: BLE001 (how Java's exceptions come through)
            if files.exists(place) and "Exists" in str(error):
                return False
            raise
        return True
    finally:
        files.delete(new, False)
