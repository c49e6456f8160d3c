"""Tables written to the folder that all executors share, so that a lost executor loses nothing and a plan's lineage is cut.

An application's tables lie in one folder of its own, which goes when the application ends. What is no longer read
may go sooner: drop() removes single tables, written() what a step wrote on its way to its result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Paths written by this process and not removed yet, and the tables read from them.
_PATHS: set[str] = set()
_OF: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: What the innermost written() of this thread has kept so far; other threads have lists of their own.
_WITHIN: ContextVar[list[str] | None] = ContextVar("within", default=None)


def scratch(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where the session names none (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        place = tempfile.mkdtemp(prefix="platelume-")
        spark.sparkContext.setCheckpointDir(place)
    return place


def _at(spark: SparkSession, path: str):
    """(Hadoop's file system, its path object)"""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def folder(spark: SparkSession) -> str:
    """This application's own folder; Hadoop removes it when the driver ends."""
    place = f"{scratch(spark)}/platelume/{spark.sparkContext.applicationId}"
    fs, where = _at(spark, place)
    if not fs.exists(where):
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return place


def apart(df: DataFrame) -> DataFrame:
    """df, whose next join shuffles and sorts both sides. Pixels compress to hundreds of times less than they are, and lines and columns that are
    made out of a small table cost nothing in an estimate, so that by their estimated size whole planes would be broadcast through the driver."""
    return df.hint("merge")


def beside(df: DataFrame) -> DataFrame:
    """df, a row a plane, which pixels without a hint of their own are joined to: it is hashed, and the pixels pass by. Sorted, they would take a task's
    memory by the hundreds of MB, as tasks are made as large as their compressed bytes allow."""
    return df.hint("shuffle_hash")


def keep(df: DataFrame, label: str = "table", pixels: bool = False) -> DataFrame:
    """df written and read back; pixels: it is joined apart()."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made = apart(made) if pixels else made
    _PATHS.add(path)
    _OF[made] = path
    if (own := _WITHIN.get()) is not None:
        own.append(path)
    return made


def keep_pixels(df: DataFrame, label: str = "table") -> DataFrame:
    """keep() of pixels, runs, or what else is counted by the pixel or the line."""
    return keep(df, label, True)


def _remove(spark: SparkSession, path: str) -> None:
    if path in _PATHS:
        _PATHS.discard(path)
        remove(spark, path)


def drop(*tables: DataFrame | None) -> None:
    """Removes tables that keep() returned and that nothing reads any more; other tables are left alone."""
    for t in tables:
        if t is not None and t in _OF:
            _remove(t.sparkSession, _OF[t])


def _within(make: Callable[[], DataFrame | None], label: str | None) -> DataFrame | None:
    own: list[str] = []
    token = _WITHIN.set(own)
    stays = None
    try:
        made = make()
        if label is not None:
            made = keep(made, label)
            stays = _OF[made]
        return made
    finally:
        _WITHIN.reset(token)
        for path in own:
            if path != stays:
                _remove(SparkSession.builder.getOrCreate(), path)
        if stays is not None and (outer := _WITHIN.get()) is not None:
            outer.append(stays)


def written(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """make()'s result, kept; the tables that this call's thread kept on the way to it are removed."""
    return _within(make, label)


def passing(make: Callable[[], None]) -> None:
    """Runs make, which needs nothing afterwards of what this call's thread keeps on the way: it is removed."""
    _within(make, None)
