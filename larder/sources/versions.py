"""Versioned folders behind one pointer file: readers see a whole version, whatever a writer does meanwhile."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

POINTER, FOLDER = "CURRENT", "versions"


def _path(spark: SparkSession, path: str) -> JavaObject:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str) -> JavaObject:
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _rename_over(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file over another in one step of the file system, so that the name never goes."""
    fs = spark._jvm.org.apache.hadoop.fs
    options = spark._sc._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    options[0] = getattr(fs, "Options$Rename").OVERWRITE
    context = fs.FileContext.getFileContext(_path(spark, target).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(_path(spark, source), _path(spark, target), options)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that readers shall see; none before the first one."""
    pointer = f"{path.rstrip('/')}/{POINTER}"
    files = _files(spark, pointer)
    if not files.exists(_path(spark, pointer)):
        return None
    stream = files.open(_path(spark, pointer))
    try:
        return f"{path.rstrip('/')}/{FOLDER}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def point(spark: SparkSession, path: str, version: str) -> None:
    """Make a version the current one.  Until the rename readers resolve the old one, after it the new one."""
    beside = f"{path.rstrip('/')}/.{POINTER}-{uuid.uuid4().hex}"
    stream = _files(spark, path).create(_path(spark, beside), True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    _rename_over(spark, beside, f"{path.rstrip('/')}/{POINTER}")


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Write a new version into a folder of its own and make it the current one; gives that folder.

    A write that fails, and a swap that fails, leave the old version current and whole.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path.rstrip('/')}/{FOLDER}/{version}"
    write(folder)
    point(spark, path, version)
    return folder


def listed(spark: SparkSession, path: str) -> list[str]:
    """All versions, the oldest first, failed ones too."""
    root = f"{path.rstrip('/')}/{FOLDER}"
    files = _files(spark, root)
    return sorted(f.getPath().getName() for f in files.listStatus(_path(spark, root))) if files.exists(_path(spark, root)) else []


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove all but the current version and the newest ``keep`` ones, which readers may still have open."""
    now, names = current(spark, path), listed(spark, path)
    gone = [n for n in names[: max(0, len(names) - keep)] if not now or not now.endswith(f"/{n}")]
    for name in gone:
        _files(spark, path).delete(_path(spark, f"{path.rstrip('/')}/{FOLDER}/{name}"), True)
    return gone


def read(spark: SparkSession, path: str, inner: str = "") -> DataFrame:
    """The current version as Parquet; ``inner`` names a folder in it."""
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"{path} has no current version")
    return spark.read.parquet(f"{folder}/{inner}".rstrip("/"))


def swapped(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write beside a plain folder and put it in its place, for consumers that know no pointer.

    The old folder is renamed aside and comes back if the new one cannot be put there; only between
    the two renames is the name free.
    """
    beside, aside = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    write(beside)
    files, old = _files(spark, path), _path(spark, path)
    had = files.exists(old)
    if had and not files.rename(old, _path(spark, aside)):
        raise OSError(f"{path} could not be moved aside")
    try:
        if not files.rename(_path(spark, beside), old):
            raise OSError(f"{beside} could not be renamed to {path}")
    except (OSError, Py4JJavaError):
        if had:
            files.rename(_path(spark, aside), old)
        raise
    if had:
        files.delete(_path(spark, aside), True)
