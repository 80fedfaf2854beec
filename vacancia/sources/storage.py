"""Byte ranges of files in any store that Spark reads, for tasks that run Python.

Spark names stores by Hadoop's schemes, Arrow by its own. ``resolved`` turns a
path into a full one on the driver, mounts included; ``opened_store`` gives the Arrow file system and the
path in it, and raises at once where a scheme has none.
"""
from __future__ import annotations

from pyspark.sql import SparkSession

#: Hadoop schemes to Arrow's, where the names differ.
SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss", "file": "file"}


def arrow_uri(uri: str) -> str:
    """``uri`` as Arrow names it. A path without a scheme is not accepted: it depends on the session."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{uri!r} has no scheme; resolve it with the session first")
    if scheme not in SCHEMES:
        raise ValueError(f"no Arrow file system for {scheme!r} paths: {uri}")
    if scheme == "file":                       # Hadoop writes file:/x, Arrow wants file:///x
        rest = "//" + "/" + rest.lstrip("/")
    return f"{SCHEMES[scheme]}:{rest}"


def opened_store(uri: str):
    """``(file system, path)`` of a full path."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(arrow_uri(uri))


def resolved(spark: SparkSession, path: str) -> str:
    """The full path behind ``path``, with the session's default store and its mounts.

    Names that do not exist yet are resolved through their nearest folder that does.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full, below = store.makeQualified(hadoop), []
    while not store.exists(full) and full.getParent() is not None:
        below.append(full.getName())
        full = full.getParent()
    found = store.resolvePath(full).toString().rstrip("/")
    return "/".join([found, *reversed(below)])


class Folder:
    """Small files and folders of a store, handled on the driver through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self._store = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """The names in a folder, sorted; none if it does not exist."""
        at = self._at(name)
        if not self._store.exists(at):
            return []
        return sorted(s.getPath().getName() for s in self._store.listStatus(at))

    def exists(self, name: str) -> bool:
        return self._store.exists(self._at(name))

    def read(self, name: str) -> str:
        source = self._store.open(self._at(name))
        try:
            return bytes(source.readAllBytes()).decode("utf-8")
        finally:
            source.close()

    def write_new(self, name: str, text: str, attempt: str) -> bool:
        """Write a whole file under its name in one step; False if the name is taken."""
        part = self._at(f"{name}.{attempt}")
        sink = self._store.create(part, True)
        sink.write(bytearray(text.encode("utf-8")))
        sink.close()
        done = not self.exists(name) and self._store.rename(part, self._at(name))
        if not done:
            self._store.delete(part, False)
        return done

    def remove(self, name: str) -> None:
        self._store.delete(self._at(name), True)
