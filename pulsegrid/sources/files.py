"""File operations on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """The few file operations that DataFrames have no word for, on any file system Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        where = self._path(folder)
        if not self._fs.exists(where):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write a file that appears under its name only when it is whole."""
        hidden = self._path(f"{path.rsplit('/', 1)[0]}/.{path.rsplit('/', 1)[1]}")
        stream = self._fs.create(hidden, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.delete(self._path(path), False)
        if not self._fs.rename(hidden, self._path(path)):
            raise OSError(f"cannot write {path}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
