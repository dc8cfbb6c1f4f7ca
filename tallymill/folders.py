"""Operations on shared folders that need their file system."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder that all executors share, on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._text = spark._jvm.org.apache.commons.io.IOUtils.toString
        self.path = path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What lies in the folder, in order; nothing if there is none."""
        at = self._at(name)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._text(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file that is there whole or not at all; fails if the name is taken."""
        aside = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(aside, self._at(name)):
            self._fs.delete(aside, False)
            raise RuntimeError(f"{self.path}/{name} is there already")
