"""Small files of the driver's own, through Hadoop's file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def make(self, name: str) -> None:
        self._fs.mkdirs(self.path(name))

    def names(self, folder: str) -> list[str]:
        place = self.path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        """The bytes of a file, from one place on."""
        size = self._fs.getFileStatus(self.path(name)).getLen()
        n = max(0, size - at) if n is None else min(n, max(0, size - at))
        stream = self._fs.open(self.path(name))
        try:
            stream.seek(min(at, size))
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Writes a file as a whole or not at all; False if there is one of that name."""
        folder = name.rpartition("/")[0]
        temporary, final = self.path(f"{folder}/.{uuid.uuid4().hex}"), self.path(name)
        out = self._fs.create(temporary, True)
        out.write(data)
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self.path(name)).getLength()
