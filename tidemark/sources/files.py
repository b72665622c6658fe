"""Small files beside the tables, through Hadoop's file systems, with exclusive creation."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class AlreadyThere(FileExistsError):
    pass


class Files:
    """Paths may be of any file system that Spark can open."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    @property
    def _local(self) -> str | None:
        parts = urlparse(self.root)
        return parts.path if parts.scheme in ("", "file") and self._fs.getScheme() == "file" else None

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def create(self, name: str, text: str) -> None:
        """Write a whole file that must not exist. Locally the name appears with its full content (a hard link); elsewhere by exclusive creation."""
        if self._local is not None:
            target = os.path.join(self._local, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            temporary = f"{target}.{os.getpid()}.tmp"
            with open(temporary, "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temporary, target)
            except FileExistsError:
                raise AlreadyThere(name) from None
            finally:
                os.unlink(temporary)
            return
        if self._fs.exists(self._path(name)):
            raise AlreadyThere(name)
        out = self._fs.create(self._path(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(folder)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
