"""Small files of a store on any Hadoop file system: exclusive creation, reading, listing, removal."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class AlreadyThere(Exception):
    """Another writer created the file first."""


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self.conf)

    def _local(self) -> str | None:
        uri = urlparse(self._fs().makeQualified(self._path("")).toString())
        return unquote(uri.path) if uri.scheme == "file" else None

    def create(self, name: str, data: bytes) -> None:
        """Create the file with this content, or raise AlreadyThere; never overwrites. Readers see all of it or nothing."""
        local = self._local()
        if local:
            target = f"{local}/{name}"
            os.makedirs(os.path.dirname(target), exist_ok=True)
            draft = f"{target}.{os.getpid()}.{os.urandom(4).hex()}.tmp"
            with open(draft, "xb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, target)  # fails when the target exists
            except FileExistsError:
                raise AlreadyThere(name) from None
            finally:
                os.unlink(draft)
            return
        from py4j.protocol import Py4JJavaError

        try:
            out = self._fs().create(self._path(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise AlreadyThere(name) from None
            raise
        out.write(bytearray(data))
        out.close()

    def read(self, name: str) -> bytes:
        stream = self._fs().open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._fs().exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs().listStatus(path) if not s.getPath().getName().endswith(".tmp"))

    def remove(self, name: str) -> None:
        self._fs().delete(self._path(name), True)
