"""The few file operations a versioned catalog needs, through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Seconds after which a claim without a published file counts as that of a crashed writer.
LEASE = 60.0


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self._path(root)
        self._fs = path.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(path).toString().rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _of(self, name: str):
        return self._path(name if name.startswith(self.root) else f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        path = self._of(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._of(name)))

    def age(self, name: str) -> float:
        """Seconds since the last change; 0 if there is no such file."""
        try:
            return time.time() - self._fs.getFileStatus(self._of(name)).getModificationTime() / 1000
        except Py4JJavaError:
            return 0.0

    def size(self, names: list[str]) -> int:
        """Bytes of files and folders."""
        return sum(self._fs.getContentSummary(self._of(n)).getLength() for n in names)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._of(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Publishes a whole file under a new name, or returns False if the name is taken.

        The content is written under a name of its own first. On a local disk a hard link publishes it, which only one writer
        can make. Elsewhere a claim, made by exclusive creation, goes before the rename; a claim older than LEASE whose writer
        has published nothing is overtaken by the claim with the next number, which again only one writer can make.
        """
        if self.exists(name):
            return False
        part = f"{name}.{self._jvm.java.util.UUID.randomUUID()}.part"
        stream = self._fs.create(self._of(part), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            return self._link(part, name) if self.root.startswith("file:") else self._rename(part, name)
        finally:
            self.delete(part)

    def _link(self, part: str, name: str) -> bool:
        source, target = (self._jvm.java.io.File(self._of(n).toUri().getPath()).toPath() for n in (part, name))
        try:
            self._jvm.java.nio.file.Files.createLink(target, source)
            return True
        except Py4JJavaError:
            if self.exists(name):
                return False
            return self._rename(part, name)  # a disk without links

    def _rename(self, part: str, name: str) -> bool:
        claims = [n for n in self.names(name.rpartition("/")[0]) if n.startswith(name.rpartition("/")[2] + ".claim")]
        number = max((int(n.rpartition("-")[2]) for n in claims), default=-1)
        if number >= 0 and self.age(f"{name}.claim-{number}") < LEASE:
            return False
        try:
            self._fs.create(self._of(f"{name}.claim-{number + 1}"), False).close()
        except Py4JJavaError:
            return False
        return not self.exists(name) and bool(self._fs.rename(self._of(part), self._of(name)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._of(name), True)
