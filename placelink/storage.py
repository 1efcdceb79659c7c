"""Small files and folders wherever Spark's paths point: local, HDFS or an object store."""

from __future__ import annotations

import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Storage:
    """A folder on the file system that its path names, reached through Hadoop's client as Spark's own tables are."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        base = self._jvm.org.apache.hadoop.fs.Path(str(root))
        self._fs = base.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(base).toString().rstrip("/")

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, folder: str = "") -> list[str]:
        """What is directly in a folder, sorted; nothing if it is not there."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def age(self, name: str) -> float:
        """Seconds since a file or folder was last changed."""
        return time.time() - self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def data(self, name: str) -> bytes:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _part(self, name: str, content: str | bytes) -> str:
        """A hidden file beside ``name`` with the content."""
        folder, _, own = name.rpartition("/")
        part = f"{folder}/.{own}-{uuid.uuid4().hex}" if folder else f".{own}-{uuid.uuid4().hex}"
        out = self._fs.create(self._at(part), True)
        try:
            out.write(bytearray(content.encode() if isinstance(content, str) else content))
        finally:
            out.close()
        return part

    def _rename(self, part: str, name: str, how: str) -> None:
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, how)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(name).toUri(), self._conf).rename(self._at(part), self._at(name), options)

    def write(self, name: str, content: str | bytes) -> None:
        """Write a file so that readers see the old one or the new one, whole."""
        self._rename(self._part(name, content), name, "OVERWRITE")

    def claim(self, name: str, content: str | bytes) -> bool:
        """Write a file, whole, unless there is one; whether it is this one.

        Of several writers one wins: on a local disk by a link, elsewhere by a
        rename that does not overwrite, which must be atomic there as it is on HDFS.
        """
        if self.exists(name):
            return False
        part = self._part(name, content)
        try:
            if self.root.startswith("file:"):
                os.link(self.path(part).removeprefix("file:"), self.path(name).removeprefix("file:"))
            else:
                self._rename(part, name, "NONE")
        except (FileExistsError, Py4JJavaError):
            if not self.exists(name):
                raise
            return False
        finally:
            self.delete(part)
        return True

    def put(self, local: str, name: str) -> None:
        """Copy a file of this machine into the folder."""
        self._fs.copyFromLocalFile(False, True, self._jvm.org.apache.hadoop.fs.Path(f"file:{local}"), self._at(name))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)
