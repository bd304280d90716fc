"""Small files of a collection on whatever file system Hadoop reaches."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

STALE = 60.0


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def mkdirs(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def list(self, path: str) -> list[str]:
        """Names in a folder, in order; none if it does not exist."""
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def age(self, path: str) -> float:
        """Seconds since a file or folder was last changed."""
        return time.time() - self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000

    def publish(self, path: str, text: str) -> bool:
        """Writes a file whole; False if there is one already or another writer is at it.

        The name is claimed first, by a file created without overwriting, which one writer only can do; the claim's
        holder renames the content into place, so readers see all of it or nothing. A claim that a writer has left
        behind without its file falls after STALE seconds.
        """
        p = self._path(path)
        folder, _, name = path.rpartition("/")
        claim = f"{folder}/.{name}.claim"
        if self._fs.exists(p) or not self._claimed(claim):
            return False
        try:
            if self._fs.exists(p):
                return False
            temp = self._path(f"{folder}/.{name}.{uuid.uuid4().hex}")
            stream = self._fs.create(temp, True)
            try:
                stream.write(bytearray(text.encode("utf-8")))
            finally:
                stream.close()
            if self._fs.rename(temp, p):
                return True
            self._fs.delete(temp, False)
            return False
        finally:
            self._fs.delete(self._path(claim), False)

    def _claimed(self, claim: str) -> bool:
        for _ in range(2):
            try:
                self._fs.create(self._path(claim), False).close()
                return True
            except Py4JJavaError:
                if not self._fs.exists(self._path(claim)):
                    continue  # given up meanwhile
                if self.age(claim) < STALE:
                    return False
                self._fs.delete(self._path(claim), False)
        return False

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder for data that tasks and driver share: in spark.checkpoint.dir or, in local mode only, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="vecloom-")
    return f"{root}/vecloom-{uuid.uuid4().hex}"
