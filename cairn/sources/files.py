"""Small files through Hadoop's file system API, so that any storage that Spark reads works."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._path(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._path(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def lines(self, path: str):
        """The lines of a text file, one at a time."""
        fs, p = self._path(path)
        reader = self.jvm.java.io.BufferedReader(self.jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
        try:
            while (line := reader.readLine()) is not None:
                yield line
        finally:
            reader.close()

    def replace(self, path: str, text: str) -> None:
        """Write a temporary file beside it and rename: a reader sees the old text or the new one."""
        fs, p = self._path(path)
        fs.mkdirs(p.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.isAbsolute() and p.toUri().getScheme() else fs.getUri(), self.conf)
        temp = self.jvm.org.apache.hadoop.fs.Path(path + ".new")
        out = fs.create(temp, True)
        out.write(bytearray(text.encode("utf-8")))
        out.hsync()
        out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(fs.makeQualified(temp), fs.makeQualified(p), options)

    def create(self, path: str, text: str) -> bool:
        """Write a file that doesn't exist yet, whole or not at all; false if another writer was first."""
        fs, p = self._path(path)
        fs.mkdirs(p.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.isAbsolute() and p.toUri().getScheme() else fs.getUri(), self.conf)
        temp = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(text.encode("utf-8")))
        out.hsync()
        out.close()
        try:
            context.rename(fs.makeQualified(temp), fs.makeQualified(p), self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            fs.delete(temp, False)
            return False

    def children(self, path: str) -> list[str]:
        fs, p = self._path(path)
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if not n.startswith(".")) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._path(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def copy(self, source: str, target: str) -> None:
        fs, p = self._path(source)
        to, q = self._path(target)
        to.mkdirs(q.getParent())
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, self.conf)

    def delete(self, path: str) -> None:
        fs, p = self._path(path)
        fs.delete(p, True)
