"""Small text files beside tables, through the file system that Spark reads tables from."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class SharedFiles:
    """Files under one root, which may be in any store Spark has a path for."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.root = root.rstrip("/")
        self._system = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        path = self._path(folder)
        if not self._system.exists(path):
            return []
        return sorted(status.getPath().getName() for status in self._system.listStatus(path))

    def read(self, name: str) -> str:
        stream = self._system.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str, staged: str) -> bool:
        """Write a file that appears whole; false if there is one of that name already.

        The text is written as ``staged`` and renamed. The rename does not
        overwrite, so of several writers one succeeds.
        """
        stream = self._system.create(self._path(staged), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs = self._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        options = self._jvm.java.lang.reflect.Array.newInstance(
            self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1
        )
        options[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        self._system.mkdirs(self._path(name).getParent())
        try:
            context.rename(self._qualified(staged), self._qualified(name), options)
        except Py4JJavaError as failed:
            self.delete(staged)
            if "FileAlreadyExistsException" in failed.java_exception.getClass().getName():
                return False
            raise
        return True

    def _qualified(self, name: str):
        return self._system.makeQualified(self._path(name))

    def delete(self, name: str) -> None:
        """Delete a file, or a folder with all it holds."""
        self._system.delete(self._path(name), True)
