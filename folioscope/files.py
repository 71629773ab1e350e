"""Small files and folders on whatever file system a path names, through Spark's own access to it."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """The name is in use."""


class Files:
    """The file systems that the session can reach: local, shared, or an object store."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        where, fs = self._at(path)
        return fs.exists(where)

    def names(self, folder: str) -> list[str]:
        """Names of what lies in a folder; none, if it is not there."""
        return [name for name, _, _ in self.listed(folder)]

    def listed(self, folder: str) -> list[tuple[str, bool, float]]:
        """(name, whether a folder, seconds of its last change) of what lies in a folder."""
        where, fs = self._at(folder)
        if not fs.exists(where):
            return []
        return [(s.getPath().getName(), s.isDirectory(), s.getModificationTime() / 1000) for s in fs.listStatus(where)]

    def read(self, path: str) -> str:
        where, fs = self._at(path)
        stream = fs.open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write a file whose name nobody else uses."""
        where, fs = self._at(path)
        out = fs.create(where, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def move(self, path: str, to: str) -> None:
        """Rename a file or folder; ``Taken`` if ``to`` is there.  As atomic as the file system's own rename."""
        source, _ = self._at(path)
        target, fs = self._at(to)
        fs.mkdirs(target.getParent())
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        try:
            context.rename(source, target, self._gateway.new_array(rename, 0))
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise Taken(to) from None
            raise

    def publish(self, path: str, text: str, part: str) -> None:
        """Make a file appear whole under its name, or ``Taken`` if somebody was first; ``part``: a name for it until then."""
        self.write(part, text)
        try:
            self.move(part, path)
        except Taken:
            self.delete(part)
            raise

    def delete(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, True)
