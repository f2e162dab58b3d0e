"""Small files beside the tables, on any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    """Text files and folders under one path; replacing a file is atomic where renaming is."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.base = base.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def full(self, name: str) -> str:
        return f"{self.base}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """First beside the file, then in its place."""
        temporary = self._path(f"{name}.tmp")
        out = self._fs.create(temporary, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        options = self._jvm.org.apache.hadoop.fs.Options
        overwrite = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        overwrite[0] = getattr(options, "Rename").OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self._conf).rename(temporary, self._path(name), overwrite)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(""))) if self.exists() else []

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def size(self, name: str = "") -> int:
        return self._fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0
