"""A folder of numbered commits: each is one small file that comes into being whole or not at all, under a number that nobody else has taken."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Commits:
    """Writers read latest(), do their work on that state, and put() the next number; where another writer was first, put() is False and they begin again from the new state."""

    spark: SparkSession
    folder: str

    def _at(self, name: str):  # noqa: ANN202  a path of the file system's own kind, and the file system
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        folder, fs = self._at("")
        names = [status.getPath().getName() for status in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> int:
        """0 before the first commit."""
        return max(self.numbers(), default=0)

    def put(self, number: int, text: str) -> bool:
        """Whether this writer got the number. The text is written beside it and then named; naming fails where the name is taken."""
        jvm = self.spark._jvm
        aside, fs = self._at(f".{uuid.uuid4().hex}")
        path, _ = self._at(str(number))
        stream = fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if fs.getScheme() == "file":  # a rename on one machine replaces what is there, a link doesn't
                local = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (path, aside)]
                try:
                    jvm.java.nio.file.Files.createLink(*local)
                except Exception as e:
                    if "FileAlreadyExistsException" not in str(e):
                        raise
                    return False
                return True
            return not fs.exists(path) and fs.rename(aside, path)
        finally:
            fs.delete(aside, False)

    def text(self, number: int) -> str:
        path, fs = self._at(str(number))
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def table(self) -> DataFrame:
        """number, text of all commits, read by Spark."""
        if not self.latest():
            return self.spark.createDataFrame([], "number long, text string")
        texts = self.spark.read.option("wholetext", "true").option("pathGlobFilter", "[0-9]*").text(self.folder)
        return texts.select(F.element_at(F.split("_metadata.file_name", "/"), -1).cast("long").alias("number"), F.col("value").alias("text"))
