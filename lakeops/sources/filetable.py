"""Tables as sets of Parquet files that a manifest names, so that a change rewrites the files it touches and keeps the rest.

A table is a folder: data/<id>/ holds the files that one change has written, in order of the key; manifest/<id>/ has a
row per file of the table after it (file, n_rows, low and high of the key, n_nulls); commits/<n> names the manifest of
version n. A version is read by its manifest, so readers see whole changes only and earlier versions stay readable.

Which files a change touches is found in two steps: counting the change's keys up to the ends of each file's range
leaves the files whose range holds a key, and a semi-join of their keys leaves those that hold one indeed.

Edge cases: rows with a null key are found where keys match null-safely; a change without rows makes no version; an
empty table has no file; changes at once are put one after the other, the later one begun anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.operators.aggregates import running_sum
from lakeops.operators.merge import Clause, merge_into
from lakeops.operators.stage import drop_folder, stage_result
from lakeops.sources.commits import Commits


def netted(signed: DataFrame) -> DataFrame:
    """Rows with _sign, each once with the sum of its signs, without those that cancel."""
    columns = [c for c in signed.columns if c != "_sign"]
    return signed.groupBy(*columns).agg(F.sum("_sign").alias("_sign")).where("_sign <> 0")


@dataclass(frozen=True)
class Change:
    """What a change did: the version it made (that it found, if it made none), and how many files it kept, rewrote and added."""

    version: int
    kept: int
    rewritten: int
    added: int


@dataclass(frozen=True)
class FileTable:
    """keys: the columns that name a row; files are in order of the first, whose ranges prune them."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]

    @property
    def commits(self) -> Commits:
        return Commits(self.spark, f"{self.path}/commits")

    def _zones(self, data: str) -> DataFrame:
        key = F.col(self.keys[0])
        return self.spark.read.schema(self.schema).parquet(data).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_rows"), F.min(key).alias("low"), F.max(key).alias("high"), F.count_if(key.isNull()).alias("n_nulls"))

    def _written(self, rows: DataFrame, files: int | None) -> tuple[str, DataFrame]:
        """Rows in new files, in order of the keys, and their zones."""
        name = uuid.uuid4().hex
        data = f"{self.path}/data/{name}"
        order = [F.col(k) for k in self.keys]
        ordered = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
        ordered.sortWithinPartitions(*order).write.parquet(data)
        return name, self._zones(data)

    def _committed(self, name: str, manifest: DataFrame, number: int, note: str) -> bool:
        manifest.write.parquet(f"{self.path}/manifest/{name}")
        return self.commits.put(number, f"{name}\n{note}")

    @staticmethod
    def create(df: DataFrame, path: str, keys: Sequence[str], files: int | None = None) -> FileTable:
        """Version 1 of a table, in so many files, or as many as the shuffle makes."""
        table = FileTable(df.sparkSession, path, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]), tuple(keys))
        name, zones = table._written(df, files)
        if not table._committed(name, zones, 1, ""):
            raise ValueError(f"there is a table at {path}")
        return table

    def files(self, version: int | None = None) -> DataFrame:
        """file, n_rows, low, high, n_nulls of a version, the last by default."""
        name = self.commits.text(version or self.commits.latest()).split("\n")[0]
        key = self.schema[self.keys[0]].dataType
        schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("n_rows", T.LongType()), T.StructField("low", key), T.StructField("high", key), T.StructField("n_nulls", T.LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/manifest/{name}")

    def rows_of(self, files: DataFrame) -> DataFrame:
        """Rows of the files named. Spark's reader takes the names from the driver, as it does those of any folder."""
        names = [r.file for r in files.select("file").collect()]
        return self.spark.read.schema(self.schema).parquet(*names) if names else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self.rows_of(self.files(version))

    def noted(self, note: str) -> bool:
        """Whether a commit carries this note; a change that is put with one can be repeated without harm."""
        return bool(note) and any(self.commits.text(n).split("\n")[1] == note for n in reversed(self.commits.numbers()))

    def in_range(self, files: DataFrame, changed: DataFrame) -> DataFrame:
        """The files whose range holds at least one of the changed keys: of keys and ends of ranges in one order, more keys stand before a range's end than before its begin."""
        key = changed.select(F.col(self.keys[0]).alias("at")).distinct()
        ends = files.where("low IS NOT NULL")
        none = F.lit(None).cast("string")
        lows = ends.select(F.col("low").alias("at"), F.lit(0).alias("kind"), "file", F.lit(0).alias("keys"))
        highs = ends.select(F.col("high").alias("at"), F.lit(2).alias("kind"), "file", F.lit(0).alias("keys"))
        points = key.where("at IS NOT NULL").select("at", F.lit(1).alias("kind"), none.alias("file"), F.lit(1).alias("keys"))
        swept = running_sum(lows.unionByName(points).unionByName(highs), [F.col("at"), F.col("kind"), F.col("file")], ["keys"])
        held = swept.where("file IS NOT NULL").groupBy("file").agg((F.max("sum_keys") - F.min("sum_keys")).alias("n")).where("n > 0").select("file")
        nulls = files.where("n_nulls > 0").join(key.where("at IS NULL"), F.lit(True), "left_semi").select("file")
        return held.union(nulls).distinct()

    def _alike(self, changed: DataFrame, on: Sequence[str]) -> tuple[DataFrame, Column]:
        """The distinct keys of a change under other names, and the condition that a row has them, nulls alike."""
        mine = changed.select(*(F.col(k).alias(f"_{n}") for n, k in enumerate(on))).distinct()
        return mine, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{n}")) for n, k in enumerate(on)))

    def touched(self, changed: DataFrame, version: int | None = None, on: Sequence[str] = ()) -> DataFrame:
        """The files that hold at least one of the changed keys (or of their first columns, `on`); only keys of files in range are read."""
        files = stage_result(self.in_range(self.files(version), changed), "in_range")
        names = [r.file for r in files.collect()]
        if not names:
            return files
        mine, alike = self._alike(changed, on or self.keys)
        found = self.spark.read.schema(self.schema).parquet(*names).select(*self.keys, F.col("_metadata.file_path").alias("file")).join(mine, alike, "left_semi")
        return stage_result(found.select("file").distinct(), "touched")

    def rows_with(self, changed: DataFrame, version: int | None = None, on: Sequence[str] = ()) -> DataFrame:
        """The table's rows that have one of the changed keys (or of their first columns, `on`), read from the files that hold them."""
        mine, alike = self._alike(changed, on or self.keys)
        return self.rows_of(self.touched(changed, version, on)).join(mine, alike, "left_semi")

    def delta(self, old: int, new: int) -> DataFrame:
        """What came and went between two versions: rows with how many more of each there are (_sign, below 0 for fewer). Only files that one of them hasn't got are read."""
        a, b = self.files(old).select("file"), self.files(new).select("file")
        gone, came = self.rows_of(a.join(b, "file", "left_anti")), self.rows_of(b.join(a, "file", "left_anti"))
        return netted(gone.withColumn("_sign", F.lit(-1).cast("long")).unionByName(came.withColumn("_sign", F.lit(1).cast("long"))))

    def mark(self, note: str) -> None:
        """A version like the last one, with a note."""
        last = self.commits.latest()
        if not self.commits.put(last + 1, self.commits.text(last).split("\n")[0] + f"\n{note}"):
            raise RuntimeError(f"another change of {self.path} came first")

    def expire(self, version: int) -> int:
        """Forgets the versions before one, and removes the files that only they have; how many."""
        numbers = self.commits.numbers()
        old, new = [n for n in numbers if n < version], [n for n in numbers if n >= version]
        if not old or not new:
            return 0
        union = lambda ns: reduce(DataFrame.unionByName, (self.files(n).select("file") for n in ns)).distinct()
        gone = [r.file for r in union(old).join(union(new), "file", "left_anti").collect()]
        kept = {self.commits.text(n).split("\n")[0] for n in new}
        for n in old:
            name = self.commits.text(n).split("\n")[0]
            drop_folder(self.spark, f"{self.path}/commits/{n}")
            if name not in kept:
                drop_folder(self.spark, f"{self.path}/manifest/{name}")
        for file in gone:
            drop_folder(self.spark, file)
        return len(gone)

    def restore(self, version: int) -> None:
        """Makes an earlier version the last one again."""
        if not self.commits.put(self.commits.latest() + 1, self.commits.text(version).split("\n")[0] + "\n"):
            raise RuntimeError(f"another change of {self.path} came first")

    def rewrite(self, changed: DataFrame, make: Callable[[DataFrame], DataFrame], note: str = "", tries: int = 5) -> Change:
        """Replaces the files that hold a changed key by what `make` makes of their rows. note: if a commit has it already, nothing is done."""
        changed = stage_result(changed, "changed")
        for _ in range(tries):
            version = self.commits.latest()
            if self.noted(note) or not changed.limit(1).count():
                return Change(version, self.files().count(), 0, 0)
            files = self.files(version)
            touched = self.touched(changed, version)
            name, zones = self._written(make(self.rows_of(touched)).select(*self.schema.names), None)
            kept = files.join(touched, "file", "left_anti")
            manifest = stage_result(kept.unionByName(zones), "manifest")
            if self._committed(name, manifest, version + 1, note):
                rewritten = touched.count()
                n = files.count() - rewritten
                return Change(version + 1, n, rewritten, manifest.count() - n)
        raise RuntimeError(f"{tries} other changes of {self.path} came first")

    def merge(self, source: DataFrame, clauses: Sequence[Clause], null_safe: bool = False, also: str = "true", check: bool = True, note: str = "") -> Change:
        """merge_into() over the files that hold a key of the source. A row of another file has none of them, so it stays as it is."""
        return self.rewrite(source, lambda rows: merge_into(rows, stage_result(source, "source"), self.keys, clauses, null_safe, also, check), note)

    def apply_changes(self, changes: DataFrame, note: str = "") -> Change:
        """A change feed (_action, _is_update) with hard deletes."""
        feed = changes.where(~((F.col("_action") == "DELETE") & F.col("_is_update")))
        return self.merge(feed, [Clause("delete", "s._action = 'DELETE'"), Clause("update"), Clause("insert", "s._action = 'INSERT'")], note=note)
