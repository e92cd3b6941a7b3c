"""A change log kept in ranges of versions, with snapshots between them, so that a past state is read from one snapshot and the few ranges after it.

log/range=<r> holds versions r * every + 1 to (r + 1) * every; snapshots is a FileTable with a version for each
completed range, of which the next rewrites only the files that the range has changed; versions has a row per version.

Edge cases: versions only grow, and a log that goes back is refused; a version without changes is the one before it; a
state before the first version is empty; a state older than what was kept is refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.operators.merge import Clause
from lakeops.operators.stage import drop_folder, stage_result
from lakeops.sources.filetable import FileTable
from lakeops.streaming.streams import read_table

_VERSIONS = "version long, ts timestamp, stmt_id string, n long"


@dataclass(frozen=True)
class History:
    """log_schema: of the log (version, ts, stmt_id, op in I/U/D, keys, columns). every: versions of a range; files: of the first snapshot."""

    spark: SparkSession
    path: str
    log_schema: T.StructType
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    every: int = 100
    files: int | None = None

    @staticmethod
    def create(log: DataFrame, path: str, keys: Sequence[str], columns: Sequence[str], every: int = 100, files: int | None = None) -> History:
        """A history that begins empty, of logs like this one."""
        kept = History(log.sparkSession, path, T.StructType([T.StructField(f.name, f.dataType) for f in log.schema]), tuple(keys), tuple(columns), every, files)
        FileTable.create(log.sparkSession.createDataFrame([], kept.snapshots.schema), kept.snapshots.path, keys, 1)
        return kept

    @property
    def snapshots(self) -> FileTable:
        fields = {f.name: f.dataType for f in self.log_schema}
        return FileTable(self.spark, f"{self.path}/snapshots", T.StructType([T.StructField(c, fields[c]) for c in (*self.keys, *self.columns)]), self.keys)

    @property
    def log(self) -> DataFrame:
        return read_table(self.spark, f"{self.path}/log", f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in self.log_schema)}, range long")

    @property
    def versions(self) -> DataFrame:
        return read_table(self.spark, f"{self.path}/versions", _VERSIONS)

    def last(self) -> int:
        return self.versions.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _marks(self) -> dict[int, int]:
        """Version -> version of the snapshot table; a mark below 0 is the oldest that is kept."""
        commits = self.snapshots.commits
        notes = {n: commits.text(n).split("\n")[1] for n in commits.numbers()}
        return {int(note.removeprefix("at ")): n for n, note in notes.items() if note.startswith("at ")} | ({0: 1} if 1 in notes else {})

    def append(self, log: DataFrame) -> None:
        """Adds versions, and a snapshot for each range that they complete."""
        log = stage_result(log.select(*self.log_schema.names), "appended")
        seen = stage_result(log.groupBy(F.col("version").cast("long").alias("version")).agg(F.min("ts").alias("ts"), F.min("stmt_id").alias("stmt_id"), F.count("*").alias("n")), "seen")
        ends = seen.agg(F.min("version"), F.max("version")).first()
        if ends[0] is None:
            return
        before = self.last()
        if ends[0] <= before:
            raise ValueError(f"version {ends[0]} comes after {before}")
        log.withColumn("range", F.floor((F.col("version") - 1) / self.every)).write.mode("append").partitionBy("range").parquet(f"{self.path}/log")
        seen.write.mode("append").parquet(f"{self.path}/versions")
        for r in range(before // self.every, ends[1] // self.every):
            last = self._last(self.log.where(F.col("range") == r)).drop("_version")
            clauses = [Clause("delete", "s._op = 'D'"), Clause("update"), Clause("insert", "s._op <> 'D'")]
            note = f"at {(r + 1) * self.every}"
            if not self.snapshots.merge(last, clauses, check=False, note=note).added and not self.snapshots.noted(note):
                self.snapshots.mark(note)

    def _last(self, log: DataFrame) -> DataFrame:
        """The last change of each key."""
        last = log.groupBy(*self.keys).agg(F.max_by(F.struct(*self.columns, F.col("op").alias("_op"), F.col("version").alias("_version")), "version").alias("_l"))
        return last.select(*self.keys, *(F.col(f"_l.{c}").alias(c) for c in (*self.columns, "_op", "_version")))

    def as_of(self, version: int) -> DataFrame:
        """The rows at a version: the snapshot at or before it, and what the ranges since have changed."""
        marks = [(at, n) for at, n in self._marks().items() if at <= version]
        if not marks:
            raise ValueError(f"version {version} is older than what is kept")
        at, n = max(marks)
        low, high = at // self.every, max(at, version - 1) // self.every
        tail = self.log.where(F.col("range").between(low, high) & (F.col("version") > at) & (F.col("version") <= version))
        last = self._last(tail)
        names = [*self.keys, *self.columns]
        whole = self.snapshots.read(n)
        if version == at:
            return whole.select(*names)
        return whole.join(last.select(*self.keys), list(self.keys), "left_anti").select(*names).unionByName(last.where("_op <> 'D'").select(*names))

    def version_at(self, ts: str) -> int:
        """The last version at or before a time; an error before the first."""
        found = self.versions.where(F.col("ts") <= F.lit(ts).cast("timestamp")).agg(F.max("version")).first()[0]
        if found is None:
            raise ValueError(f"no version at or before {ts}")
        return found

    def version_before(self, stmt_id: str) -> int:
        found = self.versions.where(F.col("stmt_id") == stmt_id).agg(F.min("version")).first()[0]
        if found is None:
            raise ValueError(f"unknown statement {stmt_id}")
        return found - 1

    def expire(self, version: int) -> list[int]:
        """Drops what no state from `version` on needs: whole ranges before the snapshot at or before it, and the snapshots before that one. Gives the ranges that went."""
        marks = self._marks()
        at = max((m for m in marks if m <= version), default=0)
        gone = [r.range for r in self.log.where(F.col("range") < at // self.every).select("range").distinct().collect()]  # a row a range
        self.snapshots.expire(marks.get(at, 1))
        for r in gone:
            drop_folder(self.spark, f"{self.path}/log/range={r}")
        return sorted(gone)
