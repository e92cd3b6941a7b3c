"""Views that are kept, and chains of them that are refreshed from what has changed.

A delta is rows with _sign: how many more of a row there are, below 0 for fewer. Filters and joins turn deltas into
deltas; kept views read and rewrite the files of the groups that a delta names, and give the delta of their own rows. A
step that can't work from deltas is made anew and compared with what it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators.stage import stage_result
from lakeops.sources.commits import Commits
from lakeops.sources.filetable import FileTable, netted


def signed(feed: DataFrame) -> DataFrame:
    """A change feed (_action, _is_update, _row_id) as a delta."""
    return feed.withColumn("_sign", F.when(F.col("_action") == "INSERT", 1).otherwise(-1).cast("long")).drop("_action", "_is_update", "_row_id")


def _counted(df: DataFrame) -> DataFrame:
    return df if "_sign" in df.columns else df.withColumn("_sign", F.lit(1).cast("long"))


def _is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def _both(old: DataFrame, new: DataFrame) -> DataFrame:
    """The delta from old rows to new ones."""
    return netted(old.withColumn("_sign", F.lit(-1).cast("long")).unionByName(new.withColumn("_sign", F.lit(1).cast("long"))))


def _others(rows: DataFrame, named: DataFrame, keys: Sequence[str], how: str = "left_anti") -> DataFrame:
    """Rows without one of the keys, or with one (left_semi); nulls are alike."""
    mine = named.select(*(F.col(k).alias(f"_{n}") for n, k in enumerate(keys))).distinct()
    return rows.join(mine, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{n}")) for n, k in enumerate(keys))), how)


@dataclass(frozen=True)
class SummedView:
    """keys, n, sum_x, cnt_x by group; groups without rows vanish."""

    table: FileTable
    keys: tuple[str, ...]
    measures: tuple[str, ...]

    @staticmethod
    def _sums(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
        s = F.col("_sign")
        sums = [F.coalesce(F.sum(F.col(m) * s), F.lit(0)).alias(f"sum_{m}") for m in measures]
        counts = [F.sum(F.when(F.col(m).isNotNull(), s).otherwise(0)).alias(f"cnt_{m}") for m in measures]
        return _counted(df).groupBy(*keys).agg(F.sum(s).alias("n"), *sums, *counts)

    @staticmethod
    def create(df: DataFrame, path: str, keys: Sequence[str], measures: Sequence[str], files: int | None = None) -> SummedView:
        return SummedView(FileTable.create(SummedView._sums(df, keys, measures), path, keys, files), tuple(keys), tuple(measures))

    def tables(self) -> list[FileTable]:
        return [self.table]

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def apply(self, delta: DataFrame) -> DataFrame:
        """The view's own delta. Groups that the delta doesn't name are neither read nor written, but for those in the same files."""
        kinds = {f.name: f.dataType for f in self.table.schema}
        change = self._sums(delta, self.keys, self.measures)
        change = stage_result(change.select(*(F.col(c).cast(kinds[c]).alias(c) for c in kinds)), "change")
        old = stage_result(self.table.rows_with(change), "old")
        sums = [F.sum(c).cast(kinds[c]).alias(c) for c in kinds if c not in self.keys]
        new = stage_result(old.unionByName(change).groupBy(*self.keys).agg(*sums).where("n > 0"), "new")
        self.table.rewrite(change, lambda rows: _others(rows, change, self.keys).unionByName(new))
        return stage_result(_both(old, new), "delta")


@dataclass(frozen=True)
class ExtremesView:
    """keys, n, n_distinct, least and most of a column by group.

    What can't be taken back from an extreme or a number of distinct values can be from how often each value is there,
    which is kept beside the view. A value that comes or goes changes the number; a new value may become an extreme;
    where the extreme itself has gone, the group's values are read again, and only then.
    """

    table: FileTable
    values: FileTable
    keys: tuple[str, ...]
    column: str

    @staticmethod
    def create(df: DataFrame, path: str, keys: Sequence[str], column: str, files: int | None = None) -> ExtremesView:
        rows = _counted(df)
        s, c = F.col("_sign"), F.col(column)
        view = rows.groupBy(*keys).agg(F.sum(s).alias("n"), F.count_distinct(c).alias("n_distinct"), F.min(c).alias("least"), F.max(c).alias("most"))
        times = rows.where(c.isNotNull()).groupBy(*keys, c.alias("value")).agg(F.sum(s).alias("times"))
        return ExtremesView(FileTable.create(view, f"{path}/view", keys, files), FileTable.create(times, f"{path}/values", [*keys, "value"], files), tuple(keys), column)

    def tables(self) -> list[FileTable]:
        return [self.table, self.values]

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def apply(self, delta: DataFrame) -> DataFrame:
        keys, named = list(self.keys), [*self.keys, "value"]
        rows = stage_result(_counted(delta).select(*keys, F.col(self.column).cast(self.values.schema["value"].dataType).alias("value"), "_sign"), "rows")
        groups = stage_result(rows.groupBy(*keys).agg(F.sum("_sign").alias("more")), "groups")
        change = stage_result(rows.where("value IS NOT NULL").groupBy(*named).agg(F.sum("_sign").alias("times")).where("times <> 0"), "change")
        before = stage_result(self.values.rows_with(change), "before")
        both = before.select(*named, F.col("times").alias("was"), F.lit(0).cast("long").alias("more")).unionByName(change.select(*named, F.lit(0).cast("long").alias("was"), F.col("times").alias("more")))
        counted = both.groupBy(*named).agg(F.sum("was").alias("was"), (F.sum("was") + F.sum("more")).alias("times"))
        lost = F.raise_error(F.lit("a value was taken away more often than it was there")).cast("long")
        counted = stage_result(counted.withColumn("times", F.when(F.col("times") < 0, lost).otherwise(F.col("times"))), "counted")
        left = counted.where("times > 0").select(*named, "times")
        self.values.rewrite(change, lambda rows: _others(rows, change, named).unionByName(left))

        came, went = F.when((F.col("was") == 0) & (F.col("times") > 0), F.col("value")), F.when((F.col("was") > 0) & (F.col("times") == 0), F.col("value"))
        moved = counted.groupBy(*keys).agg((F.count(came) - F.count(went)).alias("wider"), F.min(came).alias("low"), F.max(came).alias("high"), F.min(went).alias("low_gone"), F.max(went).alias("high_gone"))
        old = stage_result(self.table.rows_with(groups), "old")
        none = lambda *cs: [F.lit(None).cast(t).alias(c) for c, t in cs]
        kind = self.values.schema["value"].dataType
        extra = [("wider", "long"), ("low", kind), ("high", kind), ("low_gone", kind), ("high_gone", kind)]
        met = (
            old.select(*keys, "n", "n_distinct", "least", "most", *none(*extra))
            .unionByName(groups.select(*keys, F.col("more").alias("n"), *none(("n_distinct", "long"), ("least", kind), ("most", kind), *extra)))
            .unionByName(moved.select(*keys, *none(("n", "long"), ("n_distinct", "long"), ("least", kind), ("most", kind)), *(c for c, _ in extra)))
            .groupBy(*keys)
            .agg(F.sum("n").alias("n"), *(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("n_distinct", "wider")), *(F.max(c).alias(c) for c in ("least", "most", "low", "high", "low_gone", "high_gone")))
            .where("n > 0")
        )
        met = stage_result(met.withColumn("again", F.coalesce(F.col("low_gone") <= F.col("least"), F.lit(False)) | F.coalesce(F.col("high_gone") >= F.col("most"), F.lit(False))), "met")
        again = met.where("again").select(*keys)
        kept = met.where("NOT again").select(*keys, "n", (F.col("n_distinct") + F.col("wider")).alias("n_distinct"), F.least("least", "low").alias("least"), F.greatest("most", "high").alias("most"))
        if _is_empty(again):
            new = kept
        else:
            read = self.values.rows_with(again, on=keys).groupBy(*keys).agg(F.min("value").alias("least"), F.max("value").alias("most"))
            redone = met.where("again").select(*keys, "n", (F.col("n_distinct") + F.col("wider")).alias("n_distinct"), *none(("least", kind), ("most", kind)))
            read = read.select(*keys, *none(("n", "long"), ("n_distinct", "long")), "least", "most")
            new = kept.unionByName(redone.unionByName(read).groupBy(*keys).agg(*(F.max(c).alias(c) for c in ("n", "n_distinct", "least", "most"))))
        new = stage_result(new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.table.schema)), "new")
        self.table.rewrite(groups, lambda rows: _others(rows, groups, keys).unionByName(new))
        return stage_result(_both(old, new), "delta")


# Chains.


@dataclass(frozen=True)
class Filtered:
    """Rows of another that a condition is true of, and columns made of theirs (name -> SQL; all by default)."""

    of: str
    where: str = "true"
    select: Mapping[str, str] = field(default_factory=dict)

    @property
    def inputs(self) -> list[str]:
        return [self.of]

    def make(self, rows: DataFrame) -> DataFrame:
        columns = [F.expr(e).alias(n) for n, e in self.select.items()] or [c for c in rows.columns if c != "_sign"]
        return rows.where(self.where).select(*columns, *(["_sign"] if "_sign" in rows.columns else []))


@dataclass(frozen=True)
class Joined:
    """The inner join of two by columns of the same names."""

    left: str
    right: str
    on: tuple[str, ...]

    @property
    def inputs(self) -> list[str]:
        return [self.left, self.right]

    def make(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, list(self.on))

    def delta(self, left: DataFrame, right: DataFrame, d_left: DataFrame | None, d_right: DataFrame | None) -> DataFrame:
        """From what the sides were, and their deltas: each delta meets the other side, and both meet each other."""
        sign = (F.col("_sign") * F.col("_other")).alias("_sign")
        parts = []
        if d_left is not None:
            parts.append(d_left.join(right, list(self.on)))
        if d_right is not None:
            parts.append(left.join(d_right, list(self.on)))
        if d_left is not None and d_right is not None:
            both = d_left.join(d_right.withColumnRenamed("_sign", "_other"), list(self.on))
            parts.append(both.select(*(c for c in both.columns if c not in ("_sign", "_other")), sign))
        return netted(reduce(DataFrame.unionByName, parts))


@dataclass(frozen=True)
class Summed:
    """A SummedView of another."""

    of: str
    keys: tuple[str, ...]
    measures: tuple[str, ...]

    @property
    def inputs(self) -> list[str]:
        return [self.of]


@dataclass(frozen=True)
class Extremes:
    """An ExtremesView of another."""

    of: str
    keys: tuple[str, ...]
    column: str

    @property
    def inputs(self) -> list[str]:
        return [self.of]


@dataclass(frozen=True)
class Computed:
    """Any function of others; made anew whenever one of them changes. keys: of its rows, for the order of its files."""

    of: tuple[str, ...]
    make: Callable[..., DataFrame]
    keys: tuple[str, ...]

    @property
    def inputs(self) -> list[str]:
        return list(self.of)


Step = Filtered | Joined | Summed | Extremes | Computed


class Chain:
    """Steps over tables, brought up to date together. A commit names the versions of all tables and views that belong together, so a refresh that broke off is begun anew from the last whole one."""

    def __init__(self, spark: SparkSession, path: str, sources: Mapping[str, FileTable], steps: Mapping[str, Step], files: int | None = None):
        self.spark, self.path, self.sources, self.steps = spark, path, dict(sources), dict(steps)
        graph = {n: [i for i in s.inputs if i in self.steps] for n, s in self.steps.items()}
        self.order = list(TopologicalSorter(graph).static_order())
        self.commits = Commits(spark, f"{path}/commits")
        self.views: dict[str, SummedView | ExtremesView | FileTable] = {}
        now = {n: t.commits.latest() for n, t in self.sources.items()}
        for name in self.order:
            step, at = self.steps[name], f"{path}/{name}"
            if isinstance(step, Summed):
                self.views[name] = SummedView.create(self._rows(step.of, now), at, step.keys, step.measures, files)
            elif isinstance(step, Extremes):
                self.views[name] = ExtremesView.create(self._rows(step.of, now), at, step.keys, step.column, files)
            elif isinstance(step, Computed):
                self.views[name] = FileTable.create(step.make(*(self._rows(i, now) for i in step.of)), at, step.keys, files)
        self.commits.put(1, json.dumps({"sources": now, "views": self._versions()}))

    def _tables(self, name: str) -> list[FileTable]:
        view = self.views[name]
        return [view] if isinstance(view, FileTable) else view.tables()

    def _versions(self) -> dict[str, list[int]]:
        return {n: [t.commits.latest() for t in self._tables(n)] for n in self.views}

    def _rows(self, name: str, sources: Mapping[str, int], views: Mapping[str, list[int]] | None = None) -> DataFrame:
        """What a name stands for, at given versions of the sources and of the views (the last by default)."""
        if name in self.sources:
            return self.sources[name].read(sources[name])
        step = self.steps[name]
        if name in self.views:
            return self.views[name].read(views[name][0] if views else None)
        return step.make(*(self._rows(i, sources, views) for i in step.inputs))

    def read(self, name: str) -> DataFrame:
        state = json.loads(self.commits.text(self.commits.latest()))
        return self._rows(name, state["sources"], state["views"])

    def refresh(self) -> dict[str, str]:
        """Brings all steps up to date with the sources; how each was: unchanged, delta or made anew."""
        number = self.commits.latest()
        state = json.loads(self.commits.text(number))
        for name, versions in state["views"].items():
            for table, version in zip(self._tables(name), versions, strict=True):
                if table.commits.latest() != version:  # left by a refresh that broke off
                    table.restore(version)
        started = self._versions()
        now = {n: t.commits.latest() for n, t in self.sources.items()}
        deltas: dict[str, DataFrame | None] = {n: self._some(t.delta(state["sources"][n], now[n])) if state["sources"][n] != now[n] else None for n, t in self.sources.items()}
        how = {}
        for name in self.order:
            step = self.steps[name]
            given = [deltas[i] for i in step.inputs]
            how[name] = "unchanged" if all(d is None for d in given) else "made anew" if isinstance(step, Computed) else "delta"
            if how[name] == "unchanged":
                deltas[name] = None
            elif isinstance(step, Filtered):
                deltas[name] = self._some(netted(step.make(given[0])))
            elif isinstance(step, Joined):
                deltas[name] = self._some(step.delta(*(self._rows(i, state["sources"], started) for i in step.inputs), *given))
            elif isinstance(step, Computed):
                new = stage_result(step.make(*(self._rows(i, now) for i in step.of)), "new")
                table = self.views[name]
                delta = stage_result(_both(table.read(), new.select(*table.schema.names)), "delta")
                table.rewrite(delta, lambda rows, new=new, delta=delta, keys=step.keys: _others(rows, delta, keys).unionByName(_others(new, delta, keys, "left_semi").select(*rows.columns)))
                deltas[name] = self._some(delta)
            else:
                deltas[name] = self._some(self.views[name].apply(given[0]))
        if not self.commits.put(number + 1, json.dumps({"sources": now, "views": self._versions()})):
            raise RuntimeError(f"another refresh of {self.path} came first")
        return how

    @staticmethod
    def _some(delta: DataFrame) -> DataFrame | None:
        delta = stage_result(delta, "delta")
        return None if _is_empty(delta) else delta
