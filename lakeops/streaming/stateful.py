"""Streams whose state Spark keeps: aggregates by key and time in the state store, the last change of each key, and keys that fall silent.

A sink gets the keys that a micro-batch has changed and nothing else, and writes them to a folder of the batch's
number; what is known of a key is what the last batch has that names it. Every `compact_every` batches the folders are
written together. A folder goes when a later compaction, committed before, has all of it, so a batch that is repeated
after a crash finds all that it reads.

For states that don't fit in an executor's memory set spark.sql.streaming.stateStore.providerClass to Spark's RocksDB
provider; nothing here depends on it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeops.operators.stage import drop_folder
from lakeops.streaming.streams import read_table

#: Batches after which what they have written is written together.
COMPACT_EVERY = 10


def latest(spark: SparkSession, target: str, schema: str, keys: Sequence[str], before: int | None = None) -> DataFrame:
    """The last row of each key that the batches have, or those before a number."""
    rows = read_table(spark, target, f"{schema}, batch int")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in values))


def changed_keys(rows: DataFrame, target: str, schema: str, keys: Sequence[str], checkpoint: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Runs an aggregated stream in update mode over everything that is there now, into folders by batch; see latest()."""

    def write(batch: DataFrame, number: int) -> None:
        if number and number % compact_every == 0:
            old = latest(batch.sparkSession, target, schema, keys, number).join(batch.select(*keys), list(keys), "left_anti")
            batch = batch.unionByName(old)
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if number and number % compact_every == 0:
            for n in range(max(0, number - 2 * compact_every), number - compact_every):  # all in the compaction before this one
                drop_folder(batch.sparkSession, f"{target}/batch={n}")

    query = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def rolled_schema(keys: dict[str, str], measures: dict[str, str], width: str | None = None) -> str:
    """Schema of what sensor_rollup() writes, of keys and measures with their types."""
    window = {"window_start": "timestamp", "window_end": "timestamp"} if width else {}
    values = {f"{f}_{m}": t for m, kind in measures.items() for f, t in (("cnt", "long"), ("sum", kind), ("min", kind), ("max", kind))}
    return ", ".join(f"{c} {t}" for c, t in {**keys, **window, "n": "long", **values}.items())


def sensor_rollup(rows: DataFrame, target: str, keys: dict[str, str], measures: dict[str, str], checkpoint: str, ts: str | None = None, width: str | None = None, late: str = "1 hour", compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Number, counts, sums, smallest and largest of measures by key, and by windows of time where a width is given.

    The state is Spark's: a micro-batch reads and writes the groups it changes. With windows, rows that come more than
    `late` after the latest time seen may be left out, and the state of a window that can't change any more is dropped.
    keys, measures: names with their types.
    """
    group = [F.col(k) for k in keys]
    if width:
        rows = rows.withWatermark(ts, late)
        group.append(F.window(ts, width).alias("window"))
    values = [f(m).cast(kind).alias(f"{name}_{m}") for m, kind in measures.items() for name, f, kind in (("cnt", F.count, "long"), ("sum", F.sum, kind), ("min", F.min, kind), ("max", F.max, kind))]
    rolled = rows.groupBy(*group).agg(F.count("*").alias("n"), *values)
    window = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")] if width else []
    names = [*keys, *("window_start", "window_end")[: len(window)]]
    out = rolled.select(*keys, *window, *(c for c in rolled.columns if c not in (*keys, "window")))
    return changed_keys(out, target, rolled_schema(keys, measures, width), names, checkpoint, compact_every)


def cdc_merge(changes: DataFrame, target: str, schema: str, keys: Sequence[str], order: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keeps each key's last change by `order` (of one change a new row after the old one) in the state store, and writes the keys that a micro-batch has changed. Changes may come in any order, in one batch or many: an earlier one changes nothing.

    schema: of the table, without _action. merged() reads the table; deleted keys stay as such, so that earlier changes of them don't bring them back.
    """
    feed = changes.where(~((F.col("_action") == "DELETE") & F.col("_is_update")))
    values = [c for c in feed.columns if c not in (*keys, "_is_update", order)]
    last = feed.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(order, F.col("_action") == "INSERT")).alias("_last"))
    return changed_keys(last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in values)), target, f"{schema}, _action string", keys, checkpoint, compact_every)


def merged(spark: SparkSession, target: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The table that cdc_merge() keeps."""
    return latest(spark, target, f"{schema}, _action string", keys).where("_action <> 'DELETE'").drop("_action")


def silences(rows: DataFrame, key: str, ts: str, quiet_s: int, late: str = "0 seconds") -> DataFrame:
    """A stream of when keys fell silent and came back: key, status (DOWN or UP), at.

    A key is down once nothing of it has come for quiet_s seconds of event time, told by a timer of its state when the
    watermark passes that time, or by its next row. A key's state is the time of its last row and whether it is down.
    Rows of a batch that are older than the key's last row change nothing.
    """
    kind = dict(rows.dtypes)[key]
    quiet = pd.Timedelta(seconds=quiet_s)

    def step(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, down = (pd.Timestamp(state.get[0], unit="us"), state.get[1]) if state.exists else (None, False)
        found = []
        if state.hasTimedOut:
            if not down:
                found.append(("DOWN", last + quiet))
            down = True
        times = sorted(t for b in batches for t in b["at"].dropna())
        for t in times:
            if last is not None and t <= last:
                continue
            if last is not None and t - last > quiet:
                if not down:
                    found.append(("DOWN", last + quiet))
                found.append(("UP", t))
            last, down = t, False
        if last is not None:
            state.update((last.value // 1000, down))
            if not down:
                state.setTimeoutTimestamp(max((last + quiet).value // 1_000_000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": [names[0]] * len(found), "status": [s for s, _ in found], "at": [a for _, a in found]})

    named = rows.select(F.col(key).alias("key"), F.col(ts).alias("at")).withWatermark("at", late)
    return named.groupBy("key").applyInPandasWithState(step, f"key {kind}, status string, at timestamp", "last long, down boolean", "append", GroupStateTimeout.EventTimeTimeout)
