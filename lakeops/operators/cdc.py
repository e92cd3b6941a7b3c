"""Change data capture and past states over a change log (version, ts, stmt_id, op in I/U/D, row_id, columns) or two snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.operators.aggregates import latest_per_key


def state_at(log: DataFrame, version: int, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows at a version: each key's last entry, without deleted ones. A key (a row's id) is never null.

    The last version of a key is a hash aggregation; the entries then meet it in a hash join, so nothing is sorted.
    """
    seen = log.where(F.col("version") <= version)
    last = seen.groupBy(*keys).agg(F.max("version").alias("_last"))
    found = seen.select(*keys, *columns, "op", "version").join(last.hint("shuffle_hash"), list(keys))
    return found.where((F.col("version") >= F.col("_last")) & (F.col("op") != "D")).select(*keys, *columns)


def net_changes(log: DataFrame, v_from: int, v_to: int, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Least changes from one version to another: _action, _is_update, _row_id, keys and columns.

    Insert and delete in the range cancel; an insert with updates is one insert of the last values; updates are a
    delete of the old row and an insert of the new one; an update then a delete is a delete of the values at v_from.
    Only keys with an entry in the range are looked at further; their last entries at both ends are compared.
    """
    v = F.col("version")
    seen = log.where(v <= v_to)
    ends = seen.groupBy(*keys).agg(F.max(F.when(v <= v_from, v)).alias("_from"), F.max(v).alias("_to")).where(F.col("_to") > v_from)
    rows = seen.select(*keys, *columns, "op", "version").join(ends.hint("shuffle_hash"), list(keys))
    live = F.col("op") != "D"
    a = rows.where((v == F.col("_from")) & live).select(*keys, F.struct(*columns).alias("a"))
    b = rows.where((v == F.col("_to")) & live).select(*keys, F.struct(*columns).alias("b"))
    pairs = a.join(b.hint("shuffle_hash"), list(keys), "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return _feed(pairs, "a", "b", keys, columns)


def _feed(pairs: DataFrame, old: str, new: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    update = F.col(old).isNotNull() & F.col(new).isNotNull()
    event = lambda side, action: F.struct(F.col(side).alias("r"), F.lit(action).alias("_action"))
    events = F.filter(F.array(event(old, "DELETE"), event(new, "INSERT")), lambda e: e["r"].isNotNull())
    out = pairs.select(*keys, update.alias("_is_update"), F.explode(events).alias("e"))
    return out.select("e._action", "_is_update", F.concat_ws("|", *keys).alias("_row_id"), *keys, *(F.col(f"e.r.{c}").alias(c) for c in columns))


def has_data(log: DataFrame, offset: int) -> DataFrame:
    """One row, has_data: whether a consumer at an offset has anything to read; a probe of one row."""
    return log.where(F.col("version") > offset).limit(1).agg((F.count("*") > 0).alias("has_data"))


def append_only_changes(log: DataFrame, v_from: int, v_to: int) -> DataFrame:
    return log.where((F.col("op") == "I") & (F.col("version") > v_from) & (F.col("version") <= v_to))


def initial_rows(snapshot: DataFrame, keys: Sequence[str]) -> DataFrame:
    return snapshot.select(F.lit("INSERT").alias("_action"), F.lit(False).alias("_is_update"), F.concat_ws("|", *keys).alias("_row_id"), "*")


def version_at(log: DataFrame, ts: str) -> int:
    """Last version at or before a time; an error before the first."""
    found = log.where(F.col("ts") <= F.lit(ts).cast("timestamp")).agg(F.max("version")).first()[0]
    if found is None:
        raise ValueError(f"no version at or before {ts}")
    return found


def version_before(log: DataFrame, stmt_id: str) -> int:
    """The version just before a statement."""
    found = log.where(F.col("stmt_id") == stmt_id).agg(F.min("version")).first()[0]
    if found is None:
        raise ValueError(f"unknown statement {stmt_id}")
    return found - 1


def diff_snapshots(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Change feed between two snapshots with unique keys."""
    a = old.select(*keys, F.struct(*columns).alias("_old"))
    b = new.select(*keys, F.struct(*columns).alias("_new"))
    return _feed(a.join(b.hint("shuffle_hash"), list(keys), "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new"))), "_old", "_new", keys, columns)


def restore_deleted(current: DataFrame, past: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current rows and those of the past whose key is gone."""
    return current.unionByName(past.join(current, list(keys), "left_anti"))


def high_water_increment(df: DataFrame, ts: str, last: str) -> DataFrame:
    return df.where(F.col(ts) > F.lit(last).cast("timestamp"))


def sequence_guard(updates: DataFrame, target: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Of each key's updates the last by sequence, if it is later than the target's."""
    last = latest_per_key(updates, keys, [F.desc(seq)])
    return last.join(target.select(*keys, F.col(seq).alias("_at")), list(keys), "left").where(F.col("_at").isNull() | (F.col(seq) > F.col("_at"))).drop("_at")


def version_history(log: DataFrame) -> DataFrame:
    count = lambda op, name: F.count_if(F.col("op") == op).alias(name)
    return log.groupBy("version").agg(F.min("ts").alias("ts"), F.min("stmt_id").alias("stmt_id"), count("I", "inserted"), count("U", "updated"), count("D", "deleted"))


def retained_history(log: DataFrame, keys: Sequence[str], at: str, days: int, least_days: int = 0) -> DataFrame:
    """Entries that any state in the window needs: those in it and each key's last one before it, unless that is a delete."""
    cut = F.timestamp_add("DAY", F.lit(-max(days, least_days)), F.lit(at).cast("timestamp"))
    older = log.where(F.col("ts") <= cut)
    last = older.groupBy(*keys).agg(F.max("version").alias("_last"))
    kept = older.join(last.hint("shuffle_hash"), list(keys)).where((F.col("version") >= F.col("_last")) & (F.col("op") != "D")).select(*log.columns)
    return log.where(F.col("ts") > cut).unionByName(kept)


def staleness_report(consumers: DataFrame, retention_days: int, extension_days: int, at: str) -> DataFrame:
    after = F.timestamp_add("DAY", F.lit(max(retention_days, extension_days)), F.col("offset_ts"))
    return consumers.select("consumer", "offset_ts", after.alias("stale_after"), (F.lit(at).cast("timestamp") > after).alias("stale"))


def view_delta(left_delta: DataFrame, left: DataFrame, right_delta: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Delta of an inner join: dL x R, L x dR and dL x dR, netted per row. Deltas have _sign (1 or -1); left and right are the contents at the offset."""
    l0, r0 = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    dl, dr = left_delta.withColumnRenamed("_sign", "_l"), right_delta.withColumnRenamed("_sign", "_r")
    parts = dl.join(r0, key).unionByName(l0.join(dr, key)).unionByName(dl.join(dr, key))
    columns = [c for c in parts.columns if c not in ("_l", "_r")]
    return parts.groupBy(*columns).agg(F.sum(F.col("_l") * F.col("_r")).alias("_sign")).where("_sign <> 0")


def file_lifecycle(files: DataFrame, at: str, retention_days: int, safe_days: int = 7) -> DataFrame:
    """State of each file (created_ts, deleted_ts) at a time."""
    t = F.lit(at).cast("timestamp")
    gone = lambda days: F.timestamp_add("DAY", F.lit(days), F.col("deleted_ts"))
    state = F.when(F.col("created_ts") > t, "NOT_YET").when(F.col("deleted_ts").isNull() | (F.col("deleted_ts") > t), "ACTIVE").when(t <= gone(retention_days), "TIME_TRAVEL").when(t <= gone(retention_days + safe_days), "FAIL_SAFE").otherwise("PURGED")
    return files.withColumn("state", state)
