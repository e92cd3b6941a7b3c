"""Aggregation, ranking and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.operators.stage import stage_result


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the given order, which should end in a tie-break."""
    return top_n_per_group(df, keys, order, 1)


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def share_of_total(df: DataFrame, keys: Sequence[str], measure: str, name: str = "share_pct") -> DataFrame:
    """Sum per key and its share of the whole. The whole is a one-row aggregate of the sums, not an unpartitioned window."""
    sums = df.groupBy(*keys).agg(F.sum(measure).alias(measure))
    total = sums.agg(F.sum(measure).alias("_total"))
    return sums.crossJoin(total).withColumn(name, F.round(F.col(measure).cast("double") * 100 / F.nullif(F.col("_total").cast("double"), F.lit(0.0)), 2)).drop("_total")


def periodic_snapshot(events: DataFrame, keys: Sequence[str], ts: str, balance: str, unit: str, first: str, last: str) -> DataFrame:
    """One row per key and period from first to last: closing balance (the last known one carried on) and number of events. A balance is never summed over time."""
    period = F.date_trunc(unit, ts)
    seen = events.groupBy(*keys, period.alias("period")).agg(F.max_by(balance, F.struct(ts, balance)).alias("_close"), F.count("*").alias("n_events"))
    calendar = F.sequence(F.date_trunc(unit, F.lit(first).cast("timestamp")), F.date_trunc(unit, F.lit(last).cast("timestamp")), F.expr(f"INTERVAL 1 {unit}"))
    grid = events.select(*keys).distinct().withColumn("period", F.explode(calendar))
    carried = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(seen, [*keys, "period"], "left")
    return joined.select(*keys, "period", F.last("_close", ignorenulls=True).over(carried).alias("closing_balance"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def accumulating_snapshot(events: DataFrame, key: str, kind: str, ts: str, milestones: Sequence[str]) -> DataFrame:
    """One row per lifecycle with the first time of each milestone, null until it is reached."""
    return events.groupBy(key).agg(*(F.min(F.when(F.col(kind) == m, F.col(ts))).alias(f"{m}_at") for m in milestones))


def ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df in order over ranges, written once so that all that follows sees the same ranges: _p, a range's number, and _m, a row's place in it (with gaps between ranges)."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage_result(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "ranged")


def _before(sizes: DataFrame, measure: str) -> DataFrame:
    """Sum of a measure over the ranges before each; there is one row per range."""
    return sizes.withColumn("_before", F.coalesce(F.sum(measure).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def surrogate_key(df: DataFrame, order: Sequence[Column], name: str = "sk", start: int = 1, step: int = 1) -> DataFrame:
    """Dense keys in order: rows are sorted by ranges, numbered within each range, and moved on by the sizes of the ranges before. No task sees all rows."""
    ordered = ranged(df, order)
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    offsets = _before(sizes, "_n").select("_p", "_first", "_before")
    return ordered.join(offsets, "_p").withColumn(name, (F.col("_m") - F.col("_first") + F.col("_before")) * step + start).drop("_p", "_m", "_first", "_before")


def running_sum(df: DataFrame, order: Sequence[Column], measures: Sequence[str]) -> DataFrame:
    """Adds to each measure m the sum of m over this row and all before it, as sum_m: within ranges by a window, over ranges by their sums. The order should end in a tie-break."""
    ordered = ranged(df, order)
    sizes = ordered.groupBy("_p").agg(*(F.sum(m).alias(f"_s_{m}") for m in measures))
    for m in measures:
        sizes = _before(sizes, f"_s_{m}").withColumnRenamed("_before", f"_b_{m}").drop(f"_s_{m}")
    within = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ordered.select("*", *(F.sum(m).over(within).alias(f"_w_{m}") for m in measures)).join(sizes, "_p")
    return out.select(*df.columns, *((F.col(f"_w_{m}") + F.col(f"_b_{m}")).alias(f"sum_{m}") for m in measures))
