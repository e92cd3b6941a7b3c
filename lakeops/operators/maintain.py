"""Aggregates kept up to date from deltas, and chains of derived tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summed(df: DataFrame, keys: Sequence[str], measures: Sequence[str], sign: Column | None = None) -> DataFrame:
    """keys, n, sum_x, cnt_x: what can be added and taken away."""
    s = F.lit(1) if sign is None else sign
    sums = [F.coalesce(F.sum(F.col(m) * s), F.lit(0)).alias(f"sum_{m}") for m in measures]
    counts = [F.sum(F.when(F.col(m).isNotNull(), s).otherwise(0)).alias(f"cnt_{m}") for m in measures]
    return df.groupBy(*keys).agg(F.sum(s).cast("long").alias("n"), *sums, *counts)


def maintain_aggregate(mv: DataFrame, delta: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The aggregate after a delta with _action INSERT or DELETE; groups without rows vanish. MIN and MAX can't be kept this way."""
    change = summed(delta, keys, measures, F.when(F.col("_action") == "INSERT", 1).otherwise(-1))
    both = mv.unionByName(change.select(*(F.col(c).cast(mv.schema[c].dataType).alias(c) for c in mv.columns)))
    values = [c for c in mv.columns if c not in keys]
    out = both.groupBy(*keys).agg(*(F.sum(c).cast(mv.schema[c].dataType).alias(c) for c in values))
    return out.where(F.col("n") > 0)


def rollup_from(mv: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """A coarser aggregate answered from the kept one."""
    return mv.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(f"sum_{m}").alias(f"sum_{m}") for m in measures), *(F.sum(f"cnt_{m}").alias(f"cnt_{m}") for m in measures))


def refresh_chain(sources: Mapping[str, DataFrame], defs: Mapping[str, tuple[Sequence[str], Callable[..., DataFrame]]]) -> dict[str, DataFrame]:
    """Derived tables in order of what they are made from: name -> (inputs, function of them)."""
    made = dict(sources)
    for name in TopologicalSorter({n: [i for i in inputs if i in defs] for n, (inputs, _) in defs.items()}).static_order():
        inputs, make = defs[name]
        made[name] = make(*(made[i] for i in inputs))
    return made


def freshness_report(tables: DataFrame, at: str) -> DataFrame:
    """tables: name, last_ts, target_lag_s (null: takes the smallest of its consumers, in consumer_lag_s)."""
    target = F.coalesce("target_lag_s", "consumer_lag_s")
    lag = F.timestamp_diff("SECOND", F.col("last_ts"), F.lit(at).cast("timestamp"))
    return tables.select("name", lag.alias("lag_s"), target.alias("target_s"), F.when(lag <= target, "FRESH").otherwise("LATE").alias("status"))
