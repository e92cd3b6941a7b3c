"""Checks that give one small row each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def referential_integrity(fact: DataFrame, dims: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """check, missing: fact rows whose key isn't in the dimension."""
    rows = [fact.where(F.col(k).isNotNull()).join(d, fact[k] == d[other], "left_anti").agg(F.count("*").alias("missing")).select(F.lit(k).alias("check"), "missing") for k, (d, other) in dims.items()]
    return reduce(DataFrame.unionByName, rows)


def duplicate_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("n") > 1).alias("repeated_keys"))


def sanity_check(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule, violations; all rules in one pass."""
    one = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules)))
    return one.select(pairs.alias("r")).select("r.*")


def scd2_integrity(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """check, n: keys with more than one current row, versions that overlap the next, gaps between versions."""
    many = dim.where("is_current").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")).select(F.lit("many_current").alias("check"), "n")
    after = F.lead("effective_from").over(Window.partitionBy(*keys).orderBy("effective_from", "effective_to"))
    pairs = dim.withColumn("_next", after).agg(F.count_if(F.col("_next") <= F.col("effective_to")).alias("o"), F.count_if(F.col("_next") > F.date_add("effective_to", 1)).alias("g"))
    return many.unionByName(pairs.select(F.lit("overlap").alias("check"), F.col("o").alias("n"))).unionByName(pairs.select(F.lit("gap").alias("check"), F.col("g").alias("n")))


def layer_counts(layers: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n") for name, df in layers.items()))


def metric_functions(df: DataFrame, column: str, ts: str, at: str) -> DataFrame:
    """Nulls, distinct values, rows beyond the first of each value, seconds since the newest row: one aggregation."""
    c = F.col(column)
    return df.agg(
        F.count_if(c.isNull()).alias("null_count"), F.count_distinct(c).alias("unique_count"),
        (F.count(c) - F.count_distinct(c)).alias("duplicate_count"),
        F.timestamp_diff("SECOND", F.max(ts), F.lit(at).cast("timestamp")).alias("freshness_s"),
    )


def alert(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """A row with the alert's name if any row meets the condition."""
    return df.where(condition).limit(1).select(F.lit(name).alias("alert"))


def reconcile(source: DataFrame, target: DataFrame, name: str) -> DataFrame:
    """Counts and order-free checksums of both sides, and whether they agree."""
    side = lambda df, p: df.agg(F.count("*").alias(f"{p}_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias(f"{p}_sum"))
    both = side(source, "source").crossJoin(side(target.select(*source.columns), "target"))
    return both.select(F.lit(name).alias("table_name"), "source_rows", "target_rows", (F.col("source_rows").eqNullSafe(F.col("target_rows")) & F.col("source_sum").eqNullSafe(F.col("target_sum"))).alias("match"))
