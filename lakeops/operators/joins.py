"""Joins. A side is broadcast only when the planner knows it to be below the session's bound."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.operators.aggregates import ranged


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Conjunction of null-safe equalities; still an equi-join."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]], how: str = "inner") -> DataFrame:
    """Joins a fact with dimensions, each given with the fact's key and its own."""
    return reduce(lambda df, d: df.join(d[0], df[d[1]] == d[0][d[2]], how), dims, fact)


def anti_join(left: DataFrame, right: DataFrame, key: str, other: str | None = None, null_aware: bool = False) -> DataFrame:
    """Rows without a partner. null_aware: as NOT IN, which gives nothing when the list holds a null, and no row with a null key unless the list is empty."""
    other = other or key
    out = left.join(right, left[key] == right[other], "left_anti")
    if null_aware:
        facts = right.agg(F.count("*").alias("_n"), F.coalesce(F.max(F.col(other).isNull()), F.lit(False)).alias("_null"))
        out = out.join(facts, ~F.col("_null") & ((F.col("_n") == 0) | left[key].isNotNull()), "left_semi")
    return out


def full_outer_compare(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one version has, with which one."""
    b, a = before.select(*keys, F.lit(True).alias("_before")), after.select(*keys, F.lit(True).alias("_after"))
    joined = b.join(a, list(keys), "full_outer")
    side = F.when(F.col("_after").isNull(), "only_before").when(F.col("_before").isNull(), "only_after")
    return joined.where(F.col("_after").isNull() | F.col("_before").isNull()).select(*keys, side.alias("side"))


def array_membership_join(fact: DataFrame, access: DataFrame, value: str, array: str) -> DataFrame:
    """Joins where the value is in the other side's array: the array is exploded, so the join is on equality."""
    members = access.select("*", F.explode(F.array_distinct(array)).alias("_member")).drop(array)
    return fact.join(members, fact[value] == members["_member"]).drop("_member")


def join_as_of(fact: DataFrame, dim: DataFrame, key: str, ts: str, valid_from: str, valid_to: str, how: str = "left") -> DataFrame:
    """Point-in-time lookup: equal key, and ts in [valid_from, valid_to)."""
    d = dim.withColumnRenamed(key, "_key")
    return fact.join(d, (fact[key] == d["_key"]) & (fact[ts] >= d[valid_from]) & (fact[ts] < d[valid_to]), how).drop("_key")


def join_as_of_sorted(fact: DataFrame, dim: DataFrame, key: str, ts: str, valid_from: str, valid_to: str | None = None, how: str = "left") -> DataFrame:
    """Each fact row with the dimension's last version of its key that begins at or before ts and, with valid_to, ends after it; without one nulls, or no row if how is inner.

    Both sides stand in one order of key and time, cut into ranges; a version is carried on over the rows that follow
    it, and over the ranges that its key goes on in. So work grows with the rows of both sides, not with facts times
    versions of a key, and a key with any number of rows is spread over ranges. Of versions of a key that begin at once
    the one that ends last counts. A fact without key or time has no version. The dimension's columns but the key are
    added; their names must not be those of the fact.
    """
    added = [c for c in dim.columns if c != key]
    end = [F.col(valid_to).asc_nulls_first()] if valid_to else []
    sides = dim.where(F.col(key).isNotNull() & F.col(valid_from).isNotNull()).select(F.col(key).alias("_key"), F.col(valid_from).alias("_at"), F.lit(0).alias("_kind"), F.struct(*added).alias("_version"), *([F.col(valid_to).alias("_end")] if end else []))
    rows = fact.select(F.col(key).alias("_key"), F.col(ts).alias("_at"), F.lit(1).alias("_kind"), F.struct("*").alias("_fact"))
    order = [F.col("_key"), F.col("_at"), F.col("_kind"), *([F.col("_end").asc_nulls_first()] if end else [])]
    ordered = ranged(sides.unionByName(rows, allowMissingColumns=True), order)
    so_far = Window.partitionBy("_p", "_key").orderBy("_m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ordered.withColumn("_version", F.last("_version", ignorenulls=True).over(so_far)).where("_kind = 1")
    ranges = ordered.groupBy("_key", "_p").agg(F.max_by("_version", F.when(F.col("_kind") == 0, F.col("_m"))).alias("_last"))  # a row for each key, and one more for each range it goes on in
    earlier = Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("_key", "_p", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")).where("_carried IS NOT NULL")
    found = inside.join(carried, ["_key", "_p"], "left").withColumn("_version", F.coalesce("_version", "_carried"))
    holds = F.col("_version").isNotNull() & F.col("_at").isNotNull() & (F.coalesce(F.col("_at") < F.col(f"_version.{valid_to}"), F.col(f"_version.{valid_to}").isNull()) if valid_to else F.lit(True))
    found = found.withColumn("_version", F.when(holds, F.col("_version")))
    return (found.where("_version IS NOT NULL") if how == "inner" else found).select("_fact.*", *(F.col(f"_version.{c}").alias(c) for c in added))


def preaggregated(fact: DataFrame, dim: DataFrame, key: str, *measures: Column) -> DataFrame:
    """Aggregates the fact to the grain of the join first; the join then moves one row per key."""
    return fact.groupBy(key).agg(*measures).join(dim, key)


def explosion_report(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows of both sides, rows that a join on the keys would give, the multiplier, keys that repeat on both sides."""
    ca, cb = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((a, "na"), (b, "nb")))
    out = ca.join(cb, list(keys), "full_outer").agg(
        F.sum("na").alias("left_rows"), F.sum("nb").alias("right_rows"),
        F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("join_rows"),
        F.count_if((F.col("na") > 1) & (F.col("nb") > 1)).alias("many_to_many_keys"),
    )
    return out.withColumn("multiplier", F.round(F.col("join_rows") / F.greatest("left_rows", "right_rows"), 4))


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], assignments: dict[str, str]) -> DataFrame:
    """UPDATE ... SET ... FROM: columns of matched rows take the source's; a source with two rows for a key is refused when the plan runs."""
    picked = source.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_s_{c}") for c in set(assignments.values())))
    one = picked.groupBy(*(f"_k_{k}" for k in keys)).agg(F.count("*").alias("_n"), *(F.first(f"_s_{c}").alias(f"_s_{c}") for c in set(assignments.values())))
    joined = target.join(one, reduce(lambda x, y: x & y, (target[k] == one[f"_k_{k}"] for k in keys)), "left")
    matched = F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one source row for a target row")).cast("boolean")).otherwise(F.col("_n").isNotNull())
    return joined.select(*(F.when(matched, F.col(f"_s_{assignments[c]}")).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in target.columns))
