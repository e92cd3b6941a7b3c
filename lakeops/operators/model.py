"""Layered warehouse: staging, dimensions, and decomposition of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.functions.scalar import day_of_week, last_day_of
from lakeops.operators.aggregates import latest_per_key, surrogate_key


def stage_table(raw: DataFrame, spec: Mapping[str, tuple[str, str, object]], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All-text rows to typed ones, the latest per key. spec: column -> (lower, upper or as_is; type; default)."""
    change = {"lower": F.lower, "upper": F.upper, "as_is": lambda c: c}
    columns = [F.coalesce(change[how](F.trim(F.col(c))).try_cast(kind), F.lit(default).cast(kind)).alias(c) for c, (how, kind, default) in spec.items()]
    return latest_per_key(raw.select(*columns), keys, order)


def dim_date(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day; weeks as ISO has them, Sunday is day 0."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("full_date"))
    d = F.col("full_date")
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), d,
        F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.weekofyear(d).alias("week"),
        F.dayofmonth(d).alias("day"), F.dayofyear(d).alias("day_of_year"), day_of_week(d).alias("day_of_week"),
        F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "MMM").alias("month_short"), F.date_format(d, "E").alias("day_short"),
        F.date_format(d, "yyyy-MM").alias("year_month"), F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")).alias("year_quarter"),
        F.trunc(d, "month").alias("month_start"), last_day_of("month", d).alias("month_end"),
        F.trunc(d, "quarter").alias("quarter_start"), last_day_of("quarter", d).alias("quarter_end"),
        F.trunc(d, "year").alias("year_start"), last_day_of("year", d).alias("year_end"),
        day_of_week(d).isin(0, 6).alias("is_weekend"),
    )


def dimension(src: DataFrame, key: str, columns: Sequence[Column], name: str) -> DataFrame:
    """Surrogate keys in order of the business key."""
    return surrogate_key(src.select(key, *columns), [F.col(key)], name)


def data_vault_split(src: DataFrame, key: str, attributes: Sequence[str], loaded: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(hub, satellite): first load of each key, and a row for each change of the attributes."""
    from pyspark.sql import Window

    hashed = src.withColumn("hash_key", F.sha2(F.col(key).cast("string"), 256)).withColumn("hash_diff", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(a).cast("string"), F.lit("")) for a in attributes)), 256))
    hub = hashed.groupBy("hash_key", key).agg(F.min(loaded).alias("load_date")).withColumn("record_source", F.lit(source))
    before = F.lag("hash_diff").over(Window.partitionBy("hash_key").orderBy(loaded))
    satellite = hashed.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("hash_diff"))).select("hash_key", loaded, "hash_diff", *attributes)
    return hub, satellite


def decompose(df: DataFrame, determinant: Sequence[str], dependents: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rest, own table): a dependency's columns moved to a table of their own; lossless where holds() says so."""
    return df.drop(*dependents), df.select(*determinant, *dependents).distinct()


def broken_dependency(df: DataFrame, determinant: Sequence[str], dependents: Sequence[str]) -> DataFrame:
    """Determinant values with more than one combination of dependents."""
    return df.select(*determinant, *dependents).distinct().groupBy(*determinant).agg(F.count("*").alias("n")).where("n > 1")


def junk_dimension(df: DataFrame, flags: Sequence[str], name: str = "junk_key") -> tuple[DataFrame, DataFrame]:
    """(dimension, rows with its key): combinations of flags, nulls equal, numbered in order."""
    combos = surrogate_key(df.select(*flags).distinct(), [F.col(f).asc_nulls_first() for f in flags], name)
    renamed = combos.select(F.col(name), *(F.col(f).alias(f"_{f}") for f in flags))
    on = [df[f].eqNullSafe(renamed[f"_{f}"]) for f in flags]
    return combos, df.join(renamed, on).drop(*flags, *(f"_{f}" for f in flags))


def cardinality_profile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Most rows per key of both sides and the class: 1:1, 1:M, M:1 or M:N."""
    most = lambda df, n: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).agg(F.max("_n").alias(n))
    both = most(a, "left_most").crossJoin(most(b, "right_most"))
    side = lambda n, many: F.when(F.col(n) > 1, many).otherwise("1")
    kind = F.when((F.col("left_most") > 1) & (F.col("right_most") > 1), "M:N").otherwise(F.concat(side("left_most", "M"), F.lit(":"), side("right_most", "M")))
    return both.withColumn("kind", kind)
