"""Masking, row access and sharing; roles and accounts are parameters."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKED = "***MASKED***"

#: What a value of each category looks like.
CATEGORIES = {
    "EMAIL": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "PHONE": r"^\+?[0-9][0-9 ()-]{6,}$",
    "IP": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$",
    "CARD": r"^[0-9]{4}([ -]?[0-9]{4}){3}$",
}


def mask_column(df: DataFrame, column: str, role: str, admins: Collection[str], mask: Callable[[Column], Column] | None = None) -> DataFrame:
    if role in admins:
        return df
    return df.withColumn(column, mask(F.col(column)) if mask else F.when(F.col(column).isNotNull(), F.lit(MASKED)))


def row_access(df: DataFrame, column: str, allowed: Mapping[str, Sequence], role: str, admins: Collection[str]) -> DataFrame:
    """Admins see all rows, a role those with one of its values, any other role none."""
    return df if role in admins else df.where(F.col(column).isin(list(allowed.get(role, []))))


def tag_based_masking(df: DataFrame, tags: Mapping[str, str], policies: Mapping[str, Callable[[Column], Column]], role: str, admins: Collection[str]) -> DataFrame:
    if role in admins:
        return df
    return df.withColumns({c: policies[t](F.col(c)) for c, t in tags.items() if t in policies and c in df.columns})


def tenant_filter(fact: DataFrame, access: DataFrame, key: str, account: str) -> DataFrame:
    """Rows whose key the account may see; a semi join, so a mapping with repeats duplicates nothing."""
    return fact.join(access.where(F.col("account") == account), key, "left_semi")


def clean_room_overlap(a: DataFrame, b: DataFrame, key: str, dims: Sequence[str], least: int) -> DataFrame:
    """People per group that both parties know, matched on hashed keys; groups below `least` aren't shown."""
    hashed = lambda df: df.withColumn("_h", F.sha2(F.col(key).cast("string"), 256))
    matched = hashed(a).select("_h", *dims).join(hashed(b).select("_h").distinct(), "_h")
    return matched.groupBy(*dims).agg(F.count_distinct("_h").alias("n_matched")).where(F.col("n_matched") >= least)


def classify_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, category, probability: share of all non-null values that look like each category; one pass."""
    hits = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("category"), F.round(F.count_if(F.col(c).rlike(p)) / F.nullif(F.count(c), F.lit(0)), 4).alias("probability")) for c in columns for k, p in CATEGORIES.items()]
    return df.agg(F.array(*hits).alias("h")).select(F.explode("h").alias("h")).select("h.*").where("probability > 0")
