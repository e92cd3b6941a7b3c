"""User-defined functions: SQL, Python over Arrow, and table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sql_functions(spark: SparkSession) -> None:
    """calculate_tax(amount, rate), celsius_to_fahrenheit(c) and the table function split_tags(text) in SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION calculate_tax(amount DECIMAL(18,2), rate DECIMAL(5,2)) RETURNS DECIMAL(18,2) RETURN CAST(amount * rate AS DECIMAL(18,2))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION celsius_to_fahrenheit(c DOUBLE) RETURNS DOUBLE RETURN c * 9 / 5 + 32")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION split_tags(tags STRING) RETURNS TABLE(tag STRING) RETURN SELECT trim(t.c) FROM (SELECT explode(split(tags, ',')) AS c) t")


def reverse_string():
    """Python scalar function over Arrow batches."""
    return F.udf(lambda text: None if text is None else text[::-1], "string", useArrow=True)


def vectorised_discount():
    """Batches of Series in and out."""

    @F.pandas_udf("double")
    def discounted(price: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in price:
            yield (batch * 0.9).round(4)

    return discounted


def generate_dates():
    """Table function: one row per day of a range."""

    @F.udtf(returnType="day date")
    class Dates:
        def eval(self, first, last):
            import datetime

            if first is not None and last is not None:
                for n in range((last - first).days + 1):
                    yield (first + datetime.timedelta(days=n),)

    return Dates


def running_totals():
    """Partitioned table function: a running total per row, and the total at the partition's end."""

    @F.udtf(returnType="key bigint, at bigint, running bigint")
    class Running:
        def __init__(self):
            self.key, self.total = None, 0

        def eval(self, row):
            self.key, self.total = row["key"], self.total + (row["amount"] or 0)
            yield row["key"], row["at"], self.total

        def terminate(self):
            if self.key is not None:
                yield self.key, None, self.total

    return Running


def top_customers(orders: DataFrame, least: float) -> DataFrame:
    """Table-returning procedure with a bound parameter."""
    return orders.sparkSession.sql("SELECT o_custkey, count(*) AS n FROM {o} WHERE o_totalprice >= :least GROUP BY o_custkey", args={"least": least}, o=orders)


def search_table(df: DataFrame, column: str, value: object, allowed: frozenset[str]) -> DataFrame:
    """Rows whose column equals a value; only listed columns can be searched."""
    if column not in allowed:
        raise ValueError(f"column {column} can't be searched")
    return df.where(F.col(column) == F.lit(value))
