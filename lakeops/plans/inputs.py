"""Inputs derived from the given tables by fixed arithmetic, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast(MONEY)


def raised(price: Column) -> Column:
    return (price * F.lit("1.10").cast("decimal(3,2)")).cast(MONEY)


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log of orders in seven versions: inserts, updates, deletes, keys that come and go and come back. One scan."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", money("o_totalprice").alias("px"))
    k, px, status = F.col("o_orderkey"), F.col("px"), F.col("o_orderstatus")
    first = k % 13 != 0
    at2 = F.when((k % 7 == 0) & first, raised(px)).otherwise(px)

    def event(ok: Column, version: int, op: str, price: Column = px, key: Column = k, state: Column = status) -> Column:
        return F.struct(ok.alias("ok"), F.lit(version).alias("version"), F.lit(op).alias("op"), key.alias("key"), state.alias("status"), price.cast(MONEY).alias("price"))

    late = k + F.lit(1_000_000_000)
    events = F.array(
        event(first, 1, "I"),
        event((k % 7 == 0) & first, 2, "U", raised(px)),
        event(~first, 3, "I"),
        event(k % 10 == 3, 4, "D", at2),
        event((k % 21 == 0) & (k % 10 != 3), 5, "U", F.lit("1.00"), state=F.lit("X")),
        event(k % 50 == 0, 5, "I", key=late),
        event(k % 50 == 0, 6, "D", key=late),
        event(k % 30 == 3, 7, "I", F.lit("2.00")),
    )
    rows = o.select("o_custkey", F.explode(F.filter(events, lambda e: e["ok"])).alias("e"))
    return rows.select(
        F.col("e.version").alias("version"),
        F.timestamp_add("DAY", F.col("e.version"), F.lit("2024-01-01").cast("timestamp")).alias("ts"),
        F.concat(F.lit("Q"), F.col("e.version").cast("string")).alias("stmt_id"),
        F.col("e.op").alias("op"),
        F.col("e.key").cast("string").alias("row_id"),
        F.col("e.key").alias("o_orderkey"),
        "o_custkey",
        F.col("e.status").alias("o_orderstatus"),
        F.col("e.price").alias("price"),
    )


LOG_SQL = """
o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, CAST(o_totalprice AS DECIMAL(18,2)) AS px FROM orders),
e AS (
  SELECT 1 AS version, 'I' AS op, k, c, s, px AS price FROM o WHERE k % 13 <> 0
  UNION ALL SELECT 2, 'U', k, c, s, CAST(px * CAST(1.10 AS DECIMAL(3,2)) AS DECIMAL(18,2)) FROM o WHERE k % 7 = 0 AND k % 13 <> 0
  UNION ALL SELECT 3, 'I', k, c, s, px FROM o WHERE k % 13 = 0
  UNION ALL SELECT 4, 'D', k, c, s, CASE WHEN k % 7 = 0 AND k % 13 <> 0 THEN CAST(px * CAST(1.10 AS DECIMAL(3,2)) AS DECIMAL(18,2)) ELSE px END FROM o WHERE k % 10 = 3
  UNION ALL SELECT 5, 'U', k, c, 'X', CAST(1.00 AS DECIMAL(18,2)) FROM o WHERE k % 21 = 0 AND k % 10 <> 3
  UNION ALL SELECT 5, 'I', k + 1000000000, c, s, px FROM o WHERE k % 50 = 0
  UNION ALL SELECT 6, 'D', k + 1000000000, c, s, px FROM o WHERE k % 50 = 0
  UNION ALL SELECT 7, 'I', k, c, s, CAST(2.00 AS DECIMAL(18,2)) FROM o WHERE k % 30 = 3
),
log AS (
  SELECT version, TIMESTAMP '2024-01-01' + to_days(version) AS ts, 'Q' || version AS stmt_id, op, CAST(k AS VARCHAR) AS row_id,
         k AS o_orderkey, c AS o_custkey, s AS o_orderstatus, price FROM e
)"""


def state_sql(version: int, name: str) -> str:
    """State of the log at a version, as a CTE called `name`."""
    return f"""{name} AS (SELECT o_orderkey, o_custkey, o_orderstatus, price FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC) AS rn FROM log WHERE version <= {version}) WHERE rn = 1 AND op <> 'D')"""


#: Rows of the larger side of a join that a task is given: what it sorts and groups doesn't grow with the table.
TASK_ROWS = 500_000


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df dealt by a join key, in as many parts as a side of so many rows takes; as it is where the planner's own parts are small enough."""
    if rows <= 4 * TASK_ROWS:
        return df
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // TASK_ROWS)), key)


def star(spark: SparkSession, sf_dir: str, part: DataFrame | None = None) -> DataFrame:
    """One row per order line with its order's customer and date, and money in decimals; with part, the columns of its row of the table part, too. Rows lie by order, so that sums per order need no further exchange."""
    li = table(spark, sf_dir, "lineitem")
    n = li.count()  # from the footers
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    more = []
    if part is not None:
        li = spread(li, "l_partkey", n).join(spread(part, "p_partkey", n), F.col("l_partkey") == F.col("p_partkey"))
        more = part.columns
    qty, price = F.col("l_quantity").cast(MONEY), F.col("l_extendedprice").cast(MONEY)
    discount = (F.col("l_discount") * 100).cast("decimal(5,2)")
    return spread(li, "l_orderkey", n).join(spread(o, "o_orderkey", n), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "o_orderdate",
        qty.alias("quantity"), price.alias("gross"), discount.alias("discount_pct"),
        (price * (F.lit(100).cast("decimal(5,2)") - discount) * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY).alias("net"),
        *more,
    )


STAR_SQL = """
fact AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, o_orderdate, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS gross, CAST(l_discount * 100 AS DECIMAL(5,2)) AS discount_pct,
  CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(100 AS DECIMAL(5,2)) - CAST(l_discount * 100 AS DECIMAL(5,2))) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS net
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
