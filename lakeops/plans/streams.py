"""Batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.plans.inputs import money, table
from lakeops.plans.registry import query
from lakeops.streaming import streams


@query("R02_ingest_rows", "SELECT event_type AS channel, max(event_id) AS \"offset\", count(*) AS n FROM events JOIN (SELECT event_type, max(event_id) // 2 AS seen FROM events GROUP BY 1) USING (event_type) WHERE event_id > seen GROUP BY 1")
def r02(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("offset"))
    committed = e.groupBy("channel").agg(F.expr("max(offset) DIV 2").alias("offset"))
    fresh, now = streams.ingest_rows(e.unionByName(e.where("offset % 10 = 0")), committed)
    return now.join(fresh.groupBy("channel").agg(F.count("*").alias("n")), "channel")


@query("R08_dead_letter_route", "SELECT o_orderkey, o_orderkey % 97 = 0 OR o_totalprice < 5000 AS bad FROM orders")
def r08(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey")).alias("c"), "o_totalprice")
    good, bad = streams.dead_letter_route(o, {"customer": F.col("c").isNotNull(), "price": F.col("o_totalprice") >= 5000})
    return good.select("o_orderkey", F.lit(False).alias("bad")).unionByName(bad.select("o_orderkey", F.lit(True).alias("bad")))


@query("R09_validate_enrich_invoice", "SELECT o_custkey AS customer_id, c_name AS customer_name, count(*) AS n_orders, CAST(sum((1 + o_orderkey % 5) * CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 50 <> 0 GROUP BY 1, 2")
def r09(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("customer_id"), F.when(k % 50 == 0, -1).otherwise(1 + k % 5).cast("int").alias("quantity"), money("o_totalprice").alias("price"))
    customers = table(s, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"))
    return streams.invoices(orders, customers).withColumn("total", F.col("total").cast("decimal(38,2)"))
