"""Queries of filters, joins, aggregates, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from lakeops.functions import scalar as fn
from lakeops.operators import aggregates as agg
from lakeops.operators import joins
from lakeops.plans.inputs import MONEY, STAR_SQL, money, star, table
from lakeops.plans.registry import query

D28 = "decimal(28,2)"


@query("P01_project", "SELECT c_custkey, c_name || ' / ' || c_mktsegment AS label, CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 2 AS DECIMAL(19,2)) AS doubled FROM customer")
def p01(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", F.concat_ws(" / ", "c_name", "c_mktsegment").alias("label"), (money("c_acctbal") * 2).cast("decimal(19,2)").alias("doubled"))


@query("P02_filter", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 300000 AND o_orderpriority LIKE '%H%' AND NOT o_custkey < 50")
def p02(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(s, d, "orders").where(c("o_orderstatus").isin("F", "O") & c("o_totalprice").between(1000, 300000) & c("o_orderpriority").like("%H%") & ~(c("o_custkey") < 50)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("P03_sargable_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = 3")
def p03(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").where(fn.month_range("o_orderdate", 1997, 3)).select("o_orderkey", "o_orderdate")


@query("P04_case_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders")
def p04(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", fn.case_map("o_orderstatus", {"F": "filled", "O": "open"}, "other").alias("state"))


@query("P05_safe_cast", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 97 = 0 THEN 'bad' ELSE CAST(o_custkey AS VARCHAR) END AS BIGINT) AS cust FROM orders")
def p05(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, "bad").otherwise(F.col("o_custkey").cast("string")).alias("cust"))
    return fn.safe_cast(raw, {"cust": "bigint"})


@query("P06_null_safe_eq", """
WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS c FROM orders),
b AS (SELECT DISTINCT CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey END AS c FROM customer)
SELECT a.k, b.c FROM a JOIN b ON a.c IS NOT DISTINCT FROM b.c""")
def p06(s: SparkSession, d: str) -> DataFrame:
    holes = lambda k, c: F.when(F.col(k) % 17 == 0, None).otherwise(F.col(c)).alias("c")
    a = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), holes("o_orderkey", "o_custkey"))
    b = table(s, d, "customer").select(holes("c_custkey", "c_custkey")).distinct()
    return a.join(b, joins.null_safe(a, b, ["c"])).select(a["k"], b["c"])


@query("P07_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def p07(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("J01_star_join", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j01(s: SparkSession, d: str) -> DataFrame:
    dims = [(table(s, d, t), k, o) for t, k, o in (("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey"))]
    return joins.star_join(table(s, d, "orders"), dims).select("o_orderkey", "c_name", "n_name", "r_name")


@query("J02_denormalise", "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) n ON s_nationkey = n_nationkey")
def j02(s: SparkSession, d: str) -> DataFrame:
    return joins.star_join(table(s, d, "supplier"), [(table(s, d, "nation").where("n_nationkey % 3 <> 0"), "s_nationkey", "n_nationkey")], "left").select("s_suppkey", "s_name", "n_name")


@query("J03_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def j03(s: SparkSession, d: str) -> DataFrame:
    return joins.anti_join(table(s, d, "customer"), table(s, d, "orders"), "c_custkey", "o_custkey", null_aware=True).select("c_custkey")


@query("J04_semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j04(s: SparkSession, d: str) -> DataFrame:
    c, o = table(s, d, "customer"), table(s, d, "orders").where("o_orderstatus = 'F'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_name")


@query("J05_full_outer_compare", """
WITH a AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 13 <> 0), b AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'only_before' ELSE 'only_after' END AS side
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL""")
def j05(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return joins.full_outer_compare(o.where("o_orderkey % 13 <> 0"), o.where("o_orderkey % 10 <> 3"), ["o_orderkey"])


@query("J06_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def j06(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "region").crossJoin(table(s, d, "nation")).select("r_name", "n_name")


@query("J07_composite_null_safe_join", """
WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey END AS p, l_returnflag FROM lineitem),
u AS (SELECT DISTINCT l_orderkey, l_linenumber, p FROM t)
SELECT u.l_orderkey, u.l_linenumber, u.p, count(t.l_orderkey) AS n FROM u LEFT JOIN t ON u.l_orderkey IS NOT DISTINCT FROM t.l_orderkey AND u.l_linenumber IS NOT DISTINCT FROM t.l_linenumber
  AND u.p IS NOT DISTINCT FROM t.p AND t.l_returnflag = 'R' GROUP BY ALL""")
def j07(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 7 == 0, None).otherwise(F.col("l_partkey")).alias("p"), "l_returnflag")
    u = t.select("l_orderkey", "l_linenumber", "p").distinct().alias("u")
    v = t.alias("v")
    on = [F.col(f"u.{k}").eqNullSafe(F.col(f"v.{k}")) for k in ("l_orderkey", "l_linenumber", "p")]
    return u.join(v, [*on, F.col("v.l_returnflag") == "R"], "left").groupBy("u.l_orderkey", "u.l_linenumber", "u.p").agg(F.count("v.l_orderkey").alias("n"))


@query("J08_array_membership_join", """
WITH a AS (SELECT 'ACC_' || n_nationkey AS account, [n_nationkey, n_nationkey + 1] AS nations FROM nation)
SELECT account, s_suppkey FROM supplier JOIN (SELECT account, unnest(nations) AS m FROM a) ON s_nationkey = m""")
def j08(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    access = table(s, d, "nation").select(F.concat(F.lit("ACC_"), n.cast("string")).alias("account"), F.array(n, n + 1).alias("nations"))
    return joins.array_membership_join(table(s, d, "supplier"), access, "s_nationkey", "nations").select("account", "s_suppkey")


@query("J10_join_as_of_dim", """
WITH v AS (SELECT c_custkey, c_mktsegment AS seg, TIMESTAMP '1990-01-01' AS f, TIMESTAMP '1998-01-01' AS t FROM customer
 UNION ALL SELECT c_custkey, 'LATER', TIMESTAMP '1998-01-01', TIMESTAMP '9999-12-31' FROM customer)
SELECT o_orderkey, seg FROM orders LEFT JOIN v ON o_custkey = c_custkey AND o_orderdate >= f AND o_orderdate < t""")
def j10(s: SparkSession, d: str) -> DataFrame:
    c, ts = table(s, d, "customer"), lambda x, n: F.lit(x).cast("timestamp").alias(n)
    first = c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg"), ts("1990-01-01", "f"), ts("1998-01-01", "t"))
    later = c.select(F.col("c_custkey").alias("o_custkey"), F.lit("LATER").alias("seg"), ts("1998-01-01", "f"), ts("9999-12-31", "t"))
    return joins.join_as_of(table(s, d, "orders"), first.unionByName(later), "o_custkey", "o_orderdate", "f", "t").select("o_orderkey", "seg")


@query("J12_preaggregate_join", "SELECT c_custkey, c_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def j12(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.preaggregated(o, table(s, d, "customer"), "c_custkey", F.sum(money("o_totalprice")).cast(D28).alias("total"), F.count("*").alias("n")).select("c_custkey", "c_name", "total", "n")


@query("J14_join_explosion_report", """
WITH a AS (SELECT l_orderkey AS k, count(*) AS na FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, count(*) AS nb FROM orders GROUP BY 1),
r AS (SELECT CAST(sum(na) AS BIGINT) AS left_rows, CAST(sum(nb) AS BIGINT) AS right_rows, CAST(coalesce(sum(na * nb), 0) AS BIGINT) AS join_rows,
 CAST(count(*) FILTER (na > 1 AND nb > 1) AS BIGINT) AS many_to_many_keys FROM a FULL JOIN b USING (k))
SELECT *, round(join_rows / greatest(left_rows, right_rows), 4) AS multiplier FROM r""")
def j14(s: SparkSession, d: str) -> DataFrame:
    return joins.explosion_report(table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")), table(s, d, "orders").select(F.col("o_orderkey").alias("k")), ["k"])


@query("J15_update_from", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def j15(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    source = c.where("c_custkey % 5 = 0").select("c_custkey", F.lit("MOVED").alias("seg"))
    return joins.update_from(c, source, ["c_custkey"], {"c_mktsegment": "seg"})


@query("A01_aggregate", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS qty, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1, 2")
def a01(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(money("l_quantity")).cast(D28).alias("qty"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("A02_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a02(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("A03_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def a03(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("A04_ratio_pct", "SELECT o_orderpriority, round(CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) * 100, 2) AS pct FROM orders GROUP BY 1")
def a04(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_orderpriority").agg(fn.ratio_pct(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("pct"))


@query("A05_group_by_expr", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n FROM orders GROUP BY 1")
def a05(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").alias("n"))


@query("A06_global_agg", "SELECT count(*) AS n, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders")
def a06(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))


@query("A07_conditional_agg", "SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS filled, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1")
def a07(s: SparkSession, d: str) -> DataFrame:
    st = F.col("o_orderstatus")
    return table(s, d, "orders").groupBy("o_custkey").agg(F.sum(F.when(st == "F", 1).otherwise(0)).alias("filled"), F.count_if(st == "O").alias("open"))


@query("A08_share_of_total", """
WITH x AS (SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS price FROM orders GROUP BY 1)
SELECT o_orderpriority, price, round(CAST(price AS DOUBLE) * 100 / CAST((SELECT sum(price) FROM x) AS DOUBLE), 2) AS share_pct FROM x""")
def a08(s: SparkSession, d: str) -> DataFrame:
    out = agg.share_of_total(table(s, d, "orders").select("o_orderpriority", money("o_totalprice").alias("price")), ["o_orderpriority"], "price")
    return out.withColumn("price", F.col("price").cast(D28))


@query("A09_periodic_snapshot", """
WITH e AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS period, arg_max(event_id, struct_pack(ts := ts, event_id := event_id)) AS c, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT u.user_id, p.period FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS period) p)
SELECT user_id, period, last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY period ROWS UNBOUNDED PRECEDING) AS closing_balance, coalesce(n, 0) AS n_events FROM g LEFT JOIN e USING (user_id, period)""")
def a09(s: SparkSession, d: str) -> DataFrame:
    return agg.periodic_snapshot(table(s, d, "events"), ["user_id"], "ts", "event_id", "day", "2024-01-01", "2024-01-30")


@query("A10_accumulating_snapshot", "SELECT user_id, min(ts) FILTER (event_type = 'signup') AS signup_at, min(ts) FILTER (event_type = 'purchase') AS purchase_at FROM events GROUP BY 1")
def a10(s: SparkSession, d: str) -> DataFrame:
    return agg.accumulating_snapshot(table(s, d, "events"), "user_id", "event_type", "ts", ["signup", "purchase"])


@query("A11_array_agg_objects", "SELECT n_regionkey, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS nations FROM nation GROUP BY 1")
def a11(s: SparkSession, d: str) -> DataFrame:
    objects = table(s, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    return objects.withColumn("nations", F.array_join(F.transform("nations", lambda n: F.concat_ws(":", n["n_nationkey"], n["n_name"])), ","))


PCT = "round(CAST(profit AS DOUBLE) / nullif(CAST(revenue AS DOUBLE), 0) * 100, 2) AS margin_pct"
SUMS_SQL = "CAST(sum(net) AS DECIMAL(28,2)) AS revenue, CAST(sum(net - CAST(quantity * cost AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS profit"
COST_SQL = f"{STAR_SQL}, p AS (SELECT p_partkey, p_brand, p_type, CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.60 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS cost FROM part), f AS (SELECT * FROM fact JOIN p ON l_partkey = p_partkey)"


def costed(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", "p_brand", "p_type", (money("p_retailprice") * F.lit("0.60").cast("decimal(3,2)")).cast(MONEY).alias("cost"))
    return star(s, d, p).withColumn("profit", F.col("net") - (F.col("quantity") * F.col("cost")).cast(MONEY))


def totals(df: DataFrame, *keys: object) -> DataFrame:
    """Sums per key, pre-aggregated per order, so that distinct orders are a plain count."""
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    each = df.groupBy("l_orderkey", *keys).agg(*(F.sum(c).alias(c) for c in ("quantity", "net", "profit")))
    names = each.columns[1 : 1 + len(keys)]
    return each.groupBy(*names).agg(F.count("*").alias("orders"), F.sum("quantity").cast(D28).alias("units"), F.sum("net").cast(D28).alias("revenue"), F.sum("profit").cast(D28).alias("profit"))


@query("A12_monthly_revenue_trend", f"WITH {COST_SQL}, m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(DISTINCT l_orderkey) AS orders, CAST(sum(quantity) AS DECIMAL(28,2)) AS units, {SUMS_SQL} FROM f GROUP BY 1) SELECT *, {PCT} FROM m")
def a12(s: SparkSession, d: str) -> DataFrame:
    return totals(costed(s, d), F.date_trunc("month", "o_orderdate").alias("month")).withColumn("margin_pct", fn.ratio_pct(F.col("profit"), F.col("revenue")))


@query("A13_revenue_by_category", f"WITH {COST_SQL} SELECT p_type, count(DISTINCT l_orderkey) AS orders, CAST(sum(quantity) AS DECIMAL(28,2)) AS units, {SUMS_SQL} FROM f GROUP BY 1")
def a13(s: SparkSession, d: str) -> DataFrame:
    return totals(costed(s, d), "p_type")


@query("A14_top_customers_ltv", f"WITH {STAR_SQL} SELECT o_custkey, CAST(sum(net) AS DECIMAL(28,2)) AS revenue, min(o_orderdate) AS first_buy, max(o_orderdate) AS last_buy FROM fact GROUP BY 1 ORDER BY revenue DESC, o_custkey LIMIT 20")
def a14(s: SparkSession, d: str) -> DataFrame:
    return star(s, d).groupBy("o_custkey").agg(F.sum("net").cast(D28).alias("revenue"), F.min("o_orderdate").alias("first_buy"), F.max("o_orderdate").alias("last_buy")).orderBy(F.desc("revenue"), "o_custkey").limit(20)


@query("A15_sales_by_channel", f"WITH {STAR_SQL}, x AS (SELECT n_name, CAST(sum(net) AS DECIMAL(28,2)) AS net FROM fact JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT n_name, net, round(CAST(net AS DOUBLE) * 100 / CAST((SELECT sum(net) FROM x) AS DOUBLE), 2) AS share_pct FROM x")
def a15(s: SparkSession, d: str) -> DataFrame:
    f = joins.star_join(star(s, d), [(table(s, d, "supplier"), "l_suppkey", "s_suppkey"), (table(s, d, "nation"), "s_nationkey", "n_nationkey")])
    return agg.share_of_total(f, ["n_name"], "net").withColumn("net", F.col("net").cast(D28))


@query("A16_product_performance", f"WITH {COST_SQL}, m AS (SELECT p_brand, count(DISTINCT l_orderkey) AS orders, CAST(sum(quantity) AS DECIMAL(28,2)) AS units, {SUMS_SQL} FROM f GROUP BY 1) SELECT *, {PCT} FROM m")
def a16(s: SparkSession, d: str) -> DataFrame:
    return totals(costed(s, d), "p_brand").withColumn("margin_pct", fn.ratio_pct(F.col("profit"), F.col("revenue")))


@query("A17_weekend_vs_weekday", f"WITH {STAR_SQL} SELECT CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_type, count(DISTINCT l_orderkey) AS orders, CAST(sum(net) AS DECIMAL(28,2)) AS revenue FROM fact GROUP BY 1")
def a17(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(fn.day_of_week(F.col("o_orderdate")).isin(0, 6), "weekend").otherwise("weekday")
    each = star(s, d).groupBy("l_orderkey", kind.alias("day_type")).agg(F.sum("net").alias("net"))
    return each.groupBy("day_type").agg(F.count("*").alias("orders"), F.sum("net").cast(D28).alias("revenue"))


@query("A18_region_revenue_drilldown", f"WITH {STAR_SQL} SELECT o_orderdate, count(*) AS n, CAST(sum(net) AS DECIMAL(28,2)) AS revenue FROM fact JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def a18(s: SparkSession, d: str) -> DataFrame:
    f = star(s, d).where(fn.month_range("o_orderdate", 1997))
    dims = [(table(s, d, t), a, b) for t, a, b in (("supplier", "l_suppkey", "s_suppkey"), ("nation", "s_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey"))]
    return joins.star_join(f, dims).where("r_name = 'ASIA'").groupBy("o_orderdate").agg(F.count("*").alias("n"), F.sum("net").cast(D28).alias("revenue"))


def by_customer() -> WindowSpec:
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


W_SQL = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query("W01_row_number", f"SELECT o_orderkey, row_number() {W_SQL}) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr FROM orders")
def w01(s: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    return table(s, d, "orders").select("o_orderkey", *(f().over(w).cast("long").alias(n) for f, w, n in ((F.row_number, by_customer(), "rn"), (F.rank, by, "rk"), (F.dense_rank, by, "dr"))))


@query("W02_latest_per_key", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def w02(s: SparkSession, d: str) -> DataFrame:
    return agg.latest_per_key(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("W03_partition_total", "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey) AS DECIMAL(28,2)) AS total FROM orders")
def w03(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", F.sum(money("o_totalprice")).over(Window.partitionBy("o_custkey")).cast(D28).alias("total"))


@query("W04_lag_lead", f"SELECT o_orderkey, lag(o_orderkey) {W_SQL}) AS before, lead(o_orderkey) {W_SQL}) AS after FROM orders")
def w04(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(by_customer()).alias("before"), F.lead("o_orderkey").over(by_customer()).alias("after"))


@query("W05_moving_avg", f"SELECT o_orderkey, round(avg(CAST(o_orderkey AS DOUBLE)) {W_SQL} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 3) AS mean FROM orders")
def w05(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", F.round(F.avg(F.col("o_orderkey").cast("double")).over(by_customer().rowsBetween(-2, 0)), 3).alias("mean"))


@query("W06_window_over_aggregate", "SELECT o_orderpriority, o_orderstatus, n, CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS of_priority FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)")
def w06(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).withColumn("of_priority", F.sum("n").over(Window.partitionBy("o_orderpriority")))


@query("W07_running_total", f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) {W_SQL} ROWS UNBOUNDED PRECEDING) AS DECIMAL(28,2)) AS running FROM orders")
def w07(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", F.sum(money("o_totalprice")).over(by_customer().rowsBetween(Window.unboundedPreceding, 0)).cast(D28).alias("running"))


@query("T02_top_n", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders ORDER BY price DESC, o_orderkey LIMIT 25")
def t02(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", money("o_totalprice").alias("price")).orderBy(F.desc("price"), "o_orderkey").limit(25)


@query("T03_top_n_per_group", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def t03(s: SparkSession, d: str) -> DataFrame:
    return agg.top_n_per_group(table(s, d, "orders"), ["o_orderpriority"], [F.desc("o_orderdate"), F.col("o_orderkey")], 3).select("o_orderpriority", "o_orderkey")


@query("E01_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def e01(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(s, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("E02_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def e02(s: SparkSession, d: str) -> DataFrame:
    return e01(s, d).distinct()


@query("F01_string_family", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, substr(p_type, 2, 4) AS sub, lpad(CAST(p_size AS VARCHAR), 5, '0') AS pad, replace(p_name, 'a', '#') AS rep FROM part")
def f01(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_brand").alias("l"), F.substring("p_type", 2, 4).alias("sub"), F.lpad(F.col("p_size").cast("string"), 5, "0").alias("pad"), F.replace("p_name", F.lit("a"), F.lit("#")).alias("rep"))


@query("F02_search_predicates", "SELECT p_partkey FROM part WHERE contains(p_name, 'a') AND starts_with(p_brand, 'B') AND p_type LIKE '%E%'")
def f02(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").where(F.col("p_name").contains("a") & F.col("p_brand").startswith("B") & F.col("p_type").like("%E%")).select("p_partkey")


@query("F03_date_arithmetic", "SELECT o_orderkey, o_orderdate + INTERVAL 45 DAY AS due, date_diff('month', o_orderdate, TIMESTAMP '2002-01-15') AS months FROM orders")
def f03(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", F.timestamp_add("DAY", F.lit(45), "o_orderdate").alias("due"), fn.units_between("month", F.col("o_orderdate"), F.lit("2002-01-15").cast("timestamp")).alias("months"))


@query("F04_date_parts", "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, dayofweek(o_orderdate) AS dow, dayofyear(o_orderdate) AS doy, weekofyear(o_orderdate) AS w FROM orders")
def f04(s: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", *(c.cast("long").alias(n) for c, n in ((F.year(t), "y"), (F.quarter(t), "q"), (F.month(t), "m"), (fn.day_of_week(t), "dow"), (F.dayofyear(t), "doy"), (F.weekofyear(t), "w"))))


@query("F05_period_ends", "SELECT o_orderkey, last_day(o_orderdate) AS m, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS q, CAST(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS y FROM orders")
def f05(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", *(fn.last_day_of(u, F.col("o_orderdate")).alias(u[0]) for u in ("month", "quarter", "year")))


@query("F06_date_formatting", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS ymd, strftime(o_orderdate, '%B') AS month_name, strftime(o_orderdate, '%a') AS dy FROM orders")
def f06(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", *(F.date_format("o_orderdate", f).alias(n) for f, n in (("yyyyMMdd", "ymd"), ("MMMM", "month_name"), ("E", "dy"))))


@query("F08_numeric", "SELECT o_orderkey, round(CAST(o_totalprice AS DECIMAL(18,2)), 1) AS r, o_orderkey % 7 AS m, CAST(trunc(o_orderkey / 1000.0) * 1000 AS BIGINT) AS t FROM orders")
def f08(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(s, d, "orders").select("o_orderkey", F.round(money("o_totalprice"), 1).alias("r"), (k % 7).alias("m"), fn.truncated(k, 3).alias("t"))


@query("F10_semi_structured", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f10(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("F11_flatten", "SELECT event_id, 0 AS index, 'k' AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events")
def f11(s: SparkSession, d: str) -> DataFrame:
    return fn.flatten_json(table(s, d, "events"), "props", ["event_id"])


@query("F14_split_to_rows", "SELECT p_partkey, piece, CAST(i AS INTEGER) AS i FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS piece, generate_subscripts(string_split(p_type, ' '), 1) AS i FROM part)")
def f14(s: SparkSession, d: str) -> DataFrame:
    return fn.split_to_rows(table(s, d, "part").select("p_partkey", "p_type"), "p_type", " ", "piece", "i").drop("p_type")


@query("U03_slugify", "SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def u03(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", fn.slugify(F.col("p_name")).alias("slug"))


@query("U08_tokenize", "SELECT p_partkey, CAST(i AS INTEGER) AS position, token FROM (SELECT p_partkey, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT p_partkey, list_filter(regexp_split_to_array(p_name, '\\s+'), lambda x: x <> '') AS w FROM part))")
def u08(s: SparkSession, d: str) -> DataFrame:
    return fn.tokenized(table(s, d, "part"), "p_name", ["p_partkey"])


@query("G02_mask_email", "SELECT c_custkey, CASE WHEN length(n) > 1 THEN substr(n, 1, 1) || '***' || substr(n, -1, 1) || '@x.org' ELSE n || '@x.org' END AS email FROM (SELECT c_custkey, lower(replace(c_name, '#', '.')) AS n FROM customer)")
def g02(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", fn.mask_email(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@x.org"))).alias("email"))


@query("U13_dataframe_pipeline", "SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS balance FROM customer WHERE c_acctbal > 0 GROUP BY 1 ORDER BY 1")
def u13(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").where("c_acctbal > 0").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(money("c_acctbal")).cast(D28).alias("balance")).orderBy("c_mktsegment")
