"""Further queries, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.functions import scalar as fn
from lakeops.operators import cdc, govern, history, joins, layout, maintain, merge, model
from lakeops.operators.stage import shared_folder
from lakeops.plans.changes import COLS, KEYS, m06
from lakeops.plans.inputs import LOG_SQL, STAR_SQL, money, orders_log, star, table
from lakeops.plans.registry import query
from lakeops.plans.warehouse import HIST_SQL, hist, zones
from lakeops.sources import files as io

D28 = "decimal(28,2)"


@query("P08_insert_select", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'copied' FROM orders WHERE o_orderstatus = 'P'")
def p08(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return o.where("o_orderstatus = 'F'").unionByName(o.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("copied")))


@query("P10_standard_view", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def p10(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "orders").where("o_orderstatus = 'O'").createOrReplaceTempView("lakeops_open_orders")
    return s.sql("SELECT o_custkey, count(*) AS n FROM lakeops_open_orders GROUP BY o_custkey")


@query("J09_join_current", "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS seg FROM orders JOIN customer ON o_custkey = c_custkey")
def j09(s: SparkSession, d: str) -> DataFrame:
    dim = m06(s, d).where("is_current")
    return joins.star_join(table(s, d, "orders"), [(dim, "o_custkey", "c_custkey")]).select("o_orderkey", F.col("c_mktsegment").alias("seg"))


@query("J11_scalar_subquery_filter", "SELECT n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
def j11(s: SparkSession, d: str) -> DataFrame:
    n, r = table(s, d, "nation"), table(s, d, "region").where("r_name = 'ASIA'").select("r_regionkey")
    return n.where(F.col("n_regionkey") == r.scalar()).select("n_name")


@query("J13_bridge_join", "SELECT DISTINCT p_brand, s_name FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size < 5")
def j13(s: SparkSession, d: str) -> DataFrame:
    bridge = table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return joins.star_join(bridge, [(table(s, d, "part").where("p_size < 5"), "l_partkey", "p_partkey"), (table(s, d, "supplier"), "l_suppkey", "s_suppkey")]).select("p_brand", "s_name").distinct()


@query("T01_order_by", "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey")
def t01(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderpriority", "o_orderkey").orderBy(F.desc_nulls_last("o_orderpriority"), F.asc_nulls_last("o_orderkey"))


@query("F07_null_handling", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'none') AS st, nullif(o_orderstatus, 'P') IS NOT DISTINCT FROM NULL AS gone FROM orders")
def f07(s: SparkSession, d: str) -> DataFrame:
    st = F.nullif("o_orderstatus", F.lit("P"))
    return table(s, d, "orders").select("o_orderkey", F.coalesce(st, F.lit("none")).alias("st"), st.eqNullSafe(F.lit(None).cast("string")).alias("gone"))


@query("F09_casts", "SELECT o_orderkey, CAST(CAST(o_orderkey AS VARCHAR) || '0' AS BIGINT) AS ten, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_orderdate AS DATE) AS day FROM orders")
def f09(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("0")).cast("bigint").alias("ten"), money("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("day"))


@query("F12_identity_and_random", "SELECT count(*) AS n, count(*) AS uuids, true AS in_range, true AS spread FROM orders")
def f12(s: SparkSession, d: str) -> DataFrame:
    """Random values differ from run to run of other engines, so their properties are given: as many ids as rows, numbers in range, means near the middle."""
    o = table(s, d, "orders").select(F.uuid().alias("id"), F.rand(7).alias("r"), F.uniform(F.lit(1), F.lit(10), seed=3).alias("u"))
    inside = (F.min("r") >= 0) & (F.max("r") < 1) & (F.min("u") >= 1) & (F.max("u") <= 10)
    return o.agg(F.count("*").alias("n"), F.count_distinct("id").alias("uuids"), inside.alias("in_range"), (F.abs(F.avg("r") - 0.5) < 0.1).alias("spread"))


@query("F13_geo_distance", "SELECT s_suppkey, round(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(-lat) / 2), 2) + cos(radians(lat)) * pow(sin(radians(-lon) / 2), 2)))), 2) AS metres FROM (SELECT s_suppkey, CAST(s_suppkey % 360 - 180 AS DOUBLE) AS lon, CAST(s_suppkey % 180 - 90 AS DOUBLE) AS lat FROM supplier)")
def f13(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("double")
    lon, lat = fn.point(F.concat(F.lit("POINT("), (k % 360 - 180).cast("string"), F.lit(" "), (k % 180 - 90).cast("string"), F.lit(")")))
    return table(s, d, "supplier").select("s_suppkey", F.round(fn.geo_distance(lon, lat, F.lit(0.0), F.lit(0.0)), 2).alias("metres"))


@query("M08_scd1_apply_changes", f"WITH {LOG_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC) AS rn FROM log WHERE version <= 4) SELECT o_orderkey, o_custkey, o_orderstatus, price FROM x WHERE rn = 1 AND op <> 'D'")
def m08(s: SparkSession, d: str) -> DataFrame:
    log = orders_log(s, d)
    return merge.apply_changes(cdc.state_at(log, 2, KEYS, COLS), cdc.net_changes(log, 2, 4, KEYS, COLS), KEYS)


@query("M15_conditional_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'REVIEW' WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'large order' WHEN o_orderstatus = 'P' THEN 'part delivered' END AS audit FROM orders")
def m15(s: SparkSession, d: str) -> DataFrame:
    st = F.col("o_orderstatus")
    rules = [((st == "O") & (F.col("o_totalprice") > 200000), "REVIEW", "large order"), (st == "P", "PENDING", "part delivered")]
    return merge.conditional_update(table(s, d, "orders"), "o_orderstatus", rules).select("o_orderkey", "o_orderstatus", "audit")


@query("M16_incremental_fact_load", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def m16(s: SparkSession, d: str) -> DataFrame:
    """Two thirds are loaded; the staged half, some of it twice, has other customers, which must not change loaded rows."""
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    staged = o.where("o_orderkey % 2 = 0").withColumn("o_custkey", F.col("o_custkey") + 1)
    return merge.incremental_fact_load(o.where("o_orderkey % 3 <> 0"), staged.unionByName(staged.where("o_orderkey % 12 = 0")), "o_orderkey")


@query("M18_purge_older_than", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY")
def m18(s: SparkSession, d: str) -> DataFrame:
    return cdc.high_water_increment(table(s, d, "events"), "ts", "2024-01-22 23:59:59.999999").select("event_id")


@query("I03_aggregate_over_external", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def i03(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return io.json_rows(e, "props", {"k": ("$.k", "bigint")}, ["event_type"]).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("I05_freshness_report", "SELECT event_type AS name, date_sub('second', max(ts), TIMESTAMP '2024-01-30 12:00:00') AS lag_s, CAST(43200 AS BIGINT) AS target_s, CASE WHEN date_sub('second', max(ts), TIMESTAMP '2024-01-30 12:00:00') <= 43200 THEN 'FRESH' ELSE 'LATE' END AS status FROM events GROUP BY 1")
def i05(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.max("ts").alias("last_ts")).select("*", F.lit(None).cast("bigint").alias("target_lag_s"), F.lit(43200).cast("bigint").alias("consumer_lag_s"))
    return maintain.freshness_report(t, "2024-01-30 12:00:00")


@query("D02_dim_date_of_orders", "SELECT y.year, y.quarter, count(*) AS days, CAST(sum(n) AS BIGINT) AS orders FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) JOIN (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d) ON d = day, LATERAL (SELECT CAST(year(d) AS BIGINT) AS year, CAST(quarter(d) AS BIGINT) AS quarter) y GROUP BY 1, 2")
def d02(s: SparkSession, d: str) -> DataFrame:
    per_day = table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    calendar = model.dim_date(s, "1995-01-01", "2001-12-31")
    return per_day.join(calendar, per_day["day"] == calendar["full_date"]).groupBy(F.col("year").cast("long").alias("year"), F.col("quarter").cast("long").alias("quarter")).agg(F.count("*").alias("days"), F.sum("n").alias("orders"))


@query("D03_dim_customer_scd2_init", "SELECT row_number() OVER (ORDER BY c_custkey) AS surrogate_key, c_custkey, c_mktsegment, DATE '2025-01-01' AS effective_from, DATE '9999-12-31' AS effective_to, true AS is_current FROM customer")
def d03(s: SparkSession, d: str) -> DataFrame:
    return merge.scd2_init(table(s, d, "customer"), ["c_custkey"], ["c_mktsegment"], "2025-01-01")


@query("G05_column_safe_view", "SELECT c_custkey, c_mktsegment FROM customer")
def g05(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").drop("c_name", "c_acctbal", "c_nationkey")


@query("G07_partner_array_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def g07(s: SparkSession, d: str) -> DataFrame:
    seg = table(s, d, "customer").select("c_mktsegment").distinct()
    access = seg.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).agg(F.collect_set("c_mktsegment").alias("allowed"))
    return joins.array_membership_join(table(s, d, "customer"), access, "c_mktsegment", "allowed").select("c_custkey")


@query("G08_aggregate_share", f"WITH {STAR_SQL} SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, n_name, CAST(sum(net) AS DECIMAL(28,2)) AS net FROM fact JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def g08(s: SparkSession, d: str) -> DataFrame:
    f = joins.star_join(star(s, d), [(table(s, d, "supplier"), "l_suppkey", "s_suppkey"), (table(s, d, "nation"), "s_nationkey", "n_nationkey")])
    return f.groupBy(F.date_trunc("month", "o_orderdate").alias("month"), "n_name").agg(F.sum("net").cast(D28).alias("net"))


@query("G11_enrich_shared", "SELECT s_suppkey, 'tier' || s_nationkey % 3 AS tier FROM supplier")
def g11(s: SparkSession, d: str) -> DataFrame:
    local = table(s, d, "nation").select("n_nationkey", F.concat(F.lit("tier"), (F.col("n_nationkey") % 3).cast("string")).alias("tier"))
    return joins.star_join(table(s, d, "supplier"), [(local, "s_nationkey", "n_nationkey")]).select("s_suppkey", "tier")


@query("G12_data_layer_api", "SELECT c_custkey, '***MASKED***' AS c_name FROM customer WHERE c_nationkey IN (1, 2)")
def g12(s: SparkSession, d: str) -> DataFrame:
    rows = govern.row_access(table(s, d, "customer"), "c_nationkey", {"partner": [1, 2]}, "partner", ["admin"])
    return govern.mask_column(rows.select("c_custkey", "c_name"), "c_name", "partner", ["admin"])


@query("L04_clustering_depth", "WITH z AS (SELECT o_orderkey // 500 AS f, min(o_custkey) AS low, max(o_custkey) AS high FROM orders GROUP BY 1) SELECT 'o_custkey' AS column_name, round(avg(k), 4) AS average_depth FROM (SELECT a.f, count(*) AS k FROM z a JOIN z b ON b.low <= a.low AND b.high >= a.low GROUP BY 1)")
def l04(s: SparkSession, d: str) -> DataFrame:
    return layout.clustering_information(zones(s, d)).select("column_name", "average_depth")


@query("L09_search_index_variant", "SELECT DISTINCT CAST(json_extract(props, '$.k') AS VARCHAR) AS value, CAST(event_id // 1000 AS VARCHAR) AS file FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 42")
def l09(s: SparkSession, d: str) -> DataFrame:
    path, value = shared_folder(s, "index"), F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    layout.write_search_index(layout.search_index(table(s, d, "events"), value, F.floor(F.col("event_id") / 1000).cast("string")), path)
    return layout.lookup(s, path, ["42"])


@query("L10_layout_benchmark", f"WITH {HIST_SQL} SELECT a.query_id, round(CAST(a.elapsed_ms - b.elapsed_ms AS DOUBLE) / nullif(a.elapsed_ms, 0) * 100, 2) AS gain_pct FROM h a JOIN (SELECT query_id, elapsed_ms // 4 AS elapsed_ms FROM h) b USING (query_id)")
def l10(s: SparkSession, d: str) -> DataFrame:
    a = hist(s, d).select("query_id", F.col("elapsed_ms").alias("before"))
    b = hist(s, d).select("query_id", F.expr("elapsed_ms DIV 4").alias("after"))
    return a.join(b, "query_id").select("query_id", fn.ratio_pct(F.col("before") - F.col("after"), F.col("before")).alias("gain_pct"))


@query("L11_size_report", "WITH f AS (SELECT o_orderkey % 64 AS f, count(*) * 1048576 AS b FROM orders GROUP BY 1) SELECT CASE WHEN b < 16 * 1048576 THEN '1 tiny' WHEN b < 100 * 1048576 THEN '2 small' WHEN b <= 250 * 1048576 THEN '3 right' ELSE '4 large' END AS size_class, count(*) AS n_files, CAST(sum(b) AS BIGINT) AS bytes FROM f GROUP BY 1")
def l11(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "orders").groupBy((F.col("o_orderkey") % 64).alias("f")).agg((F.count("*") * 1048576).alias("length"))
    return layout.size_report(files)


@query("H09_storage_rollup", f"WITH {HIST_SQL} SELECT warehouse, CAST(sum(spill_local) AS BIGINT) AS active, CAST(sum(spill_remote) AS BIGINT) AS history, round(CAST(sum(spill_remote) AS DOUBLE) / sum(spill_local) * 100, 2) AS history_pct FROM h GROUP BY 1 ORDER BY sum(spill_local) + sum(spill_remote) DESC, 1 LIMIT 3")
def h09(s: SparkSession, d: str) -> DataFrame:
    return history.storage_rollup(hist(s, d), "warehouse", "spill_local", "spill_remote", 3)


@query("H10_run_overlap_report", "SELECT event_id AS run_id, CAST(event_id % 120 AS BIGINT) AS took_s, CASE WHEN event_id % 120 > 60 THEN 'OVERLAPS' ELSE 'NEAR' END AS status FROM events WHERE event_id % 120 > 48")
def h10(s: SparkSession, d: str) -> DataFrame:
    runs = table(s, d, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("started"), F.timestamp_add("SECOND", (F.col("event_id") % 120).cast("int"), "ts").alias("ended"))
    return history.run_overlap_report(runs, 60)


@query("H11_latency_report", "SELECT event_id, CAST(CAST(event_id % 5000 AS DECIMAL(13,3)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(10,2)) AS latency_sec FROM events")
def h11(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select("event_id", "ts", F.timestamp_add("MILLISECOND", (F.col("event_id") % 5000).cast("int"), "ts").alias("done"))
    return history.latency_report(rows, "ts", "done").select("event_id", "latency_sec")


@query("H13_log_query", "SELECT event_id, event_type AS severity, CAST(json_extract(props, '$.k') AS VARCHAR) AS message FROM events WHERE event_type = 'error'")
def h13(s: SparkSession, d: str) -> DataFrame:
    return io.json_rows(table(s, d, "events").where("event_type = 'error'").withColumnRenamed("event_type", "severity"), "props", {"message": ("$.k", "string")}, ["event_id", "severity"])


@query("H14_access_audit", "SELECT event_id AS query_id, user_id, ts, unnest(['t' || user_id % 3, 'u' || user_id % 2]) AS object_name FROM events ORDER BY ts DESC, query_id, object_name LIMIT 40")
def h14(s: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    objects = F.array(F.concat(F.lit("t"), (u % 3).cast("string")), F.concat(F.lit("u"), (u % 2).cast("string")))
    return history.object_touches(table(s, d, "events").select(F.col("event_id").alias("query_id"), "user_id", "ts", objects.alias("objects")), "objects", 40)


@query("S02_load_positional", "SELECT o_orderkey AS id, upper(o_orderstatus) AS status, TRY_CAST(CASE WHEN o_orderkey % 97 = 0 THEN 'bad' ELSE CAST(o_custkey AS VARCHAR) END AS BIGINT) AS cust FROM orders")
def s02(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = table(s, d, "orders").select(F.lower("o_orderstatus").alias("_c0"), k.cast("string").alias("_c1"), F.when(k % 97 == 0, "bad").otherwise(F.col("o_custkey").cast("string")).alias("_c2"))
    return io.load_positional(raw, ["$2", "upper($1)", "$3"], T.StructType([T.StructField("id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("cust", T.LongType())]))


@query("S03_load_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s03(s: SparkSession, d: str) -> DataFrame:
    return io.json_rows(table(s, d, "events"), "props", {"k": ("$.k", "bigint")}, ["event_id"])


@query("S11_select_files", "WITH f AS (SELECT 'f' || lpad(CAST(o_orderkey % 64 AS VARCHAR), 2, '0') AS path, count(*) AS length FROM orders GROUP BY 1), g AS (SELECT *, coalesce(sum(length) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f WHERE regexp_matches(path, '[02468]$')) SELECT path, length FROM g WHERE b = 0 OR b < 1000")
def s11(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "orders").groupBy(F.concat(F.lit("f"), F.lpad((F.col("o_orderkey") % 64).cast("string"), 2, "0")).alias("path")).agg(F.count("*").alias("length"))
    return io.select_files(files, pattern="[02468]$", size_limit=1000)


@query("S15_copy_history", "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'PARTIALLY_LOADED' ELSE 'LOADED' END AS status, count(*) AS n_files, CAST(sum(o_custkey) AS BIGINT) AS row_count, CAST(sum(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS error_count FROM orders GROUP BY 1")
def s15(s: SparkSession, d: str) -> DataFrame:
    bad = F.col("o_orderkey") % 7 == 0
    return io.copy_history(table(s, d, "orders").select(F.when(bad, "PARTIALLY_LOADED").otherwise("LOADED").alias("status"), F.col("o_custkey").alias("row_count"), bad.cast("int").alias("error_count")))


@query("U11_chaining", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN (SELECT o_custkey FROM orders WHERE o_totalprice >= 250000.0 GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def u11(s: SparkSession, d: str) -> DataFrame:
    from lakeops.functions.udfs import top_customers

    return joins.star_join(top_customers(table(s, d, "orders"), 250000.0), [(table(s, d, "customer"), "o_custkey", "c_custkey")]).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("U12_total_by_key", "SELECT n_name, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def u12(s: SparkSession, d: str) -> DataFrame:
    sums = table(s, d, "supplier").groupBy("s_nationkey").agg(F.sum(money("s_acctbal")).cast(D28).alias("total"))
    return joins.star_join(sums, [(table(s, d, "nation"), "s_nationkey", "n_nationkey")]).select("n_name", "total")


@query("S10_with_file_metadata")
def s10(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.row_index").alias("row_number"))



@query("H05_operator_breakdown", "SELECT event_id AS query_id, event_type AS operator, round((event_id % 100) / 100.0 * 100, 2) AS overall_pct, CAST(75.0 AS DOUBLE) AS processing_pct, CAST(NULL AS DOUBLE) AS io_pct FROM events")
def h05(s: SparkSession, d: str) -> DataFrame:
    share = ((F.col("event_id") % 100) / 100).alias("overall")
    ops = table(s, d, "events").select(F.col("event_id").alias("query_id"), F.col("event_type").alias("operator"), F.to_json(F.struct(share, F.lit(0.75).alias("processing"))).alias("stats"))
    return history.operator_breakdown(ops)


@query("H15_task_graph_run_order", "SELECT CAST(p_size AS BIGINT) AS task, CAST(floor(log2(p_size)) AS BIGINT) AS level FROM (SELECT DISTINCT p_size FROM part)")
def h15(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("long")
    edges = table(s, d, "part").select(size.alias("task"), F.when(size > 1, F.floor(size / 2)).alias("after")).distinct()
    return history.task_graph_run_order(edges).select("task", F.col("level").cast("long").alias("level"))
