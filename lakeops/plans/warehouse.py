"""Queries of modelling, quality, governance, layout, history, loading, functions and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.functions import scalar as fn
from lakeops.functions import udfs
from lakeops.operators import govern, history, layout, model, quality, search
from lakeops.operators.aggregates import surrogate_key
from lakeops.operators.stage import shared_folder
from lakeops.plans.changes import KEYS, days
from lakeops.plans.inputs import MONEY, STAR_SQL, money, star, table
from lakeops.plans.registry import query
from lakeops.sources import files as io

ORDER_TYPES = {"o_orderkey": ("as_is", "bigint", None), "o_custkey": ("as_is", "bigint", None), "o_orderstatus": ("upper", "string", "?"), "o_orderdate": ("as_is", "date", None)}


def raw_orders(s: SparkSession, d: str) -> DataFrame:
    """Orders as padded text with bad dates and keys that come twice."""
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    pad = lambda c: F.concat(F.lit("  "), c.cast("string"), F.lit(" "))
    text = o.select(pad(k).alias("o_orderkey"), pad(F.col("o_custkey")).alias("o_custkey"), pad(F.lower("o_orderstatus")).alias("o_orderstatus"), F.when(k % 97 == 0, "bad").otherwise(pad(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("o_orderdate"), (k % 40 == 0).alias("_twice"))
    return text.drop("_twice").unionByName(text.where("_twice").drop("_twice"))


@query("D01_stage_table", "SELECT o_orderkey, o_custkey, upper(o_orderstatus) AS o_orderstatus, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS o_orderdate FROM orders")
def d01(s: SparkSession, d: str) -> DataFrame:
    return model.stage_table(raw_orders(s, d), ORDER_TYPES, KEYS, [F.col("o_custkey")])


@query("D04_dim_product", "SELECT row_number() OVER (ORDER BY p_partkey) AS product_key, p_partkey, p_brand, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part")
def d04(s: SparkSession, d: str) -> DataFrame:
    return model.dimension(table(s, d, "part"), "p_partkey", [F.col("p_brand"), money("p_retailprice").alias("price")], "product_key")


@query("D05_fact_sales", f"WITH {STAR_SQL} SELECT * FROM fact")
def d05(s: SparkSession, d: str) -> DataFrame:
    return star(s, d)


@query("D06_sales_summary_view", f"WITH {STAR_SQL} SELECT n_name, p_brand, year(o_orderdate) AS y, count(*) AS n, CAST(sum(net) AS DECIMAL(28,2)) AS net FROM fact JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3")
def d06(s: SparkSession, d: str) -> DataFrame:
    from lakeops.operators.joins import star_join

    f = star_join(star(s, d), [(table(s, d, "customer"), "o_custkey", "c_custkey"), (table(s, d, "nation"), "c_nationkey", "n_nationkey"), (table(s, d, "part"), "l_partkey", "p_partkey")])
    return f.groupBy("n_name", "p_brand", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.sum("net").cast("decimal(28,2)").alias("net"))


@query("D07_surrogate_key", "SELECT 1000 + 5 * (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS sk, o_orderkey FROM orders")
def d07(s: SparkSession, d: str) -> DataFrame:
    return surrogate_key(table(s, d, "orders").select("o_orderdate", "o_orderkey"), [F.col("o_orderdate"), F.col("o_orderkey")], "sk", 1000, 5).select("sk", "o_orderkey")


VAULT = "v AS (SELECT user_id, ts, event_id, event_type, sha256(event_type) AS hash_diff, sha256(CAST(user_id AS VARCHAR)) AS hash_key FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS rn FROM events) WHERE rn = 1)"


def vault(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from lakeops.operators.aggregates import latest_per_key

    one = latest_per_key(table(s, d, "events"), ["user_id", "ts"], [F.col("event_id")])
    return model.data_vault_split(one, "user_id", ["event_type"], "ts", "events")


@query("D08_data_vault_hub", f"WITH {VAULT} SELECT hash_key, user_id, min(ts) AS load_date, 'events' AS record_source FROM v GROUP BY 1, 2")
def d08(s: SparkSession, d: str) -> DataFrame:
    return vault(s, d)[0]


@query("D08_data_vault_satellite", f"WITH {VAULT}, w AS (SELECT *, lag(hash_diff) OVER (PARTITION BY hash_key ORDER BY ts) AS b FROM v) SELECT hash_key, ts, hash_diff, event_type FROM w WHERE b IS NULL OR b <> hash_diff")
def d08b(s: SparkSession, d: str) -> DataFrame:
    return vault(s, d)[1]


@query("D09_decompose", "SELECT c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def d09(s: SparkSession, d: str) -> DataFrame:
    c, n = table(s, d, "customer"), table(s, d, "nation")
    wide = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", "c_nationkey", "n_name")
    return model.decompose(wide, ["c_nationkey"], ["n_name"])[1]


@query("D10_junk_dimension", "WITH j AS (SELECT *, row_number() OVER (ORDER BY l_returnflag, l_linestatus) AS junk_key FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)) SELECT junk_key, count(*) AS n FROM lineitem JOIN j USING (l_returnflag, l_linestatus) GROUP BY 1")
def d10(s: SparkSession, d: str) -> DataFrame:
    return model.junk_dimension(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"])[1].groupBy("junk_key").agg(F.count("*").alias("n"))


@query("D11_cardinality_profile", "SELECT 1 AS left_most, max(n) AS right_most, '1:M' AS kind FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def d11(s: SparkSession, d: str) -> DataFrame:
    return model.cardinality_profile(table(s, d, "customer").select(F.col("c_custkey").alias("k")), table(s, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("Q01_referential_integrity", "SELECT 'o_custkey' AS \"check\", count(*) AS missing FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) UNION ALL SELECT 'o_orderkey', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q01(s: SparkSession, d: str) -> DataFrame:
    return quality.referential_integrity(table(s, d, "orders"), {"o_custkey": (table(s, d, "customer").where("c_custkey % 10 <> 0"), "c_custkey"), "o_orderkey": (table(s, d, "lineitem"), "l_orderkey")})


@query("Q02_duplicate_check", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, count(*) FILTER (n > 1) AS repeated_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def q02(s: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_check(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("Q03_sanity_check", "SELECT 'negative' AS rule, count(*) FILTER (l_extendedprice < 0) AS violations FROM lineitem UNION ALL SELECT 'deep_discount', count(*) FILTER (l_discount > 0.08) FROM lineitem")
def q03(s: SparkSession, d: str) -> DataFrame:
    return quality.sanity_check(table(s, d, "lineitem"), {"negative": F.col("l_extendedprice") < 0, "deep_discount": F.col("l_discount") > 0.08})


@query("Q04_scd2_integrity", """WITH k AS (SELECT c_custkey AS k FROM customer UNION ALL SELECT -1 - c_custkey FROM customer WHERE c_custkey % 11 = 0) SELECT 'many_current' AS "check", count(*) FILTER (k % 7 = 0) AS n FROM k UNION ALL SELECT 'overlap', count(*) FILTER (k % 7 = 0) FROM k UNION ALL SELECT 'gap', count(*) FILTER (c_custkey % 5 = 0 AND c_custkey % 11 = 0) FROM customer""")
def q04(s: SparkSession, d: str) -> DataFrame:
    """A dimension with a second current row of some keys, and a first version of others that ends too early."""
    from lakeops.plans.changes import m06

    dim, k = m06(s, d), F.col("c_custkey")
    early = (k % 5 == 0) & (k % 11 == 0) & ~F.col("is_current")
    broken = dim.withColumn("effective_to", F.when(early, F.date_sub("effective_to", 3)).otherwise(F.col("effective_to")))
    again = dim.where(F.col("is_current") & (k % 7 == 0)).withColumn("effective_from", F.date_add("effective_from", 10))
    return quality.scd2_integrity(broken.unionByName(again), ["c_custkey"])


@query("Q05_layer_counts", "SELECT 'bronze' AS layer, count(*) AS n FROM lineitem UNION ALL SELECT 'silver', count(*) FROM orders UNION ALL SELECT 'gold', count(DISTINCT o_custkey) FROM orders")
def q05(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return quality.layer_counts({"bronze": table(s, d, "lineitem"), "silver": o, "gold": o.select("o_custkey").distinct()})


@query("Q06_metric_functions", "SELECT count(*) FILTER (user_id IS NULL) AS null_count, count(DISTINCT user_id) AS unique_count, count(user_id) - count(DISTINCT user_id) AS duplicate_count, date_sub('second', max(ts), TIMESTAMP '2024-02-01') AS freshness_s FROM events")
def q06(s: SparkSession, d: str) -> DataFrame:
    return quality.metric_functions(table(s, d, "events"), "user_id", "ts", "2024-02-01")


@query("Q07_alert", "SELECT 'large order' AS alert FROM orders WHERE o_totalprice > 1000 LIMIT 1")
def q07(s: SparkSession, d: str) -> DataFrame:
    return quality.alert(table(s, d, "orders"), F.col("o_totalprice") > 1000, "large order")


@query("S22_reconcile", "SELECT 'orders' AS table_name, count(*) AS source_rows, count(*) FILTER (o_orderkey % 500 <> 3) AS target_rows, count(*) = count(*) FILTER (o_orderkey % 500 <> 3) AS match FROM orders")
def s22(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return quality.reconcile(o, o.where("o_orderkey % 500 <> 3"), "orders")


@query("G01_mask_column", "SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '***MASKED***' END AS c_name FROM customer")
def g01(s: SparkSession, d: str) -> DataFrame:
    return govern.mask_column(table(s, d, "customer").select("c_custkey", "c_name"), "c_name", "analyst", ["admin"])


@query("G03_row_access", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def g03(s: SparkSession, d: str) -> DataFrame:
    return govern.row_access(table(s, d, "nation"), "n_regionkey", {"emea": [1, 3]}, "emea", ["admin"]).select("n_nationkey", "n_name")


@query("G04_tag_based_masking", "SELECT c_custkey, '***MASKED***' AS c_name, CAST(0.0 AS DOUBLE) AS c_acctbal FROM customer")
def g04(s: SparkSession, d: str) -> DataFrame:
    policies = {"PII": lambda c: F.when(c.isNotNull(), F.lit(govern.MASKED)), "MONEY": lambda c: F.lit(0.0)}
    return govern.tag_based_masking(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), {"c_name": "PII", "c_acctbal": "MONEY"}, policies, "analyst", ["admin"])


@query("G06_tenant_filter", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def g06(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.lit("ACC_"), F.col("n_regionkey").cast("string")).alias("account"))
    return govern.tenant_filter(table(s, d, "supplier"), n.unionByName(n), "s_nationkey", "ACC_2").select("s_suppkey")


@query("G09_clean_room_overlap", "SELECT c_mktsegment, count(DISTINCT c_custkey) AS n_matched FROM customer WHERE c_custkey IN (SELECT user_id FROM events) GROUP BY 1 HAVING count(DISTINCT c_custkey) >= 10")
def g09(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "customer").select(F.col("c_custkey").alias("person"), "c_mktsegment")
    return govern.clean_room_overlap(a, table(s, d, "events").select(F.col("user_id").alias("person")), "person", ["c_mktsegment"], 10)


@query("G10_classify_columns", "SELECT 'contact' AS column_name, 'EMAIL' AS category, round(count(*) FILTER (c_custkey % 4 <> 0) / count(*), 4) AS probability FROM customer UNION ALL SELECT 'host', 'IP', round(count(*) FILTER (c_custkey % 3 = 0) / count(*), 4) FROM customer")
def g10(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    contact = F.when(k % 4 != 0, F.concat(F.lower("c_mktsegment"), k.cast("string"), F.lit("@x.org"))).otherwise("none")
    host = F.when(k % 3 == 0, F.concat(F.lit("10.0."), (k % 256).cast("string"), F.lit(".1"))).otherwise("unknown")
    return govern.classify_columns(table(s, d, "customer").select(contact.alias("contact"), host.alias("host"), "c_name"), ["contact", "host", "c_name"])


ZONE_SQL = "z AS (SELECT CAST(o_orderkey // 500 AS VARCHAR) AS file, 'o_custkey' AS column_name, count(*) AS n_rows, CAST(min(o_custkey) AS DOUBLE) AS low, CAST(max(o_custkey) AS DOUBLE) AS high, 0 AS n_nulls FROM orders GROUP BY 1)"


def zones(s: SparkSession, d: str) -> DataFrame:
    return layout.zone_map(table(s, d, "orders"), ["o_custkey"], F.floor(F.col("o_orderkey") / 500).cast("string"))


@query("L02_zone_map", f"WITH {ZONE_SQL} SELECT file, n_rows, low, high FROM z")
def l02(s: SparkSession, d: str) -> DataFrame:
    return zones(s, d).select("file", "n_rows", "low", "high")


@query("L03_clustering_information", f"""WITH {ZONE_SQL}, p AS (SELECT a.file, count(*) FILTER (b.file <> a.file AND b.low <= a.high AND b.high >= a.low) AS n_over, count(*) FILTER (b.low <= a.low AND b.high >= a.low) AS depth FROM z a, z b GROUP BY a.file)
SELECT 'o_custkey' AS column_name, count(*) AS total_files, CAST(0 AS BIGINT) AS constant_files, round(avg(n_over), 4) AS average_overlaps, round(avg(depth), 4) AS average_depth FROM p""")
def l03(s: SparkSession, d: str) -> DataFrame:
    return layout.clustering_information(zones(s, d))


@query("L05_prune_estimate", f"WITH {ZONE_SQL}, k AS (SELECT count(*) FILTER (low <= 40 AND high >= 2) AS kept_files, count(*) AS total_files FROM z) SELECT *, round(kept_files * 100.0 / total_files, 2) AS scanned_pct, CASE WHEN kept_files * 100.0 / total_files < 20 THEN 'GOOD' WHEN kept_files * 100.0 / total_files < 50 THEN 'OK' ELSE 'BAD' END AS class FROM k")
def l05(s: SparkSession, d: str) -> DataFrame:
    return layout.prune_estimate(zones(s, d), "o_custkey", 2, 40)


@query("L06_clustering_key_advisor", "SELECT *, row_number() OVER (ORDER BY n_distinct, column_name) AS position FROM (SELECT 'o_orderstatus' AS column_name, count(DISTINCT o_orderstatus) AS n_distinct FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders)")
def l06(s: SparkSession, d: str) -> DataFrame:
    return layout.clustering_key_advisor(table(s, d, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("L07_search_index_equality", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS value, CAST(o_orderkey // 500 AS VARCHAR) AS file FROM orders WHERE o_custkey IN (7, 11)")
def l07(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "index")
    layout.write_search_index(layout.search_index(table(s, d, "orders"), F.col("o_custkey").cast("string"), F.floor(F.col("o_orderkey") / 500).cast("string")), path)
    return layout.lookup(s, path, ["7", "11"])


@query("L08_search_index_substring", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'part#1')")
def l08(s: SparkSession, d: str) -> DataFrame:
    p, path = table(s, d, "part").select("p_partkey", "p_name"), shared_folder(s, "index")
    layout.trigram_index(p, "p_name", "p_partkey").repartitionByRange("run").sortWithinPartitions("run").write.parquet(path)
    return layout.trigram_lookup(p, s.read.parquet(path), "p_name", "p_partkey", "part#1")


HIST_SQL = """h AS (SELECT event_id AS query_id, ts AS start_time, event_type AS warehouse, CAST(round(value * 1000) AS BIGINT) AS elapsed_ms, 1 + event_id % 400 AS partitions_total, 1 + (event_id * 7) % (1 + event_id % 400) AS partitions_scanned,
 (event_id % 11) * 1048576 AS spill_local, CASE WHEN event_id % 23 = 0 THEN 1048576 ELSE 0 END AS spill_remote, (event_id % 9) * 100 AS queued_ms FROM events)"""


def hist(s: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(s, d, "events").select(
        e.alias("query_id"), F.col("ts").alias("start_time"), F.col("event_type").alias("warehouse"), F.round(F.col("value") * 1000).cast("long").alias("elapsed_ms"),
        (1 + e % 400).alias("partitions_total"), (1 + (e * 7) % (1 + e % 400)).alias("partitions_scanned"),
        ((e % 11) * 1048576).alias("spill_local"), F.when(e % 23 == 0, 1048576).otherwise(0).cast("long").alias("spill_remote"), ((e % 9) * 100).alias("queued_ms"),
    )


@query("H01_slow_queries", f"WITH {HIST_SQL} SELECT query_id, warehouse, elapsed_ms, round(CAST(partitions_scanned AS DOUBLE) / partitions_total * 100, 2) AS scanned_pct, spill_local + spill_remote AS spilled FROM h WHERE elapsed_ms > 20000 ORDER BY elapsed_ms DESC, query_id LIMIT 50")
def h01(s: SparkSession, d: str) -> DataFrame:
    return history.slow_queries(hist(s, d), 20000, 50)


@query("H02_slow_query_trend", f"WITH {HIST_SQL} SELECT CAST(start_time AS DATE) AS day, count(*) AS n, CAST(sum(elapsed_ms) AS BIGINT) AS total_ms, count(*) FILTER (spill_remote > 0) AS remote_spills FROM h WHERE elapsed_ms > 20000 GROUP BY 1")
def h02(s: SparkSession, d: str) -> DataFrame:
    return history.slow_query_trend(hist(s, d), 20000)


@query("H03_spill_report", f"WITH {HIST_SQL} SELECT query_id, warehouse, CAST(spill_local // 1048576 AS DOUBLE) AS spill_local_mb, CAST(spill_remote // 1048576 AS DOUBLE) AS spill_remote_mb FROM h WHERE spill_local > 0 OR spill_remote > 0")
def h03(s: SparkSession, d: str) -> DataFrame:
    return history.spill_report(hist(s, d))


@query("H04_load_report", f"WITH {HIST_SQL} SELECT warehouse, hour(start_time) AS hour, count(*) AS n, CAST(sum(queued_ms) AS BIGINT) AS queued_ms, max(queued_ms) AS most_queued_ms FROM h GROUP BY 1, 2 HAVING sum(queued_ms) >= 30000")
def h04(s: SparkSession, d: str) -> DataFrame:
    return history.load_report(hist(s, d), 30000)


@query("H06_pruning_report", f"WITH {HIST_SQL} SELECT query_id, partitions_scanned, partitions_total, round(CAST(partitions_scanned AS DOUBLE) / partitions_total * 100, 2) AS scanned_pct FROM h")
def h06(s: SparkSession, d: str) -> DataFrame:
    return history.pruning_report(hist(s, d))


@query("H07_join_multiplier_report", "SELECT event_id AS query_id, event_id AS input_rows, event_id * 3 AS output_rows, CASE WHEN event_id > 0 THEN 3.0 END AS multiplier FROM events")
def h07(s: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    ops = table(s, d, "events").select(e.alias("query_id"), F.to_json(F.struct(e.alias("input_rows"), (e * 3).alias("output_rows"))).alias("stats"))
    return history.join_multiplier_report(ops)


@query("H08_cost_rollup", f"WITH {HIST_SQL}, p AS (SELECT warehouse, CAST(sum(queued_ms) AS BIGINT) AS credits FROM h GROUP BY 1), q AS (SELECT *, round(CAST(credits AS DOUBLE) / (SELECT sum(credits) FROM p) * 100, 2) AS share_pct FROM p) SELECT * FROM q WHERE share_pct > 10")
def h08(s: SparkSession, d: str) -> DataFrame:
    return history.cost_rollup(hist(s, d).withColumn("credits", F.col("queued_ms")), 10)


@query("H12_diagnose", f"WITH {HIST_SQL} SELECT query_id, CASE WHEN queued_ms > 500 THEN 'QUEUED' WHEN spill_remote > 0 THEN 'REMOTE_SPILL' WHEN spill_local > 0 THEN 'LOCAL_SPILL' WHEN partitions_scanned * 100.0 / partitions_total > 80 THEN 'POOR_PRUNING' ELSE 'FINE' END AS diagnosis FROM h")
def h12(s: SparkSession, d: str) -> DataFrame:
    return history.diagnose(hist(s, d))


@query("S04_load_by_name", "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS region, o_orderstatus FROM orders")
def s04(s: SparkSession, d: str) -> DataFrame:
    target = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("region", T.StringType()), T.StructField("o_orderstatus", T.StringType())])
    return io.load_by_name(table(s, d, "orders").withColumnRenamed("o_orderkey", "O_ORDERKEY"), target)


@query("S07_hot_cold_union", "SELECT o_orderkey, o_orderdate FROM orders")
def s07(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_orderdate")
    return io.hot_cold_union(o, o, "o_orderdate", "1998-01-01")


@query("S09_append_evolving", "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1")
def s09(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return io.append_evolving(o.where("o_orderkey % 2 = 0").select("o_orderkey"), o.where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderstatus"))


TEXT_SQL = "t AS (SELECT CAST(month(o_orderdate) AS VARCHAR) AS _file, o_orderkey AS _row, CASE WHEN o_orderkey % 1000 = 7 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS k FROM orders)"


def text_rows(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(F.month("o_orderdate").cast("string").alias("_file"), k.alias("_row"), F.when(k % 1000 == 7, "x").otherwise(k.cast("string")).alias("k"))


@query("S13_on_error", f"WITH {TEXT_SQL}, c AS (SELECT _file, count(*) FILTER (k = 'x') AS bad FROM t GROUP BY 1) SELECT _file, _row, CAST(k AS BIGINT) AS k FROM t WHERE k <> 'x' AND _file NOT IN (SELECT _file FROM c WHERE bad >= 2)")
def s13(s: SparkSession, d: str) -> DataFrame:
    return io.on_error(text_rows(s, d), {"k": "bigint"}, "SKIP_FILE_2")


@query("S14_validate_load", f"WITH {TEXT_SQL} SELECT _file, _row, 'k' AS column_name, k AS raw_value FROM t WHERE k = 'x'")
def s14(s: SparkSession, d: str) -> DataFrame:
    return io.validate_load(text_rows(s, d), {"k": "bigint"})


@query("S21_escape_text", "SELECT p_partkey, rtrim(p_name || '\\' || p_type) AS t FROM part")
def s21(s: SparkSession, d: str) -> DataFrame:
    text = F.concat("p_name", F.lit("\\"), "p_type", F.lit("  "))
    return table(s, d, "part").select("p_partkey", fn.unescape_text(fn.escape_text(text)).alias("t"))


@query("U01_sql_scalar_udf", "SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.18 AS DECIMAL(5,2)), 2) AS DECIMAL(18,2)) AS tax FROM orders")
def u01(s: SparkSession, d: str) -> DataFrame:
    udfs.sql_functions(s)
    return table(s, d, "orders").select("o_orderkey", F.call_function("calculate_tax", money("o_totalprice"), F.lit("0.18").cast("decimal(5,2)")).alias("tax"))


@query("U02_python_scalar_udf", "SELECT p_partkey, reverse(p_name) AS r FROM part")
def u02(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", udfs.reverse_string()("p_name").alias("r"))


@query("U04_vectorised_udf", "SELECT p_partkey, round(p_retailprice * 0.9, 2) AS p FROM part")
def u04(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", F.round(udfs.vectorised_discount()("p_retailprice"), 2).alias("p"))


@query("U05_sql_udtf", "SELECT p_partkey, trim(unnest(string_split(p_brand || ', ' || p_type, ','))) AS tag FROM part")
def u05(s: SparkSession, d: str) -> DataFrame:
    udfs.sql_functions(s)
    p = table(s, d, "part").select("p_partkey", F.concat_ws(", ", "p_brand", "p_type").alias("tags"))
    return s.sql("SELECT p_partkey, tag FROM {p}, LATERAL split_tags(tags)", p=p)


@query("U06_python_udtf", "SELECT o_orderkey, CAST(unnest(generate_series(o_orderdate, o_orderdate + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM orders")
def u06(s: SparkSession, d: str) -> DataFrame:
    s.udtf.register("lakeops_dates", udfs.generate_dates())
    o = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.date_add("o_orderdate", 2).alias("b"))
    return s.sql("SELECT o_orderkey, day FROM {o}, LATERAL lakeops_dates(a, b)", o=o)


@query("U07_partitioned_udtf", "SELECT o_custkey AS key, o_orderkey AS at, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS running FROM orders UNION ALL SELECT o_custkey, NULL, CAST(sum(o_orderkey) AS BIGINT) FROM orders GROUP BY 1")
def u07(s: SparkSession, d: str) -> DataFrame:
    s.udtf.register("lakeops_running", udfs.running_totals())
    o = table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("amount"))
    return s.sql("SELECT * FROM lakeops_running(TABLE({o}) PARTITION BY key ORDER BY at)", o=o)


@query("U09_table_procedure", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice >= 250000.0 GROUP BY 1")
def u09(s: SparkSession, d: str) -> DataFrame:
    return udfs.top_customers(table(s, d, "orders"), 250000.0)


@query("U10_dynamic_search", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def u10(s: SparkSession, d: str) -> DataFrame:
    return udfs.search_table(table(s, d, "customer"), "c_mktsegment", "BUILDING", frozenset({"c_mktsegment"})).select("c_custkey")


@query("X01_hybrid_search", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS t0, len(list_filter(w, lambda x: x = 'pathetic')) AS t1 FROM w),
a AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM h),
k AS (SELECT doc_id, ln(1 + (docs - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * t0 * 2.2::DOUBLE / (t0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) + ln(1 + (docs - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * t1 * 2.2::DOUBLE / (t1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) AS score FROM h, a),
ka AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 10) DESC, doc_id) AS a FROM k WHERE score > 0),
v AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(range(64), lambda x: 1.0::DOUBLE)), 10) AS score FROM embeddings),
vb AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS b FROM v WHERE score IS NOT NULL)
SELECT doc_id, round(coalesce(1.0::DOUBLE / (60 + a), 0.0) + coalesce(1.0::DOUBLE / (60 + b), 0.0), 9) AS score FROM ka FULL JOIN vb USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20""")
def x01(s: SparkSession, d: str) -> DataFrame:
    whole = lambda df: df.withColumn("score", F.round("score", 10))  # noqa: E731  ties that engines add up in another order stay ties
    keyword = whole(search.keyword_scores(table(s, d, "documents"), "doc_id", "text", ["the", "pathetic"]))
    vectors = table(s, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return search.fused(keyword, whole(search.cosine_scores(vectors, "doc_id", "embedding", [1.0] * 64)), "doc_id", 20)
