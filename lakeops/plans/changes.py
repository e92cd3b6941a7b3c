"""Queries of change capture, past states, merges and maintained aggregates, over a change log derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators import cdc, maintain, merge
from lakeops.plans.inputs import LOG_SQL, money, orders_log, state_sql, table
from lakeops.plans.registry import query

KEYS, COLS = ["o_orderkey"], ["o_custkey", "o_orderstatus", "price"]
V1, V7, V3 = state_sql(1, "a"), state_sql(7, "b"), state_sql(3, "c3")
DELTA = """d AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k, a.o_orderkey IS NOT NULL AS was, b.o_orderkey IS NOT NULL AS now, a, b FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a IS DISTINCT FROM b)"""
FEED = """SELECT 'DELETE' AS _action, now AS _is_update, CAST(k AS VARCHAR) AS _row_id, k AS o_orderkey, a.o_custkey AS o_custkey, a.o_orderstatus AS o_orderstatus, a.price AS price FROM d WHERE was
UNION ALL SELECT 'INSERT', was, CAST(k AS VARCHAR), k, b.o_custkey, b.o_orderstatus, b.price FROM d WHERE now"""
CHANGES = f"WITH {LOG_SQL}, {V1}, {V7}, {DELTA} {FEED}"


@query("C01_net_changes", CHANGES)
def c01(s: SparkSession, d: str) -> DataFrame:
    return cdc.net_changes(orders_log(s, d), 1, 7, KEYS, COLS)


@query("C02_append_only_changes", f"WITH {LOG_SQL} SELECT version, o_orderkey, price FROM log WHERE op = 'I' AND version > 1 AND version <= 6")
def c02(s: SparkSession, d: str) -> DataFrame:
    return cdc.append_only_changes(orders_log(s, d), 1, 6).select("version", "o_orderkey", "price")


@query("C04_initial_rows", f"WITH {LOG_SQL}, {V7} SELECT 'INSERT' AS _action, false AS _is_update, CAST(o_orderkey AS VARCHAR) AS _row_id, * FROM b")
def c04(s: SparkSession, d: str) -> DataFrame:
    return cdc.initial_rows(cdc.state_at(orders_log(s, d), 7, KEYS, COLS), KEYS)


@query("C05_changes_between", f"WITH {LOG_SQL}, {state_sql(2, 'a')}, {state_sql(5, 'b')}, {DELTA} {FEED}")
def c05(s: SparkSession, d: str) -> DataFrame:
    log = orders_log(s, d)
    return cdc.net_changes(log, cdc.version_at(log, "2024-01-03 12:00:00"), cdc.version_at(log, "2024-01-06"), KEYS, COLS)


@query("C09_staleness_report", "SELECT 'u' || user_id AS consumer, max(ts) AS offset_ts, max(ts) + INTERVAL 14 DAY AS stale_after, TIMESTAMP '2024-02-12 12:00:00' > max(ts) + INTERVAL 14 DAY AS stale FROM events GROUP BY user_id")
def c09(s: SparkSession, d: str) -> DataFrame:
    consumers = table(s, d, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("consumer")).agg(F.max("ts").alias("offset_ts"))
    return cdc.staleness_report(consumers, 1, 14, "2024-02-12 12:00:00")


@query("C10_view_delta", f"""WITH {LOG_SQL}, {V1}, {V7},
x AS (SELECT o_orderkey, price, c_name FROM b JOIN (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer) ON o_custkey = c_custkey),
y AS (SELECT o_orderkey, price, c_name FROM a JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, price, c_name, CAST(sum(sg) AS BIGINT) AS _sign FROM (SELECT *, 1 AS sg FROM x UNION ALL SELECT *, -1 FROM y) GROUP BY ALL HAVING sum(sg) <> 0""")
def c10(s: SparkSession, d: str) -> DataFrame:
    log, c = orders_log(s, d), table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    signed = cdc.net_changes(log, 1, 7, KEYS, COLS).select("o_custkey", "o_orderkey", "price", F.when(F.col("_action") == "INSERT", 1).otherwise(-1).alias("_sign"))
    moved = c.where("o_custkey % 5 = 0")
    right = moved.withColumn("_sign", F.lit(-1)).unionByName(moved.select("o_custkey", F.lit("new").alias("c_name"), F.lit(1).alias("_sign")))
    left = cdc.state_at(log, 1, KEYS, COLS).select("o_custkey", "o_orderkey", "price")
    out = cdc.view_delta(signed, left, right, c, "o_custkey")
    return out.groupBy("o_orderkey", "price", "c_name").agg(F.sum("_sign").alias("_sign")).where("_sign <> 0")


@query("C11_diff_snapshots", CHANGES)
def c11(s: SparkSession, d: str) -> DataFrame:
    log = orders_log(s, d)
    return cdc.diff_snapshots(cdc.state_at(log, 1, KEYS, COLS), cdc.state_at(log, 7, KEYS, COLS), KEYS, COLS)


@query("C12_as_of", f"WITH {LOG_SQL}, {V3} SELECT * FROM c3")
def c12(s: SparkSession, d: str) -> DataFrame:
    log = orders_log(s, d)
    return cdc.state_at(log, cdc.version_at(log, "2024-01-04 10:00:00"), KEYS, COLS)


@query("C13_before_statement", f"WITH {LOG_SQL}, {V3} SELECT * FROM c3")
def c13(s: SparkSession, d: str) -> DataFrame:
    log = orders_log(s, d)
    return cdc.state_at(log, cdc.version_before(log, "Q4"), KEYS, COLS)


@query("C14_restore_deleted", f"WITH {LOG_SQL}, {V3}, {V7} SELECT * FROM b UNION ALL SELECT * FROM c3 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def c14(s: SparkSession, d: str) -> DataFrame:
    log = orders_log(s, d)
    return cdc.restore_deleted(cdc.state_at(log, 7, KEYS, COLS), cdc.state_at(log, 3, KEYS, COLS), KEYS)


@query("C15_high_water_increment", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20'")
def c15(s: SparkSession, d: str) -> DataFrame:
    return cdc.high_water_increment(table(s, d, "events").select("event_id", "ts"), "ts", "2024-01-20")


@query("C16_sequence_guard", """WITH u AS (SELECT user_id, event_id AS seq, value FROM events WHERE event_id % 3 = 0), t AS (SELECT user_id, max(event_id) AS seen FROM events WHERE event_id % 3 <> 0 AND user_id % 2 = 0 GROUP BY 1)
SELECT user_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM u) LEFT JOIN t USING (user_id) WHERE rn = 1 AND (seen IS NULL OR seq > seen)""")
def c16(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumnRenamed("event_id", "seq")
    target = e.where("seq % 3 <> 0 AND user_id % 2 = 0").groupBy("user_id").agg(F.max("seq").alias("seq"))
    return cdc.sequence_guard(e.where("seq % 3 = 0").select("user_id", "seq", "value"), target, ["user_id"], "seq")


@query("C17_version_history", f"WITH {LOG_SQL} SELECT version, min(ts) AS ts, min(stmt_id) AS stmt_id, count(*) FILTER (op = 'I') AS inserted, count(*) FILTER (op = 'U') AS updated, count(*) FILTER (op = 'D') AS deleted FROM log GROUP BY 1")
def c17(s: SparkSession, d: str) -> DataFrame:
    return cdc.version_history(orders_log(s, d))


@query("C18_file_lifecycle", """WITH f AS (SELECT o_orderkey AS file, o_orderdate AS created_ts, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + to_days(CAST(o_orderkey % 50 AS INTEGER)) END AS deleted_ts FROM orders)
SELECT state, count(*) AS n FROM (SELECT CASE WHEN created_ts > TIMESTAMP '1998-06-01' THEN 'NOT_YET' WHEN deleted_ts IS NULL OR deleted_ts > TIMESTAMP '1998-06-01' THEN 'ACTIVE'
 WHEN TIMESTAMP '1998-06-01' <= deleted_ts + INTERVAL 30 DAY THEN 'TIME_TRAVEL' WHEN TIMESTAMP '1998-06-01' <= deleted_ts + INTERVAL 37 DAY THEN 'FAIL_SAFE' ELSE 'PURGED' END AS state FROM f) GROUP BY 1""")
def c18(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    files = table(s, d, "orders").select(k.alias("file"), F.col("o_orderdate").alias("created_ts"), F.when(k % 3 != 0, F.timestamp_add("DAY", (k % 50).cast("int"), "o_orderdate")).alias("deleted_ts"))
    return cdc.file_lifecycle(files, "1998-06-01", 30).groupBy("state").agg(F.count("*").alias("n"))


@query("C19_retained_history", f"""WITH {LOG_SQL}, old AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC) AS rn FROM log WHERE ts <= TIMESTAMP '2024-01-04')
SELECT version, o_orderkey, op FROM log WHERE ts > TIMESTAMP '2024-01-04' UNION ALL SELECT version, o_orderkey, op FROM old WHERE rn = 1 AND op <> 'D'""")
def c19(s: SparkSession, d: str) -> DataFrame:
    return cdc.retained_history(orders_log(s, d), KEYS, "2024-01-08", 1, 4).select("version", "o_orderkey", "op")


# Merges: the target is the state at version 1, the source holds what a later state changed.


def base(s: SparkSession, d: str) -> DataFrame:
    return cdc.state_at(orders_log(s, d), 1, KEYS, COLS)


@query("M01_merge_into", f"""WITH {LOG_SQL}, {V1}, {V7} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NOT NULL AND b.o_orderkey % 6 = 0 THEN b.o_custkey ELSE a.o_custkey END AS o_custkey,
 CASE WHEN a.o_orderkey IS NULL THEN b.o_orderstatus WHEN b.o_orderkey % 6 = 0 THEN 'M' ELSE a.o_orderstatus END AS o_orderstatus,
 CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NOT NULL AND b.o_orderkey % 6 = 0 THEN b.price ELSE a.price END AS price
 FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE NOT (a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND a.o_orderkey % 5 = 0) AND NOT (a.o_orderkey IS NULL AND b.price < 100)""")
def m01(s: SparkSession, d: str) -> DataFrame:
    values = {"o_orderkey": "s.o_orderkey", "o_custkey": "s.o_custkey", "o_orderstatus": "'M'", "price": "s.price"}
    clauses = [merge.Clause("delete", "t.o_orderkey % 5 = 0"), merge.Clause("update", "s.o_orderkey % 6 = 0", values), merge.Clause("insert", "s.price >= 100")]
    return merge.merge_into(base(s, d), cdc.state_at(orders_log(s, d), 7, KEYS, COLS), KEYS, clauses)


@query("M02_assert_single_source_match", f"WITH {LOG_SQL}, {V1} SELECT o_orderkey, count(*) AS n FROM log WHERE version > 1 AND o_orderkey IN (SELECT o_orderkey FROM a) GROUP BY 1 HAVING count(*) > 1")
def m02(s: SparkSession, d: str) -> DataFrame:
    return merge.many_source_rows(base(s, d), orders_log(s, d).where("version > 1"), KEYS)


SCD1 = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1 - c_custkey, c_mktsegment FROM customer WHERE c_custkey % 11 = 0"


def days(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """customer on three days: changed and added (keys below 0, which no customer has) on the second, some dropped on the third."""
    k = F.col("c_custkey")
    day1 = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    changed = day1.withColumn("c_mktsegment", F.when(k % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    day2 = changed.unionByName(day1.where(k % 11 == 0).select((-1 - k).alias("c_custkey"), "c_mktsegment"))
    return day1, day2, day2.where(k % 8 != 0)


@query("M03_scd1_merge", SCD1)
def m03(s: SparkSession, d: str) -> DataFrame:
    day1, day2, _ = days(s, d)
    return merge.scd1_merge(day1, day2, ["c_custkey"], ["c_mktsegment"])


@query("M04_scd1_two_step", SCD1)
def m04(s: SparkSession, d: str) -> DataFrame:
    day1, day2, _ = days(s, d)
    return merge.scd1_two_step(day1, day2, ["c_custkey"], ["c_mktsegment"])


@query("M05_delete_missing", f"SELECT * FROM ({SCD1}) WHERE c_custkey % 8 <> 0")
def m05(s: SparkSession, d: str) -> DataFrame:
    _, day2, day3 = days(s, d)
    return merge.delete_missing(day2, day3, ["c_custkey"])


SCD2 = """day1 AS (SELECT row_number() OVER (ORDER BY c_custkey) AS surrogate_key, c_custkey, c_mktsegment FROM customer),
new2 AS (SELECT c_custkey, 'MOVED' AS c_mktsegment FROM customer WHERE c_custkey % 5 = 0 AND c_mktsegment <> 'MOVED' UNION ALL SELECT -1 - c_custkey, c_mktsegment FROM customer WHERE c_custkey % 11 = 0),
v2 AS (SELECT surrogate_key, c_custkey, c_mktsegment, DATE '2025-01-01' AS effective_from, CASE WHEN c_custkey % 5 = 0 THEN DATE '2025-02-28' ELSE DATE '9999-12-31' END AS effective_to, c_custkey % 5 <> 0 AS is_current FROM day1
 UNION ALL SELECT row_number() OVER (ORDER BY c_custkey) + (SELECT max(surrogate_key) FROM day1), c_custkey, c_mktsegment, DATE '2025-03-01', DATE '9999-12-31', true FROM new2)"""


@query("M06_scd2_merge", f"WITH {SCD2} SELECT * FROM v2")
def m06(s: SparkSession, d: str) -> DataFrame:
    day1, day2, _ = days(s, d)
    return merge.scd2_merge(merge.scd2_init(day1, ["c_custkey"], ["c_mktsegment"], "2025-01-01"), day2, ["c_custkey"], ["c_mktsegment"], "2025-03-01")


@query("M07_scd2_soft_delete", f"WITH {SCD2} SELECT surrogate_key, c_custkey, c_mktsegment, effective_from, CASE WHEN is_current AND c_custkey % 8 = 0 THEN DATE '2025-04-30' ELSE effective_to END AS effective_to, is_current AND c_custkey % 8 <> 0 AS is_current FROM v2")
def m07(s: SparkSession, d: str) -> DataFrame:
    return merge.scd2_merge(m06(s, d), days(s, d)[2], ["c_custkey"], ["c_mktsegment"], "2025-05-01", delete_missing=True)


@query("M10_soft_delete_merge", f"""WITH {LOG_SQL}, {V1}, {V7} SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(b.o_custkey, a.o_custkey) AS o_custkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus,
 coalesce(b.price, a.price) AS price, CASE WHEN b.o_orderkey IS NULL THEN 'Y' ELSE 'N' END AS deleted_ind FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def m10(s: SparkSession, d: str) -> DataFrame:
    return merge.soft_delete_merge(base(s, d).withColumn("deleted_ind", F.lit("N")), c01(s, d), KEYS)


@query("M11_cdc_merge", f"WITH {LOG_SQL}, {V7} SELECT * FROM b")
def m11(s: SparkSession, d: str) -> DataFrame:
    return merge.apply_changes(base(s, d), c01(s, d), KEYS)


@query("M12_scd0_insert_only", "SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT -1 - c_custkey, c_mktsegment FROM customer WHERE c_custkey % 11 = 0")
def m12(s: SparkSession, d: str) -> DataFrame:
    day1, day2, _ = days(s, d)
    return cdc.restore_deleted(day1, day2, ["c_custkey"])


@query("M13_scd3_previous_value", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS current_c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS previous_c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN DATE '2025-03-01' END AS c_mktsegment_changed_on FROM customer")
def m13(s: SparkSession, d: str) -> DataFrame:
    day1, day2, _ = days(s, d)
    dim = day1.select("c_custkey", F.col("c_mktsegment").alias("current_c_mktsegment"), F.lit(None).cast("string").alias("previous_c_mktsegment"), F.lit(None).cast("date").alias("c_mktsegment_changed_on"))
    return merge.scd3_previous_value(dim, day2, ["c_custkey"], "c_mktsegment", "2025-03-01")


@query("M14_archive_and_delete", "SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'archive' ELSE 'remaining' END AS part, count(*) AS n FROM orders GROUP BY 1")
def m14(s: SparkSession, d: str) -> DataFrame:
    gone, kept = merge.archive_and_delete(table(s, d, "orders"), F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"))
    return gone.withColumn("part", F.lit("archive")).unionByName(kept.withColumn("part", F.lit("remaining"))).groupBy("part").agg(F.count("*").alias("n"))


@query("M19_dedupe_double_load", "SELECT o_orderkey, price FROM (SELECT o_orderkey, max(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END) AS price FROM orders GROUP BY 1)")
def m19(s: SparkSession, d: str) -> DataFrame:
    from lakeops.operators.aggregates import latest_per_key

    o = table(s, d, "orders").select("o_orderkey", money("o_totalprice").cast("decimal(19,2)").alias("price"))
    twice = o.unionByName(o.where("o_orderkey % 9 = 0").select("o_orderkey", (F.col("price") + 1).cast("decimal(19,2)").alias("price")))
    return latest_per_key(twice, KEYS, [F.desc("price")])


@query("M20_balanced_transfer", """WITH t AS (SELECT c_custkey AS source, (c_custkey + 1) % (SELECT count(*) FROM customer) AS target FROM customer WHERE c_custkey % 4 = 0), r AS (SELECT min(c_custkey) AS lo FROM customer)
SELECT c_custkey AS account_id, CAST(20000 + CAST(c_acctbal AS DECIMAL(18,2)) - CASE WHEN c_custkey % 4 = 0 THEN 10 ELSE 0 END + CASE WHEN c_custkey IN (SELECT target FROM t) THEN 10 ELSE 0 END AS DECIMAL(20,2)) AS balance, true AS applied FROM customer""")
def m20(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    accounts = c.select(F.col("c_custkey").alias("account_id"), (money("c_acctbal") + 20000).cast("decimal(20,2)").alias("balance"))
    n = accounts.count()
    moves = c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("source"), ((F.col("c_custkey") + 1) % n).alias("target"), F.lit("10.00").cast("decimal(20,2)").alias("amount"))
    return merge.balanced_transfer(accounts, moves)


@query("M17_enforce_constraints", """SELECT 'unique' AS rule, 'l_orderkey,l_linenumber' AS detail, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def m17(s: SparkSession, d: str) -> DataFrame:
    return merge.violations(table(s, d, "lineitem"), primary=["l_orderkey", "l_linenumber"], foreign=[("l_orderkey", table(s, d, "orders"), "o_orderkey")])


MV = "SELECT o_orderstatus, count(*) AS n, CAST(sum(price) AS DECIMAL(28,2)) AS sum_price, count(price) AS cnt_price FROM b GROUP BY 1"


@query("I01_maintain_aggregate", f"WITH {LOG_SQL}, {V7} {MV}")
def i01(s: SparkSession, d: str) -> DataFrame:
    mv = maintain.summed(base(s, d), ["o_orderstatus"], ["price"])
    return maintain.maintain_aggregate(mv, c01(s, d), ["o_orderstatus"], ["price"]).withColumn("sum_price", F.col("sum_price").cast("decimal(28,2)"))


@query("I02_mv_rewrite_check", "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS sum_price, count(*) AS cnt_price FROM orders GROUP BY 1")
def i02(s: SparkSession, d: str) -> DataFrame:
    mv = maintain.summed(table(s, d, "orders").withColumn("price", money("o_totalprice")), ["o_orderstatus", "o_orderpriority"], ["price"])
    return maintain.rollup_from(mv, ["o_orderstatus"], ["price"]).withColumn("sum_price", F.col("sum_price").cast("decimal(28,2)"))


@query("I04_dynamic_table_chain", """WITH e AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM orders GROUP BY 1), v AS (SELECT * FROM e WHERE total > 2000000)
SELECT c_mktsegment, count(*) AS n, CAST(sum(total) AS DECIMAL(28,2)) AS total FROM v JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def i04(s: SparkSession, d: str) -> DataFrame:
    defs = {
        "dashboard": (["vip", "customer"], lambda v, c: v.join(c, v["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("total").cast("decimal(28,2)").alias("total"))),
        "vip": (["totals"], lambda t: t.where("total > 2000000")),
        "totals": (["orders"], lambda o: o.groupBy("o_custkey").agg(F.sum(money("o_totalprice")).cast("decimal(28,2)").alias("total"))),
    }
    return maintain.refresh_chain({"orders": table(s, d, "orders"), "customer": table(s, d, "customer")}, defs)["dashboard"]
