"""Queries of tables kept as sets of files: merges that rewrite touched files, states kept by streams, chains refreshed from deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators import cdc, joins, layout, merge, views
from lakeops.operators.stage import shared_folder, stage_result
from lakeops.plans.changes import COLS, KEYS, V1, V7, base, c01
from lakeops.plans.inputs import LOG_SQL, money, orders_log, state_sql, table
from lakeops.plans.loading import arriving
from lakeops.plans.registry import query
from lakeops.sources.filetable import FileTable
from lakeops.sources.history import History
from lakeops.streaming import stateful, streams

CUT = "(SELECT max(o_orderkey) * 4 // 5 FROM orders)"


def cut(s: SparkSession, d: str) -> int:
    return table(s, d, "orders").agg(F.expr("max(o_orderkey) * 4 DIV 5")).first()[0]


@query("M01_merge_touched_files", f"""WITH {LOG_SQL}, {V1}, {V7}, c AS (SELECT * FROM b WHERE o_orderkey > {CUT}) SELECT coalesce(a.o_orderkey, c.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL OR c.o_orderkey IS NOT NULL AND c.o_orderkey % 6 = 0 THEN c.o_custkey ELSE a.o_custkey END AS o_custkey,
 CASE WHEN a.o_orderkey IS NULL THEN c.o_orderstatus WHEN c.o_orderkey % 6 = 0 THEN 'M' ELSE a.o_orderstatus END AS o_orderstatus,
 CASE WHEN a.o_orderkey IS NULL OR c.o_orderkey IS NOT NULL AND c.o_orderkey % 6 = 0 THEN c.price ELSE a.price END AS price
 FROM a FULL JOIN c ON a.o_orderkey = c.o_orderkey WHERE NOT (a.o_orderkey IS NOT NULL AND c.o_orderkey IS NOT NULL AND a.o_orderkey % 5 = 0) AND NOT (a.o_orderkey IS NULL AND c.price < 100)""")
def m01_files(s: SparkSession, d: str) -> DataFrame:
    """A source of late keys: files of earlier ones are kept as they are."""
    values = {"o_orderkey": "s.o_orderkey", "o_custkey": "s.o_custkey", "o_orderstatus": "'M'", "price": "s.price"}
    clauses = [merge.Clause("delete", "t.o_orderkey % 5 = 0"), merge.Clause("update", "s.o_orderkey % 6 = 0", values), merge.Clause("insert", "s.price >= 100")]
    target = FileTable.create(base(s, d), shared_folder(s, "table"), KEYS, 8)
    target.merge(cdc.state_at(orders_log(s, d), 7, KEYS, COLS).where(F.col("o_orderkey") > cut(s, d)), clauses)
    return target.read()


@query("M11_cdc_merge_touched_files", f"WITH {LOG_SQL}, {V1}, {V7} SELECT * FROM a WHERE o_orderkey <= {CUT} UNION ALL SELECT * FROM b WHERE o_orderkey > {CUT}")
def m11_files(s: SparkSession, d: str) -> DataFrame:
    target = FileTable.create(base(s, d), shared_folder(s, "table"), KEYS, 8)
    target.apply_changes(c01(s, d).where(F.col("o_orderkey") > cut(s, d)))
    return target.read()


# States kept by streams.


@query("R04_cdc_merge_in_state", f"WITH {LOG_SQL}, {V7} SELECT o_orderkey, o_custkey, o_orderstatus, price FROM b")
def r04_state(s: SparkSession, d: str) -> DataFrame:
    """The whole log in three batches that come in the wrong order."""
    path, out, ck = (shared_folder(s, n) for n in ("feed", "table", "ck"))
    action = F.when(F.col("op") == "D", "DELETE").otherwise("INSERT").alias("_action")
    feed = orders_log(s, d).select(action, (F.col("op") == "U").alias("_is_update"), F.col("version").alias("seq"), *KEYS, *COLS)
    schema, seq = "o_orderkey long, o_custkey long, o_orderstatus string, price decimal(18,2)", F.col("seq")
    run = lambda p: stateful.cdc_merge(s.readStream.schema(feed.schema).parquet(p), out, schema, KEYS, "seq", ck, 2)
    arriving(s, feed, [seq > 5, seq <= 2, seq.between(3, 5)], run, path)
    return stateful.merged(s, out, schema, KEYS)


WEEK = 7 * 86400


@query("R07_sensor_rollup_in_state", f"""WITH e AS (SELECT user_id, CAST(floor(epoch(ts) / {WEEK}) AS BIGINT) AS week, CAST(value AS DECIMAL(18,2)) AS value FROM events)
SELECT user_id, week, count(*) AS n, count(value) AS cnt_value, CAST(sum(value) AS DECIMAL(28,2)) AS sum_value, CAST(min(value) AS DECIMAL(28,2)) AS min_value, CAST(max(value) AS DECIMAL(28,2)) AS max_value FROM e GROUP BY 1, 2""")
def r07_state(s: SparkSession, d: str) -> DataFrame:
    """Weekly windows over two batches in order of time; the second changes windows of the first."""
    path, out, ck = (shared_folder(s, n) for n in ("readings", "rollup", "ck"))
    rows = readings(s, d)
    mid = rows.agg(F.expr("CAST((unix_micros(min(ts)) + unix_micros(max(ts))) DIV 2 AS LONG)")).first()[0]
    keys, measures = {"user_id": "long"}, {"value": "decimal(28,2)"}
    run = lambda p: stateful.sensor_rollup(s.readStream.schema(rows.schema).parquet(p), out, keys, measures, ck, "ts", "7 days")
    at = F.unix_micros("ts")
    arriving(s, rows, [at <= mid, at > mid], run, path)
    found = stateful.latest(s, out, stateful.rolled_schema(keys, measures, "7 days"), ["user_id", "window_start", "window_end"])
    return found.select("user_id", F.expr(f"unix_seconds(window_start) DIV {WEEK}").alias("week"), "n", "cnt_value", "sum_value", "min_value", "max_value")


def readings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), money("value").alias("value"))


QUIET = 3 * 86400


@query("R07_quiet_sensors", f"""WITH e AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events), n AS (SELECT user_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS next, (SELECT max(us) FROM e) AS top FROM e),
q AS (SELECT *, coalesce(next - us > {QUIET}000000, us // 1000 + {QUIET}000 + 1 < top // 1000) AS down FROM n)
SELECT user_id, 'DOWN' AS status, us + {QUIET}000000 AS us FROM q WHERE down UNION ALL SELECT user_id, 'UP', next FROM q WHERE down AND next IS NOT NULL""")
def r07_quiet(s: SparkSession, d: str) -> DataFrame:
    """Users of whom nothing came for three days, told by timers in keyed state."""
    path, out, ck = (shared_folder(s, n) for n in ("readings", "silences", "ck"))
    rows = readings(s, d)
    mid = rows.agg(F.expr("CAST((unix_micros(min(ts)) + unix_micros(max(ts))) DIV 2 AS LONG)")).first()[0]
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    run = lambda p: streams.drained(stateful.silences(s.readStream.schema(rows.schema).parquet(p), "user_id", "ts", QUIET), ck, write)
    at = F.unix_micros("ts")
    arriving(s, rows, [at <= mid, at > mid], run, path)
    return s.read.parquet(out).select(F.col("key").alias("user_id"), "status", F.unix_micros("at").alias("us"))


@query("R02_row_ingest_stream", "SELECT event_type AS channel, count(*) AS n, sum(event_id) AS ids, max(event_id) AS last FROM events GROUP BY 1")
def r02_stream(s: SparkSession, d: str) -> DataFrame:
    """Rows in three batches, of which the last sends some again that were written before, and some twice."""
    path, out, offsets, ck = (shared_folder(s, n) for n in ("rows", "written", "offsets", "ck"))
    rows = table(s, d, "events").select(F.col("event_type").alias("channel"), F.col("event_id").cast("long").alias("offset"))
    top = F.col("offset")
    half = rows.agg(F.expr("CAST(max(offset) DIV 2 AS LONG)")).first()[0]
    run = lambda: streams.row_ingest_stream(s.readStream.schema(rows.schema).parquet(path), out, offsets, ck)
    for part in (rows.where(top <= half), rows.where(top > half).unionByName(rows.where(top % 10 == 0)), rows.where(top % 7 == 0)):
        part.write.mode("append").parquet(path)
        run()
    return s.read.parquet(out).groupBy("channel").agg(F.count("*").alias("n"), F.sum("offset").alias("ids"), F.max("offset").alias("last"))


# Views refreshed from deltas.


def log_table(s: SparkSession, d: str) -> FileTable:
    """The state at version 1 in files by key, and then the changes up to version 7."""
    return FileTable.create(base(s, d), shared_folder(s, "orders"), KEYS, 8)


@query("I04_chain_from_deltas", f"""WITH {LOG_SQL}, {V7}, t AS (SELECT o_custkey, CAST(sum(price) AS DECIMAL(28,2)) AS total FROM b GROUP BY 1), v AS (SELECT * FROM t WHERE total > 1000000)
SELECT c_mktsegment, count(*) AS n, CAST(sum(total) AS DECIMAL(28,2)) AS total FROM v JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def i04_deltas(s: SparkSession, d: str) -> DataFrame:
    """Totals by customer, the large ones, with their segment, by segment: built at version 1, refreshed by what changed since."""
    orders = log_table(s, d)
    customers = FileTable.create(table(s, d, "customer").select("c_custkey", "c_mktsegment"), shared_folder(s, "customers"), ["c_custkey"], 4)
    steps = {
        "totals": views.Summed("orders", ("o_custkey",), ("price",)),
        "vip": views.Filtered("totals", "sum_price > 1000000", {"c_custkey": "o_custkey", "total": "CAST(sum_price AS decimal(28,2))"}),
        "named": views.Joined("vip", "customers", ("c_custkey",)),
        "dashboard": views.Summed("named", ("c_mktsegment",), ("total",)),
    }
    chain = views.Chain(s, shared_folder(s, "chain"), {"orders": orders, "customers": customers}, steps, 4)
    orders.apply_changes(c01(s, d))
    chain.refresh()
    return chain.read("dashboard").select("c_mktsegment", "n", F.col("sum_total").cast("decimal(28,2)").alias("total"))


@query("I01_extremes_and_distinct", f"WITH {LOG_SQL}, {V7} SELECT o_orderstatus, count(*) AS n, count(DISTINCT price) AS n_distinct, min(price) AS least, max(price) AS most FROM b GROUP BY 1")
def i01_extremes(s: SparkSession, d: str) -> DataFrame:
    view = views.ExtremesView.create(base(s, d), shared_folder(s, "extremes"), ["o_orderstatus"], "price", 4)
    view.apply(views.signed(c01(s, d)))
    return view.read()


# Past states from snapshots.


def history(s: SparkSession, d: str) -> History:
    """The log of orders in ranges of two versions, as it came in three parts."""
    log, v = orders_log(s, d), F.col("version")
    kept = History.create(log, shared_folder(s, "history"), KEYS, COLS, 2, 4)
    for part in (v <= 3, v.between(4, 5), v > 5):
        kept.append(log.where(part))
    return kept


@query("C12_as_of_snapshots", f"WITH {LOG_SQL}, {state_sql(5, 'x')} SELECT * FROM x")
def c12_snapshots(s: SparkSession, d: str) -> DataFrame:
    kept = history(s, d)
    return kept.as_of(kept.version_at("2024-01-06 12:00:00"))


@query("C13_before_statement_snapshots", f"WITH {LOG_SQL}, {state_sql(3, 'x')} SELECT * FROM x")
def c13_snapshots(s: SparkSession, d: str) -> DataFrame:
    kept = history(s, d)
    return kept.as_of(kept.version_before("Q4"))


@query("C19_expired_ranges", f"WITH {LOG_SQL}, {state_sql(4, 'x')} SELECT version, o_orderkey, op FROM log WHERE version > 4 UNION ALL SELECT 4, o_orderkey, 'S' FROM x")
def c19_expired(s: SparkSession, d: str) -> DataFrame:
    """What is kept for all states from version 5 on: a snapshot and the ranges after it."""
    kept = history(s, d)
    kept.expire(5)
    return kept.log.select("version", "o_orderkey", "op").unionByName(kept.as_of(4).select(F.lit(4).alias("version"), "o_orderkey", F.lit("S").alias("op")))


# Joins in order, and layouts by several columns.


@query("J10_as_of_sorted", """WITH v AS (SELECT user_id, ts, max(event_id) AS last_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1, 2)
SELECT e.event_id, v.last_id FROM events e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def j10_sorted(s: SparkSession, d: str) -> DataFrame:
    """Each event with its user's last event of one type: as many versions as there are such events."""
    e = table(s, d, "events")
    kind = e.agg(F.min("event_type")).first()[0]
    versions = e.where(F.col("event_type") == kind).groupBy("user_id", F.col("ts").alias("since")).agg(F.max("event_id").alias("last_id"))
    return joins.join_as_of_sorted(e.select("event_id", "user_id", "ts"), versions, "user_id", "ts", "since").select("event_id", "last_id")


@query("L01_interleaved_layout", "SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, true AS shallower, true AS reads_fewer FROM lineitem")
def l01_interleaved(s: SparkSession, d: str) -> DataFrame:
    """Order lines by part and day in 16 files, in order of both columns one after the other and of both at once: the second column's depth, and the files that a range of it needs."""
    lines = table(s, d, "lineitem").select("l_orderkey", "l_partkey", F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("day"))
    plain, woven = shared_folder(s, "plain"), shared_folder(s, "woven")
    lines.repartitionByRange(16, "l_partkey", "day").sortWithinPartitions("l_partkey", "day").write.parquet(plain)
    layout.cluster_write_interleaved(lines, woven, ["l_partkey", "day"], 16)
    ends = lines.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
    found = {}
    for path in (plain, woven):
        zones = stage_result(layout.zone_map(s.read.parquet(path), ["day"]), "zones")
        depth = layout.clustering_information(zones).select("average_depth")
        kept = layout.prune_estimate(zones, "day", ends.low, ends.low + (ends.high - ends.low) / 8).select("kept_files")
        found[path] = depth.crossJoin(kept)  # one row each
    both = found[plain].select(F.col("average_depth").alias("d1"), F.col("kept_files").alias("k1")).crossJoin(found[woven])
    sums = s.read.parquet(woven).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))
    return sums.crossJoin(both).select("n", "keys", (F.col("average_depth") < F.col("d1")).alias("shallower"), (F.col("kept_files") < F.col("k1")).alias("reads_fewer"))


@query("L07_bloom_files", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT min(l_partkey) FROM lineitem UNION ALL SELECT max(l_partkey) FROM lineitem UNION ALL SELECT -5)")
def l07_bloom(s: SparkSession, d: str) -> DataFrame:
    """Order lines of three parts, one of which there is not, by Bloom filters of files that came in two loads; the second load's files alone are read for their filters."""
    path, index = shared_folder(s, "lines"), shared_folder(s, "bloom")
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    ends = lines.agg(F.min("l_partkey").alias("low"), F.max("l_partkey").alias("high"), F.count("*").alias("n"), F.approx_count_distinct("l_partkey").alias("parts")).first()
    files = max(6, ends.n // 2_000_000, ends.parts // 24_000)  # four bitmaps tell about 24,000 values
    for part in (F.col("l_orderkey") % 2 == 0, F.col("l_orderkey") % 2 == 1):
        lines.where(part).repartitionByRange(files, "l_partkey").write.mode("append").parquet(path)
        layout.extend_bloom(s, path, index, "l_partkey", 4)
    return layout.rows_by_bloom(s, index, "l_partkey", [ends.low, ends.high, -5], 4)
