"""Queries of loading, unloading, layout writing and streams: each writes a given table to the shared folder first, in the form that its operator reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators import cdc, layout, merge
from lakeops.operators.stage import shared_folder, stage_result
from lakeops.plans.changes import COLS, KEYS, V1, V7, base, c01
from lakeops.plans.inputs import LOG_SQL, money, orders_log, table
from lakeops.plans.registry import query
from lakeops.sources import files as io
from lakeops.streaming import streams


def key() -> Column:
    return F.col("o_orderkey")


def orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("S01_read_files", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS prio FROM orders")
def s01(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "csv")
    prio = F.when(key() % 5 == 0, "NA").when(key() % 7 == 0, "\\N").otherwise(F.concat(F.lit("  "), F.col("o_orderpriority")))
    table(s, d, "orders").select("o_orderkey", prio.alias("prio")).write.option("sep", "|").option("header", "true").csv(path)
    return io.read_files(s, path, io.FileFormat(delimiter="|", null_if=("NA", "\\N"), trim=True, column_count=True), "o_orderkey long, prio string")


@query("S06_external_table", "SELECT event_type, event_id, CAST(value AS DECIMAL(18,4)) AS value FROM events")
def s06(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "external")
    line = F.to_json(F.struct("event_id", F.col("value").cast("decimal(18,4)").cast("string").alias("v"))).alias("value")
    table(s, d, "events").select("event_type", line).write.partitionBy("event_type").text(path)
    return io.external_table(s, path, {"event_id": ("$.event_id", "bigint"), "value": ("$.v", "decimal(18,4)")}, ["event_type"])


@query("S08_infer_schema", """WITH t AS (SELECT l_orderkey::VARCHAR AS k, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity::VARCHAR END AS q, strftime(l_shipdate, '%Y-%m-%d') AS s, CASE WHEN l_linenumber % 2 = 0 THEN 'true' ELSE 'false' END AS e, l_returnflag AS r FROM lineitem),
k AS (SELECT unnest([{'o': 0, 'c': 'k', 'v': k}, {'o': 1, 'c': 'q', 'v': q}, {'o': 2, 'c': 's', 'v': s}, {'o': 3, 'c': 'e', 'v': e}, {'o': 4, 'c': 'r', 'v': r}]) AS x FROM t)
SELECT x.o AS ordinal, x.c AS column_name, CASE WHEN bool_and(regexp_full_match(x.v, '-?[0-9]+')) THEN 'bigint' WHEN bool_and(TRY_CAST(x.v AS DOUBLE) IS NOT NULL) FILTER (x.v IS NOT NULL) THEN 'double'
 WHEN bool_and(TRY_CAST(x.v AS DATE) IS NOT NULL) THEN 'date' WHEN bool_and(x.v IN ('true', 'false')) THEN 'boolean' ELSE 'string' END AS type, count(x.v) < count(*) AS nullable FROM k GROUP BY 1, 2""")
def s08(s: SparkSession, d: str) -> DataFrame:
    path, n = shared_folder(s, "texts"), F.col("l_linenumber")
    text = table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("k"), F.when(n != 3, F.col("l_quantity").cast("string")).alias("q"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("s"), (n % 2 == 0).cast("string").alias("e"), F.col("l_returnflag").alias("r"))
    text.write.option("header", "true").csv(path)
    return io.infer_schema(s.read.option("header", "true").csv(path))


@query("S12_copy_into", """WITH t AS (SELECT o_orderkey % 4 AS f, count(*) AS n, count(*) FILTER (o_orderkey % 4 = 3 AND o_orderkey % 97 = 0) AS bad FROM orders GROUP BY 1)
SELECT CASE WHEN bad = 0 THEN 'LOADED' ELSE 'LOAD_FAILED' END AS status, count(*) AS n_files, CAST(sum(CASE WHEN bad = 0 THEN n ELSE 0 END) AS BIGINT) AS row_count, CAST(sum(bad) AS BIGINT) AS error_count,
 (SELECT CAST(sum(n) FILTER (bad = 0) AS BIGINT) FROM t) AS target_rows FROM t GROUP BY 1""")
def s12(s: SparkSession, d: str) -> DataFrame:
    """Four files, one of them with bad rows, under SKIP_FILE; a second call loads nothing more."""
    path, target, ledger = (shared_folder(s, n) for n in ("in", "target", "ledger"))
    text = table(s, d, "orders").select((key() % 4).alias("f"), key(), F.when((key() % 4 == 3) & (key() % 97 == 0), "bad").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"))
    text.repartition("f").write.partitionBy("f").option("header", "true").csv(path)
    load = lambda: io.copy_into(s, path, io.FileFormat(), {"o_orderkey": "bigint", "o_custkey": "bigint"}, target, ledger, "2030-01-01", "SKIP_FILE")
    first = load()
    load()
    return io.copy_history(first).crossJoin(io.committed(s, target, ledger).agg(F.count("*").alias("target_rows")))


def sums(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("S16_unload", "SELECT true AS within_cap, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def s16(s: SparkSession, d: str) -> DataFrame:
    path, cap = shared_folder(s, "unload"), 256 << 10
    io.unload(orders(s, d), path, "csv", max_file_bytes=cap, header="true")
    files = s.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).agg((F.max("length") <= cap).alias("within_cap"))
    return files.crossJoin(sums(s.read.schema("o_orderkey long, o_custkey long, o_orderstatus string").option("header", "true").csv(path)))


@query("S17_right_size", "SELECT 4 AS n_files, true AS near_target, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def s17(s: SparkSession, d: str) -> DataFrame:
    """Twelve small files become four of about a quarter of their size each."""
    path, out = shared_folder(s, "small"), shared_folder(s, "right")
    orders(s, d).repartition(12).write.parquet(path)
    target = io.listing(s, path).agg(F.expr("CAST(sum(length) DIV 4 + 1 AS LONG)")).first()[0]
    io.right_size(s, path, out, target)
    sizes = s.read.parquet(out).groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
    return sizes.agg(F.count("*").cast("int").alias("n_files"), (F.max("file_size") <= 1.5 * target).alias("near_target"), F.sum("n").alias("n"), F.sum("keys").alias("keys"))


@query("S18_directory_table", "SELECT o_orderstatus, CAST(1 AS BIGINT) AS n_files, true AS sized FROM orders GROUP BY 1")
def s18(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "directory")
    orders(s, d).repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    status = F.regexp_extract("path", "o_orderstatus=([^/]*)/", 1)
    return io.listing(s, path).groupBy(status.alias("o_orderstatus")).agg(F.count("*").alias("n_files"), (F.min("length") > 0).alias("sized"))


@query("S20_map_source_types", "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_totalprice AS DECIMAL(38,6)) AS amount, o_orderstatus AS status, o_orderdate AS at FROM orders")
def s20(s: SparkSession, d: str) -> DataFrame:
    """An extract as text, cast by the types that its source declares."""
    schema = io.map_source_types([("o_orderkey", "bigserial"), ("o_custkey", "integer"), ("price", "numeric(18,2)"), ("amount", "money"), ("status", "varchar(10)"), ("at", "timestamptz")])
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_totalprice", "o_orderstatus", "o_orderdate"]
    text = table(s, d, "orders").select(*(F.col(c).cast("string").alias(f.name) for c, f in zip(columns, schema, strict=True)))
    return text.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


@query("S24_generate_rows", "SELECT range AS id, range % 7 AS bucket, CASE WHEN range % 10 < 6 THEN 'A' WHEN range % 10 < 9 THEN 'B' ELSE 'C' END AS kind FROM range((SELECT count(*) FROM orders))")
def s24(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    return io.generate_rows(s, table(s, d, "orders").count(), {"bucket": i % 7, "kind": F.when(i % 10 < 6, "A").when(i % 10 < 9, "B").otherwise("C")})


@query("P09_stage_result", "WITH h AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n FROM h WHERE n > (SELECT avg(n) FROM h)")
def p09(s: SparkSession, d: str) -> DataFrame:
    h = stage_result(orders(s, d).groupBy("o_custkey").agg(F.count("*").alias("n")))
    return h.where(F.col("n") > h.agg(F.avg("n")).scalar())


@query("L01_cluster_write", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, true AS apart FROM orders")
def l01(s: SparkSession, d: str) -> DataFrame:
    """apart: no file begins before the one before it ends, by status and month."""
    path, month = shared_folder(s, "clustered"), F.date_trunc("month", "o_orderdate")
    layout.cluster_write(table(s, d, "orders").select(*orders(s, d).columns, "o_orderdate"), path, [F.col("o_orderstatus"), month], target_bytes=32 << 10)
    place = F.struct("o_orderstatus", month.alias("m"))
    files = stage_result(s.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")))
    met = files.alias("a").join(files.alias("b"), (F.col("a.file") != F.col("b.file")) & (F.col("a.low") < F.col("b.high")) & (F.col("b.low") < F.col("a.high")))
    return files.agg(F.sum("n").alias("n"), F.sum("keys").alias("keys")).crossJoin(met.agg((F.count("*") == 0).alias("apart")))


def arriving(s: SparkSession, df: DataFrame, parts: list[Column], run: Callable[[str], object], path: str) -> None:
    """The parts of df come to a folder one after the other; `run` sees it after each."""
    for n, part in enumerate(parts):
        df.where(part).write.mode("append" if n else "overwrite").parquet(path)
        run(path)


@query("C03_insert_only_changes", "SELECT o_orderkey, count(*) AS times FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1")
def c03(s: SparkSession, d: str) -> DataFrame:
    path, out, ck = (shared_folder(s, n) for n in ("files", "seen", "ck"))
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    arriving(s, orders(s, d), [key() % 2 == 0, key() % 3 == 0], lambda p: streams.insert_only_changes(s, p, "o_orderkey long, o_custkey long, o_orderstatus string", ck, keep), path)
    return s.read.parquet(out).groupBy("o_orderkey").agg(F.count("*").alias("times"))


@query("C06_has_data", f"WITH {LOG_SQL} SELECT count(*) > 0 AS has_data FROM log WHERE version > 6")
def c06(s: SparkSession, d: str) -> DataFrame:
    return cdc.has_data(orders_log(s, d), 6)


@query("C07_consume", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def c07(s: SparkSession, d: str) -> DataFrame:
    """A batch whose write fails is consumed again; a repeated batch replaces itself."""
    path, out, ck = (shared_folder(s, n) for n in ("files", "seen", "ck"))
    orders(s, d).write.parquet(path)
    source = lambda: s.readStream.schema("o_orderkey long, o_custkey long, o_orderstatus string").parquet(path)
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def fails(batch: DataFrame, number: int) -> None:
        keep(batch, number)
        raise OSError("the sink is gone")

    try:
        streams.drained(source(), ck, fails)
    except Exception as e:
        if "the sink is gone" not in str(e):
            raise
    streams.drained(source(), ck, keep)
    streams.drained(source(), ck, fails)  # nothing is left to consume
    return s.read.parquet(out).drop("batch")


@query("C08_advance_without_processing", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1")
def c08(s: SparkSession, d: str) -> DataFrame:
    path, out, ck = (shared_folder(s, n) for n in ("files", "seen", "ck"))
    source = lambda: s.readStream.schema("o_orderkey long, o_custkey long, o_orderstatus string").parquet(path)
    orders(s, d).where(key() % 2 == 0).write.parquet(path)
    streams.advance_without_processing(source(), ck)
    orders(s, d).where(key() % 2 == 1).write.mode("append").parquet(path)
    streams.drained(source(), ck, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
    return s.read.parquet(out).drop("batch")


@query("M09_scd2_apply_changes", f"""WITH {LOG_SQL}, {V1}, {V7}, dim AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS surrogate_key, * FROM a),
old AS (SELECT dim.*, b.o_orderkey IS NULL OR (dim.o_custkey, dim.o_orderstatus, dim.price) IS DISTINCT FROM (b.o_custkey, b.o_orderstatus, b.price) AS ends FROM dim LEFT JOIN b USING (o_orderkey)),
new AS (SELECT b.* FROM b LEFT JOIN a USING (o_orderkey) WHERE a.o_orderkey IS NULL OR (a.o_custkey, a.o_orderstatus, a.price) IS DISTINCT FROM (b.o_custkey, b.o_orderstatus, b.price))
SELECT surrogate_key, o_orderkey, o_custkey, o_orderstatus, price, DATE '2025-01-01' AS effective_from, CASE WHEN ends THEN DATE '2025-02-28' ELSE DATE '9999-12-31' END AS effective_to, NOT ends AS is_current FROM old
UNION ALL SELECT row_number() OVER (ORDER BY o_orderkey) + (SELECT count(*) FROM dim), o_orderkey, o_custkey, o_orderstatus, price, DATE '2025-03-01', DATE '9999-12-31', true FROM new""")
def m09(s: SparkSession, d: str) -> DataFrame:
    return merge.scd2_apply_changes(merge.scd2_init(base(s, d), KEYS, COLS, "2025-01-01"), c01(s, d), KEYS, COLS, "2025-03-01")


@query("R01_file_ingest_stream", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 97 <> 0")
def r01(s: SparkSession, d: str) -> DataFrame:
    path, out, ck = (shared_folder(s, n) for n in ("in", "loaded", "ck"))
    text = orders(s, d).select("o_orderkey", F.when(key() % 97 == 0, "bad").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"))
    for n, part in enumerate((key() % 2 == 0, key() % 2 == 1)):
        text.where(part).write.mode("append" if n else "overwrite").option("header", "true").csv(path)
        streams.file_ingest_stream(s, path, {"o_orderkey": "bigint", "o_custkey": "bigint"}, out, ck)
    return s.read.parquet(out).drop("batch")


@query("R03_event_log_append", f"WITH {LOG_SQL} SELECT version, o_orderkey, price FROM log WHERE op = 'I'")
def r03(s: SparkSession, d: str) -> DataFrame:
    path, out, ck = (shared_folder(s, n) for n in ("log", "appended", "ck"))
    log = orders_log(s, d)
    run = lambda p: streams.event_log_append(s.readStream.schema(log.schema).parquet(p), out, ck)
    arriving(s, log, [F.col("version") <= 3, F.col("version") > 3], run, path)
    return s.read.parquet(out).select("version", "o_orderkey", "price")


@query("R04_cdc_stream_merge", f"WITH {LOG_SQL}, {V7} SELECT o_orderkey, o_custkey, o_orderstatus, price FROM b")
def r04(s: SparkSession, d: str) -> DataFrame:
    """The whole log in three batches; a key may change several times in one."""
    path, out, ck = (shared_folder(s, n) for n in ("feed", "table", "ck"))
    action = F.when(F.col("op") == "D", "DELETE").otherwise("INSERT").alias("_action")
    feed = orders_log(s, d).select(action, (F.col("op") == "U").alias("_is_update"), F.col("version").alias("seq"), *KEYS, *COLS)
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, price decimal(18,2)"
    run = lambda p: streams.cdc_stream_merge(s.readStream.schema(feed.schema).parquet(p), out, schema, KEYS, ck, "seq")
    seq = F.col("seq")
    arriving(s, feed, [seq <= 2, seq.between(3, 5), seq > 5], run, path)
    return streams.latest_state(s, out, schema)


@query("R05_gate", "SELECT count(*) FILTER (o_orderstatus = 'F') > 0 OR count(*) FILTER (o_orderstatus = 'none') > 0 AS any_open, count(*) FILTER (o_orderstatus = 'F') > 0 AND count(*) FILTER (o_orderstatus = 'none') > 0 AS all_open FROM orders")
def r05(s: SparkSession, d: str) -> DataFrame:
    return streams.gates([orders(s, d).where(F.col("o_orderstatus") == x) for x in ("F", "none")])


ROLLED = "n long, sum_price decimal(38,2), cnt_price long"


@query("R06_medallion_stream", "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_price, count(*) AS cnt_price FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY 1")
def r06(s: SparkSession, d: str) -> DataFrame:
    bronze, silver, gold, ck = (shared_folder(s, n) for n in ("bronze", "silver", "gold", "ck"))
    rows = table(s, d, "orders").select("o_orderkey", "o_orderstatus", money("o_totalprice").alias("price"))
    gold_schema = f"o_orderstatus string, {ROLLED}"
    run = lambda p: streams.medallion_stream(s, p, "o_orderkey long, o_orderstatus string, price decimal(18,2)", silver, gold, ck, lambda b: b.where(key() % 97 != 0), ["o_orderstatus"], ["price"], gold_schema)
    arriving(s, rows, [key() % 3 == 0, key() % 3 != 0], run, bronze)
    return streams.latest_state(s, gold, gold_schema)


@query("R07_sensor_rollup", "SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_price, count(value) AS cnt_price FROM events GROUP BY 1")
def r07(s: SparkSession, d: str) -> DataFrame:
    path, out, ck = (shared_folder(s, n) for n in ("readings", "rollup", "ck"))
    rows = table(s, d, "events").select("event_id", "user_id", money("value").alias("price"))
    schema = f"user_id {rows.schema['user_id'].dataType.simpleString()}, {ROLLED}"
    run = lambda p: streams.keyed_rollup(s.readStream.schema(rows.schema).parquet(p), out, ["user_id"], ["price"], schema, ck)
    e = F.col("event_id")
    arriving(s, rows, [e % 2 == 0, e % 2 == 1], run, path)
    return streams.latest_state(s, out, schema)
