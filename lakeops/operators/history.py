"""Run-history analytics over a table of runs: query_id, start_time, warehouse, elapsed_ms, partitions_scanned, partitions_total, spill_local, spill_remote, queued_ms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.functions.scalar import ratio_pct
from lakeops.operators.stage import stage_result

GIB = 1 << 30


def slow_queries(hist: DataFrame, ms: int, n: int) -> DataFrame:
    out = hist.where(F.col("elapsed_ms") > ms).select("query_id", "warehouse", "elapsed_ms", ratio_pct(F.col("partitions_scanned"), F.col("partitions_total")).alias("scanned_pct"), (F.col("spill_local") + F.col("spill_remote")).alias("spilled"))
    return out.orderBy(F.desc("elapsed_ms"), "query_id").limit(n)


def slow_query_trend(hist: DataFrame, ms: int) -> DataFrame:
    return hist.where(F.col("elapsed_ms") > ms).groupBy(F.to_date("start_time").alias("day")).agg(F.count("*").alias("n"), F.sum("elapsed_ms").alias("total_ms"), F.count_if(F.col("spill_remote") > 0).alias("remote_spills"))


def spill_report(hist: DataFrame) -> DataFrame:
    """Runs that spilled, in MB."""
    mb = lambda c: F.round(F.col(c) / (1 << 20), 2).alias(f"{c}_mb")
    return hist.where((F.col("spill_local") > 0) | (F.col("spill_remote") > 0)).select("query_id", "warehouse", mb("spill_local"), mb("spill_remote"))


def load_report(hist: DataFrame, least_queued_ms: int) -> DataFrame:
    out = hist.groupBy("warehouse", F.hour("start_time").alias("hour")).agg(F.count("*").alias("n"), F.sum("queued_ms").alias("queued_ms"), F.max("queued_ms").alias("most_queued_ms"))
    return out.where(F.col("queued_ms") >= least_queued_ms)


def pruning_report(ops: DataFrame) -> DataFrame:
    return ops.select("query_id", "partitions_scanned", "partitions_total", ratio_pct(F.col("partitions_scanned"), F.col("partitions_total")).alias("scanned_pct"))


def join_multiplier_report(ops: DataFrame, stats: str = "stats") -> DataFrame:
    """output_rows / input_rows of each join in a JSON column of statistics."""
    v = F.try_parse_json(stats)
    rows_in, rows_out = (F.try_variant_get(v, f"$.{n}", "bigint") for n in ("input_rows", "output_rows"))
    return ops.select("query_id", rows_in.alias("input_rows"), rows_out.alias("output_rows"), F.round(rows_out.cast("double") / F.nullif(rows_in.cast("double"), F.lit(0.0)), 2).alias("multiplier"))


def cost_rollup(usage: DataFrame, least_pct: float) -> DataFrame:
    """Cost per day and pool, and the pools' shares above a bound."""
    pools = usage.groupBy("warehouse").agg(F.sum("credits").alias("credits"))
    total = pools.agg(F.sum("credits").alias("_t"))
    return pools.crossJoin(total).select("warehouse", "credits", ratio_pct(F.col("credits"), F.col("_t")).alias("share_pct")).where(F.col("share_pct") > least_pct)


def storage_rollup(metrics: DataFrame, pool: str, active: str, history: str, n: int) -> DataFrame:
    """Active and historic bytes of each pool and their ratio in percent, of the n largest."""
    sums = metrics.groupBy(pool).agg(F.sum(active).alias("active"), F.sum(history).alias("history"))
    return sums.withColumn("history_pct", ratio_pct(F.col("history"), F.col("active"))).orderBy(F.desc(F.col("active") + F.col("history")), pool).limit(n)


def run_overlap_report(runs: DataFrame, interval_s: int) -> DataFrame:
    """Runs that took over 80 % of the interval between runs."""
    took = F.timestamp_diff("SECOND", F.col("started"), F.col("ended"))
    return runs.select("run_id", took.alias("took_s"), F.when(took > interval_s, "OVERLAPS").when(took > 0.8 * interval_s, "NEAR").otherwise("FINE").alias("status")).where("status <> 'FINE'")


def latency_report(rows: DataFrame, started: str, ended: str) -> DataFrame:
    ms = F.timestamp_diff("MILLISECOND", F.col(started), F.col(ended))
    return rows.select("*", (ms / 1000).cast("decimal(10,2)").alias("latency_sec"))


def diagnose(hist: DataFrame) -> DataFrame:
    """One class per run: queued, then spilling, then pruning, else fine."""
    pct = F.col("partitions_scanned") * 100.0 / F.nullif(F.col("partitions_total"), F.lit(0))
    kind = F.when(F.col("queued_ms") > 500, "QUEUED").when(F.col("spill_remote") > 0, "REMOTE_SPILL").when(F.col("spill_local") > 0, "LOCAL_SPILL").when(pct > 80, "POOR_PRUNING").otherwise("FINE")
    return hist.select("query_id", kind.alias("diagnosis"))


def task_graph_run_order(edges: DataFrame, most_levels: int = 1000) -> DataFrame:
    """task, level: longest path from a root; tasks of a level can run together. edges: task, after (null for a root)."""
    levels = edges.select("task").distinct().withColumn("level", F.lit(0))
    needs = edges.where("after IS NOT NULL").select("task", "after")
    before = -1
    for _ in range(most_levels):
        above = needs.join(levels.withColumnRenamed("task", "after"), "after").groupBy("task").agg((F.max("level") + 1).alias("up"))
        levels = levels.join(above, "task", "left").select("task", F.coalesce("up", "level").alias("level"))
        levels = stage_result(levels, "levels")  # a round for each level of the graph; the plan starts anew
        now = levels.agg(F.sum("level")).first()[0]
        if now == before:
            return levels
        before = now
    raise ValueError("the graph has a cycle")


def object_touches(history: DataFrame, objects: str, n: int) -> DataFrame:
    """Last n touches of objects: one row per object of each access."""
    return history.select("query_id", "user_id", "ts", F.explode(objects).alias("object_name")).orderBy(F.desc("ts"), "query_id", "object_name").limit(n)


def operator_breakdown(ops: DataFrame, stats: str = "stats") -> DataFrame:
    """Shares of the time of each operator, from a JSON column: overall, processing, io."""
    v = F.try_parse_json(stats)
    return ops.select("query_id", "operator", *(F.round(F.try_variant_get(v, f"$.{n}", "double") * 100, 2).alias(f"{n}_pct") for n in ("overall", "processing", "io")))
