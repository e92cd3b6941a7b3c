"""Continuous forms: file ingest, row ingest with offset tokens, change merges, layered streams. Sinks are idempotent per batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeops.operators.aggregates import latest_per_key
from lakeops.operators.maintain import maintain_aggregate
from lakeops.operators.merge import apply_changes
from lakeops.operators.stage import drop_folder
from lakeops.sources.files import on_error


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder, or no rows where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def drained(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Everything that is there now, in micro-batches; the checkpoint is the consumer's offset and moves after a batch is written."""
    query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def file_ingest_stream(spark: SparkSession, path: str, schema: Mapping[str, str], target: str, checkpoint: str, policy: str = "CONTINUE", files_per_batch: int = 100) -> StreamingQuery:
    """Loads files that come to a folder, each once. A batch is written to a folder of its own number, so a repeated batch replaces itself."""
    text = ", ".join(f"`{c}` string" for c in schema)
    rows = spark.readStream.schema(text).option("header", "true").option("maxFilesPerTrigger", files_per_batch).csv(path).withColumn("_file", F.input_file_name())

    def write(batch: DataFrame, number: int) -> None:
        on_error(batch, schema, policy).drop("_file").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return drained(rows, checkpoint, write)


def ingest_rows(batch: DataFrame, offsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to write, new offsets): of each channel the rows after its committed offset token, each token once."""
    known = offsets.groupBy("channel").agg(F.max("offset").alias("_committed"))
    fresh = batch.join(known, "channel", "left").where(F.col("_committed").isNull() | (F.col("offset") > F.col("_committed"))).drop("_committed").dropDuplicates(["channel", "offset"])
    return fresh, fresh.groupBy("channel").agg(F.max("offset").alias("offset"))


def row_ingest_stream(rows: DataFrame, target: str, offsets: str, checkpoint: str) -> StreamingQuery:
    """Rows of channels with offset tokens, exactly once: a batch's rows are written under its number, and with them the last offset of every channel, a row each; a repeated batch starts from the offsets of the one before."""

    def write(batch: DataFrame, number: int) -> None:
        before = latest_state(batch.sparkSession, offsets, "channel string, offset long", number - 1)
        fresh, now = ingest_rows(batch, before)
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")
        _next_state(before.unionByName(now).groupBy("channel").agg(F.max("offset").alias("offset")), offsets, number)

    return drained(rows, checkpoint, write)


def netted(batch: DataFrame, keys: Sequence[str], order: str | None) -> DataFrame:
    """Of each key's changes in a batch the last by order, a new row after the old one of the same change; rows with an update's old values are left out. Without an order a key may change once in a batch."""
    feed = batch.where(~((F.col("_action") == "DELETE") & F.col("_is_update")))
    return latest_per_key(feed, keys, [F.desc(order), F.desc(F.col("_action") == "INSERT")]).drop(order) if order else feed


def latest_state(spark: SparkSession, target: str, schema: str, number: int | None = None) -> DataFrame:
    """The last state below a folder, or that of a batch; no rows where there is none."""
    found = read_table(spark, target, f"{schema}, state int")
    if number is None:
        number = found.agg(F.max("state")).first()[0]
    return found.where(F.col("state") == F.lit(number).cast("int")).drop("state")


def _next_state(state: DataFrame, target: str, number: int) -> None:
    """Writes the state of a batch; the one before it stays for a repeated batch, older ones go."""
    state.write.mode("overwrite").parquet(f"{target}/state={number}")
    drop_folder(state.sparkSession, f"{target}/state={number - 2}")


def cdc_stream_merge(changes: DataFrame, target: str, schema: str, keys: Sequence[str], checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Merges each batch of a change feed, netted per key, into a table. States are kept by batch number: a repeated batch starts from the state before it. A batch without rows writes nothing new but its number.

    A state is written whole, as a merge into plain files does; batches should be large next to the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        before = latest_state(batch.sparkSession, target, schema, number - 1)
        _next_state(apply_changes(before, netted(batch, keys, order), keys), target, number)

    return drained(changes, checkpoint, write)


def event_log_append(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the inserts of a streamed log; updates and deletes are passed over. A repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where("op = 'I'").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return drained(log, checkpoint, write)


def insert_only_changes(spark: SparkSession, path: str, schema: str, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Rows of files that are new to a consumer; a file written anew under another name counts as new rows, a removed one changes nothing."""
    return drained(spark.readStream.schema(schema).parquet(path), checkpoint, write)


def advance_without_processing(changes: DataFrame, checkpoint: str) -> StreamingQuery:
    """Moves a consumer's offset past all that is there, without a look at it."""
    return drained(changes, checkpoint, lambda batch, number: None)


def keyed_rollup(rows: DataFrame, target: str, keys: Sequence[str], measures: Sequence[str], schema: str, checkpoint: str) -> StreamingQuery:
    """Sums and counts per key, kept up to date by each consumed batch; schema: of the rollup (keys, n, sum_x, cnt_x)."""

    def write(batch: DataFrame, number: int) -> None:
        before = latest_state(batch.sparkSession, target, schema, number - 1)
        _next_state(maintain_aggregate(before, batch.withColumn("_action", F.lit("INSERT")), keys, measures), target, number)

    return drained(rows, checkpoint, write)


def dead_letter_route(batch: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows carry the names of the rules that they break; a rule that gives null is broken."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    marked = batch.withColumn("broken_rules", broken)
    return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(F.size("broken_rules") > 0)


def gates(inputs: Sequence[DataFrame]) -> DataFrame:
    """any_open, all_open: whether any input, or every one, has rows; a probe of one row of each."""
    probes = reduce(DataFrame.unionByName, (df.limit(1).agg((F.count("*") > 0).alias("found")) for df in inputs))
    return probes.agg(F.max("found").alias("any_open"), F.min("found").alias("all_open"))


def gate(inputs: Sequence[DataFrame], need_all: bool) -> bool:
    """Whether any input, or every one, has rows."""
    return gates(inputs).first()["all_open" if need_all else "any_open"]


def medallion_stream(spark: SparkSession, bronze: str, schema: str, silver: str, gold: str, checkpoints: str, clean: Callable[[DataFrame], DataFrame], keys: Sequence[str], measures: Sequence[str], gold_schema: str) -> None:
    """Bronze to silver to gold; each hop has its own checkpoint and reads what the one before has written. Gold is one rollup over all batches."""

    def to_silver(batch: DataFrame, number: int) -> None:
        clean(batch).write.mode("overwrite").parquet(f"{silver}/batch={number}")

    drained(spark.readStream.schema(schema).parquet(bronze), f"{checkpoints}/silver", to_silver)
    shape = spark.read.parquet(silver).drop("batch").schema
    keyed_rollup(spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(silver), gold, keys, measures, gold_schema, f"{checkpoints}/gold")


def invoices(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Validated orders with their customer, totalled per customer."""
    good, _ = dead_letter_route(orders, {"quantity": F.col("quantity") > 0, "price": F.col("price") >= 0})
    return good.join(customers, "customer_id").groupBy("customer_id", "customer_name").agg(F.count("*").alias("n_orders"), F.sum(F.col("quantity") * F.col("price")).alias("total"))
