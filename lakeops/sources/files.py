"""Loading files: formats, positional and by-name binding, error policies, load ledger, unloading."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.operators.aggregates import running_sum
from lakeops.operators.stage import drop_folder, shared_folder, stage_result
from lakeops.sources.commits import Commits


@dataclass(frozen=True)
class FileFormat:
    """A named way to read text files. null_if: texts that mean null."""

    kind: str = "csv"
    delimiter: str = ","
    header: bool = True
    quote: str = '"'
    null_if: tuple[str, ...] = ()
    empty_as_null: bool = True
    trim: bool = False
    column_count: bool = False
    options: Mapping[str, str] = field(default_factory=dict)

    def to_spark(self) -> dict[str, str]:
        base = {"sep": self.delimiter, "header": str(self.header).lower(), "quote": self.quote, "ignoreLeadingWhiteSpace": str(self.trim).lower(), "ignoreTrailingWhiteSpace": str(self.trim).lower()}
        return (base if self.kind == "csv" else {}) | dict(self.options)


def read_files(spark: SparkSession, path: str, fmt: FileFormat, schema: T.StructType | str | None = None) -> DataFrame:
    """Reads with a format; tokens of null_if become null in text columns. With column_count, a line with more or fewer columns than the schema fails the read."""
    reader = spark.read.format(fmt.kind).options(**fmt.to_spark())
    if fmt.column_count and schema:
        kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        marked = reader.option("columnNameOfCorruptRecord", "_line").option("mode", "PERMISSIVE").schema(T.StructType([*kinds.fields, T.StructField("_line", T.StringType())])).load(path)
        wrong = F.raise_error(F.concat(F.lit("wrong number of columns: "), F.col("_line")))
        df = marked.where(F.when(F.col("_line").isNotNull(), wrong.cast("boolean")).otherwise(F.lit(True))).drop("_line")
    else:
        df = (reader.schema(schema) if schema else reader).load(path)
    tokens = [*fmt.null_if, *([""] if fmt.empty_as_null else [])]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(F.col(c).isin(tokens), None).otherwise(F.col(c)) for c in texts}) if tokens and texts else df


def load_positional(df: DataFrame, exprs: Sequence[str], target: T.StructType) -> DataFrame:
    """Columns of a headerless file, as $1, $2 and so on, in expressions; cast to the target, null where a value doesn't fit."""
    import re

    def bound(e: str) -> str:
        return re.sub(r"\$(\d+)", lambda m: f"`{df.columns[int(m[1]) - 1]}`", e)

    return df.select(*(F.expr(bound(e)).try_cast(f.dataType).alias(f.name) for e, f in zip(exprs, target, strict=True)))


def load_by_name(df: DataFrame, target: T.StructType, case_sensitive: bool = False) -> DataFrame:
    """Binds columns by name; missing ones are null and further ones ignored."""
    have = {c if case_sensitive else c.lower(): c for c in df.columns}
    find = lambda n: have.get(n if case_sensitive else n.lower())
    return df.select(*((F.col(f"`{find(f.name)}`") if find(f.name) else F.lit(None)).cast(f.dataType).alias(f.name) for f in target))


def append_evolving(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Appends; columns that one side hasn't got are null. The base's order, then new columns."""
    return base.unionByName(incoming, allowMissingColumns=True)


def hot_cold_union(hot: DataFrame, cold: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """Rows from the cutoff on of one side and older ones of the other."""
    cut = F.lit(cutoff).cast("timestamp")
    return hot.where(F.col(ts) >= cut).unionByName(cold.where(F.col(ts) < cut))


def checked(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Adds `_errors`: for each column whose text doesn't fit its type, the column and the text."""
    bad = lambda c, t: F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("raw_value")))
    return df.withColumn("_errors", F.filter(F.array(*(bad(c, t) for c, t in schema.items())), lambda e: e.isNotNull()))


def on_error(df: DataFrame, schema: Mapping[str, str], policy: str, file: str = "_file") -> DataFrame:
    """Typed rows under an error policy: CONTINUE drops bad rows; SKIP_FILE drops files with any, SKIP_FILE_n those with n or more, SKIP_FILE_n% those with more than n percent; ABORT fails."""
    rows = checked(df, schema)
    bad = F.size("_errors") > 0
    typed = lambda d: d.where(~bad).drop("_errors").select(*(F.col(c).try_cast(schema[c]).alias(c) if c in schema else F.col(c) for c in df.columns))
    if policy == "CONTINUE":
        return typed(rows)
    if policy == "ABORT":
        if not rows.where(bad).isEmpty():
            raise ValueError("a value doesn't fit its column; nothing was loaded")
        return typed(rows)
    limit = policy.removeprefix("SKIP_FILE").removeprefix("_")
    counts = rows.groupBy(file).agg(F.count_if(bad).alias("_bad"), F.count("*").alias("_n"))
    if limit.endswith("%"):
        skip = F.col("_bad") * 100.0 / F.col("_n") > float(limit[:-1])
    else:
        skip = F.col("_bad") >= int(limit or 1)
    return typed(rows.join(counts.where(skip), file, "left_anti"))


def validate_load(df: DataFrame, schema: Mapping[str, str], file: str = "_file", row: str = "_row") -> DataFrame:
    """file, row, column and text of every value that wouldn't load; nothing is written."""
    return checked(df, schema).select(file, row, F.explode("_errors").alias("e")).select(file, row, "e.*")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def select_files(files: DataFrame, names: Sequence[str] | None = None, pattern: str | None = None, size_limit: int | None = None, name: str = "path", size: str = "length") -> DataFrame:
    """An explicit list (1000 at most), a pattern, and a limit of bytes after which no further file is taken; the first always is."""
    if names is not None:
        if len(names) > 1000:
            raise ValueError("at most 1000 files can be named")
        files = files.where(F.col(name).isin(list(names)))
    if pattern:
        files = files.where(F.col(name).rlike(pattern))
    if size_limit is not None:
        before = F.col(f"sum_{size}") - F.col(size)
        files = running_sum(files, [F.col(name)], [size]).where((before == 0) | (before < size_limit)).drop(f"sum_{size}")
    return files


LEDGER = "file string, tag string, loaded_at timestamp, status string, row_count long, error_count long, load long, part long"


def unloaded(files: DataFrame, ledger: DataFrame, at: str, force: bool = False, load_uncertain: bool = False, days: int = 64) -> DataFrame:
    """Files (file, tag, modified) to load. A ledger entry holds for some days; a file older than that without an entry is uncertain."""
    if force:
        return files
    now = F.lit(at).cast("timestamp")
    kept = ledger.where((F.col("loaded_at") >= F.timestamp_add("DAY", F.lit(-days), now)) & (F.col("status") != "LOAD_FAILED"))
    fresh = files.join(kept, ["file", "tag"], "left_anti")
    return fresh if load_uncertain else fresh.where(F.col("modified") >= F.timestamp_add("DAY", F.lit(-days), now))


def copy_history(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count("*").alias("n_files"), F.sum("row_count").alias("row_count"), F.sum("error_count").alias("error_count"))


def copy_into(spark: SparkSession, path: str, fmt: FileFormat, schema: Mapping[str, str], target: str, ledger: str, at: str, policy: str = "CONTINUE", force: bool = False, tries: int = 5) -> DataFrame:
    """Loads files that the ledger hasn't got, into a folder of its own (load=<part>) below a Parquet folder, writes the ledger's rows beside those of other loads, and commits both by taking the next load number. Gives these rows.

    Of loaders at once one takes a number; the others find it taken, drop what they have written, and begin again with
    the ledger as it is then, so each file is loaded once and no load is lost. A load that broke off before its commit
    is never seen: committed() gives the rows of committed loads only. Files from which the policy kept nothing, though
    they have rows, are LOAD_FAILED and tried again.
    """
    commits = Commits(spark, f"{ledger}/commits")
    files = stage_result(listing(spark, path).select(F.col("path").alias("file"), F.concat_ws("-", "length", "modificationTime").alias("tag"), F.col("modificationTime").alias("modified")), "listing")
    for _ in range(tries):
        load, part = commits.latest() + 1, uuid.uuid4().int >> 66  # a long that no other load has
        entries = _loaded(spark, files, fmt, schema, f"{target}/load={part}", _ledger(spark, ledger), at, policy, force)
        if entries is None:
            return spark.createDataFrame([], LEDGER)
        entries = entries.withColumns({"load": F.lit(load).cast("long"), "part": F.lit(part).cast("long")}).select(*T._parse_datatype_string(LEDGER).names)
        entries.write.parquet(f"{ledger}/entries/of={part}")
        if commits.put(load, str(part)):
            return spark.read.schema(LEDGER).parquet(f"{ledger}/entries/of={part}")
        for folder in (f"{target}/load={part}", f"{ledger}/entries/of={part}"):
            drop_folder(spark, folder)
    raise RuntimeError(f"{tries} other loads came first")


def _loaded(spark: SparkSession, files: DataFrame, fmt: FileFormat, schema: Mapping[str, str], target: str, known: DataFrame, at: str, policy: str, force: bool) -> DataFrame | None:
    """Writes what the policy keeps of the files that are to be loaded; their entries, or None where there are none."""
    todo = stage_result(unloaded(files, known, at, force, load_uncertain=True), "todo")
    paths = [r["file"] for r in todo.select("file").collect()]  # Spark's reader takes a list of files from the driver, as it does that of a folder
    if not paths:
        return None
    text = T.StructType([T.StructField(c, T.StringType()) for c in schema])
    rows = spark.read.format(fmt.kind).options(**fmt.to_spark()).schema(text).load(paths).withColumn("_file", F.input_file_name())
    kept = stage_result(on_error(rows, schema, policy), "kept")
    kept.drop("_file").write.parquet(target)
    counts = checked(rows, schema).groupBy("_file").agg(F.count("*").alias("n"), F.count_if(F.size("_errors") > 0).alias("bad"))
    counts = counts.join(kept.groupBy("_file").agg(F.count("*").alias("kept")), "_file", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    status = F.when(F.col("bad") == 0, "LOADED").when(F.col("kept") > 0, "PARTIALLY_LOADED").otherwise("LOAD_FAILED")
    local = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return todo.join(counts, local("file") == local("_file"), "left").select(
        "file", "tag", F.lit(at).cast("timestamp").alias("loaded_at"), F.coalesce(F.when(F.col("n").isNotNull(), status), F.lit("LOADED")).alias("status"),
        F.coalesce("kept", F.lit(0)).cast("long").alias("row_count"), F.coalesce("bad", F.lit(0)).cast("long").alias("error_count"),
    )


def _ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """Entries of committed loads."""
    commits = Commits(spark, f"{ledger}/commits")
    if not commits.latest():
        return spark.createDataFrame([], LEDGER)
    of = commits.table().select(F.col("text").cast("long").alias("part"))
    return spark.read.schema(LEDGER).parquet(f"{ledger}/entries").join(of, "part", "left_semi").select(*T._parse_datatype_string(LEDGER).names)


def committed(spark: SparkSession, target: str, ledger: str) -> DataFrame:
    """Rows of the loads that the ledger has."""
    return spark.read.parquet(target).join(_ledger(spark, ledger).select(F.col("part").alias("load")).distinct(), "load", "left_semi").drop("load")


def unload(df: DataFrame, path: str, fmt: str = "parquet", max_file_bytes: int | None = None, single: bool = False, overwrite: bool = False, **options: str) -> None:
    """Writes files of at most max_file_bytes each (or of one row). Rows per file follow from the bytes a row took in a first writing, and are halved until all files fit."""
    spark, mode = df.sparkSession, "overwrite" if overwrite else "errorifexists"
    if max_file_bytes is None:
        (df.coalesce(1) if single else df).write.format(fmt).options(**options).mode(mode).save(path)
        return
    staged = stage_result(df, "unload")
    rows = staged.count()
    per_file = max(1, rows)
    first = True
    while True:
        at = path if first else shared_folder(spark, "unload")
        (staged.coalesce(1) if single else staged).write.format(fmt).options(**options).option("maxRecordsPerFile", per_file).mode(mode if first else "overwrite").save(at)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(at).agg(F.max("length"), F.sum("length")).first()
        if not rows or (files[0] or 0) <= max_file_bytes or per_file == 1:
            break
        per_file = max(1, min(per_file // 2, int(0.8 * max_file_bytes * rows / files[1])))
        first = False
    if at != path:  # the last writing fits: its settings are used for the folder itself
        (staged.coalesce(1) if single else staged).write.format(fmt).options(**options).option("maxRecordsPerFile", per_file).mode("overwrite").save(path)


#: Types that a text column may be, the first that fits all its values.
TEXT_TYPES = ("bigint", "double", "date", "timestamp", "boolean")


#: What all values of a type look like, before they are cast: a cast of a text that is no number or boolean costs an exception. A date has no time of day.
_LOOKS = {
    "bigint": r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*$",
    "boolean": r"(?i)^[\x00-\x20\x7f]*(?:t|true|y|yes|1|f|false|n|no|0)[\x00-\x20\x7f]*$",
    "date": r"^\s*[0-9-]+\s*$",
    "double": r"(?i)^[\x00-\x20]*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?[fd]?|0x[0-9a-f.]+p[+-]?[0-9]+[fd]?|inf|infinity|nan)[\x00-\x20]*$",
}


def infer_schema(texts: DataFrame) -> DataFrame:
    """ordinal, column_name, type, nullable of text columns: the first of TEXT_TYPES that all values of a column fit, else string; one aggregation over all rows. A column without values is a string."""
    columns = texts.columns

    def as_type(c: str, t: str) -> Column:
        value = F.col(f"`{c}`")
        return F.when(value.rlike(_LOOKS[t]), value.try_cast(t)) if t in _LOOKS else value.try_cast(t)

    fits = [F.count(as_type(c, t)).alias(f"n{k}_{t}") for k, c in enumerate(columns) for t in TEXT_TYPES]
    counts = texts.agg(F.count("*").alias("rows"), *(F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(columns)), *fits)

    def kind(k: int) -> Column:
        out = F.lit("string")
        for t in reversed(TEXT_TYPES):
            out = F.when((F.col(f"n{k}") > 0) & (F.col(f"n{k}_{t}") == F.col(f"n{k}")), t).otherwise(out)
        return out

    found = [F.struct(F.lit(k).alias("ordinal"), F.lit(c).alias("column_name"), kind(k).alias("type"), (F.col(f"n{k}") < F.col("rows")).alias("nullable")) for k, c in enumerate(columns)]
    return counts.select(F.explode(F.array(*found)).alias("c")).select("c.*")


def right_size(spark: SparkSession, path: str, out: str, target_bytes: int = 160 << 20) -> int:
    """Rewrites a Parquet folder in files of about the wanted size; gives their number."""
    total = listing(spark, path).agg(F.sum("length")).first()[0] or 0
    n = max(1, -(-total // target_bytes))
    spark.read.parquet(path).repartition(n).write.parquet(out)
    return n


def external_table(spark: SparkSession, path: str, columns: Mapping[str, tuple[str, str]], partitions: Sequence[str] = ()) -> DataFrame:
    """JSON lines read as one VARIANT per row; columns: name -> (path, type)."""
    rows = spark.read.text(path).withColumn("_value", F.try_parse_json("value"))
    return rows.select(*(F.try_variant_get("_value", p, t).alias(n) for n, (p, t) in columns.items()), *partitions)


def json_rows(texts: DataFrame, column: str, paths: Mapping[str, tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    v = F.try_parse_json(column)
    return texts.select(*keep, *(F.try_variant_get(v, p, t).alias(n) for n, (p, t) in paths.items()))


def jdbc_partitioned_extract(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, chunks: int, **options: str) -> DataFrame:
    """Parallel extract by ranges of a numeric key, never by OFFSET."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=chunks, **options).load()


#: Source types and what they become.
SOURCE_TYPES = {
    "smallint": "int", "integer": "int", "int": "int", "serial": "int", "bigint": "bigint", "bigserial": "bigint",
    "real": "double", "double precision": "double", "float": "double", "money": "decimal(38,6)", "numeric": "decimal(38,6)", "decimal": "decimal(38,6)",
    "text": "string", "varchar": "string", "char": "string", "interval": "string", "time": "string", "uuid": "string",
    "bytea": "binary", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamptz": "timestamp", "json": "variant", "jsonb": "variant",
}


def map_source_types(columns: Sequence[tuple[str, str]]) -> T.StructType:
    """Spark's schema of a source table's columns; numeric keeps its precision, an unknown type is text."""
    import re

    def kind(source: str) -> str:
        base, _, size = source.lower().partition("(")
        numbers = re.findall(r"\d+", size)
        if base.strip() in ("numeric", "decimal") and numbers:
            return f"decimal({numbers[0]},{numbers[1] if len(numbers) > 1 else 0})"
        return SOURCE_TYPES.get(base.strip(), "string")

    return T._parse_datatype_string(", ".join(f"`{n}` {kind(t)}" for n, t in columns))


def generate_rows(spark: SparkSession, n: int, columns: Mapping[str, Column]) -> DataFrame:
    return spark.range(n).select("id", *(c.alias(name) for name, c in columns.items()))
