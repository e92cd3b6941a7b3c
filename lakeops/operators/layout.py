"""Measuring how files are laid out, and access paths to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeops.operators.aggregates import running_sum
from lakeops.operators.stage import shared_folder, stage_result


def zone_map(df: DataFrame, columns: Sequence[str], file: str | Column = "_metadata.file_path") -> DataFrame:
    """Per file and column: rows, nulls, smallest, largest, distinct."""
    path = F.col(file) if isinstance(file, str) else file
    stats = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"s{n}").alias("s")) for n, c in enumerate(columns))))
    made = df.groupBy(path.alias("file")).agg(F.count("*").alias("n_rows"), *(F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.count_if(F.col(c).isNull()).alias("n_nulls"), F.count_distinct(c).alias("n_distinct")).alias(f"s{n}") for n, c in enumerate(columns)))
    return made.select("file", "n_rows", stats.alias("x")).select("file", "n_rows", "x.column_name", "x.s.*")


def overlaps(zones: DataFrame) -> DataFrame:
    """file, overlaps, depth of each file's range among the others of its column, by counting range ends: a range meets those that begin by its end, less those that end before its begin. depth: ranges over the begin of it.

    The ends are swept in order over range partitions with prefix sums; no task sees all files.
    """
    ranges = zones.where(F.col("low").isNotNull()).select("column_name", "file", "low", "high")
    end = lambda at, kind: ranges.select("column_name", F.col(at).alias("at"), F.lit(kind).alias("kind"), "file", F.lit(1 - kind).alias("begins"), F.lit(kind).alias("ends"))
    swept = stage_result(running_sum(end("low", 0).unionByName(end("high", 1)), [F.col(c) for c in ("column_name", "at", "kind", "file")], ["begins", "ends"]), "sweep")
    last = swept.where("kind = 1").select("column_name", "file", F.col("sum_begins").alias("begun_by_end"))
    first = swept.where("kind = 0").select("column_name", "file", "at", F.col("sum_ends").alias("ended_before"))
    tied = swept.where("kind = 0").groupBy("column_name", "at").agg(F.max("sum_begins").alias("begun"))
    found = first.join(tied, ["column_name", "at"]).join(last, ["column_name", "file"])
    return found.select("column_name", "file", (F.col("begun_by_end") - F.col("ended_before") - 1).alias("overlaps"), (F.col("begun") - F.col("ended_before")).alias("depth"))


def cluster_write(df: DataFrame, path: str, keys: Sequence[Column], target_bytes: int = 160 << 20, bytes_per_row: int | None = None) -> int:
    """Writes df as Parquet in order of the keys, those of few values first, in files of about target_bytes whose key ranges hardly overlap; gives the number of ranges.

    bytes_per_row: of a written row, measured on a part of the rows where it isn't given; the part only sets file sizes.
    """
    rows = df.count()
    if bytes_per_row is None and rows:
        part = shared_folder(df.sparkSession, "sizing")
        df.limit(100_000).write.parquet(part)
        written = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(part).agg(F.sum("length")).first()[0]
        bytes_per_row = max(1, written // min(rows, 100_000))
    files = max(1, -(-rows * (bytes_per_row or 1) // target_bytes))
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.parquet(path)
    return files


def interleaved(df: DataFrame, columns: Sequence[str], bits: int = 8) -> Column:
    """A number that orders rows by all columns at once: the columns' ranks, their bits in turn. A rank is how many of 2^bits - 1 quantiles of the column a value reaches, so skewed columns count as much as even ones; nulls come first.

    The quantiles are one aggregate over all rows. Numbers, dates and times can be ranked.
    """
    numbers = {c: F.col(c).cast("timestamp").cast("double") if df.schema[c].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col(c).cast("double") for c in columns}
    share = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = df.agg(*(F.percentile_approx(x, share, 20_000).alias(c) for c, x in numbers.items())).first()
    key = F.lit(0).cast("long")
    for n, c in enumerate(columns):
        bounds = sorted(set(cuts[c] or []))
        x = numbers[c]
        reached = F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= x)  # noqa: B023  used at once
        rank = F.when(x.isNotNull(), F.size(reached) + 1).otherwise(0) if bounds else F.lit(0)
        for bit in range(bits + 1):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(columns) + len(columns) - 1 - n))
    return key


def cluster_write_interleaved(df: DataFrame, path: str, columns: Sequence[str], files: int, bits: int = 8) -> None:
    """Writes df as Parquet in so many files whose ranges are narrow in every one of the columns, where an order by them one after the other is narrow in the first alone."""
    marked = df.withColumn("_z", interleaved(df, columns, bits))
    marked.repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z").write.parquet(path)


def clustering_information(zones: DataFrame) -> DataFrame:
    """Per column: files, files of one value, average overlaps, average depth."""
    found = overlaps(zones).join(zones, ["column_name", "file"])
    return found.groupBy("column_name").agg(
        F.count("*").alias("total_files"), F.count_if((F.col("low") == F.col("high")) & (F.col("n_nulls") == 0)).alias("constant_files"),
        F.round(F.avg("overlaps"), 4).alias("average_overlaps"), F.round(F.avg("depth"), 4).alias("average_depth"),
    )


def prune_estimate(zones: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Files that a range predicate must read, of all, with a class."""
    hit = (F.col("low") <= high) & (F.col("high") >= low)
    out = zones.where(F.col("column_name") == column).agg(F.count_if(hit).alias("kept_files"), F.count("*").alias("total_files"))
    pct = F.round(F.col("kept_files") * 100.0 / F.nullif(F.col("total_files"), F.lit(0)), 2)
    return out.withColumn("scanned_pct", pct).withColumn("class", F.when(pct < 20, "GOOD").when(pct < 50, "OK").otherwise("BAD"))


def clustering_key_advisor(df: DataFrame, columns: Sequence[str], most: int = 4) -> DataFrame:
    """Columns from few to many distinct values, numbered; exact counts in one aggregation per column set."""
    counts = df.agg(*(F.count_distinct(c).alias(c) for c in columns)).select(F.explode(F.array(*(F.struct(F.col(c).alias("n_distinct"), F.lit(c).alias("column_name")) for c in columns))).alias("s")).select("s.*")
    w = Window.orderBy("n_distinct", "column_name")  # one row per column
    return counts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


def search_index(df: DataFrame, value: Column, file: Column) -> DataFrame:
    """Access path for = and IN: which files hold a value."""
    return df.select(value.alias("value"), file.alias("file")).where("value IS NOT NULL").distinct()


def write_search_index(index: DataFrame, path: str) -> None:
    """Stores an access path in order of its values, so that a lookup reads the row groups that may hold them."""
    index.repartitionByRange("value").sortWithinPartitions("value").write.parquet(path)


def lookup(spark: SparkSession, path: str, values: Sequence[str]) -> DataFrame:
    """value, file of the wanted values; the filter reaches the scan of the stored access path."""
    return spark.read.parquet(path).where(F.col("value").isin(list(values)))


#: Bits of a bitmap of Spark's bitmap functions.
_BITS = 32_768


def _bloom_places(value: Column, buckets: int, hashes: int) -> tuple[Column, Column]:
    """The bitmap of a value, and its bits there."""
    text = value.cast("string")
    bits = F.array(*(F.pmod(F.xxhash64(F.lit(k), text), F.lit(_BITS)) for k in range(hashes)))
    return F.pmod(F.xxhash64(F.lit(-1), text), F.lit(buckets)).cast("int"), bits


def bloom_index(df: DataFrame, value: Column, file: Column, buckets: int, hashes: int = 5) -> DataFrame:
    """file, bucket, bits: a Bloom filter of each file's values, as many bitmaps as there are buckets. About 6,000 distinct values a bitmap give one false file in a hundred.

    A filter is an aggregate of bits, so it is made where the rows are, and filters of parts of a file are merged with
    bitmap_or_agg. Bits are gathered in words of 64 by a hash aggregate, of 512 words a bitmap at most whatever the rows,
    where bitmap_construct_agg sorts all rows; the words are then put together in the order of its octets.
    """
    bucket, bits = _bloom_places(value, buckets, hashes)
    rows = df.where(value.isNotNull()).select(file.alias("file"), bucket.alias("bucket"), F.explode(bits).alias("bit"))
    at = F.expr("shiftleft(1L, int(8 * (7 - pmod(bit div 8, 8)) + pmod(bit, 8)))")
    words = rows.groupBy("file", "bucket", F.expr("int(bit div 64)").alias("word")).agg(F.bit_or(at).alias("bits"))
    each = words.groupBy("file", "bucket").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    digits = "transform(words, (x, i) -> concat(repeat('0', 16 * (x.word - if(i = 0, 0, words[i - 1].word + 1))), lpad(hex(x.bits), 16, '0')))"
    return each.select("file", "bucket", F.expr(f"unhex(rpad(array_join({digits}, ''), {_BITS // 4}, '0'))").alias("bits"))


def bloom_files(index: DataFrame, values: Sequence[object], buckets: int, hashes: int = 5) -> DataFrame:
    """value, file: the files that may hold each of some values; none that holds it is missing. Only their bitmaps are read."""
    bucket, bits = _bloom_places(F.col("value"), buckets, hashes)
    wanted = index.sparkSession.createDataFrame([(str(v),) for v in dict.fromkeys(values)], "value string").select("value", bucket.alias("bucket"), bits.alias("wanted"))
    near = index.where(F.col("bucket").isin([r.bucket for r in wanted.select("bucket").distinct().collect()]))  # of the values asked for
    octet = lambda at: F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = near.join(F.broadcast(wanted), "bucket").where(F.forall("wanted", lambda at: F.getbit(octet(at), (at % 8).cast("int")) == 1))
    return held.select("value", "file")


def extend_bloom(spark: SparkSession, path: str, index_path: str, column: str, buckets: int, hashes: int = 5) -> int:
    """Adds the files of a Parquet folder that the stored index hasn't got; how many. Files that it has aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("file"))
    local = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    try:
        files = files.join(spark.read.parquet(index_path).select(local("file").alias("_file")).distinct(), local("file") == F.col("_file"), "left_anti")
    except Exception as e:  # no index yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    names = [r.file for r in files.collect()]  # Spark's reader takes the names from the driver
    if names:
        bloom_index(spark.read.parquet(*names), F.col(column), F.col("_metadata.file_path"), buckets, hashes).sortWithinPartitions("bucket").write.mode("append").parquet(index_path)
    return len(names)


def rows_by_bloom(spark: SparkSession, index_path: str, column: str, values: Sequence[object], buckets: int, hashes: int = 5) -> DataFrame:
    """The rows that have one of the values, read from the files that may hold it; files that don't give no row."""
    names = [r.file for r in bloom_files(spark.read.parquet(index_path), values, buckets, hashes).select("file").distinct().collect()]
    if not names:
        raise LookupError("no file may hold these values")
    return spark.read.parquet(*names).where(F.col(column).isin(list(values)))


def trigram_index(df: DataFrame, column: str, key: str) -> DataFrame:
    """Access path for LIKE '%x%': which rows hold a run of three characters."""
    text = F.lower(column)
    runs = F.when(F.length(text) >= 3, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return df.select(F.col(key).alias("row_key"), F.explode(F.array_distinct(runs)).alias("run"))


def trigram_lookup(df: DataFrame, index: DataFrame, column: str, key: str, wanted: str) -> DataFrame:
    """Rows that hold the wanted text (three characters at least), found by the index and verified."""
    runs = sorted({wanted.lower()[i : i + 3] for i in range(len(wanted) - 2)})
    if not runs:
        raise ValueError("a text of three characters at least is needed")
    keys = index.where(F.col("run").isin(runs)).groupBy("row_key").agg(F.count("*").alias("n")).where(F.col("n") == len(runs))
    return df.join(keys, df[key] == keys["row_key"], "left_semi").where(F.lower(column).contains(wanted.lower()))


def size_report(files: DataFrame, size: str = "length") -> DataFrame:
    """Files and bytes per size class."""
    mb = F.col(size) / (1 << 20)
    kind = F.when(mb < 16, "1 tiny").when(mb < 100, "2 small").when(mb <= 250, "3 right").otherwise("4 large")
    return files.groupBy(kind.alias("size_class")).agg(F.count("*").alias("n_files"), F.sum(size).alias("bytes"))
