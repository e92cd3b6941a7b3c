"""Column functions of the warehouse dialect, built from Spark's own."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_range(column: str, year: int, month: int | None = None) -> Column:
    """A year or month as a half-open range on the raw column, which reaches the scan; YEAR() or DATE_TRUNC() would not."""
    low = f"{year:04d}-{month or 1:02d}-01"
    end_year, end_month = (year + 1, 1) if month in (None, 12) else (year, month + 1)
    c = F.col(column)
    return (c >= F.lit(low).cast("timestamp")) & (c < F.lit(f"{end_year:04d}-{end_month:02d}-01").cast("timestamp"))


def day_range(column: str, day: str) -> Column:
    c, low = F.col(column), F.lit(day).cast("timestamp")
    return (c >= low) & (c < F.timestamp_add("DAY", F.lit(1), low))


def case_map(column: str | Column, mapping: Mapping, default=None) -> Column:
    """Simple CASE."""
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for key, value in mapping.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def safe_cast(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Casts columns, null where a value doesn't fit."""
    return df.withColumns({name: F.col(name).try_cast(kind) for name, kind in schema.items()})


def ratio_pct(num: Column, den: Column, digits: int = 2) -> Column:
    """Percentage in doubles, null for a zero denominator."""
    den = den.cast("double")
    return F.round(num.cast("double") / F.nullif(den, F.lit(0.0)) * 100, digits)


def units_between(unit: str, start: Column, end: Column) -> Column:
    """Boundaries of a unit crossed from start to end, as DATEDIFF(unit, start, end) counts them."""
    return F.timestamp_diff(unit.upper(), F.date_trunc(unit, start), F.date_trunc(unit, end))


def day_of_week(column: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(column) - 1


def last_day_of(unit: str, column: Column) -> Column:
    """Last day of the month, quarter or year."""
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    return F.date_sub(F.add_months(F.trunc(column, unit), months), 1)


def truncated(column: Column, power: int) -> Column:
    """Toward zero to a power of ten: TRUNC(x, -power)."""
    step = 10**power
    return F.signum(column).cast("long") * F.floor(F.abs(column) / step) * step


def geo_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6_371_008.8 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def point(wkt: Column) -> tuple[Column, Column]:
    """Longitude and latitude of POINT(lon lat)."""
    number = r"(-?[0-9.]+)"
    pattern = rf"POINT\s*\(\s*{number}\s+{number}\s*\)"
    return F.regexp_extract(wkt, pattern, 1).try_cast("double"), F.regexp_extract(wkt, pattern, 2).try_cast("double")


def split_to_rows(df: DataFrame, column: str, delimiter: str, value: str = "value", index: str = "index") -> DataFrame:
    """One row per piece, numbered from 1; the delimiter is taken literally."""
    pieces = F.posexplode(F.split(column, re.escape(delimiter)))
    return df.select("*", pieces.alias("_pos", value)).withColumn(index, F.col("_pos") + 1).drop("_pos")


def flatten_json(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """One row per member of the outermost object or array of a JSON text: index, key, value as text."""
    view = df.select(*keep, F.try_parse_json(column).alias("_variant"))
    exploded = view.lateralJoin(view.sparkSession.tvf.variant_explode(F.col("_variant").outer()))
    return exploded.select(*keep, F.col("pos").alias("index"), "key", F.col("value").cast("string").alias("value"))


def slugify(text: Column) -> Column:
    """Lower case, anything but letters and digits to single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def mask_email(email: Column) -> Column:
    """First and last letter of the name and the domain stay; a name of one letter, or a text that isn't an address, is left as it is."""
    name, domain = F.substring_index(email, "@", 1), F.substring_index(email, "@", -1)
    masked = F.concat(F.substring(name, 1, 1), F.lit("***"), F.substring(name, -1, 1), F.lit("@"), domain)
    return F.when(email.contains("@") & (F.length(name) > 1), masked).otherwise(email)


def escape_text(column: Column) -> Column:
    return F.replace(column, F.lit("\\"), F.lit("$#$"))


def unescape_text(column: Column) -> Column:
    return F.rtrim(F.replace(column, F.lit("$#$"), F.lit("\\")))


def tokenized(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """Words with their place, from 1."""
    words = F.filter(F.split(F.col(column), r"\s+"), lambda w: w != "")
    return df.select(*keep, F.posexplode(words).alias("_p", "token")).select(*keep, (F.col("_p") + 1).alias("position"), "token")
