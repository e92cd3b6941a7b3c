"""MERGE and slowly changing dimensions: a target goes in, the new target comes out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


@dataclass(frozen=True)
class Clause:
    """kind: update, delete (of matched rows) or insert (of unmatched source rows). condition and values are SQL over t.column and s.column; without values, columns take the source's of the same name."""

    kind: str
    condition: str = "true"
    values: Mapping[str, str] = field(default_factory=dict)


def merge_into(target: DataFrame, source: DataFrame, keys: Sequence[str], clauses: Sequence[Clause], null_safe: bool = False, also: str = "true", check: bool = True) -> DataFrame:
    """Ordered clauses; the first whose condition is true wins, and a row without one stays as it is.

    also: a further condition of the match, over t and s. check: a target row with two source rows fails the query.
    """
    t = target.select(F.struct("*").alias("t"), F.lit(1).alias("_in_t"), *(F.col(k).alias(f"_t{n}") for n, k in enumerate(keys)))
    s = source.select(F.struct("*").alias("s"), F.lit(1).alias("_in_s"), *(F.col(k).alias(f"_s{n}") for n, k in enumerate(keys)))
    if check:  # shares the exchange and the order of the join
        s = s.withColumn("_same", F.count("*").over(Window.partitionBy(*(f"_s{n}" for n in range(len(keys))))))
    on = reduce(lambda a, b: a & b, ((F.col(f"_t{n}").eqNullSafe(F.col(f"_s{n}")) if null_safe else F.col(f"_t{n}") == F.col(f"_s{n}")) for n in range(len(keys)))) & F.expr(also)
    joined = t.join(s, on, "full_outer")
    matched, new = F.col("_in_t").isNotNull() & F.col("_in_s").isNotNull(), F.col("_in_t").isNull()
    which = F.lit(-1)
    for n in range(len(clauses) - 1, -1, -1):
        c = clauses[n]
        which = F.when((new if c.kind == "insert" else matched) & F.coalesce(F.expr(c.condition), F.lit(False)), F.lit(n)).otherwise(which)
    if check:
        which = F.when(matched & (F.col("_same") > 1), F.raise_error(F.lit("Duplicate row detected: two source rows match a target row")).cast("int")).otherwise(which)
    joined = joined.withColumn("_which", which)
    gone = [n for n, c in enumerate(clauses) if c.kind == "delete"]
    kept = joined.where(~F.col("_which").isin(gone) if gone else F.lit(True)).where(F.col("_in_t").isNotNull() | (F.col("_which") >= 0))
    fields = {f.name: f.dataType for f in target.schema}
    columns = []
    for name, kind in fields.items():
        out: Column = F.col(f"t.{name}")
        for n, c in enumerate(clauses):
            if c.kind == "delete":
                continue
            if name in c.values:
                value = F.expr(c.values[name])
            elif not c.values and name in source.columns:
                value = F.col(f"s.{name}")
            else:
                value = F.lit(None) if c.kind == "insert" else F.col(f"t.{name}")
            out = F.when(F.col("_which") == n, value.cast(kind)).otherwise(out)
        columns.append(out.alias(name))
    return kept.select(*columns)


def many_source_rows(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n of the target's rows that more than one source row matches: what a checked merge refuses."""
    counts = source.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return counts.join(target.select(*keys).distinct(), list(keys), "left_semi")


def scd1_merge(dim: DataFrame, src: DataFrame, keys: Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """Changed rows are overwritten, new ones inserted."""
    changed = " OR ".join(f"NOT (t.{c} <=> s.{c})" for c in tracked)
    return merge_into(dim, src, keys, [Clause("update", changed), Clause("insert")])


def scd1_two_step(dim: DataFrame, src: DataFrame, keys: Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """The same by an insert of missing keys and an update from the source."""
    from lakeops.operators.joins import update_from

    added = src.join(dim, list(keys), "left_anti").select(*dim.columns)
    return update_from(dim, src.select(*keys, *tracked), keys, {c: c for c in tracked}).unionByName(added)


def scd2_merge(dim: DataFrame, src: DataFrame, keys: Sequence[str], tracked: Sequence[str], as_of: str, key_name: str = "surrogate_key", delete_missing: bool = False) -> DataFrame:
    """Changed current rows end the day before as_of and get a new version; new keys get a first one; history stays. delete_missing: current rows that the source hasn't got end, too. Keys match with nulls equal.

    Surrogate keys of new versions go on after the largest there is, in order of the keys.
    """
    from lakeops.operators.aggregates import surrogate_key

    day = F.lit(as_of).cast("date")
    current, history = dim.where("is_current"), dim.where("NOT is_current")
    s = src.select(*keys, *tracked)
    mark = s.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.lit(1).alias("_in"), F.struct(*tracked).alias("_new"))
    alike = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)))  # a null key is a key
    joined = current.join(mark, alike, "left")
    old = F.struct(*tracked)
    ends = F.when(F.col("_new").isNull(), F.lit(delete_missing)).otherwise(~old.eqNullSafe(F.col("_new")))
    closed = joined.withColumn("_ends", ends)
    updated = closed.select(*(
        F.when(F.col("_ends"), F.date_sub(day, 1)).otherwise(F.col(c)).alias(c) if c == "effective_to"
        else (F.col(c) & ~F.col("_ends")).alias(c) if c == "is_current" else F.col(c)
        for c in dim.columns
    ))
    same = closed.where(~F.col("_ends")).select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)))
    fresh = s.join(same, alike, "left_anti")
    start = dim.agg(F.coalesce(F.max(key_name), F.lit(0)).alias("_top"))
    numbered = surrogate_key(fresh, [F.col(k).asc_nulls_first() for k in keys], "_n").crossJoin(start)
    added = numbered.select(*(
        {key_name: F.col("_n") + F.col("_top"), "effective_from": day, "effective_to": F.lit(OPEN_END).cast("date"), "is_current": F.lit(True)}.get(c, F.col(c) if c in fresh.columns else F.lit(None)).cast(dim.schema[c].dataType).alias(c)
        for c in dim.columns
    ))
    return history.unionByName(updated).unionByName(added)


def scd2_init(src: DataFrame, keys: Sequence[str], tracked: Sequence[str], as_of: str, key_name: str = "surrogate_key") -> DataFrame:
    from lakeops.operators.aggregates import surrogate_key

    rows = surrogate_key(src.select(*keys, *tracked), [F.col(k) for k in keys], key_name)
    return rows.select(F.col(key_name).cast("long").alias(key_name), *keys, *tracked, F.lit(as_of).cast("date").alias("effective_from"), F.lit(OPEN_END).cast("date").alias("effective_to"), F.lit(True).alias("is_current"))


def scd2_apply_changes(dim: DataFrame, changes: DataFrame, keys: Sequence[str], tracked: Sequence[str], as_of: str, key_name: str = "surrogate_key") -> DataFrame:
    """A change feed (_action, _is_update), one batch with at most one new row a key, in one pass over the current rows: an update ends the current version and begins another, an insert begins a first one, and a delete ends the current version for good.

    An insert of a key that is current counts as an update; changes that change nothing tracked are left out.
    """
    from lakeops.operators.aggregates import surrogate_key

    day = F.lit(as_of).cast("date")
    current, history = dim.where("is_current"), dim.where("NOT is_current")
    feed = changes.where(~((F.col("_action") == "DELETE") & F.col("_is_update")))
    mark = feed.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), "_action", F.struct(*tracked).alias("_new"))
    alike = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)))
    both = current.withColumn("_old", F.struct(*tracked)).join(mark, alike, "full_outer")
    there, insert = F.col("_old").isNotNull(), F.col("_action") == "INSERT"
    changed = insert & ~F.col("_old").eqNullSafe(F.col("_new"))
    both = both.withColumn("_ends", F.coalesce(there & ((F.col("_action") == "DELETE") | changed), F.lit(False))).withColumn("_begins", F.coalesce(changed, F.lit(False)))
    old = both.where(there).select(*(
        F.when(F.col("_ends"), F.date_sub(day, 1)).otherwise(F.col(c)).alias(c) if c == "effective_to"
        else (F.col(c) & ~F.col("_ends")).alias(c) if c == "is_current" else F.col(c)
        for c in dim.columns
    ))
    fresh = both.where("_begins").select(*(F.col(f"_k{n}").alias(k) for n, k in enumerate(keys)), *(F.col(f"_new.{c}").alias(c) for c in tracked))
    top = dim.agg(F.coalesce(F.max(key_name), F.lit(0)).alias("_top"))
    numbered = surrogate_key(fresh, [F.col(k).asc_nulls_first() for k in keys], "_n").crossJoin(top)
    added = numbered.select(*(
        {key_name: F.col("_n") + F.col("_top"), "effective_from": day, "effective_to": F.lit(OPEN_END).cast("date"), "is_current": F.lit(True)}.get(c, F.col(c) if c in fresh.columns else F.lit(None)).cast(dim.schema[c].dataType).alias(c)
        for c in dim.columns
    ))
    return history.unionByName(old).unionByName(added)


def delete_missing(dim: DataFrame, src: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key the source still has."""
    return dim.join(src.select(*keys), list(keys), "left_semi")


def conditional_update(df: DataFrame, column: str, rules: Sequence[tuple[Column, str, str]], message: str = "audit") -> DataFrame:
    """The first rule (condition, new value, message) that holds sets a column; the message tells which, null where none did."""
    value = said = None
    for condition, new, text in rules:
        value = F.when(condition, new) if value is None else value.when(condition, new)
        said = F.when(condition, text) if said is None else said.when(condition, text)
    return df.withColumns({column: value.otherwise(F.col(column)), message: said}) if rules else df.withColumn(message, F.lit(None).cast("string"))


def incremental_fact_load(fact: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """The fact with the staged rows whose key it hasn't got; of staged rows that repeat a key, one."""
    return fact.unionByName(staged.join(fact.select(key), key, "left_anti").dropDuplicates([key]).select(*fact.columns))


def scd3_previous_value(dim: DataFrame, src: DataFrame, keys: Sequence[str], col: str, as_of: str) -> DataFrame:
    """current_x, previous_x and x_changed_on of one column; keys that the source hasn't got stay."""
    new = src.select(*keys, F.col(col).alias("_new"), F.lit(1).alias("_in"))
    changed = F.col("_in").isNotNull() & ~F.col(f"current_{col}").eqNullSafe(F.col("_new"))
    return dim.join(new, list(keys), "left").select(
        *keys,
        F.when(changed, F.col("_new")).otherwise(F.col(f"current_{col}")).alias(f"current_{col}"),
        F.when(changed, F.col(f"current_{col}")).otherwise(F.col(f"previous_{col}")).alias(f"previous_{col}"),
        F.when(changed, F.lit(as_of).cast("date")).otherwise(F.col(f"{col}_changed_on")).alias(f"{col}_changed_on"),
    )


def apply_changes(dim: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A change feed (_action, _is_update) applied with hard deletes; rows with an update's old values are ignored."""
    feed = changes.where(~((F.col("_action") == "DELETE") & F.col("_is_update")))
    return merge_into(dim, feed, keys, [Clause("delete", "s._action = 'DELETE'"), Clause("update"), Clause("insert", "s._action = 'INSERT'")])


def soft_delete_merge(target: DataFrame, changes: DataFrame, keys: Sequence[str], deleted: str = "deleted_ind") -> DataFrame:
    """Deletes set the flag to Y; inserts and updates write the row and set it to N, so a deleted key that comes back is active again. Keys match with nulls equal."""
    feed = changes.where(~((F.col("_action") == "DELETE") & F.col("_is_update")))
    values = {c: f"s.{c}" for c in target.columns if c != deleted}
    return merge_into(target, feed, keys, [Clause("update", "s._action = 'DELETE'", {deleted: "'Y'"}), Clause("update", "true", values | {deleted: "'N'"}), Clause("insert", "s._action = 'INSERT'", values | {deleted: "'N'"})], null_safe=True)


def archive_and_delete(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(archived, remaining); rows for which the condition is null remain."""
    hit = F.coalesce(condition, F.lit(False))
    return df.where(hit), df.where(~hit)


def balanced_transfer(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """All transfers or none: if any account is unknown or would be overdrawn, every balance stays. accounts: account_id, balance; transfers: source, target, amount."""
    moves = transfers.select(F.col("source").alias("account_id"), (-F.col("amount")).alias("delta")).unionByName(transfers.select(F.col("target").alias("account_id"), F.col("amount").alias("delta")))
    net = moves.groupBy("account_id").agg(F.sum("delta").alias("delta"))
    joined = accounts.join(net, "account_id", "full_outer")
    bad = joined.agg(F.coalesce(F.max(F.col("balance").isNull() | (F.col("balance") + F.coalesce("delta", F.lit(0)) < 0)), F.lit(False)).alias("_bad"))
    applied = F.when(F.col("_bad"), F.col("balance")).otherwise(F.col("balance") + F.coalesce("delta", F.lit(0)))
    return joined.where(F.col("balance").isNotNull()).crossJoin(bad).select("account_id", applied.cast("decimal(20,2)").alias("balance"), (~F.col("_bad")).alias("applied"))


def violations(df: DataFrame, primary: Sequence[str] = (), unique: Sequence[Sequence[str]] = (), not_null: Sequence[str] = (), foreign: Sequence[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """rule, detail, n: one row per constraint that is broken."""
    rows = []
    for name in dict.fromkeys([*primary, *not_null]):
        rows.append(df.agg(F.count_if(F.col(name).isNull()).alias("n")).select(F.lit("not_null").alias("rule"), F.lit(name).alias("detail"), "n"))
    for cols in [c for c in ([primary] if primary else []) + list(unique)]:
        repeated = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cols))).groupBy(*cols).agg(F.count("*").alias("k")).where("k > 1")
        rows.append(repeated.agg(F.count("*").alias("n")).select(F.lit("unique").alias("rule"), F.lit(",".join(cols)).alias("detail"), "n"))
    for name, other, key in foreign:
        missing = df.where(F.col(name).isNotNull()).join(other, df[name] == other[key], "left_anti")
        rows.append(missing.agg(F.count("*").alias("n")).select(F.lit("foreign_key").alias("rule"), F.lit(name).alias("detail"), "n"))
    return reduce(DataFrame.unionByName, rows).where("n > 0")
