"""Secret scanning with an incremental ledger of content-addressed blobs, in DataFrame functions only.

Each text is addressed by its SHA-256, so every historical version and every copy of it is one blob. A blob is scanned
once for each version of the rules; the ledger keeps which (blob, rules version) pairs have been scanned and what was
found. Findings are joined back to all rows that hold the blob.

A span is (kind, start, end) in code points, end exclusive. Spans come from splitting a text by a rule: the gaps and the
matches in turn give every offset.

Edge cases: null texts count as empty and hold nothing; long texts are scanned whole; copies and repeated rows share
one scan and each get their findings, null ids too; a blob that two writers have added to a ledger counts once; an empty
table gives an empty result; other columns are carried by find(), whatever their names, but for one that is named as
its result is, which it replaces.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import fresh_name, scratch, text_or_empty


@dataclass(frozen=True)
class Rule:
    """pattern: what to look for, leftmost and non-overlapping. group: whose length must be `least`; shorter matches are dropped. hint: must occur in any text that matches."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str


#: The base rules, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i:password|passwd|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)
RULES_VERSION = "base-1"

_SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"


#: Values of an array that are gone through in one go; characters of a block of text.
_RUN, _BLOCK = 256, 1000


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once: what a lambda takes from outside is made anew for each element otherwise."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of numbers from 0 on, all before it combined (sum, greatest), 0 for the first.

    A fold copies what it has made at each step, so runs of _RUN values are folded, and what is known before each run
    is folded over the runs: the work is that of n * _RUN copies, not of n * n.
    """
    none = F.array().cast("array<bigint>")

    def folded(array: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(array, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    zero = F.lit(0).cast("bigint")

    def cut(all_: Column) -> Column:
        n_runs = F.ceil(F.size(all_) / _RUN).cast("int")
        return F.when(n_runs > 0, F.transform(F.sequence(F.lit(0), n_runs - 1), lambda k: F.slice(all_, k * _RUN + 1, F.lit(_RUN)))).otherwise(F.array().cast("array<array<bigint>>"))

    def scanned(runs: Column) -> Column:
        totals = F.transform(runs, lambda run: F.aggregate(run, zero, combine))
        return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), folded(totals, zero).alias("start")), lambda z: folded(z["run"], z["start"])))

    return bound(bound(values, cut), scanned)


_PARTS = "array<struct<gap:bigint,hit:bigint,kept:bigint>>"


def _parts(text: Column, rule: Rule) -> Column:
    """Lengths of the gaps and matches of a rule in turn; a text without the hint isn't taken apart."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), kept.alias("kept"))
    sizes = F.transform(parts, lambda x: F.struct(*(F.coalesce(F.length(x[c]), F.lit(-1 if c == "kept" else 0)).cast("bigint").alias(c) for c in ("gap", "hit", "kept"))))
    return F.when(text.rlike(rule.hint), sizes).otherwise(F.array().cast(_PARTS))


def _spans(parts: Column, before: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule, from its parts and what stands before each."""
    placed = F.arrays_zip(parts.alias("part"), before.alias("before"))
    hits = F.filter(placed, lambda z: z["part"]["kept"] >= rule.least)
    begin = lambda z: (z["before"] + z["part"]["gap"]).cast("int")
    return F.transform(hits, lambda z: F.struct(begin(z).alias("start"), F.lit(order).alias("ord"), (begin(z) + z["part"]["hit"]).cast("int").alias("end"), F.lit(rule.kind).alias("kind")))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) -> (blob, spans), by start and then the order of the rules."""
    numbers = range(len(rules))
    parts = blobs.select("blob", *(_parts(F.col("text"), rule).alias(f"parts_{k}") for k, rule in enumerate(rules)))
    sizes = lambda k: F.transform(f"parts_{k}", lambda x: x["gap"] + x["hit"])
    placed = parts.select("*", *(running(sizes(k), lambda a, b: a + b).alias(f"before_{k}") for k in numbers))
    found = placed.select("blob", F.concat(*(_spans(F.col(f"parts_{k}"), F.col(f"before_{k}"), rule, k) for k, rule in enumerate(rules))).alias("spans"))
    return found.select("blob", F.array_sort("spans").cast(_SPANS).alias("spans"))


def update_ledger(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, rules_version: str = RULES_VERSION, text_col: str = "text") -> DataFrame:
    """Scans the blobs of `versions` (any rows with a text) that the ledger hasn't seen under these rules, appends them to it, and gives the ledger under these rules: blob, spans."""
    spark = versions.sparkSession
    path = f"{ledger_path}/rules_version={rules_version}"
    schema = f"blob string, spans {_SPANS}"
    texts = versions.select(text_or_empty(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))
    try:
        seen = spark.read.schema(schema).parquet(path)
        texts = texts.join(seen.select("blob"), "blob", "left_anti")
    except Exception as e:  # no scan under these rules yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    unseen = texts.groupBy("blob").agg(F.first("text").alias("text"))
    scan(unseen, rules).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def find(df: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, rules_version: str = RULES_VERSION, text_col: str = "text", spans_col: str = "secret_spans") -> DataFrame:
    """Adds `spans_col` to every row. Without a ledger_path a new ledger is begun in the shared folder."""
    ledger = update_ledger(df, ledger_path or scratch(df.sparkSession, "ledger"), rules, rules_version, text_col)
    rows = df.drop(spans_col)
    address = fresh_name(rows, spans_col)
    blob = fresh_name(rows, spans_col, address)
    hits = ledger.where(F.size("spans") > 0).groupBy(F.col("blob").alias(blob)).agg(F.first("spans").alias(spans_col))
    joined = rows.withColumn(address, F.sha2(text_or_empty(text_col), 256)).join(hits, F.col(address) == F.col(blob), "left")
    return joined.withColumn(spans_col, F.coalesce(spans_col, F.array().cast(_SPANS))).drop(address, blob)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span (by start) replaced by a mark; spans that overlap become one. The text is cut into blocks once, so that a piece between two spans is looked for in its own blocks only."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    before = running(F.transform(spans, lambda s: s["end"].cast("bigint")), lambda a, b: F.greatest(a, b))

    def joined(cut: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            first, last = F.floor(start / _BLOCK).cast("int"), F.floor((end - 1) / _BLOCK).cast("int")
            held = F.array_join(F.slice(cut, first + 1, last - first + 1), "")
            return F.when(end > start, F.substring(held, (start - first * _BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise("")

        apart = F.filter(F.arrays_zip(spans.alias("span"), before.alias("before")), lambda z: z["span"]["start"] >= z["before"])
        kept = F.transform(apart, lambda z: F.concat(piece(z["before"], z["span"]["start"]), F.lit(mark)))
        done = F.array_max(F.transform(spans, lambda s: s["end"])).cast("bigint")
        return F.concat(F.array_join(kept, ""), piece(done, F.length(text).cast("bigint")))

    return F.when(F.size(spans) > 0, bound(blocks, joined)).otherwise(text)
