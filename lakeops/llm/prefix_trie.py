"""Trie of conversations' shared beginnings, measured along its Euler tour.

A node is a distinct sequence of first turns; it is named by the smallest conversation that begins with it and its depth.
Prefixes are told apart by two 64-bit sums (exclusive or) of a hash of each turn's digest and place, so that the prefix
of a node's parent follows from its own.

The tour enters a node, goes through its children in order of their conversations, and leaves it. Nodes are numbered in
order of (conversation, depth), so that a conversation's own nodes stand side by side and only the topmost of them has
to look for its parent. Each node gives an enter and an exit arc that know their successor. The list of arcs is ranked
in three steps: blocks of neighbouring nodes close the runs of arcs that stay inside them; rounds over the whole list
take out arcs that are neighbours of none that goes, until BASE runs are left, which are ranked by themselves; then the
runs that went come back in reverse, each just before its successor. Sums along the tour at a node's two arcs give the
leaves and the savings of its subtree.

A conversation's turns are cut into chunks for all that is done in their order, so one of any length is no burden; the
ids of the conversations that end at a node are hashed as a stream of blocks, so any number of copies is none.

Edge cases: null roles and texts count as empty; rows without a conversation are left out; turns come by number, null
first, then by role and text, so repeated rows are turns of their own; the remainder of a negative id is negative;
conversations without turns end at the root; an empty table gives an empty result; other columns are dropped, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.common import written
from lakeops.operators.aggregates import surrogate_key

#: Turns of a conversation, or neighbours in an order, that are looked at together.
CHUNK = 1024

#: Nodes of a block; runs of arcs that are ranked in one go.
BLOCK, BASE = 10_000, 20_000

#: Most conversation ids in one text.
_IDS = 4096

_KEY = ["depth", "hi", "lo"]
_SUMS = ["arcs", "leaves", "saved"]


def _chunk(place: str) -> Column:
    return F.floor(F.col(place) / CHUNK)


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conv_id, place (from 1), digest and octets of each turn; conv_id, n and first_row of each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    places = ordered.select("conv_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("octets"), F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at"))
    places = written(places, "turns")
    ranges = places.groupBy("range").agg(F.count("*").alias("size"), F.min("at").alias("start"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    numbered = places.join(F.broadcast(ranges.select("range", (before - F.col("start")).alias("moved"))), "range").select("conv_id", "digest", "octets", (F.col("at") + F.col("moved")).alias("row"))
    convs = numbered.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("row").alias("first_row"))
    return numbered, convs


def rebuilt(conversations: DataFrame, parts: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where each conversation c begins with the first h turns of c - c % parts and goes on with its own after its first h; h is the unsigned crc32 of c in decimals % most.

    turns: conv_id, depth, digest, octets, last; conversations: conv_id, length.
    """
    rows, convs = turns(conversations)
    borrowed = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    named = convs.select("*", borrowed.alias("h"), (F.col("conv_id") - F.col("conv_id") % parts).alias("base"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    named = named.join(sizes, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    named = written(named.withColumn("length", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    cut = F.sequence(_chunk("first_row"), F.floor((F.col("first_row") + F.col("n") - 1) / CHUNK))
    chunks = named.select("conv_id", "first_row", "h", "lent", "length", F.explode(cut).alias("chunk"))
    placed = rows.withColumn("chunk", _chunk("row")).join(chunks, ["conv_id", "chunk"]).withColumn("place", F.col("row") - F.col("first_row") + 1)
    own = placed.where(F.col("place") > F.col("h")).select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("depth"), "digest", "octets", "length")
    heads = placed.where(F.col("place") < most).select(F.col("conv_id").alias("base"), "place", "digest", "octets")
    lent = heads.join(named.select("base", "conv_id", "h", "length"), "base").where(F.col("place") <= F.col("h")).select("conv_id", F.col("place").alias("depth"), "digest", "octets", "length")
    both = own.unionByName(lent)
    return both.select("conv_id", "depth", "digest", "octets", (F.col("depth") == F.col("length")).alias("last")), named.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """Adds hi and lo, which name the turns up to each, and own_hi and own_lo, by which they differ from those of the turns before it."""
    hashed = rows.select("*", F.xxhash64("depth", "digest").alias("own_hi"), F.xxhash64("digest", "depth").alias("own_lo"), _chunk("depth").alias("chunk"))
    keys = ["conv_id", "chunk"]
    up_to = Window.partitionBy(*keys).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    inside = hashed.select("*", F.bit_xor("own_hi").over(up_to).alias("_hi"), F.bit_xor("own_lo").over(up_to).alias("_lo"))
    chunks = hashed.groupBy(*keys).agg(F.bit_xor("own_hi").alias("hi"), F.bit_xor("own_lo").alias("lo"))
    before = chunks.select(*keys, *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("hi", "lo")))
    out = inside.join(before, keys)
    return out.select("conv_id", "depth", "octets", "last", "own_hi", "own_lo", *(F.col(f"_{c}").bitwiseXOR(F.col(f"{c}_before")).alias(c) for c in ("hi", "lo")))


def nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """number, conv_id, depth, hi, lo, n_convs, saved of each node's own, and parent: the hi and lo of its parent. The root is number 0."""
    made = rows.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("octets").alias("octets"), F.first("own_hi").alias("own_hi"), F.first("own_lo").alias("own_lo"))
    up = [F.col(c).bitwiseXOR(F.col(f"own_{c}")).alias(f"up_{c}") for c in ("hi", "lo")]
    saved = ((F.col("n_convs") - 1) * F.col("octets")).alias("saved")
    none = [F.lit(0).cast("long").alias(c) for c in ("hi", "lo", "up_hi", "up_lo", "saved")]
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", *none)
    return surrogate_key(made.select(*_KEY, "conv_id", "n_convs", *up, saved).unionByName(root), [F.col("conv_id"), F.col("depth")], "number", 0)


def _hashed_in_order(ids: DataFrame) -> DataFrame:
    """(depth, hi, lo, conv_id) -> depth, hi, lo, ends_sha256 of the decimal ids in ascending order, comma-joined."""
    order = [*_KEY, "conv_id"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in _KEY], 1)
            conv = batch["conv_id"].to_pylist()
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(keys) else np.zeros(0, int)
            cuts = np.unique(np.r_[0, new, np.arange(0, len(keys), _IDS), len(keys)]) if len(keys) else np.zeros(1, int)
            at = cuts[:-1]
            texts = [",".join(map(str, conv[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.record_batch({**{c: pa.array(keys[at, k]) for k, c in enumerate(_KEY)}, "first": pa.array([conv[a] for a in at.tolist()], pa.int64()), "ids": pa.array(texts, pa.string())})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def row(done: list) -> pa.RecordBatch:
            columns = {c: pa.array([k[n] for k, _ in done], pa.int64()) for n, c in enumerate(_KEY)}
            return pa.record_batch({**columns, "ends_sha256": pa.array([s for _, s in done], pa.string())})

        for batch in batches:
            done = []
            for *k, text in zip(*(batch[c].to_pylist() for c in (*_KEY, "ids")), strict=True):
                if k == key:
                    state.update(b"," + text.encode())
                    continue
                if state:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            yield row(done)
        if state:
            yield row([(key, state.hexdigest())])

    texts = ids.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed, "depth long, hi long, lo long, first long, ids string")
    return texts.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digests, "depth long, hi long, lo long, ends_sha256 string")


def tree(found: DataFrame) -> DataFrame:
    """Numbered nodes with parent, first_child, next_sibling (numbers), parent_conv_id and n_children.

    A conversation's nodes have neighbouring numbers, so a node is its successor's parent unless the successor is the
    top of its conversation's nodes. Tops, one a conversation, find their parent by a join and their siblings in order.
    """
    spans = found.groupBy("conv_id").agg(F.min("depth").alias("top_depth"), F.max("depth").alias("low_depth"))
    spans = spans.withColumn("group", F.explode(F.sequence(F.floor(F.col("top_depth") / CHUNK), F.floor(F.col("low_depth") / CHUNK))))
    placed = found.withColumn("group", _chunk("depth")).join(spans, ["conv_id", "group"]).drop("group")
    placed = placed.select("*", ((F.col("depth") == F.col("top_depth")) & (F.col("depth") > 0)).alias("top"), (F.col("depth") < F.col("low_depth")).alias("down")).drop("top_depth", "low_depth")
    placed = written(placed, "nodes")
    keyed = placed.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("number").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tops = placed.where("top").select("number", "depth", "up_hi", "up_lo").join(keyed, ["depth", "up_hi", "up_lo"]).select("number", "parent", "parent_conv_id")
    tops = written(surrogate_key(tops, [F.col("parent"), F.col("number")], "seat", 0), "tops")
    after = tops.select((F.col("seat") - 1).alias("seat"), F.col("number").alias("sibling"), F.col("parent").alias("same"))
    seated = tops.join(after, "seat", "left").select("number", "parent", "parent_conv_id", F.when(F.col("same") == F.col("parent"), F.col("sibling")).alias("sibling"))
    below = tops.groupBy(F.col("parent").alias("number")).agg(F.min("number").alias("first_top"), F.count("*").alias("n_tops"))
    beside = below.select((F.col("number") + 1).alias("number"), F.col("first_top").alias("beside"))  # what follows a child of the same conversation
    joined = placed.join(seated, "number", "left").join(below, "number", "left").join(beside, "number", "left")
    inner = ~F.col("top") & (F.col("depth") > 0)
    return joined.select(
        "number", "conv_id", *_KEY, "n_convs", "saved",
        F.when(inner, F.col("number") - 1).otherwise(F.col("parent")).alias("parent"),
        F.when(inner, F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        (F.col("down").cast("long") + F.coalesce("n_tops", F.lit(0))).alias("n_children"),
        F.when(F.col("down"), F.col("number") + 1).otherwise(F.col("first_top")).alias("first_child"),
        F.when(inner, F.col("beside")).otherwise(F.col("sibling")).alias("next_sibling"),
    )


def _summed(back: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists given by each element's predecessor (itself at a head): the head of each, and sums of the values before it. Distances double, so there are as many steps as the longest list has binary digits."""
    back, before = back.copy(), np.where((back == np.arange(len(back)))[None, :], 0, values[:, back])
    while True:
        further = back[back]
        if (further == back).all():
            return back, before
        before, back = before + before[:, back], further


def _runs(block: pa.Table) -> pa.Table:
    """Arcs of a block of nodes, each with the head of its run inside the block and the sums before it in the run; a head also has the arc after its run and the run's sums."""
    number = block["number"].to_numpy()
    column = lambda name: block[name].fill_null(-1).to_numpy()
    child, sibling, parent, saved = (column(c) for c in ("first_child", "next_sibling", "parent", "saved"))
    order = np.argsort(number)
    number, child, sibling, parent, saved = (x[order] for x in (number, child, sibling, parent, saved))
    n = len(number)
    ids = np.empty(2 * n, np.int64)
    ids[::2], ids[1::2] = 2 * number, 2 * number + 1
    after = np.empty(2 * n, np.int64)
    after[::2] = np.where(child >= 0, 2 * child, 2 * number + 1)
    after[1::2] = np.where(sibling >= 0, 2 * sibling, np.where(parent >= 0, 2 * parent + 1, -1))
    values = np.zeros((3, 2 * n), np.int64)
    values[0], values[1, ::2], values[2, ::2] = 1, child < 0, saved
    at = np.minimum(np.searchsorted(ids, after), 2 * n - 1)
    inside = ids[at] == after
    back = np.arange(2 * n)
    back[at[inside]] = np.flatnonzero(inside)
    head, before = _summed(back, values)
    ends = np.flatnonzero(~inside)  # each run has one last arc
    is_head = np.zeros(2 * n, bool)
    is_head[head[ends]] = True
    whole = np.zeros((4, 2 * n), np.int64)
    whole[0, head[ends]], whole[1:, head[ends]] = after[ends], (before + values)[:, ends]
    nulled = lambda x: pa.array(x, mask=~is_head)
    return pa.table({"id": ids, "head": ids[head], **{f"{c}_before": before[k] for k, c in enumerate(_SUMS)}, "after": nulled(whole[0]), **{c: nulled(whole[k + 1]) for k, c in enumerate(_SUMS)}})


_RUN = "id long, head long, arcs_before long, leaves_before long, saved_before long, after long, arcs long, leaves long, saved long"


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of the few runs that are left."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    ids, after = rows["id"].to_numpy(), rows["after"].to_numpy()
    order = np.argsort(ids)
    ids, after, values = ids[order], after[order], np.stack([rows[c].to_numpy()[order] for c in _SUMS])
    back = np.arange(len(ids))
    follows = np.flatnonzero(after >= 0)
    back[np.searchsorted(ids, after[follows])] = follows
    _, before = _summed(back, values)
    yield pa.record_batch({"id": pa.array(ids), **{f"{c}_start": pa.array(before[k]) for k, c in enumerate(_SUMS)}})


def ranked(runs: DataFrame, base: int = BASE) -> DataFrame:
    """id, arcs_start, leaves_start, saved_start: sums of all that stands before each run of one list (id, after: the next run's id or -1 at the end, arcs, leaves, saved).

    A round takes out each run whose hash is less than those of both its neighbours, about a third of all, and hangs its
    sums on the run before it; two neighbours never go together. Rounds shrink, so all of them cost a few times the first.
    """
    prev = runs.where("after >= 0").select(F.col("after").alias("id"), F.col("id").alias("prev"))
    left = written(runs.join(prev, "id", "left").select("id", "after", F.coalesce("prev", F.lit(-1)).alias("prev"), *_SUMS), "runs")
    gone: list[DataFrame] = []
    while left.count() > max(base, 2):  # the ends of the list never go
        weight = lambda c: F.xxhash64(F.lit(len(gone)), F.col(c))  # noqa: E731, B023
        goes = (F.col("prev") >= 0) & (F.col("after") >= 0) & (weight("id") < weight("prev")) & (weight("id") < weight("after"))
        marked = left.withColumn("goes", goes)
        gone.append(written(marked.where("goes").drop("goes"), "gone"))
        none = F.lit(None).cast("long")
        stay = marked.where("NOT goes").select("id", "after", "prev", *_SUMS)
        to_prev = gone[-1].select(F.col("prev").alias("id"), F.col("after").alias("new_after"), none.alias("new_prev"), *_SUMS)
        to_after = gone[-1].select(F.col("after").alias("id"), none.alias("new_after"), F.col("prev").alias("new_prev"), *(F.lit(0).cast("long").alias(c) for c in _SUMS))
        told = to_prev.unionByName(to_after).select("id", none.alias("after"), none.alias("prev"), *_SUMS, "new_after", "new_prev")
        met = stay.select("*", none.alias("new_after"), none.alias("new_prev")).unionByName(told).groupBy("id")
        left = met.agg(F.coalesce(F.max("new_after"), F.max("after")).alias("after"), F.coalesce(F.max("new_prev"), F.max("prev")).alias("prev"), *(F.sum(c).alias(c) for c in _SUMS))
        left = written(left, "runs")
    done = written(left.select("id", "after", *_SUMS).coalesce(1).mapInArrow(_base, "id long, arcs_start long, leaves_start long, saved_start long"), "starts")
    for back in reversed(gone):
        at = done.withColumnRenamed("id", "after")
        returned = back.join(at, "after").select("id", *((F.col(f"{c}_start") - F.col(c)).alias(f"{c}_start") for c in _SUMS))
        done = written(done.unionByName(returned), "starts")
    return done


def toured(found: DataFrame, block: int = BLOCK, base: int = BASE) -> DataFrame:
    """number, entered and left (places of its arcs in the tour, from 0), n_leaves and saved_tokens of each node's subtree."""
    blocks = found.select("number", "first_child", "next_sibling", "parent", "saved", F.floor(F.col("number") / block).alias("block"))
    arcs = written(blocks.groupBy("block").applyInArrow(_runs, _RUN), "arcs")
    starts = ranked(arcs.where("after IS NOT NULL").select("id", "after", *_SUMS), base)
    placed = arcs.join(starts.withColumnRenamed("id", "head"), "head")
    sums = placed.select((F.col("id") / 2).cast("long").alias("number"), (F.col("id") % 2 == 1).alias("exit"), *((F.col(f"{c}_start") + F.col(f"{c}_before")).alias(c) for c in _SUMS))
    at = lambda c, out: F.max(F.when(F.col("exit") == out, F.col(c)))
    return sums.groupBy("number").agg(at("arcs", False).alias("entered"), at("arcs", True).alias("left"), (at("leaves", True) - at("leaves", False)).alias("n_leaves"), (at("saved", True) - at("saved", False)).alias("saved_tokens"))


def measured(rows: DataFrame, convs: DataFrame, block: int = BLOCK, base: int = BASE) -> DataFrame:
    """The trie of conversations given as by rebuilt(): a row per node."""
    named = written(prefixes(rows), "prefixes")
    found = written(tree(nodes(named, convs)), "tree")
    ends = named.where("last").select(*_KEY, "conv_id").unionByName(convs.where("length = 0").select(*(F.lit(0).cast("long").alias(c) for c in _KEY), "conv_id"))
    out = found.join(toured(found, block, base), "number").join(_hashed_in_order(ends), _KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "entered", "left")
