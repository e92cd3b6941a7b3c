"""Removal of passages that repeat across documents, by level-wise doubling.

Windows are taken at a first length and at twice that, up to the wanted one; only windows whose parts repeat at one
length are looked at at the next. At every length but the last it is enough to look at anchors: of all windows of that
length inside a window of the wanted one, the one with the smallest hash. Equal wanted windows have equal anchors, so a
window whose anchor is in one document only can't repeat. At the last length every window still in question is compared.

Texts with the same words are one text: the copy with the smallest id stands for all. Hashes of windows are exchanged
in packed rows; a batch of documents sends each hash once, with the smallest id that has it, and settles its other
documents itself, so that a passage that a third of all documents share costs one entry a batch.

Edge cases: null texts have no words; a null id is kept whole and takes no part; rows that repeat an id are judged
apart, and never against each other; texts shorter than a window lose nothing; very long texts are compared whole;
an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import mixed, partitions, sliced, split_words, window_hashes, word_hashes, written

#: Bits of the filter that spares the shuffle most texts that aren't wanted; its size is fixed, whatever the input.
FILTER_BITS = 1 << 25


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def levels(length: int, first: int = 25) -> list[int]:
    """Lengths of the levels: half, a quarter and so on of the wanted length, rounded up, down to `first`; the wanted one is last."""
    out = [length]
    while -(-out[0] // 2) >= first:
        out.insert(0, -(-out[0] // 2))
    return out


def anchors(h: np.ndarray, part: int, length: int, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `length` words: the smallest hash of a window of `part` words in it. Also the distinct ones of the windows that are live."""
    small = window_hashes(h, part)
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least, width, span = small, 1, length - part + 1
    while 2 * width <= span:  # sliding minimum by doubling
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    return least, np.unique(least if live is None else least[live])


def packed(parts: int, key: np.ndarray, hashes: np.ndarray, owners: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, hashes, owners) of each part of the key that has any; in order of owners, which then compress well."""
    part = (key >> np.uint64(20)) % np.uint64(parts)
    order = np.lexsort((owners, part))
    hashes, owners, part = hashes[order], owners[order], part[order]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            yield p, hashes[cuts[p] : cuts[p + 1]].tobytes(), owners[cuts[p] : cuts[p + 1]].tobytes()


_PACKED = "part int, settled boolean, hashes binary, owners binary"
_TYPES = [pa.int32(), pa.bool_(), pa.binary(), pa.binary()]


def _rows(rows: list[tuple], types: list[pa.DataType], schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in schema.split(", ")])


#: Gives, for the documents of a batch, (owner, distinct hashes, routes). Equal hashes have equal routes; hashes with one
#: route are exchanged together, so neighbouring windows, which share an anchor, come back in one row.
Windows = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def first_owner(source: DataFrame, windows: Windows) -> DataFrame:
    """(owner, hashes): those of an owner's hashes that an owner with a smaller number has, too; an owner may have several rows."""
    parts = 4 * partitions(source.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4000):
            found = [x for x in windows(batch) if len(x[1])]
            if not found:
                continue
            hashes, routes = (np.concatenate([x[k] for x in found]) for k in (1, 2))
            owners = np.repeat(np.array([x[0] for x in found], np.int64), [len(x[1]) for x in found])
            order = np.lexsort((owners, hashes))
            hashes, owners, routes = hashes[order], owners[order], routes[order]
            new = np.r_[True, hashes[1:] != hashes[:-1]]
            group = np.cumsum(new) - 1
            later = owners > owners[new][group]
            rows = [(p, False, h, o) for p, h, o in packed(parts, mixed(routes[new]), hashes[new], owners[new])]
            rows += [(p, True, h, o) for p, h, o in packed(parts, mixed(owners[later].view(np.uint64)), hashes[later], owners[later])]
            yield _rows(rows, _TYPES, _PACKED)

    def settle(rows: list[tuple[bytes, bytes]], settled: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, bytes]]:
        hashes = np.frombuffer(b"".join(h for h, _ in rows), np.uint64)
        owners = np.frombuffer(b"".join(o for _, o in rows), np.int64)
        order = np.lexsort((owners, hashes))
        hashes, owners = hashes[order], owners[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)]
        later = owners > owners[new][np.cumsum(new) - 1]
        hashes = np.concatenate([hashes[later], np.frombuffer(b"".join(h for h, _ in settled), np.uint64)])
        owners = np.concatenate([owners[later], np.frombuffer(b"".join(o for _, o in settled), np.int64)])
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
        if not len(owners):
            return
        cuts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(owners)], strict=True):
            yield int(owners[a]), hashes[a:b].tobytes()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine, settled = None, [], []
        for batch in batches:
            for part, done, hashes, owners in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    if at is not None:
                        yield _rows(list(settle(mine, settled)), [pa.int64(), pa.binary()], "owner long, hashes binary")
                    at, mine, settled = part, [], []
                (settled if done else mine).append((hashes, owners))
        if at is not None:
            yield _rows(list(settle(mine, settled)), [pa.int64(), pa.binary()], "owner long, hashes binary")

    dealt = source.mapInArrow(send, _PACKED).repartition(partitions(source.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(receive, "owner long, hashes binary")


def _slot(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(FILTER_BITS))


def filter_of(ids: DataFrame) -> Broadcast:
    """Bits of the slots of the ids of a one-column table: a filter of fixed size, broadcast, with false positives."""
    spark, slot = ids.sparkSession, _slot(ids.columns[0])
    words = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("s", F.lit(64)).cast("int"))).alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words.toLocalIterator():
        bits[row["w"]] = row["bits"]
    return spark.sparkContext.broadcast(bits.view(np.uint64))


def passing(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch, whose last column is the slot, that pass the filter; without that column."""
    s = batch.column(batch.num_columns - 1).to_numpy()
    keep = (bits[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1)
    return batch.filter(pa.array(keep.astype(bool))).select(list(range(batch.num_columns - 1)))


def only(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs without most of the rows whose id isn't among ids (a one-column table)."""
    sent = filter_of(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield passing(batch, sent.value)

    source = docs.where(F.col(id_col).isNotNull())
    return source.withColumn("_slot", _slot(id_col)).mapInArrow(run, source.schema)


def remove(docs: DataFrame, length: int = 50, first: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, `kept` (binary: the words kept, joined by one space; null where it is unchanged) and kept_sha256."""
    steps = levels(length, first)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = split_words(text.as_py())
                found = anchors(word_hashes(words), steps[0], length)[1] if len(steps) > 1 and len(words) >= length else np.zeros(0, np.uint64)
                rows.append((i, len(words), sha(words), found.tobytes()))
            yield _rows(rows, [pa.int64(), pa.int64(), pa.string(), pa.binary()], schema)

    schema = "id long, n_words long, sha string, anchors binary"
    described = written(source.mapInArrow(describe, schema), "described")
    earliest = described.where(F.col("n_words") >= length).groupBy("sha").agg(F.min("id").alias("earliest"))
    judged = written(described.join(earliest, "sha", "left").select("id", "n_words", "sha", F.coalesce("earliest", "id").alias("earliest"), "anchors"), "judged")
    standing = judged.where((F.col("n_words") >= length) & (F.col("id") == F.col("earliest")))

    def given(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = np.frombuffer(h.as_py(), np.uint64)
            yield i, found, found

    if len(steps) > 1:
        live = shared(standing.select("id", "anchors"), given)
        for k in range(1, len(steps) - 1):
            live = shared(wanted(source, live), _anchor_windows(steps, k, length))
        candidates = wanted(source, live)
    else:
        candidates = source.where(F.col("id").isNotNull()).select("id", "text", F.lit(None).cast("binary").alias("hashes"))

    repeated = written(first_owner(candidates, _full_windows(steps, length)), "repeated")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for i, text, blob in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = split_words(text.as_py())
                start = np.isin(window_hashes(word_hashes(words), length), np.frombuffer(blob.as_py(), np.uint64))
                gone = np.zeros(len(words) + 1, np.int64)
                at = np.flatnonzero(start)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + length, -1)
                keep = np.cumsum(gone)[:-1] == 0
                kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                rows.append((i, sha(words), len(words) - len(kept), b" ".join(kept), sha(kept)))
            yield _rows(rows, [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()], out)

    out = "id long, sha string, n_removed long, kept binary, kept_sha256 string"
    changed = wanted(source, repeated).mapInArrow(cut, out).dropDuplicates(["id", "sha"]).withColumnRenamed("id", "cut_id").withColumnRenamed("sha", "cut_sha")
    copy = (F.col("n_words") >= length) & (F.col("id") > F.col("earliest"))
    joined = judged.drop("anchors").join(changed, (F.col("id") == F.col("cut_id")) & (F.col("sha") == F.col("cut_sha")), "left")
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, F.lit(sha([]))).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def wanted(source: DataFrame, live: DataFrame) -> DataFrame:
    """(id, text, hashes) of the documents that still have hashes to look at."""
    live = live.groupBy(F.col("owner").alias("_owner")).agg(F.array_join(F.collect_list(F.hex("hashes")), "").alias("_hex"))
    texts = only(source, live.select(F.col("_owner").alias("id")), "id")
    return texts.join(live.hint("shuffle_hash"), F.col("id") == F.col("_owner")).select("id", "text", F.unhex("_hex").alias("hashes"))


def shared(source: DataFrame, windows: Windows) -> DataFrame:
    """(owner, hashes): an owner's hashes that any other owner has, too."""
    later = written(first_owner(source, windows), "later")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    repeated = later.select("hashes").mapInArrow(spread, "h long").distinct()

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for x in windows(batch) if len(x[1])]
            owners = np.repeat(np.array([x[0] for x in found], np.int64), [len(x[1]) for x in found])
            hashes = np.concatenate([*(x[1] for x in found), np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(hashes.view(np.int64))], ["owner", "h"])

    pairs = source.mapInArrow(mine, "owner long, h long").join(repeated, "h", "left_semi")
    grouped = pairs.groupBy("owner").agg(F.collect_list("h").alias("hs"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.asarray(h.values.to_numpy(), np.int64).tobytes() for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["owner", "hashes"])

    return grouped.mapInArrow(pack, "owner long, hashes binary")


def _anchor_windows(steps: list[int], k: int, length: int) -> Windows:
    """Anchors of level k of the windows whose anchor of the level before is still in question."""

    def windows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, text, blob in zip(*(batch.column(c) for c in range(3)), strict=True):
            h = word_hashes(split_words(text.as_py()))
            live = np.isin(anchors(h, steps[k - 1], length)[0], np.frombuffer(blob.as_py(), np.uint64))
            found = anchors(h, steps[k], length, live)[1]
            yield i.as_py(), found, found

    return windows


def _full_windows(steps: list[int], length: int) -> Windows:
    """Windows of the wanted length whose anchor of the level before is still in question."""

    def windows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, text, blob in zip(*(batch.column(c) for c in range(3)), strict=True):
            h = word_hashes(split_words(text.as_py()))
            full = route = window_hashes(h, length)
            if len(steps) > 1:
                route = anchors(h, steps[-2], length)[0]
                live = np.isin(route, np.frombuffer(blob.as_py(), np.uint64))
                full, route = full[live], route[live]
            found, at = np.unique(full, return_index=True)
            yield i.as_py(), found, route[at]

    return windows
