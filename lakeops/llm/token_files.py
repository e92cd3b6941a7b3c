"""Token-id files with keyed access through a minimal perfect hash.

A store is a folder of shards in ascending key order, written through Spark so that it can lie in any store that Spark
reaches. A shard is one index row and then its raw ids (little-endian, 16 bits where the vocabulary allows, else 32) in
rows of equal size, the blocks, so that a range of ids can be read by itself; columns of the index are read without any
payload. The index is a minimal perfect hash of the shard's keys: the displacement of the key's bucket gives its slot,
and the slot holds a 32-bit fingerprint of the key and the offset and length of its document. A lookup reads one
displacement, one slot and the blocks that the document lies in, whatever the size of the shard.

Edge cases: null texts count as empty and hold the end id alone; strings of special tokens are encoded as the library
does; a null key is stored, first in order, and not indexed; a repeated key is stored once per row in order of its
text's hash, and the index leads to the first; shards are cut at a number of ids, so a very long text has a shard of its
own; an empty table gives a store without shards; extra columns are dropped.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeops.llm.bpe import Known, binaries, chunked, irregular
from lakeops.llm.common import mixed, partitions, sliced, text_or_empty

#: Ids after which a shard is cut.
SHARD_IDS = 4_000_000

#: Ids in a block of payload.
BLOCK_IDS = 1 << 16

#: block: -1 in the index row. low, high: smallest and largest key. slots: offset (64 bits) and length (32 bits) of each.
_SHARD = "shard long, block int, n_docs long, n_ids long, width int, low long, high long, keys binary, known binary, lengths binary, displacements binary, fingerprints binary, offsets binary, sizes binary, payload binary"


def _hashed(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(keys.astype(np.int64).view(np.uint64) ^ mixed(np.asarray(seed, np.uint64) + np.uint64(0x632BE59BD9B4E019)))


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hashed(keys, 0xF1) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: buckets of about two keys, the fullest placed first; a bucket of one takes a free slot outright, so that enough slots are free for the others."""

    def __init__(self, displacements: np.ndarray, n: int):
        self.displacements, self.n = displacements, n

    @staticmethod
    def built(keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        n_buckets = max(1, n // 2)
        bucket = (_hashed(keys, 0xB0) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        sizes = np.diff(first)
        displacements = np.zeros(n_buckets, "<i4")
        taken = np.zeros(n, bool)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[sizes[by_size] > 1]:
            members = keys[order[first[b] : first[b + 1]]]
            for d in range(1, 1 << 30, 32):  # 32 displacements at a time
                slots = np.sort((_hashed(members, np.arange(d, d + 32, dtype=np.uint64)[:, None]) % np.uint64(n)).astype(np.int64), axis=1)
                good = np.flatnonzero(~taken[slots].any(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1))
                if len(good):
                    taken[slots[good[0]]] = True
                    displacements[b] = d + good[0]
                    break
        free = np.flatnonzero(~taken)
        for slot, b in zip(free.tolist(), by_size[sizes[by_size] == 1].tolist(), strict=False):
            displacements[b] = -slot - 1
        return PerfectHash(displacements, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        bucket = (_hashed(keys, 0xB0) % np.uint64(len(self.displacements))).astype(np.int64)
        d = self.displacements[bucket].astype(np.int64)
        placed = (_hashed(keys, np.maximum(d, 0).astype(np.uint64)) % np.uint64(self.n)).astype(np.int64)
        return np.where(d < 0, -d - 1, placed)


class LibraryEncoder:
    """Packed ids by the tokenizers library. Distinct chunks are encoded many in a call, with a space before each: they hold no other, so a token that begins with a space begins a chunk. plain: strings of special tokens are text like any other."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = plain
        self.ids_of = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.many = lambda texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        self.after_space = Known(self.many_after_space)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.begins = np.zeros(max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1, bool)
        for token, i in tokenizer.get_vocab().items():
            self.begins[i] = token.startswith("\u0120")  # stands for the space in byte-level vocabularies

    def whole(self, text: str) -> bool:
        """Texts that hold a special token's string are encoded in one, too, as the library finds it wherever it stands."""
        return irregular(text) or any(x in text for x in self.special)

    def encode(self, text: str) -> bytes:
        return array("I", self.ids_of(text)).tobytes()

    def many_after_space(self, chunks: list[str]) -> pa.Array:
        odd = np.array([not c or c[0] == "\n" or c[-1] == "\n" for c in chunks], bool)  # white space at an end would run into a neighbour's
        plain = [c for c, o in zip(chunks, odd.tolist(), strict=True) if not o]
        ids, cuts, size = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], 0
        groups = [" " + " ".join(plain[k : k + 500]) for k in range(0, len(plain), 500)]
        for k in range(0, len(groups), 20):
            for found in self.many(groups[k : k + 20]):
                one = np.array(found.ids, "<u4")
                ids.append(one)
                cuts.append(np.flatnonzero(self.begins[one]) + size)
                size += len(one)
        starts = np.concatenate([*cuts, [size]]) * 4
        assert len(starts) == len(plain) + 1
        packed = pa.Array.from_buffers(pa.binary(), len(plain), [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.concatenate(ids))])
        if not odd.any():
            return packed
        others = binaries([self.encode(" " + c) for c, o in zip(chunks, odd.tolist(), strict=True) if o])
        return pa.concat_arrays([packed, others]).take(pa.array(np.where(odd, len(plain) + np.cumsum(odd) - 1, np.cumsum(~odd) - 1)))

    def pack_all(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        return chunked(texts, self.after_space, self.encode, self.whole, end)


@lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write(df: DataFrame, path: str, tokenizer_path: str, end_id: int, vocabulary_size: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, adds end_id to each, and writes the store to `path`."""
    width = 2 if vocabulary_size <= 1 << 16 else 4
    kind = np.dtype(f"<u{width}")

    def shard(number: int, keys: list, docs: list[bytes]) -> Iterator[pa.RecordBatch]:
        known = np.array([k is not None for k in keys], bool)
        numbers = np.array([k or 0 for k in keys], "<i8")
        distinct, place = np.unique(numbers[known], return_index=True)
        places = np.flatnonzero(known)[place]
        lengths = np.array([len(d) // 4 for d in docs], "<u4")
        before = np.cumsum(lengths, dtype=np.int64) - lengths
        index = PerfectHash.built(distinct)
        slot = index.slots(distinct) if len(distinct) else np.zeros(0, np.int64)
        fingerprints, offsets, sizes = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<i8"), np.zeros(len(distinct), "<u4")
        fingerprints[slot], offsets[slot], sizes[slot] = _fingerprints(distinct), before[places], lengths[places]
        ids = np.frombuffer(b"".join(docs), "<u4").astype(kind)
        low, high = (int(distinct[0]), int(distinct[-1])) if len(distinct) else (None, None)
        arrays = (numbers, known, lengths, index.displacements, fingerprints, offsets, sizes)
        rows = [[number, -1, len(keys), len(ids), width, low, high, *(x.tobytes() for x in arrays), None]]
        rows += [[number, k // BLOCK_IDS, *[None] * 12, ids[k : k + BLOCK_IDS].tobytes()] for k in range(0, len(ids), BLOCK_IDS)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    end = array("I", [end_id]).tobytes()
    names = [x.split()[0] for x in _SHARD.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer_path)
        number = TaskContext.get().partitionId() << 32
        keys: list = []
        docs: list[bytes] = []
        size = 0
        for batch in sliced(batches, 4000):
            for key, packed in zip(batch.column(0).to_pylist(), encoder.pack_all(batch.column(1), end).to_pylist(), strict=True):
                size_of = len(packed) // 4
                if keys and size + size_of > SHARD_IDS:
                    yield from shard(number, keys, docs)
                    number, keys, docs, size = number + 1, [], [], 0
                keys.append(key)
                docs.append(packed)
                size += size_of
        if keys:
            yield from shard(number, keys, docs)

    source = df.select(F.col(id_col).cast("long").alias("key"), text_or_empty(text_col).alias("text"))
    ordered = source.repartitionByRange(partitions(df.sparkSession), F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(run, _SHARD).write.option("compression", "zstd").parquet(path)


class Index:
    """The index row of one shard: documents by place, or by key through the perfect hash."""

    def __init__(self, row: dict):
        self.keys, self.known = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["known"], bool)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.fingerprints = np.frombuffer(row["fingerprints"], "<u4")
        self.offsets, self.sizes = np.frombuffer(row["offsets"], "<i8"), np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.hash = PerfectHash(np.frombuffer(row["displacements"], "<i4"), len(self.offsets))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the shard has each key (keys of its range; others pass with a chance of 2^-32), and where its first document lies: offset and length."""
        if not len(self.offsets):
            return np.zeros(len(keys), bool), *[np.zeros(len(keys), np.int64)] * 2
        slot = self.hash.slots(keys)
        return self.fingerprints[slot] == _fingerprints(keys), self.offsets[slot], self.sizes[slot]

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Exactly, from the stored keys, which ascend after those that are null."""
        stored = self.keys[self.known]
        at = np.minimum(np.searchsorted(stored, keys), max(0, len(stored) - 1))
        return stored[at] == keys if len(stored) else np.zeros(len(keys), bool)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SHARD).parquet(path)


def indexes(store: DataFrame) -> DataFrame:
    return store.where("block < 0").drop("block", "payload")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian 32-bit).

    Documents with a key are fetched by it; only rows that repeat a key and rows without one are fetched by place. The
    rows of a shard meet in one task, its index first; a shard has SHARD_IDS ids or one document.
    """
    store = open_store(spark, path)

    def documents(index: Index, number: int, first: int, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        start, size = index.starts.copy(), index.lengths.copy()
        fresh = np.zeros(len(start), bool)
        fresh[np.unique(np.where(index.known, index.keys, -1), return_index=True)[1]] = True
        use = np.flatnonzero(index.known & fresh)
        start[use], size[use] = index.find(index.keys[use])[1:]
        for k in range(0, len(start), 2000):
            a, n = start[k : k + 2000], size[k : k + 2000]
            packed = pa.array([ids[x:y].astype("<u4").tobytes() for x, y in zip(a.tolist(), (a + n).tolist(), strict=True)], pa.binary())
            keys = pa.array(index.keys[k : k + 2000], pa.int64(), mask=~index.known[k : k + 2000])
            yield pa.RecordBatch.from_arrays([keys, pa.array(a + first), pa.array(n), packed], ["doc_id", "start", "n_tokens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, blocks = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if row["block"] < 0:
                    if head:
                        yield from documents(Index(head), head["shard"], head["first"], np.frombuffer(b"".join(blocks), f"<u{head['width']}"))
                    head, blocks = row, []
                else:
                    blocks.append(row["payload"])
        if head:
            yield from documents(Index(head), head["shard"], head["first"], np.frombuffer(b"".join(blocks), f"<u{head['width']}"))

    together = store.join(starts(store), "shard").repartition(partitions(spark), "shard").sortWithinPartitions("shard", "block")
    return together.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def starts(store: DataFrame) -> DataFrame:
    """(shard, first): ids before each shard, summed within each written partition, then over partitions, of which there are as many as shuffle partitions."""
    sizes = store.where("block < 0").select("shard", "n_ids", F.shiftright("shard", 32).alias("part"))
    before_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("within", within).join(before_part.select("part", "before"), "part").select("shard", (F.col("before") + F.col("within")).alias("first"))


def lookup(store: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of the wanted keys: doc_id, ids; keys that aren't there give no row.

    Keys find their shards by an equi-join on bins of the key as wide as the widest shard, so that a shard lies in two
    bins at most; each shard's index is then asked for the keys in its range, and only the blocks that hold their
    documents are fetched.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                index, wanted = Index(row), np.array(row["wanted"], np.int64)
                there, offset, size = index.find(wanted)
                there &= index.has(wanted)
                columns = [np.full(there.sum(), row["shard"]), wanted[there], offset[there], size[there], np.full(there.sum(), row["width"], np.int32)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["shard", "key", "at", "n", "width"])

    ranges = store.where("block < 0 AND low IS NOT NULL").select("shard", "low", "high")
    widest = ranges.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0
    shift = int(widest).bit_length()
    binned = ranges.withColumn("bin", F.explode(F.array_distinct(F.array(F.shiftright("low", shift), F.shiftright("high", shift)))))
    wanted = keys.select(F.col(id_col).cast("long").alias("key")).where(F.col("key").isNotNull()).distinct().withColumn("bin", F.shiftright("key", shift))
    dealt = wanted.join(binned, "bin").where(F.col("key").between(F.col("low"), F.col("high")))
    asked = dealt.groupBy("shard", F.pmod(F.xxhash64("key"), F.lit(16)).alias("part")).agg(F.collect_set("key").alias("wanted"))
    found = indexes(store).join(asked.drop("part"), "shard").mapInArrow(find, "shard long, key long, at long, n long, width int")
    last = F.floor((F.col("at") + F.greatest(F.col("n"), F.lit(1)) - 1) / BLOCK_IDS).cast("int")
    blocks = found.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / BLOCK_IDS).cast("int"), last)))
    first = F.greatest(F.lit(0), F.col("at") - F.col("block") * BLOCK_IDS)
    stop = F.least(F.lit(BLOCK_IDS), F.col("at") + F.col("n") - F.col("block") * BLOCK_IDS)
    part = F.col("payload").substr((first * F.col("width") + 1).cast("int"), ((stop - first) * F.col("width")).cast("int"))
    pieces = store.where("block >= 0").select("shard", "block", "payload").join(blocks, ["shard", "block"]).select("key", "width", F.struct("block", part.alias("ids")).alias("piece"))

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(p["ids"] for p in pieces) for pieces in batch.column(2).to_pylist()]
            ids = [np.frombuffer(x, f"<u{w}").astype("<u4").tobytes() for x, w in zip(ids, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return pieces.groupBy("key", "width").agg(F.array_sort(F.collect_list("piece")).alias("pieces")).mapInArrow(widened, "doc_id long, ids binary")
