"""Shared helpers: tables, scratch space in the shared folder, text splitting and hashing inside tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators.stage import drop_folder, shared_folder

#: Fixed value: white space that separates words in every word-based operator here.
WORD = re.compile("[^\x20\x09-\x0d]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return shared_folder(spark, name)


#: Octets of an Arrow batch while intermediate results are written.
BATCH_OCTETS = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside send texts to Python in batches of BATCH_OCTETS, so that the buffers on both sides stay small."""
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, str(BATCH_OCTETS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


#: Folders that written() has made inside cleared().
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[list[str]]:
    """Folders that written() makes inside are removed at the end, but for those that are taken out of the list."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)
        for path in made:
            drop_folder(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends here and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    schema = df.schema
    with small_batches(spark):
        df.write.parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fresh_name(df: DataFrame, *others: str) -> str:
    """A column name that neither df nor others have, in whatever case."""
    taken, name = {c.lower() for c in (*df.columns, *others)}, "_added"
    while name in taken:
        name += "_"
    return name


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000, octets: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, of at most so many rows and octets (one row at least), so that what a task holds at once is small; memory is given back after each batch."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        before = np.r_[0, np.cumsum(size)]
        k = 0
        while True:
            stop = max(k + 1, min(k + rows, int(np.searchsorted(before, before[k] + octets, "right")) - 1)) if batch.num_rows else 0
            yield batch.slice(k, stop - k)
            k = stop
            if k >= batch.num_rows:
                break
        del batch
        pa.default_memory_pool().release_unused()


def trained_on(doc_id: Column) -> Column:
    """Labelled rows that may be learnt from: crc32 of the id's text mod 5 isn't 0. A null id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Coded:
    """Words of some texts: the distinct ones, the number of the one at each place, and where each text's words start, with the end."""

    distinct: pa.Array
    codes: np.ndarray
    starts: np.ndarray


def coded(texts: pa.Array, split: Callable[[pa.Array], pa.ListArray] = pc.ascii_split_whitespace) -> Coded:
    """Words of whole texts; null texts have none. The default cuts at exactly the white space named in WORD."""
    lists = split(pc.fill_null(texts, ""))
    words = lists.flatten().dictionary_encode()
    codes, starts = words.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    empty = pc.index(words.dictionary, "").as_py() if len(words.dictionary) else -1
    if empty >= 0:  # what a split leaves at the ends of a text
        keep = codes != empty
        codes, starts = codes[keep], np.r_[0, np.cumsum(keep)][starts]
    return Coded(words.dictionary, codes, starts)


def hashed_words(texts: pa.Array, lower: bool = False) -> list[np.ndarray]:
    """64-bit hashes of the words of each text; lower: of A to Z in lower case."""
    words = coded(pc.ascii_lower(texts) if lower else texts)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words.distinct.cast(pa.binary()).to_pylist()], np.uint64)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    return [hashes[a:b] for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True)]


class WordHashes(dict):
    """64-bit hash of each word, memoised; emptied when it holds `most` words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


#: Fixed value: odd multiplier of the polynomial hash of word sequences.
_BASE = 0x9E3779B97F4A7C15


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes, built by doubling; empty when there are fewer words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        acc, done, power, width = None, 0, h, 1
        while True:
            if n & width:
                if acc is None:
                    acc = power
                else:
                    m = min(len(acc), len(power) - done) if len(power) > done else 0
                    acc = acc[:m] * np.uint64(pow(_BASE, width, 1 << 64)) + power[done : done + m]
                done += width
            if done == n:
                return mixed(acc[: len(h) - n + 1] + np.uint64(n))
            m = len(power) - width
            if m <= 0:
                return np.zeros(0, np.uint64)
            power = power[:m] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width:]
            width *= 2


def split_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; bytes.split() cuts at exactly the white space named in WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
