"""Byte-level BPE: exact merges in linear time.

Bytes are mapped to Latin-1 so that pyahocorasick finds every vocabulary token in a piece in one pass. From the
longest match at each place the encoder goes back to shorter ones, or a token back, whenever two neighbours would not
stay side by side under the merges. Whether two tokens are compatible is decided once by merging their bytes, and kept.
A sequence in which all neighbours are compatible is the one the merges give, so the result is exact.

Edge cases: null texts count as empty and give no ids; very long texts are encoded piece by piece; repeated rows each
give their own row; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import sliced, text_or_empty

#: White space other than the space and the line feed.
_OTHER_SPACE = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = [a + b + c for a in " \n" for b in " \n" for c in " \n"]


def irregular(text: str) -> bool:
    """Whether white space may come in runs that a cut at a space would change: three or more, two at the end, or of another kind."""
    return any(x in text for x in _RUNS) or any(x in text for x in _OTHER_SPACE) or (len(text) > 1 and text[-1].isspace() and text[-2].isspace())


class Memo(dict):
    """What `make` gives for each key, kept for keys of at most 64 characters; emptied when it holds `most`."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def regrouped(values: pa.Array, stops: np.ndarray) -> pa.Array:
    """Neighbouring values of a fresh array of binaries as one each; stops: where the groups begin, with the end."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[: len(values) + 1] if len(values) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(stops) - 1, [None, pa.py_buffer(offsets[stops].astype(np.int32)), values.buffers()[2] or pa.py_buffer(b"")])


class Known:
    """Packed ids of chunks with a space before them, kept as Arrow arrays from batch to batch; begun anew when there are more than `most`."""

    def __init__(self, make: Callable[[list[str]], pa.Array], most: int = 800_000):
        self.make, self.most = make, most
        self.chunks, self.ids = pa.array([], pa.string()), binaries([])

    def __call__(self, chunks: pa.Array) -> pa.Array:
        at = pc.index_in(chunks, value_set=self.chunks)
        new = chunks.filter(at.is_null())
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[at.is_null().to_numpy(zero_copy_only=False)] = len(self.chunks) + np.arange(len(new))
        ids = pa.concat_arrays([self.ids, self.make(new.to_pylist())])
        if len(ids) <= self.most:
            self.chunks, self.ids = pa.concat_arrays([self.chunks, new]), ids
        else:
            self.chunks, self.ids = new, ids.slice(len(self.ids))
        return ids.take(pa.array(place))


def chunked(texts: pa.Array, after_space: Callable[[pa.Array], pa.Array], alone: Callable[[str], bytes], whole: Callable[[str], bool] = irregular, end: bytes = b"") -> pa.Array:
    """Packed ids of each text, `end` after each.

    A chunk starts at a space. Where white space is regular, the splitting patterns of byte-level BPE begin a match
    there, so chunks can be encoded apart: each distinct one once, by `after_space`, which gives the packed ids of the
    chunks with a space before them; the ids of the texts are then put together by number. Texts that `whole` names are
    encoded in one by `alone`, as are the first chunks, which have no space before them.
    """
    apart = np.array([whole(t) for t in texts.to_pylist()], bool)
    lists = pc.split_pattern(texts.filter(pa.array(~apart)), " ")
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts, chunks = starts - starts[0], lists.flatten()
    n = len(lists)
    first = np.zeros(len(chunks), bool)
    first[starts[:-1]] = True
    later = chunks.filter(pa.array(~first)).dictionary_encode()
    heads = chunks.filter(pa.array(first)).dictionary_encode()
    n_later, n_heads = len(later.dictionary), len(heads.dictionary)
    codes = np.empty(len(chunks) + n, np.int64)  # one more for each end
    stops = starts[1:] + np.arange(n)
    at = np.ones(len(codes), bool)
    at[stops] = False
    inner = np.empty(len(chunks), np.int64)
    inner[first], inner[~first] = heads.indices.to_numpy() + n_later, later.indices.to_numpy()
    codes[at], codes[stops] = inner, n_later + n_heads
    values = pa.concat_arrays([after_space(later.dictionary), binaries([*map(alone, heads.dictionary.to_pylist()), end])])
    regular = regrouped(values.take(pa.array(codes)), np.r_[0, stops + 1])
    if not apart.any():
        return regular
    others = binaries([alone(t) + end for t in texts.filter(pa.array(apart)).to_pylist()])
    place = np.where(apart, n + np.cumsum(apart) - 1, np.cumsum(~apart) - 1)
    return pa.concat_arrays([regular, others]).take(pa.array(place))


class BytePairEncoder:
    """Encodes pieces of bytes by a table of ranks, as repeated merging of the lowest-ranked neighbours would."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.findall = ranks, regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        reachable = {token: rank for token, rank in ranks.items() if len(token) == 1 or self.merged(token) == [rank]}
        self.pieces = Memo(self.piece, 60_000)
        self.after_space = Known(lambda chunks: binaries([self.encode(" " + c) for c in chunks]))
        self.automaton = ahocorasick.Automaton()
        for token, rank in reachable.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.size = [0] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.shorter = {rank: next((reachable[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in reachable), -1) for token, rank in reachable.items()}

    def merged(self, piece: bytes) -> list[int]:
        """The plain definition; used for single tokens and for pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two side by side; memoised by the callers in `compatible`."""
        known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        if len(self.compatible) >= 500_000:
            self.compatible.clear()
        self.compatible[left, right] = known
        return known

    def piece(self, piece: str) -> bytes:
        octets = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(octets)
        return array("I", self.backtracked(octets.decode("latin-1")) if whole is None else [whole]).tobytes()

    def backtracked(self, latin: str) -> list[int]:
        size, shorter, known, fits, n = self.size, self.shorter, self.compatible.get, self.fits, len(latin)
        longest = [-1] * n
        for end, (token, width) in self.automaton.iter(latin):
            longest[end + 1 - width] = token  # ends ascend, so the longest stays
        dead = bytearray(n + 1)  # places from which no encoding goes on
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + size[token]
            if not dead[end]:
                fit = True
                if out:
                    fit = known((out[-1], token))
                    if fit is None:
                        fit = fits(out[-1], token)
                if fit:
                    out.append(token)
                    at = end
                    if at < n:
                        token = longest[at]
                    continue
            token = shorter[token]
            while token < 0:  # nothing shorter: give back a token
                dead[at] = 1
                last = out.pop()
                at -= size[last]
                token = shorter[last]
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.findall(text)))


@lru_cache(maxsize=1)
def _loaded(path: str, pattern: str) -> tuple[BytePairEncoder, pa.Array]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoder = BytePairEncoder(ranks, pattern)
    vocabulary = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        vocabulary[rank] = token
    return encoder, binaries(vocabulary)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and `ids` (binary, little-endian 32-bit) of every text. ranks_path: a file that each executor has, as part of an installed package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _loaded(ranks_path, pattern)
        for batch in sliced(batches, 2000):
            yield pa.RecordBatch.from_arrays([batch.column(0), chunked(batch.column(1), encoder.after_space, encoder.encode)], [id_col, "ids"])

    source = df.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, ids binary")


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Adds `decoded` (binary) to the ids of encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, vocabulary = _loaded(ranks_path, pattern)
        for batch in sliced(batches):
            ids = batch.column(1).to_pylist()
            n = np.cumsum([0, *(len(x) // 4 for x in ids)])
            octets = vocabulary.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, regrouped(octets, n)], [id_col, "ids", "decoded"])

    source = df.select(id_col, "ids")
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, ids binary, decoded binary")


def n_tokens(ids: str | Column = "ids") -> Column:
    return (F.octet_length(ids) / 4).cast("long")
