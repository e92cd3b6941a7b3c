"""Alignment of two tokenizers' tokens over a corpus, with an identity map as the fast path.

Both tokenizers cover the bytes of a space and the text. Bytes at which tokens of both end cut the text into groups;
tokens whose bytes overlap are linked. A pair of linked ids counts once in each document.

Most groups are one token of each with the same bytes. A table from each A id to the B id of the same bytes is made
once, and pairs of that table are counted in one vector as long as A's vocabulary in each task; only the other pairs go
through a shuffle, summed over a batch of documents before it. A batch then asks once for each of its pairs and gives
its documents their sums, so a pair that all documents hold costs one row a batch.

No token of either goes across a space before which no space stands, so texts without runs of spaces are cut there, and
each distinct word of a batch is encoded and aligned once. All other texts are one word each.

Edge cases: texts that are null or empty, or whose bytes one of the tokenizers changes, have no tokens and get zeros;
strings of special tokens are plain text; very long texts are taken whole, in batches of their own; repeated rows count
as documents of their own, null ids are kept; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.bpe import binaries, irregular, regrouped
from lakeops.llm.common import written
from lakeops.llm.common import sliced as cut_to_size
from lakeops.llm.token_files import LibraryEncoder

#: Fixed value: stands for a space in pieces.
_MARK = "▁"

#: Words that are encoded in one call.
_CALL = 500


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest follow from 256 on, in order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Side:
    """Bytes of each id, and their number."""

    tokens: pa.Array
    sizes: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> Side:
        return Side(binaries(tokens), np.array([len(t) for t in tokens], np.int64))

    def joined(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Bytes of runs of so many ids each."""
        return regrouped(pa.concat_arrays([self.tokens.take(pa.array(ids))]), np.r_[0, np.cumsum(counts)])


@dataclass
class Aligned:
    """Distinct words of a batch: ids of both sides, flat, with counts a word; groups and links a word; the pairs of links, flat; text of the groups, each ended by a semicolon."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    groups: pa.Array
    good: np.ndarray


class Aligner:
    """A: a byte-level BPE file of the tokenizers library. B: a sentencepiece model that adds a space before a text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.library = LibraryEncoder(a_path, plain=True)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocabulary = Tokenizer.from_file(a_path).get_vocab(with_added_tokens=True)
        letters = byte_of_letter()
        names = [""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            names[i] = name
        self.a = Side.of([bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names])
        model = self.pieces
        self.b = Side.of([bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(_MARK, " ").encode() for i in range(model.get_piece_size())])
        self.begins = np.array([model.id_to_piece(i).startswith(_MARK) for i in range(model.get_piece_size())])
        self.same = self.identity()
        numbers = [str(i) for i in range(max(len(self.a.sizes), len(self.b.sizes)))]
        self.numbers = binaries([(n + end).encode() for n in numbers for end in ",|;"])

    def identity(self) -> np.ndarray:
        """B id of the same bytes for each A id, -1 without one; of a piece and a byte of the same bytes the piece."""
        ids: dict[bytes, int] = {}
        for i, token in enumerate(self.b.tokens.to_pylist()):
            if token not in ids or self.pieces.is_byte(ids[token]):
                ids[token] = i
        return np.array([ids.get(token, -1) for token in self.a.tokens.to_pylist()], np.int64)

    @staticmethod
    def whole(text: str) -> bool:
        """Whether a text can't be cut at its spaces."""
        return irregular(text) or "  " in text or text[0] == " " or text[-1] == " " or _MARK in text

    def of_a(self, words: list[str], alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each word after a space; alone: which hold spaces."""
        cut = self.library.many_after_space([w for w, x in zip(words, alone.tolist(), strict=True) if not x])
        packed = pa.concat_arrays([cut, binaries([self.library.encode(" " + w) for w, x in zip(words, alone.tolist(), strict=True) if x])])
        n = len(cut)
        packed = packed.take(pa.array(np.where(alone, n + np.cumsum(alone) - 1, np.cumsum(~alone) - 1)))
        counts = pc.binary_length(packed).to_numpy().astype(np.int64) // 4
        offsets = np.frombuffer(packed.buffers()[1], np.int32)
        return np.frombuffer(packed.buffers()[2] or b"", "<u4", count=counts.sum(), offset=int(offsets[packed.offset])).astype(np.int64), counts

    def of_b(self, words: list[str], alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = [w for w, x in zip(words, alone.tolist(), strict=True) if not x]
        flat, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(plain), _CALL):
            ids = np.array(self.pieces.encode(" ".join(plain[k : k + _CALL])), np.int64)
            flat.append(ids)
            counts.append(np.diff(np.r_[np.flatnonzero(self.begins[ids]), len(ids)]))
        cut, size = np.concatenate(flat), np.concatenate(counts)
        assert len(size) == len(plain)
        if not alone.any():
            return cut, size
        texts = [np.array(self.pieces.encode(w), np.int64) for w, x in zip(words, alone.tolist(), strict=True) if x]
        parts = iter(np.split(cut, np.cumsum(size)[:-1])) if len(size) else iter(())
        rest = iter(texts)
        ordered = [next(rest) if x else next(parts) for x in alone.tolist()]
        return np.concatenate(ordered), np.array([len(x) for x in ordered], np.int64)

    def align(self, words: list[str], alone: np.ndarray) -> Aligned:
        """Words that one side changes get no tokens, and good is false."""
        (a, n_a), (b, n_b) = self.of_a(words, alone), self.of_b(words, alone)
        meant = binaries([b" " + w.encode() for w in words])
        good = (pc.equal(self.a.joined(a, n_a), meant).to_numpy(zero_copy_only=False) & pc.equal(self.b.joined(b, n_b), meant).to_numpy(zero_copy_only=False)).astype(bool)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        end_a, end_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        ends, common = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        word_a = np.repeat(np.arange(len(words)), n_a)
        last_a, last_b = np.searchsorted(end_a, common), np.searchsorted(end_b, common)
        n_groups = np.bincount(word_a[last_a], minlength=len(words))
        n_links = np.bincount(word_a[at_a], minlength=len(words))
        # a comma after an id, a bar after a group's last of A, a semicolon after its last of B
        closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        closes_a[last_a], closes_b[last_b] = 1, 2
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        texts = self.numbers.take(pa.array(np.r_[3 * a + closes_a, 3 * b + closes_b][order]))
        stops = np.r_[0, np.cumsum(n_a + n_b)]
        return Aligned(n_a, n_b, n_groups, n_links, (a[at_a] << 32) | b[at_b], regrouped(pa.concat_arrays([texts]), stops), good)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of so many each."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


#: Rows of documents, then one of their batch; a row of a task's vector at its end.
_PARTS = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words binary, links binary, sizes binary, pairs binary, docs binary, same binary, ids array<long>, counts array<long>"
_DOC = ["batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "words"]


def _parts(made: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    n = len(next(iter(made.values())))
    return pa.record_batch([made.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in schema], schema=schema)


def _schema() -> pa.Schema:
    kind = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kind[t]) for name, t in (x.split(" ") for x in _PARTS.split(", "))])


def _batch(found: Aligner, batch: int, ids: pa.Array, texts: pa.Array, vector: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a batch of documents, which adds to the vector of pairs of the identity map."""
    texts = pc.fill_null(texts, "")
    listed = texts.to_pylist()
    n = len(listed)
    empty = np.array([not t for t in listed], bool)
    alone = np.array([bool(t) and found.whole(t) for t in listed], bool)
    lists = pc.split_pattern(texts.filter(pa.array(~alone & ~empty)), " ")
    sizes = np.zeros(n, np.int64)
    sizes[~alone & ~empty] = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    sizes[alone] = 1
    doc = np.repeat(np.arange(n), sizes)
    words = np.empty(len(doc), np.int64)
    inner = ~alone[doc]
    words[inner] = coded.indices.to_numpy()
    words[~inner] = len(distinct) + np.arange(alone.sum())
    got = found.align([*distinct, *(t for t, x in zip(listed, alone.tolist(), strict=True) if x)], np.r_[np.zeros(len(distinct), bool), np.ones(alone.sum(), bool)])
    spoilt = np.zeros(n, bool)
    spoilt[doc[~got.good[words]]] = True  # the words of the rest of the text have no tokens then, either
    words, doc = words[~spoilt[doc]], doc[~spoilt[doc]]
    counts = np.bincount(doc, minlength=n)
    total = lambda per_word: np.bincount(doc, per_word[words], minlength=n).astype(np.int64)
    stops = np.r_[0, np.cumsum(counts)]
    text = regrouped(pa.concat_arrays([got.groups.take(pa.array(words))]), stops)
    shas = [hashlib.sha256(t[:-1]).hexdigest() if t else "" for t in text.to_pylist()]
    packed = words.astype("<i4")
    first = np.cumsum(got.n_links) - got.n_links
    pairs, link = np.unique(got.pairs, return_inverse=True)
    held = np.unique(doc * len(got.n_a) + words)  # each word of a document once
    held_doc, held_word = held // max(1, len(got.n_a)), held % max(1, len(got.n_a))
    places = _expanded(first[held_word], got.n_links[held_word])
    once = np.unique(np.repeat(held_doc, got.n_links[held_word]) * max(1, len(pairs)) + link[places])
    docs = np.bincount(once % max(1, len(pairs)), minlength=len(pairs))
    same = found.same[pairs >> 32] == (pairs & 0xFFFFFFFF)
    np.add.at(vector, pairs[same] >> 32, docs[same])
    yield _parts(
        {
            "batch": pa.array(np.full(n, batch)), "doc_id": ids, "n_a": pa.array(total(got.n_a)), "n_b": pa.array(total(got.n_b)), "n_groups": pa.array(total(got.n_groups)),
            "n_links": pa.array(total(got.n_links)), "groups_sha256": pa.array(shas, pa.string()), "words": binaries([packed[a:b].tobytes() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]),
        },
        schema,
    )
    place = np.where(same, np.cumsum(same) - 1 + np.count_nonzero(~same), np.cumsum(~same) - 1)  # pairs of the identity map come last
    packed = {"links": place[link].astype("<i4"), "sizes": got.n_links.astype("<i4"), "pairs": pairs[~same].astype("<i8"), "docs": docs[~same].astype("<i8"), "same": pairs[same].astype("<i8")}
    yield _parts({"batch": pa.array([batch]), **{c: binaries([x.tobytes()]) for c, x in packed.items()}}, schema)


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", octets: int = 4 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; see pair_counts() for the pairs. octets: of a batch."""
    parts = encoded(df, a_path, b_path, id_col, text_col, octets)
    counts = pair_counts(parts, a_path, b_path)
    return summed(parts, counts)


def encoded(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", octets: int = 4 << 20) -> DataFrame:
    """Written rows of documents, of their batches and of the tasks' vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, schema = aligner(a_path, b_path), _schema()
        vector, number = np.zeros(len(found.a.sizes), np.int64), TaskContext.get().partitionId() << 32
        for batch in cut_to_size(batches, 1000, octets):
            if batch.num_rows:
                yield from _batch(found, number, batch["doc_id"], batch["text"], vector, schema)
                number += 1
        used = np.flatnonzero(vector)
        if len(used):
            yield _parts({"ids": pa.array([used], pa.list_(pa.int64())), "counts": pa.array([vector[used]], pa.list_(pa.int64()))}, schema)

    return written(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PARTS), "alignment")


@dataclass
class PairCounts:
    """In how many documents pairs of ids are linked. same: a, b, n of pairs of the identity map, at most one for each A id. others: a, b, n of the rest. best: a, most; the largest n of each A id."""

    same: DataFrame
    others: DataFrame
    best: DataFrame


def pair_counts(parts: DataFrame, a_path: str, b_path: str) -> PairCounts:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, docs in zip(batch["pairs"].to_pylist(), batch["docs"].to_pylist(), strict=True):
                pair, n = np.frombuffer(pairs, "<i8"), np.frombuffer(docs, "<i8")
                yield pa.record_batch({"a": pa.array(pair >> 32), "b": pa.array(pair & 0xFFFFFFFF), "n": pa.array(n)})

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = aligner(a_path, b_path).same
            yield pa.record_batch({"a": batch["a"], "b": pa.array(same[batch["a"].to_numpy()]), "n": batch["n"]})

    vectors = parts.where("ids IS NOT NULL").select(F.explode(F.arrays_zip("ids", "counts")).alias("x"))
    same = written(vectors.groupBy(F.col("x.ids").alias("a")).agg(F.sum("x.counts").alias("n")).mapInArrow(named, "a long, b long, n long"), "same")
    rows = parts.where("pairs IS NOT NULL").select("pairs", "docs").mapInArrow(spread, "a long, b long, n long")
    others = written(rows.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    best = same.unionByName(others).groupBy("a").agg(F.max("n").alias("most"))
    return PairCounts(same, others, best)


def summed(parts: DataFrame, counts: PairCounts) -> DataFrame:
    """n_best and count_sum of each document. The counts of the identity map and the best of each A id are as many as A's vocabulary has ids, and go to all tasks; the counts of other pairs go to the batches that hold them."""
    spark = parts.sparkSession
    same, best = counts.same.toArrow(), counts.best.toArrow()  # a row for each id of the vocabulary at most
    small = spark.sparkContext.broadcast(tuple(x.to_numpy() for x in (same["a"], same["b"], same["n"], best["a"], best["most"])))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs in zip(batch["batch"].to_pylist(), batch["pairs"].to_pylist(), strict=True):
                pair = np.frombuffer(pairs, "<i8")
                yield pa.record_batch({"batch": pa.array(np.full(len(pair), number)), "a": pa.array(pair >> 32), "b": pa.array(pair & 0xFFFFFFFF)})

    def told(docs: pa.Table, told: pa.Table) -> pa.Table:
        a, b, n, best_a, most = small.value
        top = np.zeros(max(best_a.max(initial=-1), 0) + 1, np.int64)
        top[best_a] = most
        known = told.filter(pc.is_valid(told["a"]))
        other = (known["a"].to_numpy() << 32) | known["b"].to_numpy()
        pairs, found = np.r_[other, (a << 32) | b], np.r_[known["n"].to_numpy(), n]
        order = np.argsort(pairs)
        pairs, found = pairs[order], found[order]
        row = told.filter(pc.is_valid(told["links"])).slice(0, 1).to_pylist()[0]
        named = np.r_[np.frombuffer(row["pairs"], "<i8"), np.frombuffer(row["same"], "<i8")]
        links, sizes = named[np.frombuffer(row["links"], "<i4")], np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        count = found[np.searchsorted(pairs, links)] if len(links) else np.zeros(0, np.int64)
        word = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.zeros(len(sizes), np.int64)
        np.add.at(sums, word, count)
        bests = np.bincount(word[count == top[links >> 32]], minlength=len(sizes)) if len(links) else np.zeros(len(sizes), np.int64)
        words = [np.frombuffer(w, "<i4") for w in docs["words"].to_pylist()]
        totals = {"n_best": [int(bests[w].sum()) for w in words], "count_sum": [int(sums[w].sum()) for w in words]}
        return pa.table({**{c: docs[c] for c in _DOC if c not in ("batch", "words")}, **{c: pa.array(v, pa.int64()) for c, v in totals.items()}})

    docs = parts.where("words IS NOT NULL").select(*_DOC)
    batches = parts.where("links IS NOT NULL")
    questions = batches.select("batch", "pairs").mapInArrow(asked, "batch long, a long, b long")
    none = F.lit(None)
    packed = ["links", "sizes", "pairs", "same"]
    answers = questions.join(counts.others, ["a", "b"]).select("batch", "a", "b", "n", *(none.cast("binary").alias(c) for c in packed))
    tables = batches.select("batch", *(none.cast("long").alias(c) for c in ("a", "b", "n")), *packed)
    out = docs.groupBy("batch").cogroup(answers.unionByName(tables).groupBy("batch")).applyInArrow(told, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
