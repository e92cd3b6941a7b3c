"""Similarity join of texts on the Jaccard similarity of their word shingles, exact.

Method: prefixes of token combinations. Of each set, a sample of its smallest hashes is compared first: two sets that
are similar enough must share a known number of sampled tokens, so a set with fewer shared ones has no partner. The
whole sets of the rest are then indexed. Rare tokens are units by themselves; frequent tokens are dealt into classes,
and all that a set has of a class is one combination of k tokens, one unit, with as many classes as make partners agree
in one at least: a token that only one of two sets has spoils one unit at most. Units are ordered, rare ones first, and
a prefix with one more than a partner may spoil is indexed; where a set has too few units, the prefix is extended by
the units of further ways to deal the classes. Tokens that no other set has count in the prefix but aren't indexed.

Sets that share an entry are each compared exactly with the entry's smallest set, the pivot, which is enough where they
are all linked. Where they aren't, differences from the pivot stand for the sets: sets whose difference is too small to
share enough of it with a linked set of another component are left out, the pivot's other sets are dealt into blocks, and
each pair of blocks is compared by the tokens that differences share, which is as exact as comparing the sets. Links
are kept as far as they join components, so none between different texts is lost. Equal sets are one node from the start.

Edge cases: null texts and texts without words have an empty set and are linked with nothing; with fewer words than a
shingle has, the whole sequence is the one shingle; a null id takes no part and has no component; rows that repeat an
id are judged by their own texts; very long texts are taken whole; an empty table gives an empty result; extra columns
are dropped by linked_components() and kept by one_of_each(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import cleared, fresh_name, hashed_words, mixed, partitions, sliced, window_hashes, written
from lakeops.llm.components import components
from lakeops.llm.repeats import _rows, _slot, filter_of, packed, passing

#: Sets that have a token from which on it is frequent.
FREQUENT = 16
#: Parts of an exchange, at least: about as many as a set has entries, so that replies grow with the sets alone.
LEAST_PARTS = 512
#: Ways to deal classes that are tried before a set's tokens are all indexed singly.
DEALS = 4
#: Numbers in a block of differences: a pair of blocks is what a task holds at once.
BLOCK = 1 << 14


@lru_cache(maxsize=8)
def _levels(percent: int) -> list[int]:
    """Sizes at which levels begin: sets of one level and those of the next hold all sets that may be partners."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(100 * out[-1] // percent + 1)
    return out


@dataclass(frozen=True)
class Similarity:
    """words in a shingle; percent: links have 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    def least_overlap(self, n: int) -> int:
        """Shared tokens that any partner of a set of n must have."""
        return -(-self.percent * n // 100)

    def sampled(self, n: int) -> int:
        """Tokens of a set of n that are compared first: twice as many as it may miss in a partner, and two."""
        return min(n, 2 * (n - self.least_overlap(n)) + 2)

    def apart(self, a: int, b: int) -> int:
        """Tokens that only one of two linked sets of these sizes has, at most."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def levels(self, n: int) -> list[tuple[int, int, int]]:
        """(level, tokens apart from a partner of the level at most, classes) of a set of n."""
        begins = _levels(self.percent)
        level = int(np.searchsorted(begins, n, "right"))
        out = []
        for k in (level, level + 1):
            largest = begins[k] - 1
            out.append((k, self.apart(n, min(largest, 100 * n // self.percent)), int(1.15 * (self.apart(largest, largest) + 1)) + 2))
        return out

    def alike(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)


def shingles(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Of each whole text in lower case (A to Z): sorted distinct 64-bit hashes of its shingles."""
    return [np.unique(window_hashes(h, min(words, len(h)))) if len(h) else h for h in hashed_words(texts, lower=True)]


def signatures(tokens: np.ndarray, df: np.ndarray, n: int, s: Similarity) -> np.ndarray:
    """Index entries of a set of n, from those of its tokens that other sets have, too, and how many have them (FREQUENT at most)."""
    alone = n - len(tokens)
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    n_rare = int((df < FREQUENT).sum())
    rare, frequent = tokens[:n_rare], tokens[n_rare:]
    out = [np.zeros(0, np.uint64)]
    with np.errstate(over="ignore"):
        for level, apart, n_classes in s.levels(n):
            quota = apart + 1 - alone  # tokens that no one shares come first
            if quota <= 0:
                continue
            salt = mixed(np.array([level], np.uint64))
            out.append(mixed(rare[:quota] + salt))
            for deal in range(DEALS if quota > n_rare else 0):
                of = mixed(frequent ^ mixed(salt + np.uint64(deal))) % np.uint64(n_classes)
                order = np.argsort(of, kind="stable")
                first = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]][: len(of)])
                units = np.add.reduceat(mixed(frequent[order] + np.uint64(deal)), first) if len(first) else frequent
                out.append(mixed(units ^ (salt + of[order][first]))[: quota - n_rare])
                if n_rare + len(units) >= quota:
                    break
            else:
                if quota > n_rare:  # too few units in every deal
                    out.append(mixed(tokens - salt))
    return np.unique(np.concatenate(out))


def described(docs: DataFrame, s: Similarity, id_col: str, text_col: str) -> DataFrame:
    """id, n (size of the set), print (of the whole set), sample (its smallest hashes)."""
    schema = "id long, n long, print binary, sample binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), shingles(batch.column(1), s.words), strict=True):
                rows.append((i, len(t), xxhash.xxh3_128_digest(t.tobytes()), t[: s.sampled(len(t))].tobytes()))
            yield _rows(rows, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def enough(s: Similarity) -> Column:
    """Least number of sampled tokens that a set of n shares with any partner: those that a partner of the smallest size vouches for."""
    least = lambda n: F.ceil(n * s.percent / 100 - 1e-9)
    small = least(F.col("n"))
    return F.least(small, small - least(small) + 2, least(small))


def whole_sets(texts: DataFrame, nodes: DataFrame, s: Similarity) -> DataFrame:
    """(key, n, sample) with all tokens of the sets of some nodes (key, id, n, print), one row each. Texts of other ids leave before their sets are made, in the same pass, so that a task has one Python worker."""
    sent = filter_of(nodes.select("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(passing(b, sent.value) for b in batches):
            sets = [t.tobytes() for t in shingles(batch.column(1), s.words)]
            columns = [batch.column(0), pa.array([len(t) // 8 for t in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(t) for t in sets], pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "print", "sample"])

    sets = texts.where("id IS NOT NULL").select("id", "text", _slot("id").alias("slot")).mapInArrow(run, "id long, n long, print binary, sample binary")
    return sets.join(nodes, ["id", "n", "print"]).select("key", "n", "sample").dropDuplicates(["key"])


def _grouped(owners: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(owner, bytes of its part of each column)."""
    order = np.argsort(owners, kind="stable")
    owners, columns = owners[order], [c[order] for c in columns]
    cuts = np.r_[np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]]), len(owners)] if len(owners) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield (int(owners[a]), *(c[a:b].tobytes() for c in columns))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each part, which come in order of parts."""
    at, mine = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != at:
                if mine:
                    yield mine
                at, mine = row[0], []
            mine.append(row)
    if mine:
        yield mine


def _joined(rows: list[tuple], k: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[k] for r in rows), kind)


_PACKED = "part int, settled boolean, hashes binary, owners binary"
_PACKED_TYPES = [pa.int32(), pa.bool_(), pa.binary(), pa.binary()]


def shared_tokens(sets: DataFrame) -> DataFrame:
    """(key, n, tokens, df): of each set's sample, the tokens that other sets have, too, and how many have them; FREQUENT stands for that many or more.

    A batch in which a token is frequent settles it for its own sets and sends word of it once.
    """
    parts, spark = max(LEAST_PARTS, 4 * partitions(sets.sparkSession)), sets.sparkSession

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            samples = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(1)]
            tokens = np.concatenate([*samples, np.zeros(0, np.uint64)])
            owners = np.repeat(batch.column(0).to_numpy(), [len(x) for x in samples])
            _, of, n = np.unique(tokens, return_inverse=True, return_counts=True)
            often = n[of] >= FREQUENT
            word = np.unique(tokens[often])
            rows = [(p, False, h, o) for p, h, o in packed(parts, np.r_[tokens[~often], word], np.r_[tokens[~often], word], np.r_[owners[~often], np.full(len(word), np.iinfo(np.int64).min)])]
            rows += [(p, True, h, o) for p, h, o in packed(parts, mixed(owners[often].view(np.uint64)), tokens[often], owners[often])]
            yield _rows(rows, _PACKED_TYPES, _PACKED)

    reply = "key long, tokens binary, df binary"

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches):
            asked, told = [r for r in rows if not r[1]], [r for r in rows if r[1]]
            tokens, owners = _joined(asked, 2, np.uint64), _joined(asked, 3, np.int64)
            _, of = np.unique(tokens, return_inverse=True)
            word = owners == np.iinfo(np.int64).min
            df = np.bincount(of, np.where(word, FREQUENT, 1), minlength=1)[of] if len(of) else np.zeros(0)
            use = (df > 1) & ~word
            tokens = np.r_[tokens[use], _joined(told, 2, np.uint64)]
            owners = np.r_[owners[use], _joined(told, 3, np.int64)]
            df = np.r_[np.minimum(df[use], FREQUENT), np.full(len(owners) - int(use.sum()), FREQUENT)].astype(np.uint8)
            yield _rows(list(_grouped(owners, tokens, df)), [pa.int64(), pa.binary(), pa.binary()], reply)

    dealt = sets.select("key", "sample").mapInArrow(send, _PACKED).repartition(partitions(spark), "part").sortWithinPartitions("part")
    replies = dealt.mapInArrow(receive, reply).groupBy("key").agg(*(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tokens", "df"))), lambda r: F.hex(r[c])), "")).alias(c) for c in ("tokens", "df")))
    return replies.join(sets.select("key", "n"), "key").select("key", "n", "tokens", "df")


def indexed(shared: DataFrame, s: Similarity) -> DataFrame:
    """(entry, key) of the sets that may have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, entries = [], [np.zeros(0, np.uint64)]
            for k, n, tokens, df in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t, d = np.frombuffer(tokens, np.uint64), np.frombuffer(df, np.uint8)
                if len(t) >= s.least_overlap(n):
                    entries.append(signatures(t, d, n, s))
                    keys.append(np.full(len(entries[-1]), k))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(entries).view(np.int64)), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))], ["entry", "key"])

    return shared.mapInArrow(run, "entry long, key long")


def stars(index: DataFrame) -> DataFrame:
    """Distinct (a, b): every set of an entry, a, with the entry's smallest, b. Minima are pre-aggregated; a join that meets an entry of very many sets is split as Spark splits skewed joins."""
    first = index.groupBy("entry").agg(F.min("key").alias("b"), F.max("key").alias("most")).where("b <> most").select("entry", "b")
    return index.join(first, "entry").where("key <> b").select(F.col("key").alias("a"), "b").distinct()


def marked(whole: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, tokens, known): all tokens of each set, and bits that tell which of them other sets have, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            bits = [np.packbits(np.isin(np.frombuffer(t.as_buffer(), np.uint64), np.frombuffer(k.as_buffer(), np.uint64))).tobytes() for t, k in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["key", "tokens", "known"])

    known = shared.select("key", F.col("tokens").alias("known"))
    return whole.join(known, "key").select("key", F.col("sample").alias("tokens"), "known").mapInArrow(run, "key long, tokens binary, known binary")


def difference(x: np.ndarray, known_x: np.ndarray, r: np.ndarray, known_r: np.ndarray, linked: bool, s: Similarity) -> tuple[np.ndarray, int]:
    """What a set x and its pivot r don't share and other sets may, in order; and how many of these come first in a prefix of which any set that is linked with x, but lies in another component, must have one in its own prefix.

    Linked sets share at least t tokens of their differences. Where x is linked with the pivot, the other isn't, so its
    difference has more than (100-p)/(100+p) of its and the pivot's size; else the shared tokens are no more than the
    other's difference. Either gives a lower bound of t. Order: tokens that the pivot hasn't got, then its own, last
    those that no other set has.
    """
    less = ~np.isin(r, x, assume_unique=True)
    more = x[known_x & ~np.isin(x, r, assume_unique=True)]
    apart, small, large = len(x) - len(r) + 2 * int(less.sum()), 100 - s.percent, 100 + s.percent
    least = (large * apart + small * (len(r) - len(x))) // (2 * large) + 1 if linked else -(-(large * apart - small * (len(x) + len(r))) // 200)
    tokens = np.concatenate([more, r[less & known_r], r[less & ~known_r]])
    return tokens, max(0, len(tokens) - max(1, least) + 1)


_TRIED = "a long, b long, linked boolean, n long, more long, less long, alone long, front int, tokens array<bigint>"


def verified(pairs: DataFrame, sets: DataFrame, s: Similarity) -> DataFrame:
    """a, b, linked of distinct pairs of keys, by their whole sets; and of a: its size, how many tokens it has more and less than b and how many alone, and the tokens of its difference from b, `front` of them in its prefix."""
    side = lambda c: sets.select(F.col("key").alias(c), F.col("tokens").alias(f"set_{c}"), F.col("known").alias(f"known_{c}"))
    found = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "known_a", "set_b", "known_b")
    names, types = [x.split()[0] for x in _TRIED.split(", ")], [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.int32(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for a, b, x, known_x, y, known_y in zip(*batch.columns, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                known_x, known_y = (np.unpackbits(np.frombuffer(k.as_buffer(), np.uint8), count=len(t)).astype(bool) for k, t in ((known_x, x), (known_y, y)))
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                linked = s.alike(both, len(x), len(y))
                tokens, front = difference(x, known_x, y, known_y, linked, s)
                rows.append((a.as_py(), b.as_py(), linked, len(x), len(x) - both, len(y) - both, len(x) - int(known_x.sum()), front, tokens.view(np.int64) if front else []))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names)

    return found.mapInArrow(run, _TRIED)


def _cross_links(x: pa.StructArray, y: pa.StructArray, same: bool, s: Similarity) -> list[tuple[int, int]]:
    """Links between the members of two blocks of one pivot, or of one block with itself, that lie in different components: as many as join what the links join, fewer than there are members."""
    (kx, cx, nx, apart_x, all_x), (ky, cy, ny, apart_y, all_y) = ([m.field(f).to_numpy() for f in ("key", "c", "n", "apart")] + [m.field("tokens")] for m in (x, y))
    # 100 * both >= percent * union, in terms of how many tokens only one of two sets has
    least = (100 + s.percent) * (apart_x[:, None] + apart_y[None, :]) - (100 - s.percent) * (nx[:, None] + ny[None, :])
    open_ = (cx[:, None] != cy[None, :]) & (100 * np.minimum(nx[:, None], ny[None, :]) >= s.percent * np.maximum(nx[:, None], ny[None, :]))
    if not open_.any():
        return []
    sides = []
    for tokens in (all_x, all_y):
        sides.append((tokens.flatten().to_numpy(), np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy())))
    held = np.intersect1d(sides[0][0], sides[1][0])
    both = np.zeros(least.shape, np.float32)
    for start in range(0, len(held), 2048):
        some = held[start : start + 2048]
        marks = []
        for (tokens, owners), rows in zip(sides, least.shape, strict=True):
            at = np.minimum(np.searchsorted(some, tokens), len(some) - 1)
            use = some[at] == tokens
            marks.append(np.zeros((rows, len(some)), np.float32))
            marks[-1][owners[use], at[use]] = 1
        both += marks[0] @ marks[1].T
    linked = open_ & (2 * (100 + s.percent) * both.astype(np.int64) >= least)
    # a forest: each member is visited once, and only what is new from there is told
    out, seen = [], [np.zeros(len(kx), bool), np.zeros(len(ky), bool)]
    if same:
        seen[1] = seen[0]
    for root in np.flatnonzero(linked.any(axis=1)):
        if seen[0][root]:
            continue
        seen[0][root] = True
        todo = [(0, root)]
        while todo:
            side, at = todo.pop()
            there = (linked[at] if side == 0 else linked[:, at]) & ~seen[1 - side]
            seen[1 - side] |= there
            for other in np.flatnonzero(there):
                out.append((int((kx, ky)[side][at]), int((ky, kx)[side][other])))
                todo.append((1 - side, other))
    return out


def further_links(tried: DataFrame, labels: DataFrame, s: Similarity) -> DataFrame:
    """Links (a, b) that join the components which links between sets of one pivot join.

    A pivot's sets are dealt into blocks of about BLOCK numbers, and each pair of blocks is compared in a task, by one
    product of matrices of the tokens that both hold: a set is told from another by what both have more and less than the
    pivot, which is as exact as comparing the sets. Every pair of sets is compared, so the work is still the square of a
    pivot's sets, in products of small matrices; rows are pairs of blocks, and links fewer than a pair of blocks has sets.
    """
    members = tried.select(F.col("a").alias("key"), F.col("b").alias("pivot"), "n", (F.col("more") + F.col("less")).alias("apart"), "front", "tokens")
    members = members.join(labels.select(F.col("node").alias("key"), F.col("component").alias("c")), "key", "left").withColumn("c", F.coalesce("c", "key")).where("front > 0")
    per_pivot = members.groupBy("pivot").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.ceil(F.sum(F.size("tokens") + 16) / BLOCK).alias("n_blocks")).where("low <> high")
    per_pivot = written(per_pivot.select("pivot", "n_blocks"), "pivots")
    dealt = members.join(per_pivot, "pivot").withColumn("block", F.pmod(F.xxhash64("key"), "n_blocks"))
    blocks = written(dealt.groupBy("pivot", "block").agg(F.collect_list(F.struct("key", "c", "n", "apart", "tokens")).alias("sets")), "members")
    first = per_pivot.select("pivot", "n_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("i"))
    pairs = first.select("pivot", "i", F.explode(F.sequence("i", F.col("n_blocks") - 1)).alias("j"))
    side = lambda k, name: blocks.select("pivot", F.col("block").alias(k), F.col("sets").alias(name))
    met = pairs.join(side("i", "x"), ["pivot", "i"]).join(side("j", "y"), ["pivot", "j"]).select("x", "y", (F.col("i") == F.col("j")).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, same in zip(*batch.columns, strict=True):
                found = np.array(_cross_links(x.values, y.values, same.as_py(), s), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found.max(axis=1)), pa.array(found.min(axis=1))], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def of_one_id(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of rows that share an id."""
    prints = [F.col("n"), F.xxhash64("print"), F.hash("print", "n")]
    several = rows.groupBy("id").agg(*(f(p).alias(f"{f.__name__}{k}") for k, p in enumerate(prints) for f in (F.min, F.max))).where(" OR ".join(f"min{k} <> max{k}" for k in range(len(prints)))).select("id")
    own = rows.join(several, "id", "left_semi").distinct().join(nodes.select("n", "print", "key"), ["n", "print"]).select("id", "key")
    return own.join(own.groupBy("id").agg(F.min("key").alias("b")), "id").where("key <> b").select(F.col("key").alias("a"), "b").distinct()


def linked_components(docs: DataFrame, s: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that its links reach, its own included)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = written(described(docs, s, id_col, text_col), "sets")
    real = sets.where((F.col("n") > 0) & F.col("id").isNotNull())
    each = real.groupBy("n", "print").agg(F.min("id").alias("id"), (F.count("*") > 1).alias("copied"), F.first("sample").alias("sample"))
    nodes = written(each.withColumn("key", F.monotonically_increasing_id()), "nodes")  # numbers that last, once written
    likely = shared_tokens(nodes).where(F.octet_length("tokens") / 8 >= enough(s)).select("key")
    likely = written(nodes.select("key", "id", "n", "print").join(likely, "key", "left_semi"), "likely")
    whole = written(whole_sets(texts, likely, s), "whole")
    shared = written(shared_tokens(whole), "shared")
    sets_of = written(marked(whole, shared), "marked")
    tried = written(verified(stars(written(indexed(shared, s), "index")), sets_of, s), "tried")
    links = tried.where("linked").select("a", "b").union(of_one_id(real.select("id", "n", "print"), nodes))
    labels = written(components(links), "components")
    more = written(further_links(tried, labels, s), "more")
    if not more.isEmpty():
        labels = written(components(links.union(more)), "components")
    of = nodes.select("key", "id", "n", "print", "copied").join(labels.select(F.col("node").alias("key"), "component"), "key", "left").where(F.col("copied") | F.col("component").isNotNull())
    smallest = of.groupBy("component").agg(F.min("id").alias("component_id")).where("component IS NOT NULL")
    found = of.join(smallest, "component", "left").select("n", "print", F.coalesce("component_id", "id").alias("component_id"))
    joined = sets.select("id", "n", "print").join(found, ["n", "print"], "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, s: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is their component's; rows without an id stay. Rows that share a kept id stay together."""
    gone = fresh_name(docs)
    with cleared(docs.sparkSession) as made:  # only the ids that go are needed after this
        judged = linked_components(docs, s, id_col, text_col)
        others = written(judged.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct(), "gone")
        made.pop()
    return docs.join(others, docs[id_col] == F.col(gone), "left_anti")
