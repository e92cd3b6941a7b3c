"""Benchmark decontamination: passages of documents within an edit distance of a benchmark item.

Item-sized windows of the texts are embedded by a random walk that reads a string and moves on, or stays, by a random
bit of each character and step (CGK); strings at a small edit distance then differ in few places. A window is walked
from the words in it: an item has one walk per word, and a text's walk from a word serves all windows, of whatever
size, that hold this word at the item's place. In a run of more than _UNSPACED letters, as scripts without spaces have
them, a walk begins at each letter. Each repetition walks anew and samples a few places as a key; equal keys make
candidates, and as many repetitions are made as the wanted recall takes for the item of the whole benchmark that has the
fewest walks. Candidates whose surroundings are unlike the item's at every small shift are left out, and the others are
verified exactly, by the smallest edit distance between the item and any part of its window.

Texts are compared as words in lower case joined by single spaces; every word of every text is walked. Items too short
for a walk are scanned for in every text, bit-parallel, which is exact.

The benchmark is taken in blocks of a bounded number of characters. A block is sent to all tasks, and what it leaves is
written before the next, so that one block is held at a time; all blocks are walked alike, so the result doesn't depend
on them.

Edge cases: null and empty texts hold nothing; items without words and null items are left out; items that share an id
are each looked for and reported by it; a document shorter than an item may hold it within the allowed edits; null ids
are kept in the result; repeated rows are judged alike; very long texts are compared whole; an empty benchmark or table
gives a result without matches; extra columns are dropped by contaminated() and kept by clean(), whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import sliced, written


@dataclass(frozen=True)
class Settings:
    """edits: largest edit distance per character of an item. steps, places: length of a walk, 60 at most, and places sampled per key, one in each equal part of it. agreement, recall: share of the walks of a passage, with as many edits as allowed, whose keys agree (measured, of items of 12 words), and the wanted recall. block_chars: characters of items sent to the tasks at once."""

    edits: float = 0.2
    steps: int = 30
    places: int = 10
    agreement: float = 0.035
    recall: float = 0.98
    block_chars: int = 4_000_000
    seed: int = 5

    def repetitions(self, words: int) -> int:
        return max(2, math.ceil(math.log(1 - self.recall) / math.log(1 - self.agreement) / max(1, words)))


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """What each code point below 0x10000 is compared as: in lower case, a space for all that isn't part of a word."""
    table = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        if chr(c).isalnum() or c == 95:
            low = chr(c).lower()
            table[c] = ord(low[0]) if low else c
    return table


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, compared form, each between single spaces; and where each text starts, with the end."""
    raw = np.frombuffer(" ".join([" ", *(t or "" for t in texts), " "]).encode("utf-32-le", "surrogatepass"), "<u4")
    high = raw >= 0x10000
    points = _folding()[np.where(high, 32, raw)]
    if high.any():
        kinds, of = np.unique(raw[high], return_inverse=True)
        points[high] = np.array([k if chr(k).isalnum() else 32 for k in kinds.tolist()], np.uint32)[of]
    gap = points == 32
    keep = np.r_[True, ~(gap[1:] & gap[:-1])]
    kept = np.cumsum(keep)
    at = np.cumsum([2, *(len(t or "") + 1 for t in texts)]) - 1  # each text's own space before it
    return points[keep], kept[np.minimum(at, len(kept) - 1)] - 1


def words_in(text: str | None) -> str:
    """The compared form of one text."""
    return _string(folded([text])[0]).strip()


def _string(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def closest(item: str, text: str, enough: int = 0) -> int:
    """Smallest edit distance between the item and any part of the text, by bit-parallel columns; one of at most `enough` ends the search."""
    m = len(item)
    if not m:
        return 0
    masks: dict[str, int] = defaultdict(int)
    for k, ch in enumerate(item):
        masks[ch] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for ch in text:
        eq = masks.get(ch, 0)
        x = eq | down
        d0 = ((((eq & up) + up) ^ up) | x) & full
        hp = (down | ~(d0 | up)) & full
        hn = up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & full  # a part may begin anywhere: no cost on top
        hn = (hn << 1) & full
        up = (hn | ~(d0 | hp)) & full
        down = hp & d0
        if score < best:
            best = score
            if best <= enough:
                break
    return best


def scanned(windows: list[np.ndarray], items: list[str], edits: float) -> list[tuple[int, int]]:
    """(number of window, number of item) wherever an item is within the allowed edits of any part of a window; bit-parallel rows over all windows put together, apart by more marks than an item may have edits."""
    most = [int(edits * len(wanted)) for wanted in items]
    apart = np.zeros(max(most, default=0) + 1, np.uint32)
    codes = np.concatenate([apart, *(part for w in windows for part in (w + np.uint32(1), apart))])
    stops = np.cumsum([len(w) + len(apart) for w in windows]) + len(apart)
    masks = {ch: int.from_bytes(np.packbits(codes == ord(ch) + 1, bitorder="little").tobytes(), "little") for wanted in items for ch in set(wanted)}
    full, n_bytes, out = (1 << len(codes)) - 1, -(-len(codes) // 8), []
    for number, wanted in enumerate(items):
        up = down = 0  # a part may begin anywhere: no cost on top
        for ch in wanted:
            eq = masks[ch]
            d0 = (((eq & up) + up) ^ up) | eq | down
            hp = ((down | ((d0 | up) ^ full)) << 1) | 1
            hn = (up & d0) << 1
            up = hn | ((d0 | hp) ^ full)
            down = hp & d0  # bits past the end never reach those before it
        rise, fall = (np.unpackbits(np.frombuffer((x & full).to_bytes(n_bytes, "little"), np.uint8), count=len(codes), bitorder="little").view(np.int8) for x in (up, down))
        at = np.flatnonzero(np.cumsum(rise - fall, dtype=np.int32) <= most[number] - len(wanted))
        out += [(t, number) for t in np.unique(np.searchsorted(stops, at, "right")).tolist()]
    return out


class Walks:
    """The repetitions' random bits and sampled places, and the keys that they give. The bits of a character for all steps are one 64-bit word, which also stands for it in keys."""

    def __init__(self, settings: Settings, repetitions: int):
        self.rounds = []
        for r in range(repetitions):
            random = np.random.default_rng((settings.seed, r))
            cuts = np.linspace(0, settings.steps, settings.places + 1).astype(int)
            self.rounds.append((random.integers(0, 1 << 63, 256, dtype=np.int64), frozenset(random.integers(cuts[:-1], cuts[1:]).tolist())))

    def keys(self, r: int, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key of the walk from each start, and where its last sampled place lies. codes go on for `steps` past the last start."""
        words, places = self.rounds[r]
        bits, at, key, last = words[codes], starts.astype(np.int64), np.zeros(len(starts), np.int64), max(places)
        for step in range(last + 1):
            move = bits.take(at)
            if step in places:
                key *= np.int64(0x1E3779B97F4A7C15)
                key += move
            if step < last:
                move >>= step
                move &= 1
                at += move
        return key.view(np.uint64), at


#: Letters in a row beyond which a walk begins at each, as in scripts without spaces.
_UNSPACED = 20

#: Characters beside a walk that are compared, how far they may be shifted, and the share of them that must be alike.
_BESIDE, _SHIFT, _ALIKE = 24, 2, 0.5

#: Bits of a place in a batch of texts.
_PLACE = 36

#: Starts that are walked together, so that they stay in a core's cache.
_TOGETHER = 1 << 15


class Benchmark:
    """Walks of the items of a block, to be met by those of texts."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings, fewest: int | None = None):
        """fewest: walks of the item of the whole benchmark that has the fewest; of these items by default."""
        self.settings = settings
        self.ids, self.texts, self.short = [], [], []
        for item, text in items:
            wanted = words_in(text)
            if wanted:
                self.ids.append(item)
                self.texts.append(wanted)
        points, ends = folded(self.texts)
        codes, starts = self.walked(points)
        of = np.searchsorted(ends, starts, "right") - 1
        words = np.bincount(of, minlength=len(self.texts))
        long = np.array([len(t) >= settings.steps for t in self.texts], bool)  # shorter ones have hardly a walk that ends in them
        self.short, self.counts = np.flatnonzero(~long).tolist(), words[long]
        self.codes, self.begins, self.sizes = codes, ends[:-1] + 1, np.array([len(t) for t in self.texts], np.int64)
        self.walks = Walks(settings, settings.repetitions(fewest or int(words[long].min())) if long.any() else 0)
        self.tables = []
        for r in range(len(self.walks.rounds)):
            key, last = self.walks.keys(r, codes, starts)
            use = long[of] & (last < ends[of + 1])
            order = np.argsort(key[use], kind="stable")
            key, item, offset = key[use][order], of[use][order], (starts - ends[of] - 1)[use][order]
            bits = max(16, len(key).bit_length() + 7)
            sieve = np.zeros(1 << bits, bool)
            sieve[self.sifted(key, bits)] = True
            self.tables.append((key, item, offset, sieve, bits))

    def resembles(self, codes: np.ndarray, start: np.ndarray, item: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Which candidates are worth an exact look: on one side of the agreeing walk's start, or beyond it, enough characters are those of the item, at one of a few shifts. A side of which the item has too little says nothing; where both say nothing, a candidate passes."""
        out, silent = np.zeros(len(start), bool), np.ones(len(start), bool)
        at = self.begins[item] + offset
        for side in (-_BESIDE, self.settings.steps // 2):
            low, high = offset + side, offset + side + _BESIDE
            says = np.minimum(high, self.sizes[item]) - np.maximum(low, 0) >= _BESIDE // 2
            silent &= ~says
            todo = np.flatnonzero(says & ~out)
            for k in range(0, len(todo), 1 << 14):
                part = todo[k : k + (1 << 14)]
                wanted = self.codes[np.clip(at[part, None] + side + np.arange(_BESIDE), 0, len(self.codes) - 1)]
                inside = (np.arange(_BESIDE) + low[part, None] >= 0) & (np.arange(_BESIDE) + low[part, None] < self.sizes[item[part], None])
                need = _ALIKE * inside.sum(axis=1)
                text = codes[np.clip(start[part, None] + side - _SHIFT + np.arange(_BESIDE + 2 * _SHIFT), 0, len(codes) - 1)]
                best = np.zeros(len(part))
                for shift in range(2 * _SHIFT + 1):
                    best = np.maximum(best, ((text[:, shift : shift + _BESIDE] == wanted) & inside).sum(axis=1))
                out[part] |= best >= need
        return out | silent

    @staticmethod
    def sifted(key: np.ndarray, bits: int) -> np.ndarray:
        return ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)

    @staticmethod
    def numbers_of_walks(texts: list[str | None], settings: Settings) -> list[int]:
        """Walks of each text that is long enough for one."""
        return Benchmark(list(enumerate(texts)), settings, 1 << 30).counts.tolist()

    def walked(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One byte per character, 0 for the space, with room for walks past the end; and where words start."""
        codes = np.where(points == 32, 0, points % 255 + 1).astype(np.uint8)
        gaps = np.flatnonzero(codes == 0)
        sizes = np.diff(np.r_[gaps, len(codes)]) - 1
        each = np.where(sizes > _UNSPACED, sizes, np.minimum(sizes, 1))
        starts = np.repeat(gaps + 1 - (np.cumsum(each) - each), each) + np.arange(each.sum())
        return np.r_[codes, np.zeros(self.settings.steps + 1, np.uint8)], starts

    def matches(self, texts: list[str | None], first_only: bool = False) -> list[set[int]]:
        """Ids of the items found in each text; with first_only, at least one of them where there are any."""
        found: list[set[int]] = [set() for _ in texts]
        points, ends = folded(texts)
        codes, starts = self.walked(points)
        candidates = [np.zeros(0, np.int64)]
        for k in range(0, len(starts), _TOGETHER):
            part = starts[k : k + _TOGETHER]
            near, shift = codes[part[0] : part[-1] + self.settings.steps + 1], part[0]
            for r, (keys, item, offset, sieve, bits) in enumerate(self.tables):
                key, _ = self.walks.keys(r, near, part - shift)
                hit = np.flatnonzero(sieve[self.sifted(key, bits)])
                low, high = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
                n = high - low
                entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                start = np.repeat(part[hit], n)
                if len(start):
                    fits = self.resembles(codes, start, item[entry], offset[entry])
                    start, entry = start[fits], entry[fits]
                own = ends[np.searchsorted(ends, start, "right") - 1]  # a passage may begin before its text
                candidates.append((item[entry] << _PLACE) | np.maximum(start - offset[entry], own))
        met = np.sort(np.concatenate(candidates))
        item, begin = met >> _PLACE, met & ((1 << _PLACE) - 1)
        for i, windows in self.joined(np.searchsorted(ends, begin, "right") - 1, item, begin):
            wanted = self.texts[i]
            most = int(self.settings.edits * len(wanted))
            windows = [(t, max(ends[t], a - most), min(ends[t + 1], b + len(wanted) + most)) for t, a, b in windows if not (first_only and found[t])]
            if len(windows) < 3:  # less work one by one
                hits = [w for w, (_, a, b) in enumerate(windows) if closest(wanted, _string(points[a:b]), most) <= most]
            else:
                hits = [w for w, _ in scanned([points[a:b] for _, a, b in windows], [wanted], self.settings.edits)]
            for w in hits:
                found[windows[w][0]].add(self.ids[i])
        if self.short and texts:
            for t, number in scanned([points[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], [self.texts[i] for i in self.short], self.settings.edits):
                found[t].add(self.ids[self.short[number]])
        return found

    def joined(self, text: np.ndarray, item: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Each item with (text, first and last begin) of its candidates, which come in order; those that begin within an item's length of the next are one."""
        if not len(text):
            return
        length = np.array([len(t) for t in self.texts], np.int64)
        new = np.r_[True, (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (begin[1:] - begin[:-1] > length[item[1:]])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(text)] - 1
        joined = np.c_[text[first], begin[first], begin[last]].tolist()
        cuts = [*np.flatnonzero(np.r_[True, item[first][1:] != item[first][:-1]]).tolist(), len(first)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(item[first[a]]), joined[a:b]


def _blocks(benchmark: DataFrame, settings: Settings, item_col: str, item_text: str) -> Iterator[tuple[list[tuple[int, str]], int | None, bool]]:
    """Items in blocks of about block_chars characters, the fewest walks of any item, and whether the block is the last; one block at a time is held."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).where(F.col("item").isNotNull() & (F.length("text") > 0))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-size // settings.block_chars)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.record_batch({"n": pa.array(Benchmark.numbers_of_walks(batch["text"].to_pylist(), settings), pa.int64())})

    fewest = items.select("text").mapInArrow(counted, "n long").agg(F.min("n")).first()[0]
    blocked = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, n_blocks))).cast("int"))
    for block in range(n_blocks):
        yield sorted((r["item"], r["text"]) for r in blocked.where(F.col("block") == block).toLocalIterator()), fewest, block == n_blocks - 1


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, items) of every row: the ids of the benchmark items that its text holds, in order."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast("array<bigint>").alias("items"))

    def with_block(rows: list[tuple[int, str]], fewest: int | None, kept: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Benchmark(rows, settings, fewest)
            for batch in sliced(batches):
                matches = block.matches(batch.column(1).to_pylist())
                items = [sorted(m | set(old)) for m, old in zip(matches, batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, pa.list_(pa.int64()))], ["id", "text", "items"])

        return kept.mapInArrow(run, kept.schema)

    for rows, fewest, last in _blocks(benchmark, settings, item_col, item_text):
        kept = with_block(rows, fewest, kept)
        kept = kept if last else written(kept, "block")
    return kept.select(F.col("id").alias(id_col), "items")


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that hold no benchmark item, with all their columns; rows don't leave their task."""

    def without(rows: list[tuple[int, str]], fewest: int | None, docs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Benchmark(rows, settings, fewest)
            for batch in sliced(batches):
                matches = block.matches(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), first_only=True)
                yield batch.filter(pa.array([not m for m in matches], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    for rows, fewest, last in _blocks(benchmark, settings, item_col, item_text):
        docs = without(rows, fewest, docs)
        docs = docs if last else written(docs, "block")
    return docs
