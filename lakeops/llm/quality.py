"""Quality classifier: learned embeddings of hashed word and character n-grams, averaged per text, with softmax output.

Each word stands for the bucket of itself and those of its character n-grams; each pair of neighbouring words stands for
one more, and words that equal the one one to three places before count in three buckets of their own. A text is the
mean of the vectors of all of its features; a softmax over two classes follows. The vectors and the output weights are
trained together by stochastic gradient descent in numpy. Since averaging is linear, a trained bucket contributes one
number; a text's score is the sum of those of its features. Distinct words of a batch are looked at once.

Edge cases: null and empty texts have no features and get the softmax of the bias; long texts are scored whole;
repeated rows get equal scores; labels that are null, or whose id is null, are not learnt from; a repeated label counts
once; without labels of both classes every score is the share of label 1 (0 without labels); extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import Coded, coded, mixed, sliced, text_or_empty
from lakeops.llm.toxicity import labelled_sample


@dataclass(frozen=True)
class Settings:
    """buckets and size of the vectors, lengths of character n-grams, passes and step of training, and the bound of the labelled sample."""

    buckets: int = 1 << 16
    size: int = 16
    grams: tuple[int, ...] = (2, 3, 4)
    passes: int = 4
    step: float = 0.5
    most_rows: int = 4000
    seed: int = 7


#: Places back at which an equal word is counted; each is a bucket of its own, after the hashed ones.
REPEATS = (1, 2, 3)
#: Fixed value: odd multiplier of the hashes of character and word sequences.
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_features(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word; and (word, bucket) of all features of the words: itself and its character n-grams, its ends shown by the marks < and >."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    points = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) if words else np.zeros(0, np.uint64)
    ends = np.cumsum(lengths)
    begins, word = ends - lengths, np.repeat(np.arange(len(words)), lengths)
    with np.errstate(over="ignore"):
        place = np.arange(len(points)) - begins[word]
        whole = mixed(np.add.reduceat(mixed(points + place.astype(np.uint64) * _ODD), begins)) if words else points
        owners, hashes, rolling = [np.arange(len(words))], [whole], points
        for n in range(2, max(settings.grams) + 1):
            rolling = rolling[:-1] * _ODD + points[n - 1 :]
            if n in settings.grams:
                inside = np.flatnonzero(np.arange(len(rolling)) + n <= ends[word[: len(rolling)]])
                owners.append(word[inside])
                hashes.append(mixed(rolling[inside] + np.uint64(n)))
    return whole, np.concatenate(owners), (np.concatenate(hashes) % np.uint64(settings.buckets)).astype(np.int64)


def sequence_features(words: Coded, hashes: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(place, bucket) of the features of a text's sequence of words: each pair of neighbours, at the place of its first word, and equal words a few places apart."""
    codes, text = words.codes, np.repeat(np.arange(len(words.starts) - 1), np.diff(words.starts))
    with np.errstate(over="ignore"):
        pairs = mixed(hashes[codes[:-1]] * _ODD + hashes[codes[1:]]) % np.uint64(settings.buckets)
    together = np.flatnonzero(text[1:] == text[:-1])
    places, buckets = [together], [pairs[together].astype(np.int64)]
    for k, back in enumerate(REPEATS):
        again = np.flatnonzero((codes[back:] == codes[:-back]) & (text[back:] == text[:-back])) if len(codes) > back else np.zeros(0, np.int64)
        places.append(again)
        buckets.append(np.full(len(again), settings.buckets + k))
    return np.concatenate(places), np.concatenate(buckets)


@dataclass
class Model:
    settings: Settings
    vectors: np.ndarray  # (buckets + repeats, size)
    output: np.ndarray  # (size, 2)
    bias: np.ndarray  # (2,)

    def leaning(self) -> np.ndarray:
        """What each bucket adds to class 1 over class 0."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)

    def leaning_of_none(self) -> float:
        return float(self.bias[1] - self.bias[0])


def scores(texts: pa.Array, leaning: np.ndarray, of_none: float, settings: Settings) -> np.ndarray:
    """Score of each text."""
    words = coded(texts, pc.utf8_split_whitespace)
    hashes, owner, bucket = word_features(words.distinct.to_pylist(), settings)
    value = np.bincount(owner, leaning[bucket], len(hashes))[words.codes]
    features = np.bincount(owner, minlength=len(hashes))[words.codes]
    place, bucket = sequence_features(words, hashes, settings)
    value += np.bincount(place, leaning[bucket], len(value))
    features = features + np.bincount(place, minlength=len(value))
    z, n = np.zeros(len(texts)), np.ones(len(texts))
    some = np.flatnonzero(np.diff(words.starts))
    if len(some):
        z[some], n[some] = np.add.reduceat(value, words.starts[some]), np.add.reduceat(features, words.starts[some])
    return 1 / (1 + np.exp(-np.clip(z / n + of_none, -30, 30)))


def counted(texts: pa.Array, settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its buckets, and how often each occurs."""
    words = coded(texts, pc.utf8_split_whitespace)
    hashes, owner, bucket = word_features(words.distinct.to_pylist(), settings)
    order = np.argsort(owner, kind="stable")
    bucket, first = bucket[order], np.searchsorted(owner[order], np.arange(len(hashes) + 1))
    place, of_place = sequence_features(words, hashes, settings)
    order = np.argsort(place, kind="stable")
    place, of_place = place[order], of_place[order]
    out = []
    for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
        codes = words.codes[a:b]
        n = first[codes + 1] - first[codes]
        mine = bucket[np.repeat(first[codes] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        out.append(np.unique(np.r_[mine, of_place[slice(*np.searchsorted(place, [a, b]))]], return_counts=True))
    return out


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, settings: Settings) -> Model:
    """Stochastic gradient descent, one text at a time in seeded order, the step falling to nothing."""
    random = np.random.default_rng(settings.seed)
    n_buckets = settings.buckets + len(REPEATS)
    vectors = random.uniform(-1, 1, (n_buckets, settings.size)) / settings.size
    output, bias = random.uniform(-0.1, 0.1, (settings.size, 2)), np.zeros(2)
    share = float(labels.mean()) if len(labels) else 0.0
    model = Model(settings, vectors, output, bias)
    if not 0 < share < 1:
        model.vectors, bias[1] = np.zeros_like(vectors), 30.0 if share else -30.0
        return model
    steps, done = settings.passes * len(rows), 0
    for _ in range(settings.passes):
        for r in random.permutation(len(rows)):
            rate = settings.step * (1 - done / steps)
            done += 1
            bucket, n = rows[r]
            weight = n / max(n.sum(), 1.0)
            mean = weight @ vectors[bucket]
            z = mean @ output + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[labels[r]] -= 1
            back = output @ error
            output -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            vectors[bucket] -= (rate * len(bucket) ** 0.5) * np.outer(weight, back)
    return model


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on at most settings.most_rows labelled rows, whole texts turned to buckets on the executors."""
    chosen = labelled_sample(docs, labels, label, settings.most_rows, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = counted(batch.column(1), settings)
            columns = [pa.array([x.astype(kind).tobytes() for x in xs], pa.binary()) for xs, kind in zip(zip(*rows, strict=True) if rows else ([], []), ("<i4", "<f4"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], ["id", "bucket", "n", "y"])

    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).where(F.col("id").isNotNull())
    joined = source.join(chosen.select(F.col(id_col).alias("id"), "y"), "id").select("id", "text", "y")
    rows, y = [], []
    for row in joined.mapInArrow(run, f"id {source.schema[0].dataType.simpleString()}, bucket binary, n binary, y int").orderBy("id").toLocalIterator():
        rows.append((np.frombuffer(row["bucket"], "<i4"), np.frombuffer(row["n"], "<f4").astype(np.float64)))
        y.append(row["y"])
    return fitted(rows, np.array(y, int), settings)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text. One number per bucket goes along with the tasks: its size is bounded by the settings."""
    leaning, of_none, settings = model.leaning(), model.leaning_of_none(), model.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), leaning, of_none, settings), pa.float64())], [id_col, "score"])

    source = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, score double")
