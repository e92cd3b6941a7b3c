"""Toxicity scores of deobfuscated text.

Obfuscation is taken as a noisy channel: a writer meant a plain word and typed digits or signs for letters, put marks
or spaces between letters, or repeated them. Each odd token, of whatever length, becomes a lattice of what every
character may stand for, and Viterbi decoding under a character trigram model, counted over all texts, restores the
likeliest word; all states are kept. A token of plain letters is a lattice of one path. Spaces between short tokens are
arcs that may be left out: neighbours that put together make a known word, as they stand or restored, count as that
word, too, beside the ordinary words around them. The restored words are then scored: a lexicon of words and word
beginnings with their log-odds is learnt from labelled rows, and a logistic regression over what a text holds of it
gives the score. Distinct tokens of a batch are looked at once.

Edge cases: null and empty texts have no words and get the score of the intercept; long texts are scored whole; repeated
rows get equal scores; labels that are null, or whose id is null, are not learnt from; a repeated label counts once; with
no labels of either class every score is the share of label 1 (0 without labels); extra columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import Coded, coded, sliced, text_or_empty

#: Classes of characters in the language model: boundary, a to z, and 37 others by code point.
CLASSES = 64
#: Letters that a sign may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "%": "x", "&": "e"}
#: Marks that are put between letters.
BETWEEN = ".-_*~^`'"
#: Natural-log prices of the channel: a sign for a letter, a dropped mark, a dropped repetition, a sign that stays itself.
PRICE_SIGN, PRICE_MARK, PRICE_REPEAT, PRICE_STAY = -0.7, -0.5, -0.4, -9.0

_LETTER = r"[^\W\d_]"
_PLAIN = re.compile(rf"{_LETTER}+")
_TWICE = re.compile(rf"({_LETTER})\1")
_THRICE = re.compile(rf"({_LETTER})\1\1")
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_LONG_RUN = re.compile(r"(.)\1{3,}", re.DOTALL)
#: Signs three times or more are decoration, not letters; asterisks after a letter hide some.
_DECORATION = re.compile(r"([^\w\s*])\1{2,}|(?<![^\W\d_*])\*{3,}")
_EDGE = ".,;:?!\"'()[]{}<>|¡¿"
_SIGNS = re.compile("[0-9@$!|+(€£¡*#%&.\\-_~^`']")


def odd_core(token: str) -> str | None:
    """What of a token must be decoded, if anything: letters with signs or digits among them, or before them in their stead."""
    core = token.strip(_EDGE)
    if not core:
        return None
    if core.isalpha():
        at = token.index(core)
        return token[at - 1 :].rstrip(_EDGE) if at and token[at - 1] in STANDS_FOR else None
    core = _DECORATION.sub("", token)
    letters = sum(c.isalpha() for c in core)
    return core if letters and letters < len(core.strip(_EDGE)) and len(core) > 2 and _SIGNS.search(core) else None


def _class_table() -> np.ndarray:
    """Class of each code point below 0x3000 in lower case; 0 is a word's boundary."""
    table = np.zeros(0x3000, np.uint8)
    for c in range(0x3000):
        low = chr(c).lower()
        if low.isalpha():
            k = ord(low[0])
            table[c] = k - 96 if 97 <= k <= 122 else 27 + k % 37
    return table


CLASS = _class_table()


def trigram_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): trigrams of character classes over every whole text. A task gives one row per trigram it has seen, so at most 64 cubed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                points = np.frombuffer(f"  {text.as_py()} ".encode("utf-32-le", "surrogatepass"), "<u4")
                c = CLASS[np.minimum(points, 0x2FFF)].astype(np.int32)
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3) if len(c) > 100_000 else 0
                if len(c) <= 100_000:
                    code, n = np.unique((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], return_counts=True)
                    total[code] += n
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(total[code], pa.int64())], ["code", "n"])

    return df.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probabilities of a class after two others. The counts cover all texts; the driver holds 64 cubed of them whatever the input."""
    counts = np.zeros(CLASSES**3)
    for row in trigram_counts(df, text_col).toLocalIterator():
        counts[row["code"]] = row["n"]
    three = counts.reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (three + 20 * p2) / (three.sum(2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32)


#: Letters of a token that may be a piece of a spaced word, at most.
PIECE = 3


class Restorer:
    """Viterbi decoding of odd tokens; results are memoised. known: words of the lexicon."""

    def __init__(self, model: np.ndarray, known: frozenset[str] = frozenset(), bonus: float = 8.0, most: int = 60_000):
        self.model, self.known, self.bonus, self.most = model.tolist(), known, bonus, most
        self.memo: dict[str, str] = {}
        self.beginnings = {w[:n] for w in known for n in range(1, len(w) + 1)}
        self.repeatable: dict[str, list[str]] = {}
        for w in sorted(known):
            self.repeatable.setdefault(_RUN.sub(r"\1", w), []).append(w)

    @staticmethod
    def options(ch: str, before: str, edge: bool) -> list[tuple[str, float]]:
        """What a character may stand for, with the channel's price; '' drops it, which costs nothing at a token's edge."""
        if ch.isalpha():
            return [(ch, 0.0), ("", PRICE_REPEAT)] if ch == before else [(ch, 0.0)]
        out = [(x, PRICE_SIGN) for x in STANDS_FOR.get(ch, "")]
        if edge or ch in BETWEEN or ch == before or not out:
            out.append(("", 0.0 if edge else PRICE_MARK))
        return out

    def decode(self, token: str, edges: bool = True) -> str:
        """edges: signs around the token may be dropped for nothing."""
        low = _LONG_RUN.sub(r"\1\1\1", token.lower())
        if "*" in low:
            hidden = re.compile(re.escape(low.strip(_EDGE)).replace(r"\*", "."))
            found = min((w for w in self.known if hidden.fullmatch(w)), default=None)
            if found:
                return found
        model = self.model
        first, last = len(low) - len(low.lstrip(_EDGE)), len(low.rstrip(_EDGE))
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        before = ""
        for k, ch in enumerate(low):
            step: dict[tuple[int, int], tuple[float, str]] = {}
            options = self.options(ch, before, edges and (k < first or k >= last))
            for (a, b), (score, text) in states.items():
                for out, price in options:
                    if out:
                        c = int(CLASS[min(ord(out), 0x2FFF)])
                        state, value = (b, c), score + price + model[a][b][c]
                        made = text + out
                    else:
                        state, value, made = (a, b), score + price, text
                    if state not in step or value > step[state][0]:
                        step[state] = (value, made)
            states = step
            before = ch
        return max((s + model[a][b][0] + (self.bonus if t in self.known else 0), t) for (a, b), (s, t) in states.items())[1]

    def restore(self, core: str) -> str:
        found = self.memo.get(core)
        if found is None:
            found = self.decode(core)
            if found not in self.known:
                whole = self.decode(core, edges=False) if core[0] in STANDS_FOR and core[0] in _EDGE else found
                found = whole if whole in self.known else self.repeatable.get(_RUN.sub(r"\1", found), [found])[0]
            if len(core) <= 64:
                if len(self.memo) >= self.most:
                    self.memo.clear()
                self.memo[core] = found
        return found

    def parts(self, token: str) -> list[str]:
        """Words of one token in lower case: those that stand as letters, and what it is restored to where it is odd."""
        words = _PLAIN.findall(token)
        core = odd_core(token)
        if core:
            words.append(self.restore(core))
        elif _TWICE.search(token):
            words += [self.restore(w) for w in words if _THRICE.search(w)]
            words += [r for w in words if w not in self.known and _TWICE.search(w) for r in self.repeatable.get(_RUN.sub(r"\1", w), ())]
        return words

    def spaced(self, words: Coded) -> list[tuple[int, str]]:
        """(text, word): words whose letters stand apart, as neighbouring tokens of at most PIECE letters that make a known word; and each row of three or more single characters put together, restored where it is odd."""
        tokens, codes = words.distinct, words.codes
        size = pc.utf8_length(tokens).to_numpy()[codes] if len(codes) else codes
        text = np.repeat(np.arange(len(words.starts) - 1), np.diff(words.starts))
        together = text[1:] == text[:-1]
        out = []
        pairs = np.flatnonzero(together & (size[1:] <= PIECE) & (size[:-1] <= PIECE))
        if self.known and len(pairs):
            kinds, of = np.unique(codes[pairs] * np.int64(len(tokens)) + codes[pairs + 1], return_inverse=True)
            left, right = tokens.take(pa.array(kinds // len(tokens))).to_pylist(), tokens.take(pa.array(kinds % len(tokens))).to_pylist()
            begins = np.array([a + b in self.beginnings for a, b in zip(left, right, strict=True)], bool)
            for at in pairs[begins[of]].tolist():
                made, k, end = tokens[int(codes[at])].as_py(), at + 1, int(words.starts[text[at] + 1])
                while k < end and size[k] <= PIECE:
                    made += tokens[int(codes[k])].as_py()
                    if made not in self.beginnings:
                        break
                    if made in self.known:
                        out.append((int(text[at]), made))
                    k += 1
        single = size == 1
        runs = np.flatnonzero(single & np.r_[True, ~(single[:-1] & together)][: len(single)])
        for at in runs.tolist():
            k, end = at + 1, int(words.starts[text[at] + 1])
            while k < end and single[k]:
                k += 1
            if k - at >= 3:
                out += [(int(text[at]), w) for w in self.run_of(tokens.take(pa.array(codes[at:k])).to_pylist())]
        return out

    def run_of(self, characters: list[str]) -> list[str]:
        """Words of a row of single characters: known words in it, restored where it is odd, and all of it as one."""
        joined = "".join(characters)
        words = self.parts(joined) if odd_core(joined) or not joined.isalpha() or _TWICE.search(joined) else [joined]
        if not joined.isalpha():
            longest = max(map(len, self.known), default=0)
            for a in range(len(joined)):
                for b in range(a + 3, min(len(joined), a + longest) + 1):
                    core = odd_core(joined[a:b]) if (a, b) != (0, len(joined)) else None
                    if core and (word := self.restore(core)) in self.known:
                        words.append(word)
        return words

    def words(self, texts: pa.Array) -> list[list[str]]:
        """All words of each text."""
        words = tokens_of(texts)
        parts = [[t] if t.isalpha() and not _TWICE.search(t) else self.parts(t) for t in words.distinct.to_pylist()]
        out = [[w for c in words.codes[a:b].tolist() for w in parts[c]] for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True)]
        for text, word in self.spaced(words):
            out[text].append(word)
        return out


def tokens_of(texts: pa.Array) -> Coded:
    """Tokens in lower case."""
    return coded(pc.utf8_lower(texts), pc.utf8_split_whitespace)


#: Lengths of word beginnings in the lexicon.
BEGINNINGS = (4, 5, 6, 7)


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Lexicon:
    """Log-odds of the words and beginnings that label 1 prefers, and a logistic regression over a text's sums of them."""

    weights: dict[str, float] = field(default_factory=dict)
    centre: np.ndarray = field(default_factory=lambda: np.zeros(4))
    spread: np.ndarray = field(default_factory=lambda: np.ones(4))
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(4))
    intercept: float = 0.0

    def weight(self, word: str) -> float:
        get = self.weights.get
        return max((get(f, 0.0) for f in features_of(word)), default=0.0)

    def numbers(self, weights: list[float], n: int) -> list[float]:
        """What the regression sees of a text: its positive weights, against its number of tokens."""
        total, most = sum(weights), max(weights, default=0.0)
        return [math.log1p(total), 10 * total / (n + 5), most, math.log1p(100 * len(weights) / (n + 5))]

    def score(self, numbers: np.ndarray) -> np.ndarray:
        z = ((numbers - self.centre) / self.spread) @ self.coefficients + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Scorer:
    """Scores of texts by model and lexicon; the positive weights of distinct tokens are memoised."""

    def __init__(self, model: np.ndarray, lexicon: Lexicon, most: int = 150_000):
        self.lexicon, self.most = lexicon, most
        self.restorer = Restorer(model, frozenset(w for w in lexicon.weights if not w.endswith("*")))
        self.memo: dict[str, tuple[float, ...]] = {}

    def weights(self, token: str) -> tuple[float, ...]:
        found = self.memo.get(token)
        if found is None:
            found = tuple(v for w in self.restorer.parts(token) if (v := self.lexicon.weight(w)) > 0)
            if len(token) <= 64:
                if len(self.memo) >= self.most:
                    self.memo.clear()
                self.memo[token] = found
        return found

    def scores(self, texts: pa.Array) -> np.ndarray:
        words = tokens_of(texts)
        weights = [self.weights(t) for t in words.distinct.to_pylist()]
        telling = np.array([bool(w) for w in weights], bool)
        at = np.flatnonzero(telling[words.codes]) if len(telling) else np.zeros(0, np.int64)
        found: list[list[float]] = [[] for _ in range(len(texts))]
        for text, code in zip((np.searchsorted(words.starts, at, "right") - 1).tolist(), words.codes[at].tolist(), strict=True):
            found[text] += weights[code]
        for text, word in self.restorer.spaced(words):
            if (v := self.lexicon.weight(word)) > 0:
                found[text].append(v)
        rows = [self.lexicon.numbers(f, n) for f, n in zip(found, np.diff(words.starts).tolist(), strict=True)]
        return self.lexicon.score(np.array(rows).reshape(-1, 4))


def fitted(words: list[list[str]], labels: np.ndarray, least: int = 3, odds: float = 1.5) -> Lexicon:
    """Lexicon from half the rows and regression on the other half, then the lexicon of all rows; a text's words count once."""
    model = Lexicon()
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        model.intercept = 30.0 if share else -30.0
        return model

    def learn(rows: np.ndarray) -> dict[str, float]:
        seen = (Counter(), Counter())
        for r in rows:
            seen[labels[r]].update({f for w in set(words[r]) for f in features_of(w)})
        n = [max(1, int((labels[rows] == y).sum())) for y in (0, 1)]
        out = {}
        for f, k in seen[1].items():
            if k >= least:
                v = math.log((k + 0.5) / (n[1] + 1)) - math.log((seen[0][f] + 0.5) / (n[0] + 1))
                if v >= odds:
                    out[f] = v
        return out

    x = np.zeros((len(words), 4))
    side = np.random.default_rng(1).permutation(len(words)) % 2
    for half in (0, 1):  # a row's numbers come from a lexicon learnt without it
        model.weights = learn(np.flatnonzero(side != half))
        mine = np.flatnonzero(side == half).tolist()
        memo = {w: v for r in mine for w in set(words[r]) if (v := model.weight(w))}
        for r in mine:
            x[r] = model.numbers([memo[w] for w in words[r] if w in memo], len(words[r]))
    model.centre, model.spread = x.mean(0), x.std(0) + 1e-9
    z, y = (x - model.centre) / model.spread, labels.astype(float)
    use = np.ones(4, bool)
    while True:  # more evidence never lowers a score: the number with the most negative coefficient is left out
        a, wb = np.c_[z[:, use], np.ones(len(z))], np.zeros(int(use.sum()) + 1)
        ridge = np.diag(np.r_[np.full(len(wb) - 1, 0.5), 1e-6])
        for _ in range(25):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(a @ wb, -30, 30)))
            h = p * (1 - p) + 1e-6
            wb = wb + np.linalg.solve(a.T @ (a * h[:, None]) + ridge, a.T @ (y - p) - ridge @ wb)
        w, b = np.zeros(4), wb[-1]
        w[use] = wb[:-1]
        if (w >= 0).all():
            break
        use[int(w.argmin())] = False
    model.coefficients, model.intercept = w, float(b)
    model.weights = learn(np.arange(len(words)))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most most_rows labelled rows, those of the smallest hash of the id: (id, y). labels is cut first, so its bound is proven when it is broadcast."""
    clean = labels.select(F.col(id_col), F.col(label).cast("int").alias("y")).where(F.col(id_col).isNotNull() & F.col("y").isin(0, 1)).groupBy(id_col).agg(F.max("y").alias("y"))
    return F.broadcast(clean.orderBy(F.xxhash64(id_col), id_col).limit(most_rows))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, DataFrame]:
    """The language model over all of docs, and the restored words of at most most_rows labelled rows (whole texts): id, words, y."""
    model = language_model(docs, text_col)
    chosen = labelled_sample(docs, labels, label, most_rows, id_col)
    restorer = Restorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            words = list(map(" ".join, restorer.words(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string()), batch.column(2)], ["id", "words", "y"])

    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).where(F.col("id").isNotNull())
    rows = source.join(chosen.select(F.col(id_col).alias("id"), "y"), "id").select("id", "text", "y")
    return model, rows.mapInArrow(run, f"id {source.schema[0].dataType.simpleString()}, words string, y int")


def model_of(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Lexicon]:
    """train(), with the bounded sample brought to the driver and the lexicon fitted there."""
    import sys

    model, rows = train(docs, labels, most_rows, label, id_col, text_col)
    words, y = [], []
    for row in rows.orderBy("id").toLocalIterator():
        words.append([sys.intern(w) for w in row["words"].split()])
        y.append(row["y"])
    return model, fitted(words, np.array(y, int))


def score(docs: DataFrame, model: np.ndarray, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text. Model and lexicon go along with the tasks: their size is bounded by CLASSES and the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, lexicon)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch.column(1)), pa.float64())], [id_col, "score"])

    source = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: np.ndarray, lexicon: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, with all their columns; rows don't leave their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, lexicon)
        for batch in sliced(batches):
            yield batch.filter(pa.array(scorer.scores(batch.column(batch.schema.get_field_index(text_col))) < threshold))

    return docs.mapInArrow(run, docs.schema)
