"""Personal data: base rules, and a semi-Markov conditional random field that adds spans written in other ways.

A text is cut into tokens: runs of letters, runs of digits, and single characters. A candidate is a whole span of at
most LONGEST tokens with a kind (email, ip, card, phone) that its digits, letters and signs allow; it is scored by
features of the whole span: sizes of its groups of digits, what stands between them, checksum, ranges, signs at its
ends, the word before it. Spans of no kind are single tokens and score nothing. Over all ways to cut a text into
spans, the best one is found by dynamic programming, which chooses boundaries and kinds jointly; the field is fitted by
the likelihood of whole segmentations (forward and backward sums, numpy stochastic gradient descent).

There are no labels. The field learns from passages in which the base rules have found something, some of them written
in other ways (without the plus sign, with words for signs, with other separators) and some spoilt (a wrong check
digit, a part out of range), and from passages with digits in which they haven't. At most `most_windows` passages of
each kind are taken, by hash, from all documents.

Spans of the base rules always stay; the field adds spans that meet none of them and that it holds to be far likelier
than none (CAUTION).

Edge cases: null and empty texts hold nothing; texts are read whole, in time that is linear but for the candidates,
which are bounded for each token; repeated rows get their own spans, null ids too; a table without passages gives a
field that adds nothing; an empty table gives an empty result; other columns are carried if they are asked for, a
column that is named as the result is replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lakeops.llm.common import sliced, written

#: The kinds, in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")

#: Most tokens of a span; numbers of weights; how much likelier a span must be than none, as a logarithm.
LONGEST, WEIGHTS, CAUTION = 24, 1 << 16, 2.0

#: Characters on either side of what the base rules or a hint have found, in a passage to learn from.
AROUND = 60

Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    twice = [2 * int(c) - 9 * (c > "4") for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def small(part: str) -> bool:
    """Whether a number is at most 255, whatever its length."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def emails(text: str) -> Iterator[Span]:
    """From each sign to the left as far as a name goes, to the right a domain; each character is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end(), "email"
        done = found.end() if found else at + 1
        at = text.find("@", max(done, at + 1))


def addresses(text: str) -> Iterator[Span]:
    """Numbers with dots between them, four at a time."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts = [(m.start(), m.end()) for m in _PART.finditer(text, run.start(), run.end())]
        for k in range(0, len(parts) - 3, 4):
            if all(small(text[a:b]) for a, b in parts[k : k + 4]):
                yield parts[k][0], parts[k + 3][1], "ip"


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, by kind and then start."""
    found = list(emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += addresses(text)
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return found


# The field: tokens, candidates and their features.

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)

#: Words for signs.
_AT, _DOT = frozenset({"@", "at"}), frozenset({".", "dot"})

#: Where candidates can be at all: digits or signs of the kinds, written out or not.
_HINT = re.compile(r"@|[0-9](?:[^0-9]{0,6}[0-9]){3}|[\[({<]\s*(?i:at)\s*[\])}>]|\b(?i:at)\b.{1,60}?\b(?i:dot)\b", re.DOTALL)
#: The same as above but for the distance of digits, for whole tables.
HINT = r"[0-9@]|[\[({<]\s*(?i:at)\s*[\])}>]|\b(?i:at)\b[^@]{1,60}?\b(?i:dot)\b"

_SIGNS = frozenset(" .-()+/,\t –_[]{}<>|:")


def tokens(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def _slot(kind: str, name: str) -> int:
    return crc32(f"{kind} {name}".encode()) % WEIGHTS


@dataclass
class Candidate:
    """Tokens first to last, a kind, and the places of its features' weights."""

    first: int
    last: int
    kind: str
    features: list[int]


def _sides(text: str, start: int, end: int) -> list[str]:
    def name(c: str) -> str:
        return "none" if not c else "space" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isdigit() else c

    words = text[max(0, start - 30) : start].split()
    return [f"left={name(text[start - 1 : start])}", f"right={name(text[end : end + 1])}", f"before={words[-1].lower() if words else ''}"]


def _numeric(text: str, cut: list[tuple[int, int]], groups: list[int], first: int, last: int) -> list[Candidate]:
    """Candidates of addresses, cards and phones over tokens without letters; groups: which tokens are digits."""
    start, end = cut[first][0], cut[last][1]
    sizes = [cut[g][1] - cut[g][0] for g in groups]
    digits = "".join(text[cut[g][0] : cut[g][1]] for g in groups)
    between = [text[cut[a][1] : cut[b][0]] for a, b in zip(groups, groups[1:], strict=False)]
    kinds = ["ip"] * (len(sizes) == 4 and max(sizes) <= 3) + ["card"] * (13 <= len(digits) <= 19) + ["phone"] * (7 <= len(digits) <= 15)
    names = [f"n={len(digits)}", f"groups={len(sizes)}", f"sizes={','.join(map(str, sizes))}", f"head={text[start : cut[groups[0]][0]]}", f"tail={text[cut[groups[-1]][1] : end]}", f"widest={max(map(len, between), default=0)}", f"same={len(set(between)) < 2}"]
    names += [f"sep={s}" for s in sorted(set(between))] + _sides(text, start, end)
    out = []
    for kind in kinds:
        more = ["bias"]
        if kind == "card":
            more.append(f"check={luhn(digits)}")
        if kind == "ip":
            more.append(f"small={all(small(text[cut[g][0] : cut[g][1]]) for g in groups)}")
        out.append(Candidate(first, last, kind, [_slot(kind, n) for n in (*names, *more)]))
    return out


def _named(text: str, cut: list[tuple[int, int]], at: int, first: int, last: int) -> list[Candidate]:
    """Candidates of addresses of mail around a token that stands for the sign."""
    start, end = cut[first][0], cut[last][1]
    before, after = text[start : cut[at][0]], text[cut[at][1] : end]
    name, domain = before.rstrip(" \t[({<"), after.lstrip(" \t])}>")
    if before[-1:].isspace() and after[:1].isspace() and re.search(r"\.\s|\s\.", domain):  # a word between words, and the end of a sentence
        return []
    labels = re.split(r"\s*[\[({<]?\s*(?:\bdot\b|\.)\s*[\])}>]?\s*", domain.lower())
    if not name or len(labels) < 2 or not all(re.fullmatch(r"[a-z0-9-]+", x) for x in labels) or not all(c in _LOCAL for c in name):
        return []
    dots = re.findall(r"[\s\[({<]*(?:\bdot\b|\.)[\s\])}>]*", domain.lower())
    names = ["bias", f"sign={before[len(name) :]}{text[cut[at][0] : cut[at][1]].lower()}{after[: len(after) - len(domain)]}", f"labels={len(labels)}", f"top={labels[-1]}", f"toplen={len(labels[-1])}", f"dots={'|'.join(sorted(set(dots)))}", f"tail={text[end - 1].isalnum()}"]
    return [Candidate(first, last, "email", [_slot("email", n) for n in (*names, *_sides(text, start, end))])]


def candidates(text: str, cut: list[tuple[int, int]], taken: Sequence[tuple[int, int]] = ()) -> list[Candidate]:
    """All candidates over the tokens of a passage, none of which meets what is taken, in order of their last token."""
    blocked = np.zeros(len(cut) + 1, bool)
    starts = np.array([a for a, _ in cut], np.int64)
    for a, b in taken:
        blocked[max(0, np.searchsorted(starts, a, "right") - 1) : np.searchsorted(starts, b)] = True
    kind = ["digit" if text[a].isdigit() and text[a].isascii() else "letter" if text[a].isalpha() else "space" if text[a].isspace() else "sign" for a, _ in cut]
    out: list[Candidate] = []
    for first in range(len(cut)):
        if blocked[first] or not (kind[first] == "digit" or text[cut[first][0]] in "+("):
            continue
        groups: list[int] = []
        total = 0
        for last in range(first, min(first + LONGEST, len(cut))):
            if blocked[last] or kind[last] == "letter" or (kind[last] != "digit" and text[cut[last][0]] not in _SIGNS):
                break
            if kind[last] == "digit":
                groups.append(last)
                total += cut[last][1] - cut[last][0]
                if total > 19:
                    break
                if total >= 4:
                    out += _numeric(text, cut, groups, first, last)
            elif last - (groups[-1] if groups else first) > 4:
                break
    for at, (a, b) in enumerate(cut):
        if blocked[at] or text[a:b].lower() not in _AT or at == 0:
            continue
        lows = []
        for first in range(at - 1, max(-1, at - LONGEST // 2), -1):
            if blocked[first]:
                break
            if kind[first] in ("letter", "digit"):
                lows.append(first)
            elif lows and text[cut[first][0]] not in "._%+-":  # a name holds no space
                break
            elif not lows and text[cut[first][0]] not in " \t[({<":
                break
        highs = []
        for last in range(at + 1, min(len(cut), lows[0] + LONGEST if lows else 0)):
            if blocked[last] or text[cut[last][0]] in "\r\n":
                break
            if kind[last] in ("letter", "digit"):
                highs.append(last)
            elif text[cut[last][0]] not in ".- \t[](){}<>":
                break
        for first in lows:
            for last in highs:
                if last - first < LONGEST:
                    out += _named(text, cut, at, first, last)
    return sorted(out, key=lambda c: c.last)


def best(n: int, found: list[Candidate], weights: np.ndarray, caution: float = CAUTION) -> list[Candidate]:
    """The likeliest cut of n tokens: which candidates it holds."""
    top, back = [0.0] * (n + 1), [None] * (n + 1)
    k = 0
    for end in range(1, n + 1):
        top[end] = top[end - 1]
        while k < len(found) and found[k].last == end - 1:
            c = found[k]
            score = top[c.first] + float(weights[c.features].sum()) - caution
            if score > top[end]:
                top[end], back[end] = score, c
            k += 1
    chosen, end = [], n
    while end > 0:
        c = back[end]
        if c is not None:
            chosen.append(c)
        end = c.first if c is not None else end - 1
    return chosen[::-1]


def marginals(n: int, found: list[Candidate], scores: np.ndarray) -> np.ndarray:
    """How likely each candidate is to be in a cut of n tokens, by sums forward and backward."""
    ahead = np.zeros(n + 1)
    k = 0
    for end in range(1, n + 1):
        ahead[end] = ahead[end - 1]
        while k < len(found) and found[k].last == end - 1:
            ahead[end] = np.logaddexp(ahead[end], ahead[found[k].first] + scores[k])
            k += 1
    behind = np.zeros(n + 1)
    by_first = sorted(range(len(found)), key=lambda j: -found[j].first)
    k = 0
    for start in range(n - 1, -1, -1):
        behind[start] = behind[start + 1]
        while k < len(by_first) and found[by_first[k]].first == start:
            j = by_first[k]
            behind[start] = np.logaddexp(behind[start], behind[found[j].last + 1] + scores[j])
            k += 1
    return np.array([np.exp(ahead[c.first] + s + behind[c.last + 1] - ahead[n]) for c, s in zip(found, scores, strict=True)])


def fit(passages: list[tuple[str, list[Span]]], rounds: int = 8, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights under which the given spans of the passages are likely; the same for the same passages."""
    weights, squares = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-6)
    made = []
    for text, spans in passages:
        cut = tokens(text)
        found = candidates(text, cut)
        gold = {(a, b, k) for a, b, k in spans}
        truth = np.array([(cut[c.first][0], cut[c.last][1], c.kind) in gold for c in found], float)
        if found:
            made.append((len(cut), found, truth))
    order = random.Random(0)
    for _ in range(rounds):
        order.shuffle(made)
        for n, found, truth in made:
            scores = np.array([weights[c.features].sum() for c in found])
            wrong = truth - marginals(n, found, scores)
            at = np.concatenate([c.features for c in found])
            slots, place = np.unique(at, return_inverse=True)
            step = np.bincount(place, np.repeat(wrong, [len(c.features) for c in found])) - decay * weights[slots]
            squares[slots] += step * step
            weights[slots] += rate * step / np.sqrt(squares[slots])
    return weights


# Passages to learn from.


def _rewritten(r: random.Random, span: str, kind: str) -> str:
    """The same datum as people write it to be understood by people alone, or by other habits."""
    if kind == "email":
        name, _, domain = span.partition("@")
        at = r.choice([" at ", " [at] ", "[at]", " (at) ", "(at)"])
        return name + at + (domain if r.random() < 0.4 and at != " at " else domain.replace(".", r.choice([" dot ", " [dot] ", "[dot]", "(dot)"])))
    if kind == "ip":
        return span.replace(".", r.choice(["[.]", " . ", "(.)", ". "]))
    digits = "".join(c for c in span if c.isdigit())
    if kind == "card":
        groups = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return r.choice([".", "/", "  ", " - "]).join(groups)
    last = [digits[-10:-7], digits[-7:-4], digits[-4:]]
    return r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}){}-{}", "00" + (digits[:-10] or "1") + " {} {} {}"]).format(*last)


def _spoilt(r: random.Random, span: str, kind: str) -> str:
    """Something alike that is no datum of the kind."""
    if kind == "email":
        return span.replace("@", r.choice([" @ ", " at the ", " "])).replace(".", " ")
    if kind == "ip":
        parts = span.split(".")
        parts[r.randrange(4)] = str(r.randrange(256, 999))
        return r.choice([".", "[.]", " . "]).join(parts)
    digits = [c for c in span if c.isdigit()]
    if kind == "card":
        digits[-1] = str((int(digits[-1]) + r.randrange(1, 9)) % 10)
        return r.choice(["", ".", "/", " "]).join("".join(digits)[k : k + 4] for k in range(0, len(digits), 4))
    year = f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}"
    return r.choice(["".join(digits[:7]), "".join(digits[-10:]), year, f"{year} {r.randrange(10, 24)}:{r.randrange(10, 60)}", f"{r.randrange(1, 999)}.{r.randrange(100, 999)}.{r.randrange(100, 999)}", f"{r.randrange(10, 99)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}"])


def taught(passages: list[tuple[str, list[Span]]]) -> list[tuple[str, list[Span]]]:
    """Passages as they are, and those with one span also with the span written in other ways, and spoilt."""
    out = list(passages)
    r = random.Random(1)
    for text, spans in passages:
        if len(spans) != 1:
            continue
        (start, end, kind) = spans[0]
        for _ in range(2):
            new = _rewritten(r, text[start:end], kind)
            out.append((text[:start] + new + text[end:], [(start, start + len(new), kind)]))
        out.append((text[:start] + _spoilt(r, text[start:end], kind) + text[end:], []))
    return out


def _passages(text: str, spans: list[Span]) -> Iterator[tuple[int, int, list[Span]]]:
    """Start, end and base spans (which are given by start) of what lies around each hint; hints whose surroundings meet share a passage."""
    at = [(a, b) for a, b, _ in spans] + [(m.start(), m.end()) for m in _HINT.finditer(text)]
    merged: list[list[int]] = []
    for a, b in sorted(at):
        if merged and a - merged[-1][1] <= 2 * AROUND:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    k = 0
    for a, b in merged:
        inside = []
        while k < len(spans) and spans[k][0] < b:
            inside.append(spans[k])
            k += 1
        yield max(0, a - AROUND), min(len(text), b + AROUND), inside


def _hinted(text: str | Column) -> Column:
    return (F.col(text) if isinstance(text, str) else text).rlike(HINT)


def train(df: DataFrame, most_windows: int = 300, text_col: str = "text") -> np.ndarray:
    """Weights learnt from at most `most_windows` passages of each kind and of none, chosen by hash from all rows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for text in batch["text"].to_pylist():
                for start, end, spans in _passages(text or "", sorted(base_spans(text or ""))):
                    if end - start <= 400:
                        kinds = {k for _, _, k in spans}
                        rows.append((text[start:end], kinds.pop() if len(kinds) == 1 else "several" if kinds else "none"))
            yield pa.record_batch({"passage": pa.array([p for p, _ in rows], pa.string()), "kind": pa.array([k for _, k in rows], pa.string())})

    texts = df.select(F.col(text_col).alias("text")).where(_hinted("text"))
    passages = written(texts.mapInArrow(found, "passage string, kind string").withColumn("hash", F.xxhash64("passage")), "passages")
    kinds = [*KINDS, "several", "none"]
    chosen = [r.passage for kind in kinds for r in passages.where(F.col("kind") == kind).orderBy("hash", "passage").limit(most_windows).collect()]
    return fit(taught([(p, base_spans(p)) for p in chosen]))


# The operator.


def spans_in(text: str, weights: np.ndarray) -> list[tuple[str, int, int, bool]]:
    """kind, start, end and whether a base rule has found it, of all spans, by kind and then start."""
    base = sorted(base_spans(text))
    starts, ends = np.array([a for a, _, _ in base], np.int64), np.maximum.accumulate(np.array([b for _, b, _ in base], np.int64))
    found = {(k, a, b): True for a, b, k in base}
    for start, end, _ in _passages(text, base) if weights.any() else ():
        cut = tokens(text, start, end)
        near = base[np.searchsorted(ends, start, "right") : np.searchsorted(starts, end)]
        for c in best(len(cut), candidates(text, cut, [(a, b) for a, b, _ in near if b > start]), weights):
            found[c.kind, cut[c.first][0], cut[c.last][1]] = False
    return [(k, a, b, x) for (k, a, b), x in sorted(found.items(), key=lambda s: (KINDS.index(s[0][0]), s[0][1], s[0][2]))]


def masked(text: str, spans: Sequence[tuple[str, int, int, bool]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that meet become one, named by the first."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("base", LongType())])


@lru_cache(maxsize=1)
def _hint() -> re.Pattern:
    return re.compile(HINT)


def find(df: DataFrame, weights: np.ndarray, keep: Sequence[str] = ("doc_id",), text_col: str = "text", spans_col: str = "pii_spans", masked_col: str | None = None) -> DataFrame:
    """The columns `keep` of every row with `spans_col`: kind, start, end (code points, end exclusive), base (1 if a base rule has found it, else 0); masked_col: also the text without the spans."""
    keep = [c for c in keep if c not in (spans_col, masked_col)]
    shared = df.sparkSession.sparkContext.broadcast(weights)  # as many as WEIGHTS
    kept = df.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)), F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = [StructField(f"k{n}", df.schema[c].dataType) for n, c in enumerate(keep)] + [StructField("spans", ArrayType(_SPAN))] + [StructField("masked", StringType())] * bool(masked_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch["text"]
            some = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]|(?i:at)"), False).to_numpy(zero_copy_only=False)
            rows: list = [[] for _ in range(batch.num_rows)]
            for k in np.flatnonzero(some).tolist():
                text = texts[k].as_py()
                if _hint().search(text):
                    rows[k] = spans_in(text, shared.value)
            columns = [batch[f"k{n}"] for n in range(len(keep))]
            lists = pa.array([[{"kind": a, "start": b, "end": c, "base": int(d)} for a, b, c, d in r] for r in rows], kind)
            more = [pa.array([t if t is None or not r else masked(t, r) for t, r in zip(texts.to_pylist(), rows, strict=True)], pa.string())] * bool(masked_col)
            yield pa.record_batch([*columns, lists, *more], names=[f.name for f in fields])

    out = kept.mapInArrow(run, StructType(fields))
    return out.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(keep)), F.col("spans").alias(spans_col), *([F.col("masked").alias(masked_col)] if masked_col else []))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
