"""Alignment of tokenizers, tries of conversations and personal data against brute-force versions on small hostile tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lakeops.llm import alignment, pii, prefix_trie
from lakeops.llm.queries import PIECES, TOKENIZER

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES)

TEXTS = [
    None, "", " ", "a  b", "\n", " lead x", "trail ", "a▁b c", "<|endoftext|> <s> </s> <0x41> the", "é漢😀 " * 20, "x\n y\nz \n w", "the the the a\tb",
    "a" * 40 + " bbb", " nb　sp", "0123456789" * 300, "the cat sat", "the cat sat", "a\n\nb \nc\n d", "漢字" * 500, "don't I'll 'tis", "\x00\x01 \x7f", "x\r\ny z",
]


# Alignment


def walked(texts):
    """Tokens, groups and links of each text, by a walk over both lists of tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    letters = alignment.byte_of_letter()
    out = []
    for text in texts:
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_side.encode(text or "")
        of_a = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
        of_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        meant = (" " + (text or "")).encode()
        if not text or b"".join(of_a) != meant or b"".join(of_b) != meant:
            out.append(None)
            continue
        i, j, end_a, end_b, links, groups = 0, 0, len(of_a[0]), len(of_b[0]), [], [([a[0]], [b[0]])]
        while True:
            links.append((a[i], b[j]))
            move_a, move_b = end_a <= end_b, end_b <= end_a
            i, j = i + move_a, j + move_b
            if i == len(a):
                break
            if move_a and move_b:
                groups.append(([], []))
            if move_a:
                end_a += len(of_a[i])
                groups[-1][0].append(a[i])
            if move_b:
                end_b += len(of_b[j])
                groups[-1][1].append(b[j])
        out.append((len(a), len(b), groups, links))
    return out


def brute_alignment(rows):
    found = walked([t for _, t in rows])
    held = Counter(p for x in found if x for p in set(x[3]))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for (i, _), x in zip(rows, found, strict=True):
        if not x:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = x
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("octets", [200, 1 << 20])
def test_alignment_equals_brute_force(spark, octets):
    rows = [(None if k == 11 else k // 2, t) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, batch int, pairs string").repartition(3)
    assert sorted(map(tuple, alignment.align(docs, A, B, octets=octets).collect()), key=repr) == brute_alignment(rows)


def test_alignment_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.align(docs, A, B).collect()), key=repr) == brute_alignment(rows)


def test_pairs_are_counted_once_a_document(spark):
    """Pairs of the identity map in vectors, others in the shuffle; together they are all pairs, each once a document."""
    texts = [t for t in TEXTS if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    counts = alignment.pair_counts(alignment.encoded(docs, A, B, octets=300), A, B)
    want = Counter(p for x in walked(texts) if x for p in set(x[3]))
    same, others = ({(r.a, r.b): r.n for r in df.collect()} for df in (counts.same, counts.others))
    assert not set(same) & set(others)
    assert {**same, **others} == want
    table = alignment.aligner(A, B).same
    assert all(table[a] == b for a, b in same) and not any(table[a] == b for a, b in others)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


# Trie


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


CONVERSATION = "conv_id long, turn long, role string, text string"


def conversations(seed, n):
    """Shared beginnings, copies, gaps in ids and turns, nulls everywhere, repeated rows, and one long conversation."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if r.random() < 0.2:
            continue
        for t in range(r.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]), r.choice(["hi", "ho", "é漢", "", None, f"own {c}"])))
    rows += rows[:20]
    rows += [(3 * n, t, "user", "long") for t in range(300)] + [(3 * n + 1, t, "user", "long") for t in range(280)] + [(None, 1, "user", "nobody's")]
    return rows


@pytest.mark.parametrize("block,base,chunk", [(prefix_trie.BLOCK, prefix_trie.BASE, prefix_trie.CHUNK), (7, 3, 5)])
def test_trie_equals_brute_force(spark, monkeypatch, block, base, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = conversations(4, 40)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{CONVERSATION}, hi string, depth int").repartition(3)
    got = prefix_trie.measured(*prefix_trie.rebuilt(df), block, base).drop("entered", "left").collect()
    assert sorted(map(tuple, got)) == brute_trie(rows)


def test_the_tour_nests(spark):
    """A node is left right after its subtree: two arcs for each of its nodes."""
    df = spark.createDataFrame(conversations(5, 40), CONVERSATION)
    rows = prefix_trie.measured(*prefix_trie.rebuilt(df), 11, 4).select("conv_id", "depth", "parent_conv_id", "n_children", "entered", "left").collect()
    assert sorted(x for r in rows for x in (r.entered, r.left)) == list(range(2 * len(rows)))
    node = {(r.conv_id, r.depth): r for r in rows}
    for r in rows:
        assert r.left > r.entered and (r.left == r.entered + 1) == (r.n_children == 0)
        if r.depth:
            up = node[r.parent_conv_id, r.depth - 1]
            assert up.entered < r.entered and r.left < up.left


@pytest.mark.parametrize("base", [30, 1000])
def test_lists_are_ranked(spark, base):
    r = random.Random(base)
    ids = r.sample(range(10**9), 400)
    rows = [(i, j, r.randrange(5), r.randrange(5), r.randrange(5)) for i, j in itertools.zip_longest(ids, ids[1:], fillvalue=-1)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "id long, after long, arcs long, leaves long, saved long")
    got = {x[0]: tuple(x[1:]) for x in prefix_trie.ranked(df, base).collect()}
    sums = np.vstack([[0, 0, 0], np.cumsum([x[2:] for x in rows], axis=0)[:-1]])
    assert got == {x[0]: tuple(s) for x, s in zip(rows, sums.tolist(), strict=True)}


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.measured(*prefix_trie.rebuilt(spark.createDataFrame([], CONVERSATION))).collect() == []


def test_trie_of_one_turn_that_is_not_borrowed(spark):
    """A conversation all of whose turns are replaced by those of one that isn't there ends at the root."""
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 0, "user", "x")]
    got = prefix_trie.measured(*prefix_trie.rebuilt(spark.createDataFrame(rows, CONVERSATION))).drop("entered", "left").collect()
    assert list(map(tuple, got)) == brute_trie(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


# Personal data

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_spans(text):
    out = []
    for kind, pattern in RULES:
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            fits = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),  # noqa: B023
                "card": lambda: 13 <= len(digits) <= 19 and sum(sum(divmod(d * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0,  # noqa: B023
                "phone": lambda: 9 <= len(digits) <= 15,  # noqa: B023
            }[kind]
            if fits():
                out.append((m.start(), m.end(), kind))
    return out


def test_base_rules_equal_the_patterns():
    r = random.Random(3)
    found = 0
    for k in range(6000):
        letters = ["aZ9.5@1-+ (", "0123456789. +-", "a@.b@-"][k % 3]
        text = "".join(r.choice(letters) for _ in range(r.randrange(1, 60)))
        want = brute_spans(text)
        found += len(want)
        assert pii.base_spans(text) == want
    assert found > 500


def test_base_rules_take_linear_time():
    for text in ("a" * 200_000, "a@" * 100_000, "1." * 100_000, "9" * 200_000, "+" * 200_000, "@" * 200_000, "1 " * 100_000):
        pii.base_spans(text)


def segmentations(n, found, at=0):
    """All ways to cut n tokens: lists of candidates' numbers."""
    if at == n:
        yield []
        return
    yield from segmentations(n, found, at + 1)
    for k, c in enumerate(found):
        if c.first == at:
            for rest in segmentations(n, found, c.last + 1):
                yield [k, *rest]


def test_dynamic_programmes_equal_all_segmentations():
    r = np.random.default_rng(0)
    for n in (1, 4, 9):
        found = sorted((pii.Candidate(a, b, "ip", [int(r.integers(pii.WEIGHTS))]) for a in range(n) for b in range(a, min(n, a + 4)) if r.random() < 0.6), key=lambda c: c.last)
        weights = np.zeros(pii.WEIGHTS)
        for c in found:
            weights[c.features] = r.normal()
        scores = np.array([weights[c.features].sum() for c in found])
        ways = list(segmentations(n, found))
        totals = np.array([sum(scores[k] for k in w) for w in ways])
        share = np.exp(totals) / np.exp(totals).sum()
        want = [sum(p for w, p in zip(ways, share, strict=True) if k in w) for k in range(len(found))]
        assert np.allclose(pii.marginals(n, found, scores), want)
        top = ways[int(np.argmax([sum(scores[k] - 0.3 for k in w) for w in ways]))]
        assert [(c.first, c.last) for c in pii.best(n, found, weights, 0.3)] == [(found[k].first, found[k].last) for k in top]


@pytest.fixture(scope="module")
def weights(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


@pytest.mark.parametrize(
    "text,span",
    [
        ("call me (152) 555-8590 now", "phone:(152) 555-8590"), ("mail bob.smith at mail2 dot example dot com please", "email:bob.smith at mail2 dot example dot com"),
        ("mail bob [at] example.com ok", "email:bob [at] example.com"), ("see 10[.]2[.]3[.]4 here", "ip:10[.]2[.]3[.]4"), ("card 4610.5689.0197.0798 ok", "card:4610.5689.0197.0798"),
        ("card 4610.5689.0197.0799 ok", None), ("on 2024-01-15 at 10:30", None), ("version 1.2.3 of it", None), ("id 1234567890 of it", None), ("we met at noon. it was hot", None), ("pi is 3.14159265", None),
        ("300[.]2[.]3[.]4 is none", None), ("we are at erre. Tintea. Of", None), ("see 42.73.240.87 4495589438270767 now", "card:4495589438270767"), ("sum of 1,234,567,890 in all", None),
    ],
)
def test_other_ways_to_write(weights, text, span):
    assert [f"{k}:{text[a:b]}" for k, a, b, base in pii.spans_in(text, weights) if not base] == ([span] if span else [])


def test_clean_documents_are_left_alone(spark, weights):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pii.find(docs, weights, keep=("doc_id", "text")).collect()
    assert len(found) == docs.count()
    for r in found:
        assert [(s.start, s.end, s.kind) for s in r.pii_spans if s.base] == brute_spans(r.text or "")
    added = {r.text[s.start : s.end] for r in found for s in r.pii_spans if not s.base}
    assert added <= {"4465758382889437"}  # twice with a space between, which the base rule takes for one number


def test_personal_data_of_a_hostile_table(spark, weights):
    long = "word " * 5000 + "a.b@c.de " + "+1 (152) 555-8590 " * 300
    rows = [(1, None, "a"), (1, "", "b"), (None, "x@y.zz", "c"), (3, long, "d"), (3, long, "d"), (4, "1.2.3.4 é漢 4610568901970798", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k0 string").withColumn("pii_spans", F.lit(1)).repartition(2)
    got = pii.find(docs, weights, keep=("doc_id", "k0", "pii_spans"), masked_col="clean").collect()
    assert sorted((r.k0, r.doc_id or 0, len([s for s in r.pii_spans if s.base])) for r in got) == [("a", 1, 0), ("b", 1, 0), ("c", 0, 1), ("d", 3, 301), ("d", 3, 301), ("e", 4, 2)]
    assert {r.k0: r.clean for r in got if r.k0 in "abce"} == {"a": None, "b": "", "c": "[EMAIL]", "e": "[IP] é漢 [CARD]"}
    assert pii.find(docs.where("false"), weights).collect() == []


def test_a_field_without_passages_adds_nothing(spark):
    docs = spark.createDataFrame([(1, "no numbers"), (2, None)], "doc_id long, text string")
    assert not pii.train(docs).any()
    assert pii.spans_in("(152) 555-8590 a@b.cc", np.zeros(pii.WEIGHTS)) == [("email", 15, 21, True)]
