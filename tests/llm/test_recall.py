"""Recall of decontamination at the allowed edit distance, in spaced and unspaced scripts, whatever the blocks; secrets of texts with very many of them."""

import random

import pytest
from pyspark.sql import functions as F

from lakeops.llm import decontaminate, secrets


def made_up(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(n))


def replaced(r, text, share, letters="abcdefghijklmnopqrstuvwxyz"):
    out = list(text)
    for k in r.sample(range(len(out)), int(share * len(out))):
        out[k] = r.choice(letters)
    return "".join(out)


def cjk(r, n):
    return "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n))


@pytest.mark.parametrize("words", [12, 25, 60])
def test_recall_at_the_allowed_distance(words):
    r = random.Random(words)
    items = [made_up(r, words) for _ in range(100)]
    found = decontaminate.Benchmark(list(enumerate(items)), decontaminate.Settings(), 12)
    got = found.matches([f"{made_up(r, 40)} {replaced(r, t, 0.2)} {made_up(r, 40)}" for t in items])
    assert sum(i in x for i, x in enumerate(got)) >= (93 if words == 12 else 97)
    assert not any(found.matches([made_up(r, 100) for _ in range(40)]))


@pytest.mark.parametrize("share", [0, 0.1])
def test_unspaced_scripts_are_found(share):
    r = random.Random(9)
    letters = cjk(r, 3000)
    items = ["".join(r.choice(letters) for _ in range(80)) for _ in range(30)]
    found = decontaminate.Benchmark(list(enumerate(items)), decontaminate.Settings())
    texts = ["".join(r.choice(letters) for _ in range(300)) + replaced(r, t, share, letters) + "".join(r.choice(letters) for _ in range(300)) for t in items]
    assert all(i in x for i, x in enumerate(found.matches(texts)))
    assert not any(found.matches(["".join(r.choice(letters) for _ in range(900)) for _ in range(20)]))


def test_blocks_do_not_change_what_is_found(spark):
    r = random.Random(11)
    items = [made_up(r, n) for n in [12] * 12 + [60] * 12]
    rows = [(i, f"{made_up(r, 30)} {replaced(r, t, 0.2)} {made_up(r, 30)}") for i, t in enumerate(items)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = [{x.doc_id: list(x["items"]) for x in decontaminate.contaminated(docs, benchmark, decontaminate.Settings(block_chars=size)).collect()} for size in (4_000_000, 1500)]
    assert got[0] == got[1] and sum(i in x for i, x in got[0].items()) >= 22


def test_texts_with_very_many_secrets(spark):
    """Ten times the hits take about ten times the work, not a hundred times, in finding and in replacing."""
    text = " ".join(f"é token=abcdef{k}" if k % 2 else "AKIA" + "A" * 20 for k in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = secrets.find(docs)
    row = found.select(F.size("secret_spans").alias("n"), F.element_at("secret_spans", -1).alias("last"), secrets.redacted(F.col("text"), F.col("secret_spans")).alias("clean")).first()
    assert row.n == 100_000 and row.last.end == len(text)
    assert row.clean == " ".join("é [SECRET]" if k % 2 else "[SECRET]" for k in range(100_000))


def test_overlapping_spans_become_one_mark(spark):
    r = random.Random(3)
    for _ in range(8):
        text = "".join(r.choice("aé漢😀 ") for _ in range(r.choice([5, 40, 2500])))
        spans = sorted((a, min(len(text), a + r.randrange(1, 9))) for a in (r.randrange(len(text)) for _ in range(r.randrange(6))))
        out, at = [], 0
        for a, b in spans:
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = max(at, b)
        df = spark.createDataFrame([(text, [(a, 0, b, "x") for a, b in spans])], "text string, spans array<struct<start:int,ord:int,end:int,kind:string>>")
        assert df.select(secrets.redacted(F.col("text"), F.col("spans"))).first()[0] == "".join([*out, text[at:]])


def test_a_second_version_scans_what_is_new(spark):
    import duckdb

    from lakeops.llm.queries import ORACLE_SQL, ledger_of_versions

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = sorted(map(tuple, ledger_of_versions(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(con.sql(ORACLE_SQL["ledger_of_versions"]).fetchall()) and 0 < got[1][2] < got[1][1]


def test_trie_query_equals_its_sql(spark):
    import duckdb

    from lakeops.llm.queries import ORACLE_SQL, op12_prefix_trie

    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = con.sql(ORACLE_SQL["op12_prefix_trie"])
    got = op12_prefix_trie(spark, "/root/testdata/sf0.01")
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
