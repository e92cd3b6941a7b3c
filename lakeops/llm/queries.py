"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm import alignment, bpe, decontaminate, hnsw, jaccard, pii, prefix_trie, quality, repeats, secrets, token_files, toxicity, warc
from lakeops.llm.common import scratch, table, trained_on

TIKTOKEN_RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER, VOCABULARY, END_ID = "byte_bpe_50k.json", 50_257, 2
PIECES = "piece_bpe_32k.model"


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_components(table(spark, sf_dir, "documents"), jaccard.Similarity(words=4, percent=85))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(TIKTOKEN_RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern)
    return bpe.decode(ids, ranks, pattern).select(
        "doc_id",
        bpe.n_tokens("ids").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("item_ids"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path, least=1000)
    return warc.resolved(warc.read(spark, path)).select(
        F.col("key").alias("page_id"), F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), END_ID, VOCABULARY)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model, lexicon = toxicity.model_of(docs, labels.where(trained_on(F.col("doc_id"))))
    return toxicity.score(docs, model, lexicon).select(
        "doc_id", (~trained_on(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    kinds = [rule.kind for rule in secrets.RULES]
    base = secrets.listed(F.filter(spans, lambda s: s["kind"].isin(kinds)))
    return found.select("doc_id", *map(count, kinds), F.sha2(base, 256).alias("base_sha256"), secrets.listed(spans).alias("spans"))


def ledger_of_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the documents against one ledger: blobs of each, and how many of them were scanned."""
    path = scratch(spark, "ledger")
    first = table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" token=abcdef123"))).otherwise(F.col("text"))
    rows, before = [], 0
    for version, docs in enumerate((first, first.withColumn("text", changed)), 1):
        known = secrets.update_ledger(docs, path).count()
        rows.append((version, docs.select(F.coalesce("text", F.lit(""))).distinct().count(), known - before))
        before = known
    return spark.createDataFrame(rows, "version int, blobs long, scanned long")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(trained_on(F.col("doc_id"))))
    return quality.score(docs, model).select(
        "doc_id", (~trained_on(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"), length=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.measured(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations"), parts=5, most=9)).drop("entered", "left")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    base = F.filter("pii_spans", lambda s: s["base"] == 1)
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii_spans")).alias("spans"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_decontamination": op3_decontamination,
    "op4_hnsw": op4_hnsw,
    "op5_warc": op5_warc,
    "op6_token_files": op6_token_files,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_repeats": op10_repeats,
    "op11_alignment": op11_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_personal_data": op13_personal_data,
    "ledger_of_versions": ledger_of_versions,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS h FROM p),
        o AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS original FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> original THEN original END AS refers_to
        FROM o""",
    "ledger_of_versions": """
        WITH a AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
        b AS (SELECT DISTINCT CASE WHEN doc_id % 10 = 0 THEN coalesce(text, '') || ' token=abcdef123' ELSE coalesce(text, '') END AS t FROM documents)
        SELECT 1 AS version, count(*) AS blobs, count(*) AS scanned FROM a
        UNION ALL SELECT 2, count(*), count(*) FILTER (t NOT IN (SELECT t FROM a)) FROM b""",
    "op8_secrets": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        r AS (SELECT * FROM (VALUES
            ('assign', 1, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
            ('access', 2, 'AKIA[A-Z0-9]+', 20),
            ('hex', 3, '[0-9a-f]+', 24)) AS v(kind, ord, pattern, least)),
        m AS (
            SELECT doc_id, kind, ord, least, string_split_regex(t, pattern) AS gaps, regexp_extract_all(t, pattern) AS hits,
                   CASE kind WHEN 'assign' THEN regexp_extract_all(t, pattern, 2) ELSE regexp_extract_all(t, pattern) END AS kept
            FROM d, r WHERE regexp_matches(t, CASE kind WHEN 'hex' THEN '[0-9a-f]{24}' ELSE pattern END)),
        n AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM m),
        s AS (
            SELECT doc_id, kind, ord, length(array_to_string(gaps[1:k], '')) + length(array_to_string(hits[1:k - 1], '')) AS a, length(hits[k]) AS n
            FROM n WHERE length(kept[k]) >= least),
        l AS (
            SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                   count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, ord) AS spans
            FROM s GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
               CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN l USING (doc_id)""",
    "op12_prefix_trie": """
        WITH t AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
            FROM conversations WHERE conv_id IS NOT NULL),
        h AS (
            SELECT c, c - c % 5 AS b, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
                       list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda x: [x, 0, 0, 0, 0, 0, 0, 0]))),
                       lambda crc, x: xor(xor(crc, x) >> 1, CASE WHEN xor(crc, x) & 1 = 1 THEN 3988292384 ELSE 0 END))) % 9 AS h
            FROM (SELECT c, count(*) AS n FROM t GROUP BY 1)),
        s AS (SELECT h.*, least(h.h, coalesce(o.n, 0)) AS lent FROM h LEFT JOIN h o ON o.c = h.b),
        r AS (
            SELECT s.c, t.place - s.h + s.lent AS d, t.role, t.text FROM s JOIN t ON t.c = s.c WHERE t.place > s.h
            UNION ALL SELECT s.c, t.place, t.role, t.text FROM s JOIN t ON t.c = s.b WHERE t.place <= s.h),
        p AS (
            SELECT c, d, octet_length(encode(text)) AS bytes, list([role, text]) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM r
            UNION ALL SELECT c, 0, 0, [] FROM s),
        e AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
        n AS (
            SELECT path, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
                   sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
            FROM e GROUP BY path),
        k AS (SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN n u ON n.depth > 0 AND u.path = n.path[1:n.depth - 1]),
        c AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY 1, 2),
        f AS (SELECT k.*, coalesce(c.n_children, 0) AS n_children FROM k LEFT JOIN c USING (conv_id, depth)),
        g AS (
            SELECT a.path, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.saved) AS saved_tokens
            FROM f JOIN p a ON a.c = f.conv_id AND a.d <= f.depth GROUP BY a.path)
        SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, f.n_children, g.n_leaves, CAST(g.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
        FROM f JOIN g USING (path)""",
}
