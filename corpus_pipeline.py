"""From raw documents to token ids, in five stages.

A stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents, further ones of whatever name included.

Edge cases, the same in all stages: null and empty texts are harmless, without partners, passages or secrets, and stay
as they are; rows without an id stay; rows that repeat an id are judged by their own texts, and stay or go as one where
their near-duplicate group is decided by id; repeated rows are judged alike; very long texts are taken whole; an empty
table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm import bpe, decontaminate, jaccard, secrets, toxicity
from lakeops.llm.common import fresh_name, table, trained_on, written


#: Octets of the batches in which texts go to Python workers, for the session that runs the pipeline: what a worker and
#: its task hold at once follows from it.
BATCH_OCTETS = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Stages whose result is computed when it is written by the caller send texts in small batches, too."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_OCTETS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that score 0.5 or more go; the model is learnt from the documents that are there."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(trained_on(F.col("doc_id")))
    return toxicity.accepted(docs, *toxicity.model_of(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: shingles of five words, similarity of 0.8 or more; the document with the smallest id of each component stays."""
    return jaccard.one_of_each(docs, jaccard.Similarity(words=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a benchmark passage go."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: secrets are replaced by a mark; every document stays, n_chars follows the text."""
    spans = fresh_name(docs)
    found = secrets.find(docs, spans_col=spans)
    hit = F.size(spans) > 0
    text = F.when(hit, secrets.redacted(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: doc_id, n_tokens, ids (little-endian 32-bit)."""
    small_batches(spark)
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", bpe.n_tokens("ids").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", encode_tokens),
]

#: SQL can't express the first stage, a trained classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
