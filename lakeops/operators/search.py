"""Keyword and vector ranking, fused."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.operators.aggregates import surrogate_key


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda word: word == F.lit(term)


def keyword_scores(docs: DataFrame, key: str, text: str, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of the terms; document counts and lengths are over all rows."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    sized = docs.select(F.col(key), words.alias("w")).withColumn("n", F.size("w"))
    hits = sized.select(key, "n", *(F.size(F.filter("w", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)))
    whole = hits.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return hits.crossJoin(whole).select(key, score.alias("score")).where("score > 0")


def cosine_scores(vectors: DataFrame, key: str, vector: str, query: Sequence[float]) -> DataFrame:
    """Cosine with a query vector, in column functions."""
    q = F.array(*map(F.lit, query))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    v = F.col(vector).cast("array<double>")
    dot = total(F.zip_with(v, q, lambda x, y: x * y))
    length = F.sqrt(total(F.transform(v, lambda x: x * x))) * sum(x * x for x in query) ** 0.5
    return vectors.select(key, (dot / F.nullif(length, F.lit(0.0))).alias("score")).where("score IS NOT NULL")


def fused(keyword: DataFrame, vector: DataFrame, key: str, k: int, offset: int = 60) -> DataFrame:
    """Reciprocal rank fusion of whole rankings, ranked over ranges; ties go to the smaller key."""
    a, b = (surrogate_key(df, [F.desc("score"), F.col(key)], name).select(key, name) for df, name in ((keyword, "a"), (vector, "b")))
    both = a.join(b, key, "full_outer")
    part = lambda c: F.coalesce(1.0 / (offset + F.col(c)), F.lit(0.0))
    return both.select(key, F.round(part("a") + part("b"), 9).alias("score")).orderBy(F.desc("score"), key).limit(k)
