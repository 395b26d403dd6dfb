"""Search over stored vectors, merging and ranking of results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.lexicon import DATE_WORDS
from docloom.functions.text import contains_any, sigmoid, tokens


def is_date_query(text: Column) -> Column:
    return contains_any(F.lower(text), DATE_WORDS)


def prefer_first(first: DataFrame, second: DataFrame, key: Column) -> DataFrame:
    """Both tables, each key once: from the first where it has it, in order of ``ord``."""
    both = first.withColumn("branch", F.lit(0)).unionByName(second.withColumn("branch", F.lit(1))).withColumn("_key", key)
    w = Window.partitionBy("_key").orderBy("branch", "ord")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")


def without_summarised(results: DataFrame, by: str = "query_id") -> DataFrame:
    """Results (ord, content, is_summary, original_content) less originals that come after their summary."""
    summaries = results.where("is_summary").groupBy(by, F.col("original_content").alias("content")).agg(F.min("ord").alias("_first"))
    return results.join(summaries, [by, "content"], "left").where(F.col("is_summary") | F.col("_first").isNull() | (F.col("ord") < F.col("_first"))).drop("_first")


def tiered(results: DataFrame, dated: Column, keyed: Column, id_col: str, limit: int = 20) -> DataFrame:
    """Date-relevant records, then those with a keyword, then the rest; each by distance, at most ``limit`` in all."""
    tier = F.when(dated, 1).when(keyed, 2).otherwise(3)
    return results.withColumn("tier", tier).orderBy("tier", "distance", id_col).limit(limit)


def context(results: DataFrame, by: str, order: list[str], text_col: str, separator: str = "\n\n---\n\n") -> DataFrame:
    """One text for each query, of its results' texts in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, text_col)))
    return results.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p[text_col]), separator).alias("context"))


def reranked(results: DataFrame, logit: Column, k: int, id_col: str, by: str = "query_id") -> DataFrame:
    """By the sigmoid of a model's logit, highest first; the k best of each query."""
    w = Window.partitionBy(by).orderBy(F.desc("rerank_score"), id_col)
    return results.withColumn("rerank_score", F.round(sigmoid(logit), 6)).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def with_embeddings(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with an ``embedding`` from a provider, one batch of texts at a time; null texts count as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(np.asarray(embed(texts.fillna("").tolist()), np.float32)))

    return docs.withColumn("embedding", run(F.col(text_col)))


def hashing_embeddings(texts: list[str], width: int = 64) -> np.ndarray:
    """A stand-in provider: hashed bag of words, unit length.  It knows no meaning.

    A text whose words cancel each other out, or that no word is split from though it is
    not blank, takes the place of its own hash; only blank texts are zero.
    """
    import xxhash

    out = np.zeros((len(texts), width))
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            h = xxhash.xxh64_intdigest(word)
            row[h % width] += 1 if h >> 63 else -1
        if not row.any() and text.strip("\t\n\f\r "):
            row[xxhash.xxh64_intdigest(text.lower()) % width] = 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def bm25(docs: DataFrame, terms: list[str], id_col: str, text_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents that hold a term of the query, by the Okapi formula.

    Words are counted where they lie and only the query's terms are shuffled.
    """
    words = tokens(F.lower(F.coalesce(text_col, F.lit(""))))
    count = lambda term: F.size(F.filter("words", lambda w: w == F.lit(term)))
    sized = docs.select(F.col(id_col), words.alias("words")).select(id_col, F.size("words").alias("size"), *(count(t).alias(f"tf{i}") for i, t in enumerate(terms)))
    stats = sized.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    idf = lambda i: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    part = lambda i: idf(i) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    hits = sized.where(" or ".join(f"tf{i} > 0" for i in range(len(terms))))
    return hits.join(F.broadcast(stats)).select(id_col, F.round(sum(part(i) for i in range(len(terms))), 6).alias("score"))


def keyword_recall(expected: Column, answer: Column) -> Column:
    """Share of the distinct expected words that stand in the answer; 0 without any."""
    words = F.array_distinct(tokens(F.lower(expected)))
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(answer), w)))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(0.0)


def coverage(whole: Column, part: Column) -> Column:
    """Per cent of the distinct lower-cased words of ``whole`` that ``part`` has."""
    words = F.array_distinct(tokens(F.lower(whole)))
    return F.when(F.size(words) > 0, 100 * F.size(F.array_intersect(words, F.array_distinct(tokens(F.lower(part))))) / F.size(words)).otherwise(0.0)



def result_counts(results: DataFrame) -> DataFrame:
    """One row: results in all, summaries, results of the graph, dated ones, and originals (the rest)."""
    counts = {c: F.count_if(F.coalesce(c, F.lit(False))) for c in ("is_summary", "is_graph", "is_dated")}
    return results.agg(F.count("*").alias("total"), *(n.alias(c) for c, n in counts.items())).withColumn("originals", F.col("total") - F.col("is_summary") - F.col("is_graph"))


def keyword_totals(keywords: DataFrame, col: str = "keywords") -> DataFrame:
    """(keyword, n): how many records hold each keyword, from arrays."""
    return keywords.select(F.explode(F.array_distinct(col)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


def shares_date(stored: Column, asked: Column) -> Column:
    """Whether a record's dates (joined by ``; ``) hold one of those asked for."""
    return F.coalesce(F.arrays_overlap(F.split(stored, "; "), asked), F.lit(False))


def keyword_relevant(keywords: Column, query: Column) -> Column:
    """Whether the query holds one of a record's keywords, in any case."""
    return F.coalesce(F.exists(keywords, lambda k: F.contains(F.lower(query), F.lower(k))), F.lit(False))


def date_merged(results: DataFrame, n: int, id_col: str, by: str = "query_id") -> DataFrame:
    """Results found by date first, then by distance (1 where there is none), at most 2 ``n`` of each query."""
    w = Window.partitionBy(by).orderBy(F.desc("from_date_search"), F.coalesce("distance", F.lit(1.0)), id_col)
    return results.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= 2 * n)


def prompt(context: Column, question: Column) -> Column:
    """What a model is asked; a fixed sentence where no context was found."""
    found = F.coalesce(F.nullif(context, F.lit("")), F.lit("No relevant document was found."))
    return F.concat(F.lit("Context:\n"), found, F.lit("\n\nQuestion: "), question)
