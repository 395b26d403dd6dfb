"""Vectors kept by the digest of their text, so that a provider sees each text once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.retrieval import with_embeddings

SCHEMA = "digest binary, embedding array<float>"


def digest(text: Column) -> Column:
    """Null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def cached(spark: SparkSession, path: str) -> DataFrame:
    """(digest, embedding) of a cache, each digest once; a cache that is not there yet is empty.

    A write that was repeated after a failure leaves a digest twice, with the same vector.
    """
    try:
        return spark.read.schema(SCHEMA).parquet(path).dropDuplicates(["digest"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def remember(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], path: str, text_col: str = "text") -> int:
    """Adds the vectors of texts that the cache lacks, each distinct text once; how many these were.

    Digests alone are compared with the cache; only texts that it lacks are shuffled.
    """
    spark = docs.sparkSession
    held = cached(spark, path).select("digest")
    keyed = docs.select(digest(F.col(text_col)).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lacking = keyed.select("digest").distinct().join(held, "digest", "left_anti")
    new = keyed.join(lacking, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    before = held.count()
    with_embeddings(new, embed).select("digest", "embedding").write.mode("append").parquet(path)
    return cached(spark, path).count() - before


def with_cached_embeddings(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with an ``embedding`` of each text, from the cache after what it lacks was added to it."""
    remember(docs, embed, path, text_col)
    vectors = cached(docs.sparkSession, path).withColumnRenamed("digest", "_digest")
    return docs.withColumn("_digest", digest(F.col(text_col))).join(vectors, "_digest", "left").drop("_digest")
