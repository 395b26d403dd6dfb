"""Conditions on records and the cache of embeddings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.predicates import condition, matching
from docloom.operators.retrieval import hashing_embeddings
from docloom.sources import embedding_cache
from docloom.sources.tables import read_table
from tests.conftest import SF


def test_condition_reaches_the_scan(spark):
    where = {"$or": [{"lang": "fr"}, {"$and": [{"source": {"$contains": "1"}}, {"n_chars": {"$gt": 200}}]}], "n_chars": {"$lt": 3000}, "lang": {"$in": ["fr", "en"]}}
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = matching(read_table(spark, SF, "documents"), where).select("doc_id")._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "LessThan(n_chars,3000)" in pushed and "In(lang" in pushed and "StringContains(source,1)" in pushed and "Or(" in pushed


def test_conditions_on_missing_fields(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, None), (3, "b", 7)], "id long, tag string, n int")
    ids = lambda w: [r.id for r in df.where(condition(w)).orderBy("id").collect()]
    assert ids({}) == ids({"$and": []}) == [1, 2, 3] and ids({"$or": []}) == []
    assert ids({"tag": {"$ne": "a"}}) == [2, 3] and ids({"tag": {"$nin": ["a", "b"]}}) == [2]
    assert ids({"tag": {"$in": []}}) == [] and ids({"tag": {"$nin": []}}) == [1, 2, 3]
    assert ids({"tag": {"$contains": "a"}, "n": {"$gte": 5, "$lt": 7}}) == [1]
    assert [r.id for r in matching(df, {"n": {"$gt": 0}}, 1).collect()] == [1]
    assert matching(df, limit=0).collect() == [] and matching(df).count() == 3
    for bad in ({"$not": []}, {"n": {"$near": 1}}, {"n": {}}):
        with pytest.raises(ValueError):
            condition(bad)


def test_provider_sees_each_text_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return hashing_embeddings(texts)

    path = str(tmp_path / "cache")
    docs = spark.createDataFrame([(k, f"text {k % 7}", b"x", 1.0) for k in range(50)] + [(90, None, b"x", 1.0), (91, "", b"x", 1.0)], "doc_id long, text string, digest binary, n double").repartition(4)
    first = {r.doc_id: r.embedding for r in embedding_cache.with_cached_embeddings(docs, embed, path).collect()}
    assert calls.value == 8 and len(first) == 52
    again = {r.doc_id: r.embedding for r in embedding_cache.with_cached_embeddings(docs, embed, path).collect()}
    assert calls.value == 8 and again == first
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("new")))
    assert embedding_cache.remember(more, embed, path) == 1 and calls.value == 9
    assert np.allclose(first[3], hashing_embeddings(["text 3"])[0])
    embedding_cache.cached(spark, path).limit(3).write.mode("append").parquet(path)  # as after a repeated write
    assert embedding_cache.with_cached_embeddings(docs, embed, path).count() == 52 and calls.value == 9
    assert embedding_cache.with_cached_embeddings(docs.limit(0), embed, str(tmp_path / "none")).collect() == []


def test_only_blank_texts_have_no_vector():
    words = [f"w{k}" for k in range(400)]
    rows = hashing_embeddings(words)
    at = {(int(np.argmax(np.abs(r))), float(r.sum())): w for w, r in zip(words, rows, strict=True)}
    place = next(p for p, sign in at if (p, -sign) in at)
    found = hashing_embeddings([f"{at[place, 1.0]} {at[place, -1.0]}", "\xa0", "\x0b", "", " \t\n"])
    assert np.linalg.norm(found, axis=1).tolist() == [1, 1, 1, 0, 0]
