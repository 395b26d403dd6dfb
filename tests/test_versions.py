from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.sources.versions import Store, state_of


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_replace_and_read(spark, store):
    assert store.manifest() is None
    with pytest.raises(KeyError):
        store.read("nodes")
    first = store.replace({"nodes": spark.range(5), "edges": spark.range(2)})
    second = store.replace({"nodes": store.read("nodes").where("id > 2"), "edges": spark.range(0)})
    assert (first["version"], second["version"]) == (1, 2)
    assert ids(store.read("nodes")) == [3, 4] and ids(store.read("edges")) == []
    assert ids(store.read("nodes", first)) == [0, 1, 2, 3, 4]
    store.replace({})
    with pytest.raises(KeyError):
        store.read("nodes")
    store.clean(keep=1)
    assert store._versions() == [3] and not list(Path(store.root, "data").iterdir())


def test_append_once(spark, store):
    store.append({"nodes": spark.range(2)}, "monday")
    store.append({"nodes": spark.range(2, 4), "edges": spark.range(1)}, "tuesday")
    again = store.append({"nodes": spark.range(2, 4)}, "tuesday")
    assert again["version"] == 2 and ids(store.read("nodes")) == [0, 1, 2, 3] and ids(store.read("edges")) == [0]
    with pytest.raises(ValueError):
        store.append({"nodes": spark.range(1).select(F.col("id").cast("string"))}, "wednesday")
    assert store.manifest()["version"] == 2
    store.clean(keep=1)
    assert ids(store.read("nodes")) == [0, 1, 2, 3]


def test_failed_write_keeps_readers(spark, store):
    store.replace({"nodes": spark.range(3), "edges": spark.range(3)}, "a")
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.replace({"nodes": spark.range(9), "edges": broken}, "b")
    assert store.manifest()["state"] == "a" and ids(store.read("nodes")) == ids(store.read("edges")) == [0, 1, 2]


def test_two_writers(spark, store):
    store.replace({"nodes": spark.range(1)})
    seen = store.manifest()
    store.replace({"nodes": spark.range(2)})
    with pytest.raises(FileExistsError):
        store._switch(seen, state="", batches=[], tables={})
    assert ids(store.read("nodes")) == [0, 1]


def test_state(spark):
    rows = spark.createDataFrame([(1, "a", [1.0]), (2, None, None), (2, None, None)], "id long, text string, v array<double>")
    key = state_of(rows)
    assert state_of(rows.repartition(3).select("v", "id", "text")) == key
    others = [rows.limit(0), rows.dropDuplicates(["id"]), rows.withColumn("text", F.coalesce("text", F.lit(""))), rows.withColumn("id", F.col("id") + 1)]
    assert len({key, *map(state_of, others)}) == 5


def test_graph_follows_collection(spark, store):
    """A graph is made again when, and only when, the records it was made from change."""
    made = []

    def graph(records):
        made.append(1)
        return {"nodes": records.select("id"), "edges": records.alias("a").join(records.alias("b"), F.expr("a.id + 1 = b.id")).select(F.col("a.id"), F.col("b.id").alias("other"))}

    records = spark.range(4)
    for _ in range(2):
        version = store.fresh(state_of(records), lambda: graph(records))
    assert len(made) == 1 and store.read("edges", version).count() == 3
    more = spark.range(6)
    version = store.fresh(state_of(more), lambda: graph(more))
    assert len(made) == 2 and ids(store.read("nodes", version)) == [0, 1, 2, 3, 4, 5] and store.read("edges", version).count() == 5
