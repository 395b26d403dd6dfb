"""Nearest vectors by blocks and through the index against numpy; retrieval on hand-written records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.dates import partial_match
from docloom.functions.text import cosine
from docloom.operators import search, vectors
from docloom.sources.tables import read_table


def plain(queries, records, k, above=None, least=None, others=False, larger_first=False):
    out = {}
    for q, x in queries:
        found = []
        for i, y in records:
            n = np.linalg.norm(x) * np.linalg.norm(y)
            cos = float(np.dot(x, y) / n) if n else 0.0
            if (above is None or cos > above) and (least is None or round(cos, 6) >= least) and not (others and i == q):
                found.append((-round(cos, 6), -i if larger_first else i, i))
        out[q] = [i for *_, i in sorted(found)[:k]]
    return {q: ids for q, ids in out.items() if ids}


def listed(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = [(int(i), np.float32(rng.normal(0, 1, 8)).tolist()) for i in range(200)]
    return base + [(300, base[0][1]), (301, base[0][1]), (302, [0.0] * 8)]


def frames(spark, rows):
    bad = [(900, None), (901, [1.0] * 7), (None, [1.0] * 8)]
    records = spark.createDataFrame([(*r, 1, "x") for r in rows + bad], "vec_id long, embedding array<float>, i int, list string").repartition(4)
    return records.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")).where("query_id % 20 = 0 or query_id > 299"), records


@pytest.mark.parametrize("options", [{}, {"above": 0.3, "others": True, "larger_first": True}, {"least": 0.5, "others": True}])
def test_nearest_by_blocks(spark, rows, options):
    asked, records = frames(spark, rows)
    want = plain([r for r in rows if r[0] % 20 == 0 or r[0] > 299], rows, 4, **options)
    for block in (10_000, 17):
        assert listed(vectors.nearest(asked, records, 4, width=8, block_rows=block, **options)) == want
    assert vectors.nearest(asked.limit(0), records, 4).collect() == []


def test_blocks_meet_in_any_number_of_partitions(spark, rows):
    asked, records = frames(spark, rows)
    every = records.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        assert listed(vectors.nearest(every, records, 4, width=8, block_rows=50)) == plain(rows, rows, 4)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_all_within_a_threshold_or_all(spark, rows):
    asked, records = frames(spark, rows)
    want, held = {}, [r for r in rows if r[0] % 20 == 0 or r[0] > 299]
    near = plain(held, rows, len(rows), least=0.8, others=True)
    for q, _ in held:
        want[q] = sorted(near.get(q) or [i for i, _ in rows if i != q])
    found = vectors.alike_or_all(asked, records, 0.8, width=8, others=True)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert {q: sorted(ids) for q, ids in got.items()} == want
    assert max(map(len, near.values())) > 1 and len(near) < len(held)
    bounds = asked.withColumn("least", F.when(F.col("query_id") != 0, 0.5))
    some, every = (sorted((r.query_id, r.id, r.similarity) for r in vectors.alike(bounds, records, width=8, block_rows=b).collect()) for b in (13, 10_000))
    assert some == every and sum(q == 0 for q, *_ in some) == len(rows)


def test_no_pair_is_a_row(spark, rows):
    asked, records = frames(spark, rows)
    plan = vectors.nearest(asked, records, 4, width=8)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_index_probing_all_lists_is_exact(spark, rows):
    asked, records = frames(spark, rows)
    index = vectors.build_index(records, width=8, lists=9)
    assert index.records.count() == len(rows) and index.lists.agg(F.sum("n")).first()[0] == len(rows)
    want = plain([r for r in rows if r[0] % 20 == 0 or r[0] > 299], rows, 5)
    assert listed(vectors.search_index(index, asked, 5, probes=9, width=8, block_rows=11)) == want
    assert listed(vectors.search_index(index, asked, 5, probes=1, width=8)) != want


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_at_10(spark, sf):
    records = read_table(spark, f"/root/testdata/{sf}", "embeddings")
    asked = records.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = vectors.build_index(records)
    exact, found = listed(vectors.nearest(asked, records, 10)), listed(vectors.search_index(index, asked, 10))
    recall = np.mean([len(set(found[q]) & set(ids)) / len(ids) for q, ids in exact.items()])
    assert recall >= 0.9
    assert index.probes < len(index.centroids)


def test_index_on_clusters_probes_few_lists(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (40, 16))
    rows = [(int(i), np.float32(centres[i % 40] + rng.normal(0, 0.05, 16)).tolist()) for i in range(2000)]
    records = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = records.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = vectors.build_index(records)
    exact, found = listed(vectors.nearest(asked, records, 10)), listed(vectors.search_index(index, asked, 10))
    assert index.probes <= len(index.centroids) / 4
    assert np.mean([len(set(found[q]) & set(ids)) / len(ids) for q, ids in exact.items()]) >= 0.9


def test_hot_key_is_cut_into_blocks(spark, rows):
    keyed = lambda rs: [(i, x, "hot" if i % 2 else f"k{i % 3}") for i, x in rs]
    asked = [r for r in rows if r[0] % 5 == 0]
    q = spark.createDataFrame(keyed(asked), "query_id long, vector array<float>, key string")
    r = spark.createDataFrame(keyed(rows), "id long, vector array<float>, key string")
    got = listed(vectors.nearest_of_key(q, r, 3, block_rows=13))
    want = {}
    for key in ("hot", "k0", "k1", "k2"):
        own = {i for i, _, k in keyed(rows) if k == key}
        want |= plain([x for x in asked if x[0] in own], [x for x in rows if x[0] in own], 3)
    assert got == want


def test_cosine_column(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_days_of_partial_dates(spark):
    cases = [("3 October 1998", "5 October 1998", False), ("3 October 1998", "3 octobre 1998", True), ("October 1998", "5 October 1998", True), ("1998", "5 October 1998", True), ("3rd October 1998", "3 October 1998", True), ("2020-03-05", "05/03/2020", True), ("2020-03-05", "05/04/2020", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert [r.got for r in df.select(partial_match(F.col("a"), F.col("b")).alias("got")).collect()] == [w for *_, w in cases]


RECORDS = "id long, vector array<float>, content string, dates string, keywords string, is_summary boolean, original_content string, extra int"


def test_retrieval_of_hand_written_records(spark):
    at = lambda d: [float(np.cos(np.arccos(1 - d))), float(np.sin(np.arccos(1 - d)))]
    records = spark.createDataFrame([
        (1, at(0.01), "first", None, None, False, None, 0), (2, at(0.02), "short", None, None, True, "long", 0), (3, at(0.03), "long", None, None, False, None, 0),
        (4, at(0.5), "fourth", "2020-01-10; 2021", "Price", False, None, 0), (5, at(0.6), "fifth", "10/01/2020", "delay", None, None, 0), (6, at(0.7), "sixth", "", None, False, None, 0),
        (7, None, "no vector", "2019-05-05", None, False, None, 0),
    ], RECORDS)
    ask = lambda text: search.retrieve(spark.createDataFrame([(1, text, [1.0, 0.0])], "query_id long, query_text string, query_vector array<float>"), records, 2, 0.6)
    rows = lambda text: [(r.id, r.from_dates) for r in ask(text).orderBy("rank").collect()]
    assert rows("what is it") == [(1, False), (2, False)]  # 3 follows its summary
    assert rows(None) == [(1, False), (2, False)]
    assert rows("signed 2020-01-10") == [(1, False)]  # no word about dates: what is near of what was fetched
    # 4 holds the date and is fetched first, but lies beyond the threshold, so it comes back from the dates.
    assert rows("the date 2020-01-10") == [(1, False), (4, True)]
    # No result has a date: the first records with dates join in, without a vector too.
    assert rows("which date") == [(1, False), (2, False), (4, True), (5, True)]
    far = search.retrieve(spark.createDataFrame([(1, "what", [-1.0, 0.0])], "query_id long, query_text string, query_vector array<float>"), records, 2, 0.6)
    assert [r.id for r in far.orderBy("rank").collect()] == [6, 5]  # nothing is near, so all that was fetched stays
    q = search.asked(spark.createDataFrame([(1, "the date 2019-05-05", [1.0, 0.0]), (2, "any deadline", [1.0, 0.0])], "query_id long, query_text string, query_vector array<float>"))
    none = search.fetched(q, records, 2).where(F.lit(False))
    got = {(r.query_id, r.id, r.source) for r in search.context_of(none, q, records).collect()}
    assert got == {(1, 7, "exact"), (2, 4, "first"), (2, 5, "first"), (2, 7, "first")}
    assert search.retrieve(q.limit(0).select("query_id", "query_text", "query_vector"), records).collect() == []


def test_a_block_needs_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    x, ids = rng.normal(0, 1, (1200, 4)), np.arange(10_000)
    y = rng.normal(0, 1, (10_000, 4))
    tracemalloc.start()
    p, q, s = vectors.best(x, ids[:1200], y, ids, 3, None, None, False, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and len(p) == 3600
    assert np.allclose(s[:3], np.sort(x[0] @ y.T)[::-1][:3])


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize(("above", "least"), [(0.35, None), (0.35, 0.5), (0.9, None), (-0.5, None)])
def test_few_over_a_bound_and_many_agree(k, above, least, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.round(rng.normal(size=(150, 6)), 0), np.zeros((2, 6))])  # many equals, and vectors without length
    x, ids = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), rng.permutation(400)[:152]
    got = []
    for few in (1, 10**9):  # only those over the bound, or all
        monkeypatch.setattr(vectors, "FEW", few)
        got += [[a.tolist() for a in vectors.best(x[:70], ids[:70], x, ids, k, above, least, True, larger)] for larger in (True, False)]
    assert got[:2] == got[2:] and got[0][0]


def test_few_over_a_bound_are_not_searched_among_all(monkeypatch):
    x = np.eye(40)
    monkeypatch.setattr(np, "partition", None)  # the search for the k-th of all
    p, q, s = vectors.best(x[:5], np.arange(5), x, np.arange(40), 3, 0.35, None, False, True)
    assert p.tolist() == q.tolist() == list(range(5)) and s.tolist() == [1.0] * 5
