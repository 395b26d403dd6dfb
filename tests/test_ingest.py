"""A document's way into the collection, by hand-written contracts and by what must arrive of whole texts."""

from pyspark.sql import functions as F

from docloom.operators import ingest
from docloom.sources.tables import read_table
from tests.conftest import SF

CONTRACT = "# 1. Scope\nArticle 4.2.1 Payment of the price\nThe buyer shall pay within thirty days of the invoice date.\n# 2. Term\n(a) the seller may end the contract."


def test_records_of_a_contract(spark):
    rows = [(1, CONTRACT, "c.pdf", "x"), (2, None, "n.pdf", "x"), (3, " \n\t", "b.pdf", "x"), (4, "one line", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string, content string")
    got = {(r.doc_id, r.position): r for r in ingest.ingested(docs).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (4, 0)]
    first, second, last = got[1, 0], got[1, 1], got[4, 0]
    assert (first.section_number, first.hierarchy, first.parent_section, first.total_chunks) == ("4.2.1", "4 -> 4.2 -> 4.2.1", "4.2", 2)
    assert first.document_title == "c.pdf" and first.restored == 0 and "thirty days" in first.content and "2. Term" in second.content
    assert first.embedded_text == f"Section: 4.2.1\nHierarchy: 4 -> 4.2 -> 4.2.1\nDocument: c.pdf\nChapter: {first.chapter_title}\nPosition: 0/2\nContent: {first.content}"
    assert (last.section_number, last.document_title, last.parent_section, last.clause_type) == ("unknown", "unknown", "unknown", "autre")
    assert ingest.ingested(docs.limit(0)).count() == 0


def test_whole_texts_arrive(spark):
    docs = read_table(spark, SF, "documents").withColumn("title", F.lit("t"))
    records = ingest.ingested(docs, words=100, percent=90).cache()
    seen = ingest.coverage(docs, records)
    assert seen.where("coverage < 100 or ratio < 100 or warn or size(missing) > 0").count() == 0
    assert seen.count() == docs.count() and seen.where("n_words > 0").count() == records.select("doc_id").distinct().count()
    off = records.groupBy("doc_id").agg(F.min("position").alias("a"), F.max("position").alias("b"), F.max("total_chunks").alias("n"), F.countDistinct("position").alias("d"))
    assert off.where("a <> 0 or b <> n - 1 or d <> n").count() == 0 and off.where("n > 1").count() > 0


def test_coverage(spark):
    docs = spark.createDataFrame([(1, "Alpha beta GAMMA delta of of"), (2, None), (3, "x y"), (4, "long " * 300_000), (5, "")], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, "alpha BETA"), (1, "of beta"), (4, "long"), (4, None), (9, "nobody")], "doc_id long, content string")
    got = {r.doc_id: tuple(r)[1:] for r in ingest.coverage(docs, chunks).collect()}
    assert got == {
        1: (6, 4, 60.0, 66.666667, True, ["delta", "gamma"]),
        2: (0, 0, None, None, False, []),
        3: (2, 0, 0.0, 0.0, True, []),
        4: (300_000, 1, 100.0, 0.000333, False, []),
        5: (0, 0, None, None, False, []),
    }


def test_chunks_are_made_once(spark):
    docs = spark.createDataFrame([(1, "t", CONTRACT)], "doc_id long, title string, text string")
    assert ingest.ingested(docs)._jdf.queryExecution().optimizedPlan().toString().count("InArrow") == 1
