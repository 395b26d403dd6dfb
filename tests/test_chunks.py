"""Semantic chunks, restored lines and tables on hand-written texts."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import chunking, restoration, semantic
from docloom.plans import catalog
from tests.conftest import SF

DOCS = "doc_id long, text string, section_no int, content string"


def test_cut_points():
    flat = np.array([[1.0, 0], [1, 0], [1, 0.01], [0, 1], [0, 1]])
    assert semantic.cut_points(flat, 90).tolist() == [2]
    assert semantic.cut_points(flat, 100).tolist() == []
    assert semantic.cut_points(np.zeros((3, 2)), 50).tolist() == []  # all are as far apart
    assert semantic.cut_points(np.ones((1, 2)), 50).tolist() == []


def test_semantic_chunks_of_awkward_texts(spark):
    topic = "Aaa aa aaa aa. " * 12 + "Nnn nn nnn nn. " * 12
    rows = [(1, topic.strip()), (2, None), (3, ""), (4, " \n\t\r\n"), (5, "short text"), (6, "word " * 100), (7, "# One\nbody\n# Two\n" + topic), (8, "x" * 1_000_000), (8, "Ends here. " * 60_000)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], DOCS)
    found = semantic.semantic_chunks(df, words=40, percent=95, reach=0)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    got = {}
    for r in found.orderBy("doc_id", "section_no", "position").collect():
        got.setdefault((r.doc_id, r.section_no), []).append((r.kind, r.content))
    assert got[1, 0] == [("semantic", ("Aaa aa aaa aa. " * 12).strip()), ("semantic", ("Nnn nn nnn nn. " * 12).strip())]
    assert got[5, 0] == [("whole", "short text")]
    assert {k for k, _ in got} == {1, 5, 6, 7, 8}
    assert all(kind == "recursive" and len(c) <= 40 for kind, c in got[6, 0])
    assert got[7, 1] == [("whole", "# One\nbody")] and {k for k, _ in got[7, 2]} == {"semantic"}
    assert semantic.semantic_chunks(df.limit(0)).collect() == []


def test_provider_sees_windows():
    seen = []

    def embed(texts):
        seen.extend(texts)
        return semantic.letter_embeddings(texts)

    assert semantic.split_by_meaning(["A b.  C d! E", "F"], embed, 100, 1) == [["A b. C d! E"], ["F"]]
    assert seen == ["A b. C d!", "A b. C d! E", "C d! E", "F"]


def test_best_place():
    chunk = restoration.OpenChunk
    a, b = chunk("The seller shall deliver.\nIn time.", "4.1"), chunk("Payment within 30 days.", "7.2")
    assert restoration.best_place("A line.", ["in time."], [a, b]) is a  # a line of its frame
    assert restoration.best_place("See clause 7.2 and clause 9", [], [a, b]) is b  # a clause that the section has
    assert restoration.best_place("the the 30 x", [], [a, b]) is b  # nothing above 1: the first number
    assert restoration.best_place("within reach", [], [a, b]) is b  # then the most words
    assert restoration.best_place("zzz", [], [a, b]) is a  # the first among equals


def test_restored_lines_change_later_scores():
    chunks = [("alpha one two", None), ("beta three", None)]
    lines = ["alpha one two", "beta three", "gamma delta", "gamma epsilon"]
    # "gamma delta" has both chunks in its frame and goes to the first; "gamma epsilon" then has one line more there.
    assert restoration.fold(lines, ["gamma delta", "gamma epsilon"], chunks) == ["alpha one two\n\ngamma delta\n\ngamma epsilon", "beta three"]
    assert restoration.fold(["a b", "c d"], ["a b", "c d"], []) == ["a b\n\nc d"]
    twice = ["k", "same line", "m", "same line"]
    assert restoration.fold(twice, ["same line", "same line"], [("k", "1"), ("m", "2")]) == ["k\n\nsame line\n\nsame line", "m"]


def plain_lost(doc, contents):
    squeeze = lambda x: " ".join(x.split())
    kept = {squeeze(x) for c in contents for x in c.split("\n")}
    return [squeeze(x) for x in doc.split("\n") if squeeze(x) and squeeze(x) not in kept]


def test_with_restored(spark):
    legal = "The Seller shall deliver all goods to the Buyer in time"
    doc = f"INTRO\r\n\n\t\n{legal} at  place A\nkept line\nBeing short\n(a) an item\nclause 4.2 must hold for every party here\n"
    docs = spark.createDataFrame([(1, doc, 1, "c"), (2, legal, 1, "c"), (3, None, 1, "c"), (4, "TITLE", 1, "c"), (5, "", 1, "c"), (7, "y" * 1_000_000 + " shall", 1, "c")], DOCS)
    chunks = spark.createDataFrame([(1, 1, "INTRO", "3"), (1, 2, "kept line", "4.2.1"), (3, 1, "alone", None), (6, 1, "of no document", "1")], "doc_id long, position long, content string, section string")
    lost = docs.where("doc_id = 1").select(restoration.lost_lines(F.col("text"), F.array(F.lit("INTRO"), F.lit("kept line"))).alias("x")).first().x
    assert set(lost) <= set(plain_lost(doc, ["INTRO", "kept line"])) and [x[:4] for x in lost] == ["The ", "(a) ", "clau"]
    got = {(r.doc_id, r.position): (r.section, r.content, r.restored) for r in restoration.with_restored(docs, chunks).collect()}
    frame = [" ".join(x.split()) for x in doc.split("\n") if x.strip()]
    want = restoration.fold(frame, lost, [("INTRO", "3"), ("kept line", "4.2.1")])
    assert [got[1, 1], got[1, 2]] == [("3", want[0], 3), ("4.2.1", want[1], 3)]
    # The lines restored before it stand in the first chunk, and outweigh the clause that the second one's section has.
    assert want[0].endswith("clause 4.2 must hold for every party here") and want[1] == "kept line"
    assert got[2, 1] == ("unknown", legal, 1)  # without chunks the line opens one
    assert got[3, 1] == (None, "alone", 0) and got[6, 1] == ("1", "of no document", 0)
    assert got[7, 1][2] == 1 and {k for k, _ in got} == {1, 2, 3, 6, 7}
    assert restoration.with_restored(docs.limit(0), chunks.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("| a | b |", True), ("+--+", True), ("a\tb\tc", True), ("x  a  b  c", True), ("Name: Ann  Age: 7", True), ("plain words here", False), (None, None), ("", False),
        ("ab cd ef\nxx yy zz\nqq ww rr", True), ("ab cd ef\n\nxx yy zz\n \nqq wwrr", False), ("ab cd ef\nxx yy zz", False), ("a b\nc d\ne f", False), ("one two\n" * 3 + "x" * 100_000, False),
    ],
)
def test_has_table(spark, value, want):
    got = spark.createDataFrame([(value,)], "text string").select(text.has_table(F.col("text"))).first()[0]
    assert got is want or (want is None and got in (None, False))


def test_table_blocks(spark):
    cases = {
        "prose (a)\n| a | b |\n\n\n+--+\nprose (b)\n----\n": [(1, 4), (6, 1)],
        "a | b\n4.2 | section\nx ; y\r\n\t\n| z |": [(0, 1), (2, 3)],
        "": [],
        "no table (here)": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r.text: [tuple(b) for b in r.b] for r in df.select("text", text.table_blocks(F.col("text")).alias("b")).collect()} == cases


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_batches_go_in_parts():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10_000] * 1000)], names=["text"])
    parts = list(chunking.slices([batch, batch.slice(0, 0)]))
    assert max(p.nbytes for p in parts) <= 1.1 * chunking.SLICE_BYTES and sum(p.num_rows for p in parts) == 1000
    assert [p.num_rows for p in chunking.slices([pa.RecordBatch.from_arrays([pa.array(["x" * 3_000_000] * 2)], names=["text"])])] == [1, 1]


def test_texts_pass_in_batches_and_not_as_series(spark):
    docs = spark.createDataFrame([(k, "a b\n" * 30, "x") for k in range(5)], "doc_id long, text string, more string")
    pieces = chunking.chunks(docs, 20).withColumn("important", F.lit(None).cast("boolean")).withColumn("list_type", F.lit(None).cast("string"))
    for df in (chunking.without_headers(docs), chunking.merge_small(pieces, 20), semantic.semantic_chunks(docs)):
        plan = plan_of(df)
        assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan and "ArrowEvalPython" not in plan
    assert {r.doc_id: r.n for r in chunking.merge_small(pieces, 100).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {k: 2 for k in range(5)}
    assert chunking.without_headers(docs).columns == docs.columns


def test_lines_and_chunks_are_prepared_before_they_meet(spark):
    lines = spark.createDataFrame([(1, 3, "Clause 4.2 pays", ["a  b", "c"])], "doc_id long, line_no int, line string, frame array<string>")
    chunks = spark.createDataFrame([(1, 1, "x A b\ny", "4.2"), (1, 2, "pays", None)], "doc_id long, position int, content string, section string")
    found = chunking.best_chunk(lines, chunks)
    above = plan_of(found).split("Join")[0]
    assert "regexp_replace" not in above and "split(" not in above
    assert [(r.position, r.score) for r in found.collect()] == [(1, 6.0)]


def plain_replaced(rows):
    """{(doc, line_no, line): (position, score)} of odd lines, pair by pair; texts by id."""
    squeeze = lambda x: " ".join(x.split())
    out = {}
    for doc in {d for d, _ in rows}:
        solid = sorted((k, x) for d, t in rows if d == doc and t is not None for k, x in enumerate(t.split("\n")) if x.strip(" "))
        even = [(k, x) for k, x in solid if k % 2 == 0 and doc is not None]
        chunks = {p: "\n".join(x for k, x in even if k // 10 == p).lower() for p in {k // 10 for k, _ in even}}
        kept = {squeeze(x) for _, x in even}
        judged = {}
        for i, (k, x) in enumerate(solid):
            if squeeze(x) and squeeze(x) not in kept:
                frame = [squeeze(y.lower()) for _, y in solid[max(0, i - 5) : i] + solid[i + 1 : i + 6]]
                number = re.search(r"\b(\d+(\.\d+)?)\b", x)
                for p, c in chunks.items():
                    common = len(set(x.lower().split()) & set(c.split()))
                    has = bool(number and number[1] in c)
                    judged.setdefault((doc, k, x), []).append((round(3 * sum(f in squeeze(c) for f in frame) + 0.2 * common, 6), -p, has, common))
                judged.setdefault((doc, k, x), [])
        for key, found in judged.items():
            best = max(found, default=None)
            if best and best[0] <= 1:
                best = max(found, key=lambda f: (f[2], 0 if f[2] else f[3], f[1], f[0]))
            out[key] = (-best[1], best[0]) if best else (None, None)
    return out


def test_replaced_lines_stay_in_the_row_of_their_document(spark):
    rng = np.random.default_rng(3)
    word = lambda: ["aa", "Bb", "cc 4.2", "dd", "12", "e\tf", "", "  "][rng.integers(8)]
    texts = ["\n".join(" ".join(word() for _ in range(rng.integers(5))) for _ in range(rng.integers(1, 45))) for _ in range(40)]
    rows = [*enumerate(texts), (3, texts[5]), (3, texts[3]), (None, texts[7]), (None, texts[8]), (50, None), (51, ""), (52, "\nalone"), (53, "zz 7\n7.\n\n\n\n\n\n\n\n\nqq 7\nww"), (54, "a\r\nB\n\t\na\r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    put = chunking.replaced_lines(docs, lambda n: n % 2 == 0, lambda n: F.floor(n / 10))
    got = [((r.doc_id, r.line_no, r.line), (r.position, r.score)) for r in put.collect()]
    assert len(got) == len(dict(got)) > 300 and dict(got) == plain_replaced(rows)
    # Texts alone are shuffled: no frames of ten lines each, and no pairs of lines and chunks to be sorted.
    plan = catalog.QUERIES["restored_lines"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan


def test_best_chunk_has_no_row_for_a_pair(spark):
    lines = spark.createDataFrame([(1, k, f"word{k} clause 4.{k}", ["a b"]) for k in range(6)] + [(2, 0, "alone", [])] + [(1, 0, "word0 clause 4.0", ["x"])], "doc_id long, line_no int, line string, frame array<string>")
    chunks = spark.createDataFrame([(1, p, f"word{p} x", f"4.{p}") for p in range(5)], "doc_id long, position int, content string, section string")
    found = chunking.best_chunk(lines, chunks)
    got = {(r.doc_id, r.line_no): (r.position, r.score) for r in found.collect()}
    assert got == {**{(1, k): (k, 3.2) for k in range(1, 5)}, (1, 0): (0, 6.2), (1, 5): (0, 0.0), (2, 0): (None, None)}
    assert found.count() == 7
    joined = [x for x in plan_of(found).splitlines() if "Join" in x]
    assert len(joined) == 1 and "collect_list" in plan_of(found).split("Join")[1]
