"""Hand-written cases for text, date, chunk and dialogue functions."""

from pyspark.sql import functions as F

from docloom.functions import text
from docloom.functions.dates import found_dates
from docloom.operators import chunking, dialogue, graph, retrieval
from docloom.sources import tables
from docloom.streaming import metrics


def test_dates():
    assert found_dates("01/02/2020 2021-03-04") == ["01/02/2020", "2021-03-04"]
    assert found_dates("it was signed on 3 October 1998.") == ["signed on 3 October 1998"]
    assert found_dates("le 1er janvier 2024") == ["le 1er janvier 2024"]
    assert found_dates("Q3 2021 and mars 2020") == ["Q3 2021", "mars 2020"]
    assert found_dates(None) == [] and found_dates("") == []


def test_headers():
    page = "\n".join(["ACME Corp confidential report 2020", "one two three four five"] * 3)
    out = chunking.cleaned(page)
    assert out.startswith("\n[Note: 6 repeated")
    assert chunking.cleaned("a\nb\n\n| x |\n| x |\n| x |") == "a\nb\n\n| x |\n| x |\n| x |"
    assert chunking.cleaned(None) is None and chunking.cleaned("") == ""


def test_split_long():
    assert chunking.split_long("", 10) == []
    assert chunking.split_long("aaaa bbbb cccc", 9) == ["aaaa bbbb", "cccc"]
    assert "".join(chunking.split_long("x" * 25, 10)) == "x" * 25


def test_merge_small():
    assert chunking.merged_small([10, 10, 10], [False] * 3, [""] * 3, 100) == [0, 0, 0]
    assert chunking.merged_small([10, 10], [True, False], ["", ""], 100) == [0, 1]
    assert chunking.merged_small([50, 40, 40], [False] * 3, ["a", "a", "b"], 100) == [0, 0, 1]


def test_columns(spark):
    rows = spark.createDataFrame([("3.4.1",), ("7",), ("(a)",), ("1.2",), (None,)], "n string")
    got = [r[0] for r in rows.select(text.hierarchy(F.col("n"))).collect()]
    assert got == [["3", "3.4", "3.4.1"], ["7"], ["(a)"], ["1.2"], None]
    t = spark.createDataFrame([("L'échéance du CONTRAT",), ("écontrat",), (None,)], "t string")
    assert [r[0] for r in t.select(text.keywords(F.col("t"))).collect()][:2] == [["contrat", "échéance"], []]
    c = spark.createDataFrame([("termination is confidential",), ("compensation",), ("none",)], "t string")
    assert [r[0] for r in c.select(text.clause_type(F.col("t"))).collect()] == ["confidentialité", "indemnisation", "autre"]


def test_marks(spark):
    lines = ["(a) x", "(b) y", "1) z", "- w", "Article 2 Scope", "(c) v"]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc_id long, line_no int, line string")
    got = [r.mark for r in chunking.marked(rows).orderBy("line_no").collect()]
    assert got == ["LIST_START:alpha", "LIST_ITEM:alpha", "LIST_START:numeric", "LIST_START:bullet", "CLAUSE_START", "LIST_START:alpha"]


def test_partial_pairs_and_history(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (2, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    assert {(r.question, r.answer) for r in dialogue.history_pairs(turns).collect()} == {("q", "a"), ("r", None)}


def test_graph_components_and_blocks(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "source long, target long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6)], "id long")
    assert {(r.id, r.component) for r in graph.components(edges, nodes).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([((k * 7) % 307, ((k + 1) * 7) % 307) for k in range(306)], "source long, target long")
    got = graph.components(edges, spark.range(307)).collect()
    assert {r.component for r in got} == {0} and len(got) == 307


def test_summaries(spark):
    rows = spark.createDataFrame([(1, 0, "a", False, None), (1, 1, "s", True, "a"), (1, 2, "a", False, None)], "query_id int, ord int, content string, is_summary boolean, original_content string")
    assert [r.ord for r in retrieval.without_summarised(rows).orderBy("ord").collect()] == [0, 1]


def test_delete_and_exists(spark):
    rows = spark.createDataFrame([("a.pdf",), ("aa.pdf",), (None,)], "document_title string")
    assert tables.without_document(rows, "a.pdf").count() == 1
    assert tables.without_document(rows, "a.pdf", exact=True).count() == 2
    paths = spark.createDataFrame([("/x/a.pdf",), ("/x/b.pdf",), ("--force",)], "path string")
    assert [r.path for r in tables.existing(paths, rows).collect()] == ["/x/a.pdf"]


def test_extraction_errors_are_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("good")
    (tmp_path / "b.txt").write_text("bad")

    def extract(content, path):
        if content == b"bad":
            raise ValueError("no")
        return content.decode()

    rows = {r.path[-5:]: (r.text, r.error) for r in tables.read_documents(spark, str(tmp_path), extract).collect()}
    assert rows == {"a.txt": ("good", None), "b.txt": (None, "ValueError: no")}


def test_stream_equals_batch(spark, tmp_path):
    from tests.conftest import SF

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = metrics.tumbling(metrics.event_stream(spark, str(tmp_path / "in"), events.schema), late="40 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = metrics.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("tumbling")) == key(batch)


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, x string")
    metrics.append_new(one, path, "id")
    metrics.append_new(spark.createDataFrame([(2, "b"), (3, "c")], "id int, x string"), path, "id")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
