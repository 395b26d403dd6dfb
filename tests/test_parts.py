"""Parts that no query runs, on hand-written rows."""

import datetime as dt

from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import chunking, dialogue, records
from docloom.sources import tables
from docloom.streaming import metrics


def test_list_types_in_order(spark):
    df = spark.createDataFrame([("[LIST_START:alpha](a) x\n[LIST_ITEM:alpha](b) y\n[LIST_START:bullet]- z",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(text.list_types(F.col("t"))).collect()] == [["alpha", "bullet"], [], None]


def test_texts_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in tables.read_texts(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "one\ntwo\n" and got.get("b.txt", "") in ("", None)


def test_types_by_first_value(spark):
    rows = [(1, "a", ""), (2, "a", "True"), (3, "a", "x"), (1, "b", "1.5"), (1, "c", "."), (1, "d", None), (2, "e", "1,5")]
    got = {r.key: r.type for r in tables.inferred_schema(spark.createDataFrame(rows, "id int, key string, value string"), "id").collect()}
    assert got == {"a": "bool", "b": "number", "c": "string", "e": "string"}


def test_history_rows(spark):
    pairs = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "q", "a", [1.0, 0.5], [0.0, 1.0])], "conversation_id long, timestamp timestamp, question string, answer string, question_vector array<double>, answer_vector array<double>")
    got = dialogue.history_rows(pairs).orderBy(F.desc("role")).collect()
    assert [(r.role, r.content, r.embedding) for r in got] == [("user", "q", "[1.0,0.5]"), ("assistant", "a", "[0.0,1.0]")]


def test_first_holder(spark):
    nodes = spark.createDataFrame([("d", 1, 10, "only alpha"), ("d", 2, 11, "alpha and beta"), ("e", 1, 12, "beta")], "doc string, ord int, node_id int, content string")
    results = spark.createDataFrame([("d", 1, "alpha"), ("d", 2, "beta"), ("d", 3, "gamma"), ("f", 4, "alpha")], "doc string, result_id int, text string")
    assert {(r.result_id, r.node_id) for r in records.first_holder(results, nodes, ["doc"]).collect()} == {(1, 10), (2, 11)}


def test_fitted_router(spark):
    rows = [(f"Quel est le montant de la clause {k}", "RAG") for k in range(20)] + [(f"Rédige un modèle de lettre {k}", "LLM") for k in range(10)]
    df = spark.createDataFrame(rows, "question string, label string")
    model = dialogue.fitted_router(df, trees=5)
    told = model.transform(dialogue.with_features(df, "question"))
    labels = model.stages[0].labels
    assert labels == ["LLM", "RAG"]
    right = [labels[int(r.prediction)] == r.label for r in told.collect()]
    assert sum(right) == len(rows) and all(abs(sum(r.probability) - 1) < 1e-9 for r in told.collect())


def test_long_sections_are_cut(spark):
    long = "4.1 Long\n" + "\n".join(f"line {k} of the section" for k in range(100))
    rows = [(1, k, x) for k, x in enumerate(["lost preamble", "4. Short", "body", *long.split("\n")])]
    numbered = chunking.numbered_sections(spark.createDataFrame(rows, "doc_id long, line_no int, line string"))
    got = chunking.hybrid_chunks(numbered, 300).orderBy("section_no", "position").collect()
    assert (got[0].number, got[0].content) == ("4", "4. Short\nbody")
    assert [r.position for r in got[1:]] == list(range(1, len(got))) and {r.number for r in got[1:]} == {"4.1"}
    assert all(len(r.content) <= 300 for r in got[1:]) and "\n".join(r.content for r in got[1:]) == long


def test_sections_of_a_title_alone_go(spark):
    lines = ["4.1 SCOPE OF WORK", "4.2 TERMS", "The seller pays.", "4.3 PARTY shall pay", "in time.", ""]
    rows = [(1, k, x) for k, x in enumerate(lines)]
    got = chunking.numbered_sections(spark.createDataFrame(rows, "doc_id long, line_no int, line string")).orderBy("section_no").collect()
    assert [(r.number, r.body) for r in got] == [("4.2", "The seller pays."), ("4.3", "4.3 PARTY shall pay\nin time.")]


def test_each_mark(spark):
    lines = ["pursuant to Section 4.1 of this", "12. Formation", "ends here.", "NEXT begins", "the seller shall " + "word " * 25, "plain words", "(a) first", "(b) second"]
    got = chunking.marked(spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc_id long, line_no int, line string")).orderBy("line_no").collect()
    mark = {r.line: r.mark for r in got}
    assert mark[lines[0]] == "CROSS_REF" and mark["ends here."] == "PARAGRAPH_END" and mark[lines[4]] == "IMPORTANT_CLAUSE"
    assert mark["plain words"] is None and mark["(a) first"] == "LIST_START:alpha" and mark["(b) second"] == "LIST_ITEM:alpha"


def test_first_row_of_a_key_in_a_stream(spark, tmp_path):
    rows = [(k % 4, dt.datetime(2024, 1, 1, 0, k)) for k in range(12)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = metrics.event_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    query = metrics.first_seen(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3]


def test_positions(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 9)], "k string, o int")
    assert {(r.k, r.o, r.position, r.total) for r in chunking.with_position(df, "k", "o").collect()} == {("a", 1, 1, 2), ("a", 3, 2, 2), ("b", 9, 1, 1)}
