"""Queries of sections, restored content, routing rules, results and graphs, with their DuckDB statements.

The driver's texts have few numbered lines, French questions or markers, so such
lines are made from relational columns by an expression both sides read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import lexicon, text
from docloom.operators import chunking, dialogue, graph, retrieval, vectors
from docloom.plans.catalog import COUNTS, LINES, PAIRS, TITLE_SQL, edges_of, query, quoted, re2, solid_lines, words_sql
from docloom.sources.tables import read_table


def any_of(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


# Sections

#: A line for each part, of one of twelve shapes.
LINE = """CASE p_partkey % 12 WHEN 0 THEN concat('### **', p_size, '.', p_partkey % 7, '** ', upper(p_name)) WHEN 1 THEN concat('**4.', p_size, '** Delay ', p_name)
WHEN 2 THEN concat('- 3.', p_size, ' The ', p_name) WHEN 3 THEN concat('# ', p_size, '. Formation') WHEN 4 THEN concat('## **', p_size, '. Definitions**')
WHEN 5 THEN concat('#### 6.', p_size, ' Rejection') WHEN 6 THEN concat('### FORCE MAJEURE ', p_size, '.') WHEN 7 THEN concat('8 ', p_size, ' ', p_name)
WHEN 8 THEN concat('Page ', p_size) WHEN 9 THEN concat(p_size, ' days after the contract') WHEN 10 THEN p_name ELSE concat('#### 13.3.', p_size, ' Seller shall pay') END"""
LINED = f"t AS (SELECT p_partkey AS id, {LINE} AS line FROM part)"


def made_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(LINE).alias("line"))


@query(rf"""WITH {LINED} SELECT id, regexp_replace(CASE WHEN line LIKE 'Page%' OR NOT regexp_matches(line, '\d') THEN NULL
WHEN line LIKE '### **%' THEN regexp_extract(line, '^### \*\*([0-9.]+)', 1) WHEN line LIKE '**%' THEN regexp_extract(line, '^\*\*([0-9.]+)', 1) WHEN line LIKE '- %' THEN regexp_extract(line, '^- ([0-9.]+)', 1)
WHEN line LIKE '## **%' THEN regexp_extract(line, '([0-9]+)', 1) WHEN line LIKE '### FORCE%' THEN regexp_extract(line, '([0-9]+)', 1) WHEN line LIKE '#%' THEN regexp_extract(line, '([0-9]+(\.[0-9]+)*)', 1)
WHEN line LIKE '8 %' AND line NOT LIKE '% days after%' THEN regexp_replace(regexp_extract(line, '^([0-9]+ [0-9]+)', 1), ' ', '.') ELSE regexp_extract(line, '^([0-9]+)', 1) END, '^$', '') AS number,
CASE WHEN line LIKE 'Page%' OR NOT regexp_matches(line, '\d') THEN NULL WHEN line LIKE '### **%' OR line LIKE '**%' THEN regexp_extract(line, '\*\* (.*)$', 1) WHEN line LIKE '- %' THEN regexp_extract(line, '^- [0-9.]+ (.*)$', 1)
WHEN line LIKE '# %' THEN 'Formation' WHEN line LIKE '## **%' THEN 'Definitions' WHEN line LIKE '#### 6%' THEN 'Rejection' WHEN line LIKE '### FORCE%' THEN 'FORCE MAJEURE' WHEN line LIKE '#### 13%' THEN 'Seller shall pay'
WHEN line LIKE '8 %' AND line NOT LIKE '% days after%' THEN '' ELSE 'days after the contract' END AS title FROM t""")
def section_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = text.section_start(F.col("line"))
    return made_lines(spark, sf_dir).select("id", start["number"].alias("number"), start["title"].alias("title"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size || '.' || p_partkey ELSE 'a.' || p_size END AS number FROM part""")
def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_size", F.lit("  . "), "p_partkey")).otherwise(F.concat(F.lit("a."), "p_size"))
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.section_number(raw).alias("number"))


#: A chunk for each order: a heading, a date line and prose.
CHUNK = """concat(CASE o_orderkey % 5 WHEN 0 THEN concat('Article ', o_custkey % 9, '.', o_orderkey % 4, ' Of prices') WHEN 1 THEN concat(1 + o_custkey % 9, '. Scope of the work') WHEN 2 THEN concat('(', 'a', ') delivery to the buyer')
WHEN 3 THEN 'GENERAL TERMS AND PAYMENT' ELSE 'short' END, chr(10), 'the buyer is number ', o_custkey, chr(10), lower(o_orderpriority))"""
CHUNKED = f"c AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority, {CHUNK} AS chunk FROM orders)"


def made_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").withColumns({"id": F.col("o_orderkey"), "chunk": F.expr(CHUNK)})


@query(f"""WITH {CHUNKED} SELECT id, CASE id % 5 WHEN 0 THEN (o_custkey % 9) || '.' || (id % 4) WHEN 2 THEN '(a)' WHEN 1 THEN substr(o_orderpriority, 1, 1) ELSE substr(o_orderpriority, 1, 1) END AS number,
CASE id % 5 WHEN 0 THEN 'Article ' || (o_custkey % 9) || '.' || (id % 4) || ' Of prices' WHEN 1 THEN (1 + o_custkey % 9) || '. Scope of the work' WHEN 3 THEN 'GENERAL TERMS AND PAYMENT' WHEN 2 THEN '(a) delivery to the buyer' ELSE 'short' END AS chapter FROM c""")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no article or item names the section, a line that begins with a number does."""
    content = F.when((F.col("id") % 5).isin(0, 2), F.col("chunk")).otherwise(F.regexp_replace("chunk", r"\n(\d)-", "\n$1 "))
    pieces = made_chunks(spark, sf_dir).select("id", F.lit(1).alias("position"), content.alias("content"))
    return chunking.with_metadata(pieces, "id").select("id", F.col("section_number").alias("number"), F.col("chapter_title").alias("chapter"))


MARKERS = ["[CLAUSE_START]", "[LIST_START:alpha]", "[LIST_ITEM:roman]", "[DEFINITION]", "[CROSS_REF]", "[PARAGRAPH_END]", "[IMPORTANT_CLAUSE]", "[SECTION_BREAK]"]


@query("SELECT doc_id, text FROM documents")
def markers_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a marker before them and one after each line, and without them again."""
    marker = F.get(F.array(*map(F.lit, MARKERS)), F.pmod("doc_id", F.lit(len(MARKERS))).cast("int"))
    full = F.concat(marker, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), marker)))
    return read_table(spark, sf_dir, "documents").select("doc_id", text.without_markers(full).alias("text"))


@query(f"""WITH {LINES}, s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,2}}\\s+|^\\d+\\.\\s+[A-Z]|^[A-Z][A-Z\\s]+:$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM l)
SELECT doc_id, section_no::BIGINT AS section_no, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS content FROM s GROUP BY ALL""")
def main_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.main_sections(solid_lines(spark, sf_dir)).select("doc_id", "section_no", "n_lines", "content")


#: Contracts of twelve lines, made from parts.
CONTRACT = """p_partkey // 12 AS doc_id, (p_partkey % 12)::INTEGER AS line_no"""


def contract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_lines(spark, sf_dir).select(F.floor(F.col("id") / 12).alias("doc_id"), (F.col("id") % 12).cast("int").alias("line_no"), "line")


@query(f"""WITH l AS (SELECT {CONTRACT}, {LINE} AS line FROM part), s AS (SELECT *, sum(CASE WHEN line_no NOT IN (8, 10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM l)
SELECT doc_id, section_no::BIGINT AS section_no, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS content FROM s WHERE section_no > 0 GROUP BY ALL""")
def numbered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.numbered_sections(contract_lines(spark, sf_dir)).select("doc_id", "section_no", "n_lines", "content")


@query(f"""WITH l AS (SELECT {CONTRACT}, {LINE} AS line FROM part), s AS (SELECT *, sum(CASE WHEN line_no NOT IN (8, 10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM l)
SELECT doc_id, section_no::BIGINT AS section_no, 1 AS position, string_agg(line, chr(10) ORDER BY line_no) AS content FROM s WHERE section_no > 0 GROUP BY doc_id, section_no""")
def hybrid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No section has a thousand characters here, so all stay whole; cutting long ones has hand-written cases."""
    return chunking.hybrid_chunks(chunking.numbered_sections(contract_lines(spark, sf_dir))).select("doc_id", "section_no", "position", "content")


@query("""SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS empty_section,
CASE n_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '4.1 - PARTY shall pay' WHEN 3 THEN '' ELSE 'body of ' || n_name END AS body FROM nation""")
def empty_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 5
    content = F.when(k == 0, "## 4.1. SCOPE OF WORK\n").when(k == 1, "**4.1 - PRICES**").when(k == 2, "4.1 - PARTY shall pay").when(k == 3, "\n# 4.1 - A B\n\n").otherwise(F.concat(F.lit("## 4.1 TERMS\nbody of "), "n_name"))
    return read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), text.is_empty_section(content, F.lit("4.1")).alias("empty_section"), chunking.without_title(content, F.lit("4.1")).alias("body"))


#: A line for each part, in twelve shapes: tables with and without bars, blanks inside them, a section and prose.
ROW = """CASE p_partkey % 12 WHEN 0 THEN '| name | size |' WHEN 1 THEN '+----+---+' WHEN 2 THEN concat('| ', p_name, ' | ', p_size, ' |') WHEN 3 THEN '' WHEN 4 THEN '| more | 3 |'
WHEN 5 THEN concat('prose of ', p_size) WHEN 6 THEN '----' WHEN 7 THEN concat('alpha ; ', p_size) WHEN 8 THEN 'more (prose)' WHEN 9 THEN '4.2 | a section' WHEN 10 THEN '__' ELSE ' ' END"""


@query(f"""WITH l AS (SELECT p_partkey // 12 AS doc_id, p_partkey % 12 AS k, {ROW} AS line FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS line_no FROM l),
g AS (SELECT *, sum(CASE WHEN k IN (5, 8, 9) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM n)
SELECT doc_id, min(line_no)::INTEGER AS first_line, (max(line_no) - min(line_no) + 1)::INTEGER AS n_lines FROM g WHERE k NOT IN (3, 5, 8, 9, 11) GROUP BY doc_id, run""")
def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 12).alias("doc_id"), (F.col("p_partkey") % 12).alias("k"), F.expr(ROW).alias("line"))
    docs = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return docs.select("doc_id", F.inline(text.table_blocks(F.col("text"))))


# Content that must not get lost

LEGAL_SQL = f"""(regexp_matches(line, '^\\([a-zA-Z0-9]\\)|^[a-zA-Z0-9]\\)') OR (NOT {TITLE_SQL} AND (regexp_matches(line, '^W(hereas|HEREAS),') OR regexp_matches(line, '^for the [A-Za-z]')
 OR (len({words_sql('line')}) > 5 AND NOT regexp_matches(line, '^#|^\\d+(\\.\\d+)*\\s') AND NOT (upper(line) = line AND lower(line) != line) AND NOT ends_with(line, ':'))
 OR regexp_matches(line, '^#{{1,6}}\\s+\\d+(\\.\\d+)*\\s') OR (len({words_sql('line')}) <= 5 AND {any_of('lower(line)', lexicon.SHORT_LINE_WORDS)}) OR {any_of('lower(line)', lexicon.LEGAL_WORDS)}
 OR {' OR '.join(f'regexp_matches(lower(line), {quoted(p)})' for p in lexicon.LEGAL_PATTERNS)})))"""


@query(f"WITH {LINES} SELECT doc_id, line_no, {LEGAL_SQL} AS legal FROM l")
def legal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solid_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), text.is_legal(F.col("line")).alias("legal"))


@query(f"WITH {LINED} SELECT id, {LEGAL_SQL} AS legal FROM t")
def legal_made_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_lines(spark, sf_dir).select("id", text.is_legal(F.col("line")).alias("legal"))


# Routing

#: A French question for each turn, by its place.
QUESTION = """concat(CASE (conv_id + turn) % 10 WHEN 0 THEN 'Liste les pénalités et propose un plan de mitigation' WHEN 1 THEN 'Rappelle-moi les échéances' WHEN 2 THEN 'Compare le contrat A et indique quelle clause'
WHEN 3 THEN 'Compare le contrat avec la norme ISO' WHEN 4 THEN 'Traduis la clause chiffrées' WHEN 5 THEN 'Quelle stratégie adopter, donne une approche, rédige' WHEN 6 THEN 'Quel est le montant maximal'
WHEN 7 THEN 'Synthèse technique et liste des documents' WHEN 8 THEN 'Élabore un modèle puis extrait les dates' ELSE 'Bonjour' END, ' ', conv_id)"""


def has(words: list[str]) -> str:
    return any_of("low", words)


@query(f"""WITH asked AS (SELECT conv_id, turn, {QUESTION} AS text FROM conversations),
{COUNTS.replace('FROM conversations', 'FROM asked')}, w AS (SELECT *, lower(text) AS low, CASE WHEN turn % 2 = 0 THEN 'LLM' ELSE 'RAG' END AS mode FROM c),
m AS (SELECT *, rag >= 1 AND llm >= 1 AND {has(lexicon.CREATION)} AND {has(lexicon.EXTRACTION)} AS mixed, regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])(et|puis)($|[^\\p{{L}}\\p{{N}}_])') AS joined FROM w),
o AS (SELECT conv_id, turn, mode, CASE WHEN mixed AND {has(lexicon.STRATEGY)} AND NOT joined THEN '' WHEN mixed THEN 'RAG 0.85'
 WHEN {has(['liste'])} AND {has(['plan', 'stratégie', 'mitigation'])} AND {has(['pénalités', 'montants'])} THEN CASE WHEN {has(['propose', 'suggère', 'établis', 'élabore'])} THEN 'LLM 0.85' ELSE 'RAG 0.85' END
 WHEN {has(['échéances', 'dates clés', 'date butoir', 'calendrier'])} AND ({has(['rappelle', 'notifie', 'alerte'])} OR NOT {has(['évalue', 'analyse', 'impact'])}) THEN 'RAG 0.9'
 WHEN {has(['compare'])} AND {has(['contrat'])} AND {has(['contrat a', 'contrat b', 'contrat c'])} AND {has(['indique', 'quelle'])} THEN 'RAG 0.85'
 WHEN {has(['compare'])} AND {has(['contrat'])} AND {has(['standard', 'norme', 'iso', 'pratique'])} THEN 'LLM 0.9'
 WHEN mode = 'LLM' AND (starts_with(low, 'traduis') OR {has(['comment traduire'])}) AND {has(['article', 'clause', 'responsabilité', 'obligation', 'pénalité'])} AND {has(['chiffrées', 'précise'])} THEN 'RAG 0.85'
 WHEN mode = 'LLM' AND {has(['montant maximal', 'garantie de bonne exécution', 'puissance délivrée'])} THEN 'RAG 0.9'
 WHEN {has(['synthèse'])} AND {has(['technique'])} AND {has(['liste'])} AND {has(['documents'])} THEN 'RAG 0.85' ELSE '' END AS told FROM m)
SELECT conv_id, turn, CASE WHEN told = '' THEN mode ELSE split_part(told, ' ', 1) END AS mode, CASE WHEN told = '' THEN 0.5 ELSE split_part(told, ' ', 2)::DOUBLE END AS confidence FROM o""")
def corrected_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read_table(spark, sf_dir, "conversations").withColumn("text", F.expr(QUESTION)).withColumn("mode", F.when(F.col("turn") % 2 == 0, "LLM").otherwise("RAG"))
    rows = dialogue.with_features(asked, "text")
    told = dialogue.corrected(F.col("text"), F.col("mode"), F.lit(0.5), F.col("rag_pattern_count"), F.col("llm_pattern_count"))
    return rows.select("conv_id", "turn", told["mode"].alias("mode"), told["confidence"].alias("confidence"))


@query("SELECT round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM labels")
def feedback_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.feedback_accuracy(read_table(spark, sf_dir, "labels"), F.col("quality") == 1)


@query("""WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), p AS (SELECT unnest(['test', 'train']) AS part)
SELECT quality, part, CASE WHEN part = 'test' THEN round(0.2 * n) ELSE n - round(0.2 * n) END::BIGINT AS n FROM n, p WHERE CASE WHEN part = 'test' THEN round(0.2 * n) ELSE n - round(0.2 * n) END > 0""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.stratified(read_table(spark, sf_dir, "labels"), "quality", "doc_id").groupBy("quality", "part").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS place FROM events")
def mode_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.get(F.array(*map(F.lit, ["classic", "graph", "advanced", "rules"])), (F.col("event_id") % 4).cast("int"))
    return read_table(spark, sf_dir, "events").select("event_id", dialogue.mode_order(mode).alias("place"))


@query(f"""WITH {LINES} SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS answer FROM l WHERE NOT regexp_matches(line, '^[=-]') AND NOT contains(line, '-----') GROUP BY doc_id""")
def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    return docs.where(F.exists(F.split("text", "\n", -1), lambda x: ~x.rlike("^[=-]") & ~F.contains(x, F.lit("-----")))).select("doc_id", dialogue.answer_lines(F.col("text")).alias("answer"))


@query(f"""WITH l AS (SELECT {CONTRACT}, {LINE} AS line FROM part), n AS (SELECT *, CASE WHEN starts_with(line, '#') THEN line END AS own FROM l)
SELECT doc_id, line_no, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS label FROM n""")
def labelled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.startswith("line", F.lit("#")), F.col("line"))
    return dialogue.labelled_blocks(contract_lines(spark, sf_dir), label).select("doc_id", "line_no", "label")


# Results

HISTORY_SQL = """q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query_id, vec_id AS pair_id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS similarity FROM q, embeddings WHERE vec_id != query_id)"""


def past_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_table(spark, sf_dir, "embeddings")
    q = records.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.nearest(q, records, 5, least=0.4, others=True).select("query_id", F.col("id").alias("pair_id"), "similarity")


@query(f"""WITH {HISTORY_SQL} SELECT query_id, pair_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, pair_id) AS rank FROM d WHERE similarity >= 0.4) WHERE rank <= 5""")
def similar_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 0.4, for these vectors lie further apart than the default of 0.7."""
    return dialogue.similar_history(past_pairs(spark, sf_dir), 0.4).select("query_id", "pair_id", "similarity", "rank")


@query(f"""WITH {HISTORY_SQL}, k AS (SELECT DISTINCT query_id FROM d WHERE similarity >= 0.4)
SELECT vec_id AS query_id, CASE WHEN k.query_id IS NOT NULL AND vec_id % 40 != 0 THEN 'history' ELSE 'retrieval' END AS source FROM embeddings LEFT JOIN k ON vec_id = k.query_id WHERE vec_id % 20 = 0""")
def answered_from_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read_table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 40 == 0, "again #force").otherwise("again").alias("text"))
    return dialogue.answered_from_history(asked, dialogue.similar_history(past_pairs(spark, sf_dir), 0.4)).select("query_id", "source")


@query("""SELECT count(*) AS total, count(*) FILTER (quality = 1) AS is_summary, count(*) FILTER (toxic = 1) AS is_graph, count(*) FILTER (doc_id % 2 = 0) AS is_dated,
count(*) - count(*) FILTER (quality = 1) - count(*) FILTER (toxic = 1) AS originals FROM labels""")
def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("is_summary"), (F.col("toxic") == 1).alias("is_graph"), (F.col("doc_id") % 2 == 0).alias("is_dated"))
    return retrieval.result_counts(rows)


@query(f"SELECT round(avg(len({words_sql('text')})), 6) AS mean_words FROM documents")
def mean_chunk_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").agg(F.round(F.avg(F.size(text.tokens(F.col("text")))), 6).alias("mean_words"))


@query("SELECT event_type AS keyword, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'user' || user_id % 7, count(*) FROM events GROUP BY ALL")
def keyword_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.array("event_type", F.concat(F.lit("user"), F.col("user_id") % 7), "event_type").alias("keywords"))
    return retrieval.keyword_totals(rows)


@query("""SELECT o_orderkey, month(o_orderdate) IN (1, 3) AS dated, contains(lower('Urgent and HIGH orders'), lower(split_part(o_orderpriority, '-', 2))) AS keyed FROM orders""")
def date_and_keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.concat_ws("; ", F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "MMMM"))
    keyed = retrieval.keyword_relevant(F.array(F.regexp_extract("o_orderpriority", "-(.*)$", 1)), F.lit("Urgent and HIGH orders"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", retrieval.shares_date(stored, F.array(F.lit("January"), F.lit("March"))).alias("dated"), keyed.alias("keyed"))


@query("""SELECT query_id, doc_id, rank FROM (SELECT toxic AS query_id, doc_id, row_number() OVER (PARTITION BY toxic ORDER BY quality = 1 DESC, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE doc_id % 10 / 10.0 END, doc_id) AS rank FROM labels) WHERE rank <= 10""")
def date_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "labels").select(F.col("toxic").alias("query_id"), "doc_id", (F.col("quality") == 1).alias("from_date_search"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 10) / 10.0).alias("distance"))
    return retrieval.date_merged(rows, 5, "doc_id").select("query_id", "doc_id", "rank")


@query("""SELECT item_id, 'Context:' || chr(10) || CASE WHEN item_id % 2 = 0 THEN text ELSE 'No relevant document was found.' END || chr(10) || chr(10) || 'Question: ' || item_id AS prompt FROM benchmark""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = retrieval.prompt(F.when(F.col("item_id") % 2 == 0, F.col("text")), F.col("item_id").cast("string"))
    return read_table(spark, sf_dir, "benchmark").select("item_id", asked.alias("prompt"))


@query("SELECT l.doc_id, d.text FROM labels l LEFT JOIN documents d USING (doc_id)")
def content_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").select("doc_id").join(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "left")


# Graph

GRAPH = f"""{PAIRS}, g AS (SELECT source, target, 'similar_to' AS relation, weight FROM e WHERE rank <= 3 UNION ALL SELECT r_regionkey, 100 + n_nationkey, 'contains', 1.0 FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def whole_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    contains = nation.select(F.col("r_regionkey").cast("long").alias("source"), (F.col("n_nationkey") + 100).cast("long").alias("target"), F.lit("contains").alias("relation"), F.lit(1.0).alias("weight"))
    return edges_of(spark, sf_dir).select("source", "target", "relation", "weight").unionByName(contains)


@query(f"WITH {GRAPH} SELECT relation, count(*) AS n FROM g GROUP BY relation")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relation_counts(whole_graph(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT source, target, relation, weight FROM g WHERE relation = 'contains' AND source < 3")
def related_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(whole_graph(spark, sf_dir), spark.range(3).select("id"), "contains")


@query(f"WITH {GRAPH} SELECT source, target, relation, weight FROM g WHERE source % 2 = 0 AND target % 2 = 0")
def induced_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose both ends are among the nodes with an even id."""
    nodes = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")).unionByName(read_table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id")))
    return graph.induced(whole_graph(spark, sf_dir), nodes.where("id % 2 = 0"))


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type", "event_id")
    return graph.last_nodes(nodes, "event_id")


@query("""WITH s AS (SELECT label AS community, count(*) AS size, array_to_string((list(vec_id ORDER BY vec_id))[1:5], ' ') AS members FROM embeddings GROUP BY label)
SELECT community, size, members, row_number() OVER (ORDER BY size DESC, community) AS place FROM s""")
def largest_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("community"))
    return graph.largest_communities(labels).withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), " "))
