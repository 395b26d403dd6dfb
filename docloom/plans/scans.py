"""Queries of scanned pages and of lines that name parties, dates and signatures, with their DuckDB statements.

Pages and agreements are made from whole documents: each run of five lines is a
page, with what a page reader adds before it; each text gets a line of an
agreement before and after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import lexicon
from docloom.functions.text import windows
from docloom.operators import ingest, pages
from docloom.plans.catalog import query, quoted
from docloom.sources.tables import read_table

#: White space of any kind and decimal digits of any script, for RE2.
WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def any_script(pattern: str) -> str:
    return quoted(pattern.replace(r"\s", f"[{WHITE}]").replace(r"\d", r"\p{Nd}").replace(r"\w", r"[\p{L}\p{N}\p{M}_]"))


def trimmed(expression: str) -> str:
    return f"regexp_replace({expression}, {any_script(r'^\s+|\s+$')}, '', 'g')"


#: Before a page, by document and page: marks, remarks, bold words, headings, blank lines.
BEFORE = """CASE (doc_id + page_no) % 6 WHEN 0 THEN concat('--- Page ', page_no, ' of 9 ---', chr(10), '### Part', chr(10)) WHEN 1 THEN concat('The document shows a page.', chr(10), 'The text is small.', chr(10))
WHEN 2 THEN '**Bold** and **1.2. Scope** ** Article 3. Price** ' WHEN 3 THEN concat('3.1. Deep', chr(10)) WHEN 4 THEN '' ELSE concat(chr(10), ' ', chr(10), chr(9), chr(10), '  ') END"""


def made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 5).cast("int")), lambda k: F.array_join(F.slice("lines", k * 5 + 1, 5), "\n"))
    made = read_table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).select("doc_id", F.posexplode(cut).alias("page_no", "body"))
    return made.select("doc_id", "page_no", F.concat(F.expr(BEFORE), "body").alias("text"))


def removed(expression: str, *patterns: str) -> str:
    for p in patterns:
        expression = f"regexp_replace({expression}, {any_script(p)}, '', 'g')"
    return expression


INSIDE = rf"[{WHITE.replace(r'\t-\r', r'\t\x0b-\r')}]"
BARE = f"regexp_replace({removed('text', *lexicon.PAGE_REMARKS)}, {any_script(rf'\*\*(?:({INSIDE}*(?:Article |Section |Clause )?\d+(?:\.\d+)*\..*?)|.*?)\*\*')}, '\\1', 'g')"
EVEN = f"regexp_replace(regexp_replace({BARE}, {any_script(r'\n\s*\n\s*\n')}, chr(10) || chr(10), 'g'), {any_script(rf'{INSIDE}*\n{INSIDE}*')}, chr(10), 'g')"


@query(f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), k AS (SELECT doc_id, a, unnest(range(0, (len(a) - 1) // 5 + 1)) AS page_no FROM l),
p AS (SELECT doc_id, page_no, {BEFORE} || array_to_string(a[page_no * 5 + 1 : page_no * 5 + 5], chr(10)) AS text FROM k),
c AS (SELECT doc_id, page_no, {trimmed(EVEN)} || chr(10) AS text FROM p),
o AS (SELECT *, coalesce(max(regexp_matches(text, '###|\\p{{Nd}}+\\.')) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS opened FROM c),
g AS (SELECT *, sum(CASE WHEN opened AND NOT regexp_matches(text, '^(###|\\p{{Nd}}+(\\.\\p{{Nd}}+)*\\.)') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_no) AS grp FROM o),
m AS (SELECT doc_id, grp, string_agg(text, chr(10) ORDER BY page_no) AS text FROM g GROUP BY ALL)
SELECT doc_id, count(*) AS n_groups, string_agg(text, chr(10) || chr(10) ORDER BY grp) AS text FROM m GROUP BY doc_id""")
def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.merged_pages(made_pages(spark, sf_dir))


#: Lines before and after a document's text.
HEAD = """CASE doc_id % 8 WHEN 0 THEN 'Entre les soussignés :' WHEN 1 THEN ' Between: ' WHEN 2 THEN 'Zwischen :' WHEN 3 THEN 'Por una parte, ACME' WHEN 4 THEN 'Tra i sottoscritti: A' WHEN 5 THEN 'Entre :' WHEN 6 THEN 'De klant:' ELSE 'between:' END"""
TAIL = """CASE doc_id % 7 WHEN 0 THEN concat('Fait à Paris, le ', 1 + doc_id % 28, ' mars 2020') WHEN 1 THEN 'Signed:' WHEN 2 THEN 'Geschehen zu Bonn, den 3.4.2020' WHEN 3 THEN 'Hecho en Madrid, el 1/2/2020' WHEN 4 THEN 'Feito em' WHEN 5 THEN 'Te Gent, de 3-4-2020' ELSE 'Signed by hand' END"""
FITS = " UNION ALL ".join(f"SELECT doc_id, line_no, line, {quoted(language)} AS language, {quoted(kind)} AS kind FROM b WHERE regexp_matches(bare, {any_script('|'.join(f'(?:{p})' for p in patterns))})" for language, kinds in lexicon.AGREEMENT_LINES.items() for kind, patterns in kinds.items())


@query(f"""WITH t AS (SELECT doc_id, string_split({HEAD} || chr(10) || text || chr(10) || {TAIL}, chr(10)) AS a FROM documents), l AS (SELECT doc_id, unnest(range(0, len(a))) AS line_no, unnest(a) AS line FROM t),
b AS MATERIALIZED (SELECT doc_id, line_no::INTEGER AS line_no, line, {trimmed('line')} AS bare FROM l) {FITS}""")
def agreement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.expr(HEAD), F.lit("\n"), "text", F.lit("\n"), F.expr(TAIL))
    return pages.agreement_lines(read_table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))


# What arrives of a document


@query(rf"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), {any_script(r'\s+')}), lambda w: w <> '') AS w FROM documents), o AS (SELECT doc_id, w, list_distinct(list_transform(w, lambda x: lower(x))) AS own FROM d),
k AS (SELECT doc_id, unnest(range(0, length(text), 800)) AS pos, text FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, list_filter(regexp_split_to_array(substr(text, pos + 1, 500), {any_script(r'\s+')}), lambda w: w <> '') AS w FROM k),
h AS (SELECT doc_id, sum(len(w)) AS n, list_distinct(flatten(list(list_transform(w, lambda x: lower(x))))) AS held FROM c GROUP BY doc_id),
b AS (SELECT o.doc_id, len(o.w) AS n_words, coalesce(n, 0)::BIGINT AS n_chunk_words, len(own) AS n_own, list_filter(own, lambda x: NOT list_contains(coalesce(held, []), x)) AS gone FROM o LEFT JOIN h USING (doc_id)),
s AS (SELECT *, 100 * (n_own - len(gone)) / nullif(n_own, 0) AS share FROM b)
SELECT doc_id, n_words, n_chunk_words, round(share, 6) AS coverage, round(100 * n_chunk_words / nullif(n_words, 0), 6) AS ratio, coalesce(share < 90, false) AS warn,
md5(CASE WHEN share < 90 THEN array_to_string(list_sort(list_filter(gone, lambda x: length(x) > 3))[:50], ' ') ELSE '' END) AS missing FROM s""")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pieces of 500 characters, one each 800 characters, so that words are missing."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = docs.select("doc_id", F.explode(windows(F.col("text"), 500, 800)).alias("content"))
    return ingest.coverage(docs, pieces).withColumn("missing", F.md5(F.array_join("missing", " ")))


@query()
def ingested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all documents; hand-written contracts and the words that must arrive are tested."""
    docs = read_table(spark, sf_dir, "documents").withColumn("title", F.concat_ws("-", "source", "doc_id"))
    return ingest.ingested(docs).drop("embedded_text").withColumn("content", F.md5("content"))
