"""Stored records: their fields, the text that is embedded, and the composed search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import contains_any, tokens
from docloom.operators.retrieval import is_date_query, without_summarised
from docloom.operators.vectors import nearest

# Words that make a chunk one to keep whole.
IMPORTANT = [
    "shall", "must", "will not", "shall not", "represent", "warrant",
    "liability", "indemnify", "termination", "dispute", "governing law",
    "force majeure", "confidential", "warranty",
]
FIELDS = ["section_number", "hierarchy", "document_title", "parent_section", "chapter_title"]


def projected(chunks: DataFrame) -> DataFrame:
    """Records with ``unknown`` for missing fields and the hierarchy as one string."""
    out = chunks.withColumn("hierarchy", F.nullif(F.array_join("hierarchy", " -> "), F.lit("")))
    return out.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in FIELDS})


def enriched(section: Column, hierarchy: Column, title: Column, chapter: Column, position: Column, total: Column, content: Column) -> Column:
    """The text of a record that is embedded: where it stands, then what it says."""
    return F.concat(F.lit("Section: "), section, F.lit("\nHierarchy: "), hierarchy, F.lit("\nDocument: "), title, F.lit("\nChapter: "), chapter, F.lit("\nPosition: "), position.cast("string"), F.lit("/"), total.cast("string"), F.lit("\nContent: "), content)


def is_important(chunk: Column) -> Column:
    return F.contains(chunk, F.lit("[DEFINITION]")) | F.contains(chunk, F.lit("[IMPORTANT_CLAUSE]")) | contains_any(F.lower(chunk), IMPORTANT)


def chunk_threshold(text: Column) -> Column:
    """The similarity at which chunks are cut: 0.65, less for long sentences, many references or deep numbering, more for short sentences; between 0.4 and 0.8."""
    sentences = F.filter(F.split(text, r"[.!?]\s"), lambda s: F.trim(s) != "")
    mean = F.when(F.size(sentences) > 0, F.size(tokens(text)) / F.size(sentences)).otherwise(25.0)
    references = F.regexp_count(text, F.lit(r"(?i)\b(section|article|clause)\s+[0-9]+"))
    deep = text.rlike(r"(?m)^\s*[0-9]+\.[0-9]+\.[0-9]+")
    out = F.lit(65) + F.when(mean > 35, -5).when(mean < 15, 5).otherwise(0) - F.when(references > 10, 5).otherwise(0) - F.when(deep, 5).otherwise(0)
    return F.greatest(F.lit(40), F.least(F.lit(80), out)) / 100


def filename_parts(path: Column) -> dict[str, Column]:
    base = F.regexp_extract(path, r"([^/\\?#]*)/?(?:[?#].*)?$", 1)
    return {"base": base, "stem": F.regexp_replace(base, r"\.[^.]*$", ""), "suffix": F.regexp_extract(base, r"(\.[^.]*)$", 1)}


def first_holder(results: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """For each result the first node, by ordinal, of the same group whose content holds the result's text."""
    both = results.join(nodes, by).where(F.contains("content", F.col("text")))
    return both.groupBy(*by, "result_id").agg(F.min_by("node_id", "ord").alias("node_id"))


def search(queries: DataFrame, records: DataFrame, n: int, id_col: str = "vec_id", vector_col: str = "embedding", date_col: str | None = None) -> DataFrame:
    """For each query of a stated set (query_id, query_vector, query_text): the n nearest records among 2n that are fetched.

    A question about dates fetches 2n with a date as well and takes these first; originals
    that follow their summary (is_summary, original_content) are dropped before the cut.
    """
    asks = queries.select("query_id", F.coalesce(is_date_query(F.col("query_text")), F.lit(False)).alias("_asks"))
    found = nearest(queries, records, 2 * n, id_col, vector_col).select("query_id", F.col("id").alias(id_col), "distance", F.lit(1).alias("_branch"))
    if date_col:
        about = queries.join(asks.where("_asks"), "query_id", "left_semi")
        dated = nearest(about, records.where(F.col(date_col).isNotNull()), 2 * n, id_col, vector_col)
        found = dated.select("query_id", F.col("id").alias(id_col), "distance", F.lit(0).alias("_branch")).unionByName(found)
    once = found.groupBy("query_id", id_col).agg(F.min_by(F.struct("distance", "_branch"), "_branch").alias("f")).select("query_id", id_col, "f.*")
    w = Window.partitionBy("query_id").orderBy("_branch", "distance", id_col)
    ranked = once.withColumn("ord", F.row_number().over(w)).drop("_branch").join(records, id_col)
    if "is_summary" in records.columns:
        ranked = without_summarised(ranked)
    last = Window.partitionBy("query_id").orderBy("ord")
    return ranked.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= n)
