"""The way of a document into the collection: chunks by meaning, their metadata, lost legal lines, records; and how much of it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import bound, hierarchy, parent_section, tokens
from docloom.operators import records, restoration, semantic
from docloom.operators.chunking import with_metadata
from docloom.sources.shared import stored

META = ["chapter_title", "clause_type", "has_cross_references"]
#: What a report of missing words names, and the share of words below which it is due.
MISSING, LETTERS, ENOUGH = 50, 3, 90


def ingested(docs: DataFrame, embed: semantic.Provider = semantic.letter_embeddings, title_col: str = "title", by: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(by, position from 0, total_chunks, document_title, section_number, hierarchy, parent_section, chapter_title,
    clause_type, has_cross_references, content, embedded_text, restored) of each document's chunks.

    Metadata are those of the chunk before lost lines came back.  A document without chunks that lost legal lines gets
    one chunk of its own; null and blank texts without such lines give no record.  ``how`` goes to the chunker.  ``by``
    names each document once.  Texts are shuffled with their chunks once, metadata and restored chunks once more.
    """
    cut = semantic.semantic_chunks(docs.select(by, text_col), embed, by=by, text_col=text_col, **how)
    order = Window.partitionBy(by).orderBy("section_no", "position")
    numbered = cut.withColumn("place", F.row_number().over(order).cast("long")).select(by, F.col("place").alias("position"), "content")
    told = stored(with_metadata(numbered, by), "ingest")  # two joins read it
    whole = restoration.with_restored(docs.select(by, text_col), told.select(by, "position", "content", F.col("section_number").alias("section")), by, text_col)
    opened = ~F.col("known")
    kept = whole.join(told.select(by, "position", *META, F.lit(True).alias("known")), [by, "position"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    named = kept.join(docs.select(by, F.col(title_col).alias("document_title")), by, "left").select(
        by,
        (F.col("position") - 1).alias("position"),
        F.count("*").over(Window.partitionBy(by)).alias("total_chunks"),
        "document_title",
        F.col("section").alias("section_number"),
        F.when(~opened, hierarchy(F.col("section"))).alias("hierarchy"),
        F.when(opened, F.lit(restoration.NEW_CHUNK["parent"])).otherwise(parent_section(F.col("section"))).alias("parent_section"),
        F.when(opened, F.lit(restoration.NEW_CHUNK["chapter"])).otherwise(F.col("chapter_title")).alias("chapter_title"),
        F.coalesce("clause_type", F.lit("autre")).alias("clause_type"),
        F.coalesce("has_cross_references", F.lit(False)).alias("has_cross_references"),
        "content",
        "restored",
    )
    out = records.projected(named)
    text = records.enriched(*(F.col(c) for c in ("section_number", "hierarchy", "document_title", "chapter_title", "position", "total_chunks", "content")))
    return out.withColumn("embedded_text", text)


def coverage(docs: DataFrame, chunks: DataFrame, by: str = "doc_id", text_col: str = "text", content_col: str = "content") -> DataFrame:
    """(by, n_words, n_chunk_words, coverage, ratio, warn, missing) of each document.

    coverage: per cent of its different lower-cased words that its chunks have; ratio: words of the chunks, repeats
    counted, per cent of its words; both null for a text without words.  warn: coverage is below 90; missing: then the
    first 50, in order, of its words of more than three letters that no chunk has, else none.  Of a chunk only its
    different words are shuffled.
    """
    held = chunks.select(by, bound(tokens(F.col(content_col)), lambda w: F.struct(F.size(w).alias("n"), F.array_distinct(F.transform(w, F.lower)).alias("words"))).alias("c"))
    held = held.groupBy(by).agg(F.sum("c.n").alias("_n"), F.array_distinct(F.flatten(F.collect_list("c.words"))).alias("_held"))
    own = docs.select(by, bound(tokens(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.array_distinct(F.transform(w, F.lower)).alias("words"))).alias("_own"))
    both = own.join(held, by, "left").withColumn("_gone", F.array_except(F.col("_own.words"), F.coalesce("_held", F.array().cast("array<string>"))))
    n = F.nullif(F.size("_own.words"), F.lit(0))
    share = 100 * (n - F.size("_gone")) / n
    named = F.slice(F.array_sort(F.filter("_gone", lambda w: F.length(w) > LETTERS)), 1, MISSING)
    return both.select(
        by,
        F.col("_own.n").alias("n_words"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_chunk_words"),
        F.round(share, 6).alias("coverage"),
        F.round(100 * F.coalesce("_n", F.lit(0)) / F.nullif(F.col("_own.n"), F.lit(0)), 6).alias("ratio"),
        F.coalesce(share < ENOUGH, F.lit(False)).alias("warn"),
        F.when(share < ENOUGH, named).otherwise(F.array().cast("array<string>")).alias("missing"),
    )
