"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of the digests, one per task and merged by a shuffle of at
most ``counters`` rows a task, find every digest that more than
``n / (counters + 1)`` rows carry.  Their exact winners (one aggregate over the
candidates) are broadcast, at most ``counters`` rows, and settle their copies
where these lie.  All other digests go through an ordinary shuffle, in which no
group can be larger than ``n / (counters + 1)`` rows.

Defined results: a null text counts as the empty text; of equal texts the row
with the largest id stays, null ids last; of rows that also share the id exactly
one stays; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.shared import Scratch, ascii_lower, table

COUNTERS = 1024


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """One summary of the digests in ``batches``; counts are lower bounds."""
    kept: Counter[bytes] = Counter()
    for batch in batches:
        for pair in batch.column("digest").value_counts().to_pylist():
            kept[pair["values"]] += pair["counts"]
        if len(kept) > counters:
            cut = sorted(kept.values(), reverse=True)[counters]
            kept = Counter({k: v - cut for k, v in kept.items() if v > cut})
    yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], names=["digest", "bound"])


def frequent_digests(digests: DataFrame, counters: int) -> DataFrame:
    """At most ``counters`` digests, among them all of more than n / (counters + 1) rows."""
    summaries = digests.select("digest").mapInArrow(lambda batches: misra_gries(batches, counters), "digest binary, bound long")
    return summaries.groupBy("digest").agg(F.sum("bound").alias("bound")).orderBy(F.desc("bound"), "digest").limit(counters).select("digest")


def with_digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(text, 256)).alias("digest"))


def decide(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(id, row, digest, keep_id, group_size, kept) for each row of a stored table (id, row, digest)."""
    winner = [F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("best")]
    heavy = digests.join(F.broadcast(frequent_digests(digests, counters)), "digest").groupBy("digest").agg(*winner).where("group_size > 1")
    marked = digests.join(F.broadcast(heavy), "digest", "left")
    w = Window.partitionBy("digest")
    light = marked.where("group_size is null").select("id", "row", "digest", F.count("*").over(w).alias("group_size"), F.max(F.struct("id", "row")).over(w).alias("best"))
    both = marked.where("group_size is not null").select(*light.columns).unionByName(light)
    return both.select("id", "row", "digest", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, scratch: Scratch | None = None) -> DataFrame:
    """A decision for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = scratch or Scratch(docs.sparkSession)
    digests = scratch.table(with_digest(docs, id_col, text_col), "digests")
    return decide(digests, counters).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    stored = scratch.table(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)).alias("digest")), "docs-by-row")
    digests = stored.select(F.col(f"doc.{id_col}").alias("id"), "row", "digest")
    gone = decide(digests, counters).where("not kept").select("row")
    return stored.join(gone, "row", "left_anti").select("doc.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
