"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written and
read again as the next one's docs; all but the last have the columns of
``documents``.  A stage's scratch tables are removed when the next stage begins,
for by then its result has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.bpe import bpe_digests, tokenizer_path
from docloom.llm.exact_dedup import drop_copies
from docloom.llm.jaccard_join import one_of_each
from docloom.llm.mixing import mixture
from docloom.llm.quality import keep_good
from docloom.llm.shared import Scratch

_used: list[Scratch] = []


def _scratch(spark: SparkSession) -> Scratch:
    while _used:
        _used.pop().close()
    _used.append(Scratch(spark))
    return _used[0]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or have a posterior of quality below one half go."""
    return keep_good(docs, _scratch(spark))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id stays."""
    return drop_copies(docs, _scratch(spark))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a similarity of 0.8 or more, the smallest doc_id stays."""
    return one_of_each(docs, _scratch(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (not at all, once or twice), in shuffled shards."""
    return mixture(docs, _scratch(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each taken document: its number of tokens, and digests of ids and decoded text."""
    return bpe_digests(docs, tokenizer_path(), scratch=_scratch(spark))


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mix_sources), ("BPE", encode)]

#: Posterior quality and byte-pair merges are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to scratch tables."""
    between = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = between.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
