"""Readers and writers: tables, plain texts, labelled questions, binary documents, and document tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each text file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions from a JSON array: question, label."""
    return spark.read.schema("question string, label string").json(path, multiLine=True)


def read_documents(spark: SparkSession, path: str, extract: Callable[[bytes, str], str], glob: str = "*.{pdf,doc,docx,txt,html}") -> DataFrame:
    """Binary files through an extraction provider: path, text, error.  A failure is a value of ``error``, never a text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(frames):
        for frame in frames:
            texts, errors = [], []
            for p, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    texts.append(extract(bytes(content), p))
                    errors.append(None)
                except Exception as e:  # a provider's failure belongs to its row
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield frame[["path"]].assign(text=texts, error=errors)

    return files.mapInPandas(run, "path string, text string, error string")


def append_records(records: DataFrame, path: str) -> None:
    """Adds records to a document table, partitioned by document."""
    records.write.mode("append").partitionBy("document_title").parquet(path)


def names_document(title: Column, name: str, exact: bool = False) -> Column:
    """Whether a record belongs to the named document: equal title, or (not exact) a title that contains the name in any case."""
    title = F.coalesce(title, F.lit(""))
    return title == name if exact else F.contains(F.lower(title), F.lower(F.lit(name)))


def without_document(records: DataFrame, name: str, exact: bool = False, title_col: str = "document_title") -> DataFrame:
    """The records that stay when the named document is deleted."""
    return records.where(~names_document(F.col(title_col), name, exact))


def existing(paths: DataFrame, records: DataFrame, path_col: str = "path", title_col: str = "document_title") -> DataFrame:
    """The rows of ``paths`` whose base name is a title of a record; flags (``--``) never are."""
    base = F.regexp_extract(F.col(path_col), r"([^/\\]*)$", 1)
    titles = records.select(F.col(title_col).alias("_title")).distinct()
    return paths.where(~F.startswith(F.col(path_col), F.lit("--"))).join(titles, base == F.col("_title"), "left_semi")


def inferred_schema(metadata: DataFrame, id_col: str, key_col: str = "key", value_col: str = "value") -> DataFrame:
    """(key, type): bool, number or string by the first non-empty value in order of ``id_col``."""
    v = F.col(value_col)
    kind = F.when(F.lower(v).isin("true", "false"), "bool").when(v.rlike(r"^[0-9]*\.?[0-9]*$") & v.rlike("[0-9]"), "number").otherwise("string")
    return metadata.where(v.isNotNull() & (v != "")).groupBy(key_col).agg(F.min_by(kind, F.col(id_col)).alias("type"))
