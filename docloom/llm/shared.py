"""Helpers that several operators use: scratch tables, word rules, text slices."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed
#: and carriage return.  ``bytes.split()`` cuts UTF-8 at the very same bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Characters of text that a task holds as Python objects at one time.
SLICE_CHARS = 1_000_000


class Scratch:
    """Written tables in the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir`` of the session; only where that is
    unset (tests, local mode) a local default is taken.  A table written here
    survives lost executors.  ``close`` removes the tables; the process's end
    removes what is left.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
        self.paths: list[str] = []
        atexit.register(self.close)

    def path(self, label: str) -> str:
        self.paths.append(f"{self.root}/{label}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def table(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        self.remove(*self.paths)

    def remove(self, *paths: str) -> None:
        """Deletes tables that nothing will read any more."""
        self.paths = [p for p in self.paths if p not in paths]
        if not paths or self.spark.sparkContext._jsc is None:
            return
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null stays null."""
    return F.translate(text, UPPER, LOWER)


def bound(col: Column, f: Callable[[Column], Column]) -> Column:
    """f(col) with the column evaluated once, also where f uses it inside lambdas."""
    return F.transform(F.array(col), f)[0]


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch in runs of about ``chars`` characters; null is ''."""
    start, size, texts = 0, 0, []
    for i, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        if texts and size + len(text) > chars:
            yield start, texts
            start, size, texts = i, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield start, texts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def most_frequent(counted: DataFrame, limit: int, scratch: Scratch, n_col: str = "n") -> DataFrame:
    """The rows of ``counted`` with the largest counts, at most ``limit``: whole levels of 1/16 of a doubling.

    A histogram of at most some hundred levels finds the cut, so no task sends its own candidates to the driver.
    """
    stored = scratch.table(counted.withColumn("level", F.floor(F.log2(n_col) * 16)), "counted")
    left, cut = limit, None
    for r in stored.groupBy("level").count().orderBy(F.desc("level")).collect():
        left -= r["count"]
        if left < 0:
            break
        cut = r.level
    return stored.where(F.lit(False) if cut is None else F.col("level") >= cut).drop("level")
