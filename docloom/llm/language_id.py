"""Language identification, word first, with back-off to shorter character n-grams.

Spark counts words by language over all training rows, and character n-grams of
4, 3, 2 and 1 letters (word borders marked) from these word counts.  A known word
adds its log frequency in each language.  An unseen word is the mean of its
4-grams; a 4-gram that no training word has is the mean of its two 3-grams, and
so on to single letters.

Every learned word and n-gram counts, however rare: the most frequent words, at
most ``max_words`` of up to 64 letters, are broadcast and summed where the texts
lie; all other words of the texts meet the whole tables in joins, each distinct
one once.  ``max_words`` changes the speed only.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
or when nothing was learned; rows with a null lang or id teach nothing (a null
id) or only lack a label; an empty table gives an empty table; repeated rows get
equal rows; the first language in order of code points wins a tie.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import Scratch, fold, most_frequent, slices, table

LETTERS, NEARLY = regex.compile(r"\p{L}+"), re.compile(r"[^\W\d_]+")
MAX_WORDS, LENGTHS = 200_000, (4, 3, 2, 1)
FOLDS = 5
#: Longer words are not broadcast, so that a worker's memory is bounded in bytes.
LONGEST = 64
#: Different n-grams that a task counts before it passes them on.
GRAMS_HELD = 500_000
#: Added to each count; the log frequency of a letter that no training word has.
SMOOTH, UNKNOWN = 0.5, math.log(1e-6)


def split_words(text: str) -> list[str]:
    """Runs of letters, lower-cased.  The quick pattern also takes number signs such as ², which are rare."""
    words = NEARLY.findall(text.lower())
    return words if all(map(str.isalpha, words)) else LETTERS.findall(text.lower())


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    words = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"\p{L}+"), F.lit(0))).alias("unit"))
    return words.groupBy("lang", "unit").agg(F.count("*").alias("n"))


def grams(text: Column, n: int) -> Column:
    """The n-grams of a text in order; a shorter text is its own."""
    # The outer transform names the letters, so that they are split once and not for each n-gram.
    cut = lambda letters: F.transform(F.sequence(F.lit(1), F.greatest(F.size(letters) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(letters, i, n), ""))
    return F.transform(F.array(F.split(text, "")), cut)[0]


def marked(word: Column) -> Column:
    return F.concat(F.lit("^"), word, F.lit("$"))


def gram_counts(words: DataFrame, width: int) -> DataFrame:
    """(k, unit, by): partial counts of the n-grams of all lengths, from counts of words (unit, by)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[dict[str, int], np.ndarray]] = [({}, np.zeros((0, width), np.int64)) for _ in LENGTHS]

        def told() -> Iterator[pa.RecordBatch]:
            for i, k in enumerate(LENGTHS):
                (number, by), held[i] = held[i], ({}, np.zeros((0, width), np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(number) + 1, dtype=np.int32) * width), pa.array(by[: len(number)].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), k, np.int32)), pa.array(list(number), pa.string()), lists], names=["k", "unit", "by"])

        for batch in batches:
            marks = [f"^{w}$" for w in batch.column("unit").to_pylist()]
            counts = batch.column("by").flatten().to_numpy(zero_copy_only=False).reshape(len(marks), width)
            for i, k in enumerate(LENGTHS):
                number, by = held[i]
                ids = np.array([number.setdefault(w[a : a + k], len(number)) for w in marks for a in range(max(1, len(w) - k + 1))], np.int64)
                if len(by) < len(number):
                    by = np.concatenate([by, np.zeros((2 * len(number) - len(by), width), np.int64)])
                owner = np.repeat(np.arange(len(marks)), [max(1, len(w) - k + 1) for w in marks])
                np.add.at(by, ids, counts[owner])
                held[i] = number, by
            if sum(len(number) for number, _ in held) > GRAMS_HELD:
                yield from told()
        yield from told()

    return words.select("unit", "by").mapInArrow(run, "k int, unit string, by array<long>")


class Counts:
    """Stored counts by language of words, and of n-grams with their length ``k``; their sums."""

    def __init__(self, docs: DataFrame, text_col: str, lang_col: str, scratch: Scratch):
        words = scratch.table(word_counts(docs, text_col, lang_col), "words")
        self.languages = sorted(r.lang for r in words.select("lang").distinct().collect())
        by = self.each(lambda x: F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)))
        self.words = scratch.table(words.groupBy("unit").agg(by.alias("by")).withColumn("k", F.lit(0)), "words-by-language")
        self.grams = scratch.table(gram_counts(self.words, len(self.languages)).groupBy("k", "unit").agg(self.each(lambda x: F.sum(F.get("by", F.lit(self.languages.index(x))))).alias("by")), "grams-by-language")
        sums = self.words.unionByName(self.grams).groupBy("k").agg(F.count("*").alias("distinct"), self.each(lambda x: F.sum(F.get("by", F.lit(self.languages.index(x))))).alias("all")).collect()
        self.below = {r.k: [float(n) + SMOOTH * (r.distinct + 1) for n in r["all"]] for r in sums}

    def each(self, column) -> Column:
        """An array of a column for each language."""
        return F.array(*map(column, self.languages)) if self.languages else F.array().cast("array<long>")

    def logs(self, k: int) -> Column:
        below = F.array(*map(F.lit, self.below.get(k, [])))
        return F.zip_with("by", below, lambda n, d: F.log((n + SMOOTH) / d))

    def frequent(self, limit: int, scratch: Scratch) -> tuple[list[str], np.ndarray]:
        """The words that are broadcast and their log frequencies."""
        short = self.words.where(F.length("unit") <= LONGEST).withColumn("all", F.aggregate("by", F.lit(0).cast("long"), lambda s, n: s + n))
        rows = most_frequent(short, limit, scratch, "all").select("unit", "by").toArrow()
        by = rows.column("by").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(self.languages))
        return rows.column("unit").to_pylist(), np.log((by + SMOOTH) / np.array(self.below.get(0, [1.0])))

    def mean(self) -> list[Column]:
        return [self.each(lambda x: F.avg(F.get("logs", F.lit(self.languages.index(x))))).alias("logs")]

    def told(self, words: DataFrame, scratch: Scratch) -> DataFrame:
        """(unit, logs) for each of the distinct ``words`` (unit): from the counts of words, else of n-grams."""
        found = words.join(self.words.select("unit", "by"), "unit", "left")
        unseen = scratch.table(found.where("by is null").select("unit"), "unseen-words")
        parts = scratch.table(unseen.select("unit", F.explode(grams(marked(F.col("unit")), LENGTHS[0])).alias("part")), "parts")
        levels = [parts]
        for k in LENGTHS[:-1]:
            needed = levels[-1].select(F.col("part").alias("unit")).distinct()
            missing = needed.join(self.grams.where(F.col("k") == k), "unit", "left_anti")
            levels.append(scratch.table(missing.select("unit", F.explode(grams(F.col("unit"), k - 1)).alias("part")), "parts"))
        last = self.grams.where(F.col("k") == 1).select("unit", self.logs(1).alias("logs"))
        unknown = F.array(*(F.lit(UNKNOWN) for _ in self.languages))
        out = levels[-1].select(F.col("part").alias("unit")).distinct().join(last, "unit", "left").select("unit", F.coalesce("logs", unknown).alias("logs"))
        for k, level, above in zip((2, 3, 4), levels[:0:-1], levels[-2::-1], strict=True):
            backed = level.join(out.withColumnRenamed("unit", "part"), "part").groupBy("unit").agg(*self.mean())
            needed = above.select(F.col("part").alias("unit")).distinct()
            out = needed.join(self.grams.where(F.col("k") == k), "unit").select("unit", self.logs(k).alias("logs")).unionByName(backed)
        backed = parts.join(out.withColumnRenamed("unit", "part"), "part").groupBy("unit").agg(*self.mean())
        return found.where("by is not null").select("unit", self.logs(0).alias("logs")).unionByName(backed)


def summed(texts: list[str], known: dict[str, int], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Of each text the number of words and the sum of the logs of those known; and how many others it has, these, and how often."""
    number: dict[str, int] = {}
    split = [[number.setdefault(w, len(number)) for w in split_words(t)] for t in texts]
    lengths = np.array([len(x) for x in split], np.int64)
    ids, owner = np.array([i for x in split for i in x], np.int64), np.repeat(np.arange(len(split)), lengths)
    names = list(number)
    place = np.array([known.get(w, -1) for w in names], np.int64)[ids] if len(ids) else ids
    hit = place >= 0
    total = np.stack([np.bincount(owner[hit], column[place[hit]], len(texts)) for column in logs.T], 1) if logs.shape[1] else np.zeros((len(texts), 0))
    rest, times = np.unique(owner[~hit] * max(1, len(names)) + ids[~hit], return_counts=True)
    return lengths, total, np.bincount(rest // max(1, len(names)), minlength=len(texts)), [names[i] for i in rest % max(1, len(names))], times


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs``; one fold of FOLDS teaches nothing."""
    scratch = scratch or Scratch(docs.sparkSession)
    part = fold(F.col(id_col), FOLDS)
    counts = Counts(docs.where(part > 0), text_col, lang_col, scratch)
    shared = docs.sparkSession.sparkContext.broadcast(counts.frequent(max_words, scratch))
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), (part == 0).alias("held_out"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, logs = shared.value
        known = {u: i for i, u in enumerate(units)}
        for batch in batches:
            for start, texts in slices(batch, "body"):
                own = batch.slice(start, len(texts))
                n, total, many, words, times = summed(texts, known, logs)
                width = total.shape[1]
                sums = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * width), pa.array(total.ravel(), pa.float64()))
                each = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], names=["unit", "times"])
                rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), each)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("row", "doc_id", "held_out")), pa.array(n), sums, rest], names=["row", "doc_id", "held_out", "n", "total", "rest"])

    schema = f"row long, doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, n long, total array<double>, rest array<struct<unit:string,times:long>>"
    read = scratch.table(slim.mapInArrow(run, schema), "read")
    if not counts.languages:
        return read.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rest = read.select("row", F.inline("rest"))
    told = scratch.table(counts.told(rest.select("unit").distinct(), scratch), "rare-words")
    plus = counts.each(lambda x: F.sum(F.get("logs", F.lit(counts.languages.index(x))) * F.col("times")))
    more = rest.join(told, "unit").groupBy("row").agg(plus.alias("more"))
    whole = F.when(F.col("more").isNull(), F.col("total")).otherwise(F.zip_with("total", "more", lambda a, b: a + b))
    best = F.array_max("whole")
    names = F.array(*map(F.lit, counts.languages))
    # The posterior for equal priors, tempered by the number of words, which do not come independently.
    mass = F.aggregate("whole", F.lit(0.0), lambda s, x: s + F.exp((x - best) / F.sqrt("n")))
    out = read.join(more, "row", "left").withColumn("whole", whole)
    return out.select("doc_id", "held_out", F.when(F.col("n") > 0, F.element_at(names, F.array_position("whole", best).cast("int"))).otherwise("und").alias("lang_pred"), F.when(F.col("n") > 0, 1 / mass).otherwise(0.0).alias("score"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
