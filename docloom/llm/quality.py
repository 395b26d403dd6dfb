"""Quality rules by weak supervision.

Every rule votes good (1), bad (-1) or abstains (0) on a document.  Votes are
counted by pattern, so the label model sees at most 3^rules rows however large
the corpus is.  Expectation-maximisation then estimates, for each rule, how
often it votes bad where it votes at all, on good documents and on each kind of
junk.  A document stays if its posterior probability of being good is at least
one half.

Junk is of many kinds that have little in common, so there is one class for good
documents and one for each rule's defect.  No rate is fixed: ``PRIOR`` says what
is expected of each, with the weight of a share of the corpus (``WEIGHT``), so
equal patterns in equal shares are judged alike whatever their number, and counts
overrule it.  Symbols are counted against words and against characters, so that a
text marred by them has two witnesses and its verdict does not hang on how many
others of its kind show a further defect.  At the
start a lone bad vote is believed as far as its rule agrees with others: twice
the share of the rule's bad votes that come with another's.  So a rule whose bad
votes mostly stand alone ends as one that errs on good documents and is
overruled; one that others bear out is believed, alone too.  A kind of junk needs
more than a share ``NEEDED`` of the corpus that bears it out; chance meetings of
votes do not make one.

Defined results: null and empty texts have no words, fail the base rule and have
all counts 0; an empty table gives an empty table; repeated rows get equal rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.llm.shared import Scratch, slices, table

BLANKS = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: How often a rule is expected to vote bad: on its own defect, on other junk, on good documents.
PRIOR = (0.9, 0.1, 0.01)
#: The weight of what is expected of a rate, as a share of all documents.
WEIGHT = 0.005
#: The share of all documents that is taken from a kind of junk before it counts.
NEEDED = 0.001
LINE_WORD = re.compile(r"[^\x20\x09-\x0D]")
LETTERS = re.compile(r"[^\W\d_]+")
BARE = "".join(map(chr, range(0x21, 0x7F))).translate({c: None for c in (*range(0x41, 0x5B), *range(0x61, 0x7B))}).encode()
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_marks", "n_lines", "n_bare", "n_stutter"]


def word_counts(words: list[bytes], lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: words in 5-word windows that occur twice or more in it; words of ASCII digits and marks alone; words equal to the one before."""
    n = len(words)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    bare = np.bincount(owner[np.array([not w.strip(BARE) for w in number], bool)[ids]], minlength=len(lengths))
    stutter = np.bincount(owner[1:][(ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])], minlength=len(lengths))
    if n < WINDOW:
        return np.zeros(len(lengths), np.int64), bare, stutter
    # Windows are named exactly: (name so far, next word) is one number, renumbered before it could overflow.
    whole = np.flatnonzero(owner[: n - WINDOW + 1] == owner[WINDOW - 1 :])
    name = owner[whole].astype(np.int64)
    for k in range(WINDOW):
        name = name * len(number) + ids[whole + k]
        if k == 2 or len(number) > 50_000:
            name = np.unique(name, return_inverse=True)[1]
    _, name, times = np.unique(name, return_inverse=True, return_counts=True)
    start = whole[times[name] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + WINDOW, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=len(lengths)), bare, stutter


def measure(texts: list[str]) -> list[np.ndarray]:
    """The columns of COUNTS for a list of texts."""
    split = [t.encode().split() for t in texts]
    n_words = [len(w) for w in split]
    rows = []
    for text in texts:
        lines = [x for x in text.split("\n") if LINE_WORD.search(x)] if "\n" in text else [text] * bool(LINE_WORD.search(text))
        runs = "".join(LETTERS.findall(text))
        rows.append((len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), len(runs), sum(map(str.isupper, runs)), text.count("!") + text.count("?"), len(lines)))
    word_chars, n_symbols, n_dup_lines, n_letters, n_upper, n_marks, n_lines = np.array(rows, np.int64).reshape(-1, 7).T
    n_repeat_words, n_bare, n_stutter = word_counts([w for x in split for w in x], n_words)
    return [np.array(n_words, np.int64), word_chars, n_symbols, n_dup_lines, n_repeat_words, n_letters, n_upper, n_marks, n_lines, n_bare, n_stutter]


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` as (doc struct, row counts); the text is read once."""
    keep = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("body")) if text_col in docs.columns else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch, "body"):
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc"), *map(pa.array, measure(texts))], names=["doc", *COUNTS])

    schema = StructType([StructField("doc", keep.schema["doc"].dataType), *(StructField(c, LongType()) for c in COUNTS)])
    return keep.mapInArrow(run, schema)


def ballot(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def votes() -> dict[str, Column]:
    """The rules.  Each compares counts of one document; shares are per word, letter or line."""
    n, letters, lines = F.col("n_words"), F.col("n_letters"), F.col("n_lines")
    return {
        "length": ballot(n < 10, n >= 50),
        "word_length": ballot((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n), F.col("word_chars").between(3 * n, 12 * n)),
        "symbols": ballot(10 * F.col("n_symbols") > n, 100 * F.col("n_symbols") <= n),
        "symbol_share": ballot(50 * F.col("n_symbols") > F.col("word_chars"), 200 * F.col("n_symbols") <= F.col("word_chars")),
        "lines": ballot((10 * F.col("n_dup_lines") > 3 * lines) & (F.col("n_dup_lines") > 1), F.col("n_dup_lines") == 0),
        "repeats": ballot(100 * F.col("n_repeat_words") > 20 * n, 100 * F.col("n_repeat_words") <= 5 * n),
        "capitals": ballot((2 * F.col("n_upper") > letters) & (letters > 20), 5 * F.col("n_upper") <= letters),
        "marks": ballot(5 * F.col("n_marks") > n, 20 * F.col("n_marks") <= n),
        "letters": ballot(10 * letters < 3 * F.col("word_chars"), 10 * letters >= 3 * F.col("word_chars")),
        "stutter": ballot(3 * F.col("n_stutter") > n, 50 * F.col("n_stutter") <= n),
        "bare": ballot(5 * F.col("n_bare") > 2 * n, 5 * F.col("n_bare") <= 2 * n),
    }


def estimate(patterns: np.ndarray, weights: np.ndarray, prior: tuple[float, float, float] = PRIOR, weight: float = WEIGHT, rounds: int = 1000) -> np.ndarray:
    """Posterior of good for each vote pattern (rows of -1, 0, 1) that ``weights`` documents show.

    Class 0 is good; class j is bad for the defect that rule j names.
    """
    n_rules, total = patterns.shape[1], max(weights.sum(), 1.0)
    add, own = weight * total, np.arange(n_rules)
    bad, cast = (patterns < 0).astype(float), (patterns != 0).astype(float)
    expected = np.full((n_rules + 1, n_rules), prior[1])
    expected[0], expected[own + 1, own] = prior[2], prior[0]
    many = bad.sum(1, keepdims=True)
    agreed = (weights @ (bad * (many > 1)) + add / 4) / (weights @ bad + add)
    borne = bad * agreed
    junk = np.where(many == 1, np.minimum(1, 2 * borne), borne / np.maximum(borne.sum(1, keepdims=True), 1e-9))
    belong = np.concatenate([1 - junk.sum(1, keepdims=True), junk], axis=1)
    for _ in range(rounds):
        mass = belong.T * weights
        share = np.maximum(mass.sum(1) - NEEDED * total * (np.arange(n_rules + 1) > 0), 1e-6 * total)
        share /= share.sum()
        rate = (mass @ bad + add * expected) / (mass @ cast + add)
        joint = np.log(share) + bad @ np.log(rate).T + (cast - bad) @ np.log(1 - rate).T
        before, belong = belong, np.exp(joint - joint.max(1, keepdims=True))
        belong /= belong.sum(1, keepdims=True)
        if np.abs(before - belong).max(initial=0) < 1e-7:
            break
    return belong[:, 0]


def posterior(counted: DataFrame) -> DataFrame:
    """A row for each vote pattern that occurs (at most 3^rules): the votes and ``p_good``."""
    names = list(votes())
    found = counted.select(*(v.alias(k) for k, v in votes().items())).groupBy(*names).count().orderBy(*names).collect()
    patterns = np.array([r[:-1] for r in found], float).reshape(-1, len(names))
    p = estimate(patterns, np.array([r[-1] for r in found], float))
    return counted.sparkSession.createDataFrame([(*(int(v) for v in r[:-1]), float(q)) for r, q in zip(found, p, strict=True)], ", ".join(f"{k} tinyint" for k in names) + ", p_good double")


def judged(counted: DataFrame) -> DataFrame:
    """``counted`` with p_good, base_failed and kept."""
    rules = votes()
    told = counted.select("*", *(v.alias(f"vote_{k}") for k, v in rules.items()))
    model = posterior(counted)
    model = F.broadcast(model.select(*(F.col(k).alias(f"vote_{k}") for k in rules), "p_good"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return told.join(model, [f"vote_{k}" for k in rules], "left").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce("p_good", F.lit(0.0)) >= 0.5))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, the counts, p_good, base_failed and kept for each row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession)
    slim = docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("doc"), F.col(text_col).alias("body"))
    return judged(scratch.table(with_counts(slim), "quality")).select("doc.doc_id", *COUNTS[:5], "base_failed", "kept", "p_good")


def keep_good(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    return judged(scratch.table(with_counts(docs, text_col), "quality-docs")).where("kept").select("doc.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
