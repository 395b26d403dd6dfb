"""Token ids of a corpus as files of directly addressable codes, in ascending order of document ids.

Texts are dealt to tasks by ranges of (id, digest of the text), so that documents of
one id are split too, sorted there, encoded and written, one file for each stretch of
some million tokens.  A written table names the files of the tasks that succeeded with
their numbers of documents and tokens; a file of a lost attempt has a name of its own
and is read by nothing.  Where a file begins in the corpus follows from sums over that
table, in two steps.  Files are read in slices, and single tokens through ``Tokens``.

The tokenizer drops white space and never joins across a space or a line feed, so a text
is encoded word by word: a worker keeps the ids of words that it met (two generations of
bounded size), and hands new ones to the tokenizers library.  What it keeps changes
speed only.

Defined results: null counts as the empty text, which has the end id alone; null document
ids come first; documents of one id stand in the order of their texts' digests; an empty
table gives an empty table and no file.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.addressable import Tokens, encoded
from docloom.llm.shared import Scratch, table

END = 1
#: Tokens of one file, and of one slice that is read at a time; a longer document makes a larger file.
FILE_TOKENS, SLICE_TOKENS = 8_000_000, 2_000_000
#: Bytes of text that are cut into words at one time, and new words that go to the library as one text.
SLICE_BYTES, RUN, BLOCK = 12_000_000, 64, 1 << 16
#: Words that a worker keeps in one of two generations, and the longest of them.
GENERATION, LONGEST = 300_000, 64
FILES = "part int, file int, path string, docs long, tokens long"


class Words:
    """Ids of words by a tokenizer (its JSON), each new word once."""

    def __init__(self, model: str, generation: int = GENERATION):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        suffix = json.loads(model)["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.tokenizer.get_vocab_size(), *vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.marks = dict(zip(".,;:!?", self.singles(list(".,;:!?")), strict=True))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.generation = generation

    def singles(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def new(self, words: list[str]) -> list[bytes]:
        """Ids of words as the library gives them.

        A word of letters alone (and as many when lower-cased) is one unit of the tokenizer, and a mark after it
        begins another.  So such words go to the library many at a time, without their mark, and are told apart
        by the ids that end a unit; all others go one by one.
        """
        out: list[bytes | None] = [None] * len(words)
        plain, stems = [], []
        for k, w in enumerate(words):
            stem = w[:-1] if w[-1:] in self.marks else w
            if stem.isalpha() and len(stem.lower()) == len(stem):
                plain.append(k)
                stems.append(stem)
        for i in range(0, len(plain) if self.ends.any() else 0, BLOCK):
            texts = [" ".join(stems[j : j + RUN]) for j in range(i, min(i + BLOCK, len(stems)), RUN)]
            for j, e in zip(range(i, len(stems), RUN), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=False):
                run = plain[j : j + RUN]
                ids = np.array(e.ids, np.uint32)
                cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
                if len(cuts) == len(run):
                    data, begin = ids.tobytes(), 0
                    for k, end in zip(run, cuts.tolist(), strict=True):
                        out[k], begin = data[begin:end] + self.marks.get(words[k][-1], b""), end
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self.singles([words[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of these distinct words, as unsigned 32-bit integers."""
        young, old = self.young, self.old
        out = list(map(young.get, words))
        lacking = [k for k, ids in enumerate(out) if ids is None]
        for k in lacking:
            out[k] = old.get(words[k])
        new = [k for k in lacking if out[k] is None]
        for k, ids in zip(new, self.new([words[k] for k in new]), strict=True):
            out[k] = ids
        young.update((words[k], out[k]) for k in lacking if len(words[k]) <= LONGEST)
        if len(young) > self.generation:
            self.old, self.young = young, {}
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each with the end id; how many each text has)."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        ids = [*self.ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.uint32(END).tobytes()]
        width = np.array([len(x) // 4 for x in ids], np.int64)
        pool = pa.LargeListArray.from_arrays(np.concatenate([[0], width.cumsum()]), pa.array(np.frombuffer(b"".join(ids), np.uint32)))
        ends = np.diff(split.offsets.to_numpy(zero_copy_only=False)).cumsum()
        codes = np.insert(coded.indices.to_numpy(zero_copy_only=False), ends, len(ids) - 1)
        placed = width[codes].cumsum()
        sizes = np.diff(placed[ends + np.arange(len(ends))], prepend=0)
        return pool.take(pa.array(codes)).flatten().to_numpy(), sizes


@lru_cache(maxsize=2)
def words_of(model: str) -> Words:
    """One for all tasks of a worker."""
    return Words(model)


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The shared folder's file system and the folder's path in it."""
    return fs.FileSystem.from_uri(root)


def written(batches: Iterator[pa.RecordBatch], model: str, root: str, file_tokens: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Files of sorted rows (id, text); a row for each file."""
    context = TaskContext.get()
    part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
    store, folder = opened(root)
    store.create_dir(folder, recursive=True)
    words = words_of(model)
    docs, ids, sizes, n, file = [], [], [], 0, 0

    def flush() -> pa.RecordBatch:
        path = f"{folder}/part-{part:06d}-{file:05d}-{attempt}.dac"
        first = np.concatenate([[0], np.concatenate(sizes).cumsum()])
        with store.open_output_stream(path) as f:
            f.write(encoded(np.concatenate(ids), first, docs))
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([file], pa.int32()), "path": [path], "docs": [len(docs)], "tokens": [int(first[-1])]})

    for batch in batches:
        keys = batch.column("id").to_pylist()
        texts = batch.column("text")
        whole = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(whole, (whole[start - 1] if start else 0) + slice_bytes, "right")))
            got, size = words.encode(texts.slice(start, stop - start).cast(pa.large_string()))
            docs += keys[start:stop]
            start = stop
            ids.append(got)
            sizes.append(size)
            n += len(got)
            if n >= file_tokens:
                yield flush()
                docs, ids, sizes, n, file = [], [], [], 0, file + 1
    if docs:
        yield flush()


def write_tokens(docs: DataFrame, tokenizer: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Writes the files; gives a stored table (part, file, path, docs, tokens) of them, in order of (part, file).

    ``tokenizer`` is the place of a tokenizer file on the driver; tasks get its content, a few megabytes, as a broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    order = [F.asc_nulls_first("id"), F.asc("digest")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("id", "text")
    root = scratch.path("token-files")
    return scratch.table(dealt.mapInArrow(lambda b: written(b, model.value, root, file_tokens, slice_bytes), FILES), "token-file-list")


def with_starts(files: DataFrame) -> DataFrame:
    """The list of files with ``start``: the tokens of all files before each."""
    parts = files.groupBy("part").agg(F.sum("tokens").alias("n"))
    block = F.floor(F.col("part") / 1024)
    inner = Window.partitionBy(block).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = parts.groupBy(block.alias("block")).agg(F.sum("n").alias("n"))
    outer = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("block", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("outer"))
    placed = parts.select("part", block.alias("block"), F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("inner")).join(before, "block")
    own = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    started = files.withColumn("own", F.coalesce(F.sum("tokens").over(own), F.lit(0))).join(placed, "part")
    return started.select(*files.columns, (F.col("outer") + F.col("inner") + F.col("own")).alias("start"))


def read_back(batches: Iterator[pa.RecordBatch], root: str, slice_tokens: int) -> Iterator[pa.RecordBatch]:
    """doc_id, start, n_tokens and ids_crc32 of each document of the listed files (path, start), read in slices."""
    store, _ = opened(root)
    for batch in batches:
        for path, begin in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with store.open_input_file(path) as f:
                tokens = Tokens(f)
                first = tokens.first(0, tokens.docs + 1)
                low = 0
                while low < tokens.docs:
                    high = max(low + 1, int(np.searchsorted(first, first[low] + slice_tokens, "right")) - 1)
                    ids = tokens.read(int(first[low]), int(first[high])).astype("<u4")
                    at = first[low : high + 1] - first[low]
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(tokens.names(low, high), pa.int64()), "start": first[low:high] + begin, "n_tokens": np.diff(at), "ids_crc32": pa.array(crc, pa.int64())})
                    low = high


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, file_tokens: int = FILE_TOKENS, slice_tokens: int = SLICE_TOKENS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from files that were written from ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession)
    files = write_tokens(docs, tokenizer, scratch, id_col, text_col, file_tokens, slice_bytes)
    root = scratch.root
    listed = with_starts(files).select("path", "start").repartition(max(1, files.count()), "path")
    return listed.mapInArrow(lambda b: read_back(b, root, slice_tokens), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), tokenizer_path())
