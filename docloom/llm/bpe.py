"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Spark counts the pre-tokens of the whole corpus; the most frequent ones, at most
``lexicon_words``, are encoded once and compiled into an acyclic automaton whose
equal suffixes are shared.  Edges carry skips whose sum along a word is the
word's place among all words, which points to its ids.  The automaton is one
flat array of integers that Spark ships to the executors as a file and each task
memory-maps.  A task looks up the distinct words of a slice of texts together,
one byte of all of them at a time; words outside the lexicon are merged by rank,
exactly.  The lexicon changes the speed only, never a result.

Defined results: a null text is the empty text and has no tokens; a special
token's string in a text becomes its id, as the reference tokenizer does by
default; an empty table gives an empty table; repeated rows get equal rows.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from docloom.llm.shared import Scratch, most_frequent, slices, table

#: The pre-token rule of byte-level BPE vocabularies of this family; a fixed value.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEXICON_WORDS = 262_144
#: Longer words stay out of the lexicon and of workers' memories, so that both are bounded in bytes.
LONGEST = 64
#: Words of more bytes are merged with a heap.
LONG_WORD = 48
#: Entries of a worker's memory of words that the lexicon lacks.
MEMORY = 200_000
#: Characters that a task handles together; more share more words.
SLICE = 3_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next free one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) or spec["normalizer"]:
            raise ValueError("only plain special tokens and no normalizer are supported")
        ids = {spell(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        #: Pair of ids to rank; rank to the id that the pair becomes.
        self.ranks: dict[tuple[int, int], int] = {}
        self.joined: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = map(spell, merge if isinstance(merge, list) else merge.split(" "))
            self.ranks[ids[a], ids[b]] = rank
            self.joined.append(ids[a + b])
        self.special = special
        self.bytes_of = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in special.items()}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token: the pair of lowest rank is joined, the leftmost first, until none is left."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > LONG_WORD:
            return self.merge_long(ids)
        rank, none = self.ranks.get, len(self.joined)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            ids[k : k + 2] = [self.joined[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = rank((ids[k], ids[k + 1]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list, in n log n."""
        end = len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < end and (rank := self.ranks.get((ids[k], ids[after[k]]))) is not None:
                heapq.heappush(heap, (rank, k, ids[k], ids[after[k]]))

        for k in range(end):
            offer(k)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            if ids[k] != left or after[k] >= end or ids[after[k]] != right:
                continue
            gone = after[k]
            ids[k], ids[gone], after[k] = self.joined[rank], -1, after[gone]
            if after[k] < end:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [i for i in ids if i >= 0]


class Lexicon:
    """Read side of the transducer: a flat array of sections, memory-mapped."""

    def __init__(self, flat: np.ndarray):
        edges, states, words, total = (int(x) for x in flat[:4])
        cuts = np.cumsum([4, edges, edges, edges, states, words + 1, total])
        self.keys, self.next, self.skip, self.final, self.starts, self.ids = (flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    @staticmethod
    def compile(entries: dict[bytes, list[int]]) -> np.ndarray:
        """Words in order, each added at the end of the last one's path; finished suffixes are looked up among the states that exist."""
        words = sorted(w for w in entries if w)
        known: dict[tuple, int] = {}
        final: list[bool] = []
        out: list[list[tuple[int, int]]] = []
        open_states: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]

        def close(state: tuple[bool, list[tuple[int, int]]]) -> int:
            key = (state[0], tuple(state[1]))
            if key not in known:
                known[key] = len(final)
                final.append(state[0])
                out.append(state[1])
            return known[key]

        last = b""
        for word in [*words, b""]:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            for depth in range(len(last), same, -1):
                done = close(open_states.pop())
                open_states[-1][1].append((last[depth - 1], done))
            open_states += [(k == len(word) - 1, []) for k in range(same, len(word))]
            last = word
        close(open_states[0])
        # A state is closed after all states that it leads to, so the start is the last one.
        below = np.zeros(len(final), np.int64)
        keys, nexts, skips = [], [], []
        for s, edges in enumerate(out):
            passed = int(final[s])
            for byte, to in edges:
                keys.append(s * 256 + byte)
                nexts.append(to)
                skips.append(passed)
                passed += below[to]
            below[s] = passed
        ids = [entries[w] for w in words]
        starts = np.cumsum([0, *map(len, ids)])
        return np.concatenate([np.array([len(keys), len(final), len(words), starts[-1]]), keys, nexts, skips, final, starts, [i for x in ids for i in x]]).astype(np.int64)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the lexicon, or -1."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(lengths) - lengths
        place, state = np.zeros(len(words), np.int64), np.full(len(words), len(self.final) - 1)
        alive = np.flatnonzero(lengths)
        depth = 0
        while len(alive) and len(self.keys):
            key = state[alive] * 256 + text[at[alive] + depth]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            state[alive[~hit]] = -1
            alive, edge = alive[hit], edge[hit]
            place[alive] += self.skip[edge]
            state[alive] = self.next[edge]
            depth += 1
            alive = alive[lengths[alive] > depth]
        found = (lengths > 0) & (state >= 0) & (self.final[state] == 1) if len(self.keys) else np.zeros(len(words), bool)
        return np.where(found, place, -1)


class Coder:
    """Encoding and decoding of texts in a worker."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.pre_token = regex.compile(PRE_TOKEN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.known: list[tuple[str, bytes] | None] = [None] * (len(lexicon.starts) - 1)
        self.memory: dict[str, tuple[str, bytes]] = {}

    def words(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.pre_token.findall(text)
        parts = self.special.split(text)
        return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self.pre_token.findall(p))]

    def ids_of(self, word: str) -> list[int]:
        return [self.vocabulary.special[word]] if word in self.vocabulary.special else self.vocabulary.merge(word.encode())

    def form(self, ids: list[int]) -> tuple[str, bytes]:
        """Ids as decimal numbers joined by commas, and the bytes they stand for."""
        return ",".join(map(str, ids)), b"".join([self.vocabulary.bytes_of[i] for i in ids])

    def forms(self, words: list[str]) -> list[tuple[str, bytes]]:
        """The form of each word's ids, from the lexicon or else by merging; forms are made once in a worker."""
        special, known, memory = self.vocabulary.special, self.known, self.memory
        places = self.lexicon.find([b"" if w in special else w.encode() for w in words]).tolist()
        out = []
        for word, place in zip(words, places, strict=True):
            if place >= 0:
                if (got := known[place]) is None:
                    got = known[place] = self.form(self.lexicon.ids[self.lexicon.starts[place] : self.lexicon.starts[place + 1]].tolist())
            elif (got := memory.get(word)) is None:
                if len(memory) >= MEMORY:
                    memory.clear()
                got = self.form(self.ids_of(word))
                if len(word) <= LONGEST:
                    memory[word] = got
            out.append(got)
        return out

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(n_tokens, SHA-256 of the ids, SHA-256 of the decoded text) of each text."""
        split = [self.words(t) for t in texts]
        distinct = list(set().union(*split))
        forms = self.forms(distinct)
        written = dict(zip(distinct, [x for x, _ in forms], strict=True)).__getitem__
        spelled = dict(zip(distinct, [x for _, x in forms], strict=True)).__getitem__
        for words in split:
            row = ",".join(map(written, words))
            decoded = b"".join(map(spelled, words)).decode("utf-8", errors="replace")
            yield row.count(",") + bool(row), sha256(row.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        places = self.lexicon.find([b"" if w in self.vocabulary.special else w.encode() for w in words]).tolist()
        starts, ids = self.lexicon.starts, self.lexicon.ids
        return [i for w, p in zip(words, places, strict=True) for i in (ids[starts[p] : starts[p + 1]].tolist() if p >= 0 else self.ids_of(w))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.vocabulary.bytes_of[i] for i in ids).decode("utf-8", errors="replace")


def frequent_words(docs: DataFrame, text_col: str, lexicon_words: int, scratch: Scratch) -> list[str]:
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(PRE_TOKEN), F.lit(0))).alias("word"))
    counted = words.where(F.octet_length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    return [r.word for r in most_frequent(counted, lexicon_words, scratch).collect()]


def ship(spark: SparkSession, flat: np.ndarray) -> str:
    """The array as a file beside every executor; its name for SparkFiles."""
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    path = os.path.join(tempfile.mkdtemp(), name)
    np.save(path, flat)
    spark.sparkContext.addFile(path)
    return name


def prepared(docs: DataFrame, text_col: str, tokenizer_file: str, lexicon_words: int, scratch: Scratch) -> Callable[[], Coder]:
    """Compiles and ships the lexicon; gives what makes a coder inside a task."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(tokenizer_file)
    entries = {w.encode(): vocabulary.merge(w.encode()) for w in frequent_words(docs, text_col, lexicon_words, scratch) if w not in vocabulary.special}
    name, shared = ship(spark, Lexicon.compile(entries)), spark.sparkContext.broadcast(vocabulary)
    return lambda: Coder(shared.value, Lexicon(np.load(SparkFiles.get(name), mmap_mode="r")))


def bpe_digests(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of ``docs``."""
    coder = prepared(docs, text_col, tokenizer_file, lexicon_words, scratch or Scratch(docs.sparkSession))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        for batch in batches:
            for start, texts in slices(batch, "body", SLICE):
                columns = zip(*own.digests(texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), *map(pa.array, columns)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, tokenizer_file: str, text_col: str = "text", ids_col: str = "ids", lexicon_words: int = LEXICON_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` as (doc struct, ids array<int>)."""
    coder = prepared(docs, text_col, tokenizer_file, lexicon_words, scratch or Scratch(docs.sparkSession))
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        for batch in batches:
            for start, texts in slices(batch, "body", SLICE):
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(start, len(texts)), pa.array([own.encode(t) for t in texts], pa.list_(pa.int32()))], names=["doc", ids_col])

    return packed.mapInArrow(run, StructType([StructField("doc", packed.schema["doc"].dataType), StructField(ids_col, ArrayType(IntegerType()))]))


def bpe_decode(encoded: DataFrame, tokenizer_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_file).bytes_of)

    @F.pandas_udf("string")
    def decode(ids):
        spelled = shared.value
        return ids.map(lambda x: None if x is None else b"".join(spelled[i] for i in x).decode("utf-8", errors="replace"))

    return encoded.withColumn(out_col, decode(ids_col))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path())
