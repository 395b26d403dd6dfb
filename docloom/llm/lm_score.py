"""Language-model scores: a smoothed unigram base and a causal self-attention model.

Counts: Spark counts the lower-cased words of all training rows.  The most
frequent ones, at most ``frequent_words``, are broadcast; all rarer words of the
texts meet their counts in a shuffle join, so every count is exact and no word
that is hot reaches the shuffle.

Model: words become subword ids of a public byte-level vocabulary, the longest
piece first.  The most frequent subwords are classes of their own, the others
share a few classes by frequency, those that begin words apart from those inside.
The attention model predicts the class, on top of what counts over all training
rows say of the class after the last subword; a subword's share of its class comes
from counts of the subword after the one before it in the word.  Every pair counts:
the most frequent ones, at most ``kept_pairs``, are broadcast, and those of the
texts beyond them meet their counts in a shuffle join.  Training goes in rounds: each
task passes once over the windows of its share of the training documents (one in
``rounds`` a round, other ones each round, so the rounds together read every
training document once), and Spark averages the weights, by windows, parameter by
parameter; a subword's embedding by how often the subword was an input.

Scoring: a text is one sequence with an end; overlapping windows cover it, and
each token is scored once, in batches of masked attention.

Defined results: a null text is empty and has one token, the end; rows with a
null id teach nothing and are not held out; without training rows c, N and V are
0 (the base is that of an unseen token) and the model is uniform over classes; an
empty table gives an empty table; repeated rows get equal rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import attention
from docloom.llm.bpe import Vocabulary, tokenizer_path
from docloom.llm.shared import LOWER, LOWER_BYTES, UPPER, Scratch, fold, most_frequent, slices, table

FOLDS, FREQUENT_WORDS = 10, 200_000
OWN_CLASSES, SHARED_CLASSES = 88, 4
KEPT_PAIRS, PAIRS_AT_ONCE, BATCHES_AT_ONCE = 200_000, 200_000, 16
ROUNDS, RATE, SEED = 3, 0.01, 9
ADD = 0.1
#: Bytes of the longest word that is broadcast.
LONGEST = 64
#: Bytes of a word that are cut together.
STRETCH = 64
#: White space other than the space, as words are split.
BLANKS = "\t\n\x0b\x0c\r"
#: Bytes that words are made of.
SOLID = ~np.isin(np.arange(256), list(b" " + BLANKS.encode()))
#: Characters that a task reads together; more share more words.
SLICE = 2_000_000
#: Words that a worker remembers, and an eighth of their pieces; speed only.
REMEMBERED = 400_000


def word_counts(train: DataFrame, text_col: str) -> DataFrame:
    plain = F.translate(F.col(text_col), UPPER + BLANKS, LOWER + " " * len(BLANKS))
    words = train.select(F.explode(F.split(plain, " ")).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


class Numbers:
    """A hash table from non-negative numbers to their places in ``keys``, for whole arrays at a time.

    Only the keys travel; the table is built again where it arrives.
    """

    def __init__(self, keys: np.ndarray):
        self.own = keys
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.places = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        open_ones, at = np.arange(len(keys)), self.seat(keys)
        while len(open_ones):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[open_ones[free]]
            placed = self.keys[at] == keys[open_ones]
            self.places[at[placed]] = open_ones[placed]
            open_ones, at = open_ones[~placed], (at[~placed] + 1) & self.last

    def __reduce__(self):
        return Numbers, (self.own,)

    def seat(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those that are not there."""
        at = self.seat(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.places[at], -1)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.last
            there = self.keys[at[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.places[at[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out


class Pieces:
    """Subword ids by the longest piece of the vocabulary that fits, from left to right; pieces do not cross a border after each STRETCH bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.top = max(vocabulary.bytes_of) + 1
        self.end = next(iter(vocabulary.special.values()), 0)
        #: A tree of the pieces: (state, byte) to state, and the id of a state that is a piece.
        step: dict[int, int] = {}
        found: list[int] = [-1]
        for i, piece in vocabulary.bytes_of.items():
            if i not in vocabulary.special.values():
                state = 0
                for b in piece:
                    key = state << 8 | b
                    if (state := step.get(key, 0)) == 0:
                        state = step[key] = len(found)
                        found.append(-1)
                found[state] = i
        # Keys in the order of their states, so that a key's place tells the state.
        self.step, self.found = Numbers(np.fromiter(step, np.int64, len(step))), np.array(found, np.int32)

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many pieces each word has, and the pieces of all; all stretches of words take a step at a time."""
        text = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        many = -(-lengths // STRETCH)
        word = np.repeat(np.arange(len(words)), many)
        at = np.repeat(np.cumsum(lengths) - lengths, many) + STRETCH * (np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many))
        stop, owner = np.minimum(at + STRETCH, np.cumsum(lengths)[word]), np.arange(len(word))
        state, best, best_end = np.zeros(len(word), np.int64), np.zeros(len(word), np.int32), at.copy()
        owners, pieces = [], []
        while len(at):
            after = np.where(at < stop, self.step.find(state << 8 | text[at]) + 1, 0)
            on = after > 0
            state, at = after, at + on
            piece = self.found[after]
            best, best_end = np.where(piece >= 0, piece, best), np.where(piece >= 0, at, best_end)
            if not on.all():
                owners.append(owner[~on])
                pieces.append(best[~on])
                at = np.where(on, at, best_end)
                if not (more := on | (at < stop)).all():
                    at, stop, owner, state, best, best_end = (x[more] for x in (at, stop, owner, state, best, best_end))
        if not owners:
            return np.zeros(len(words), np.int64), np.zeros(0, np.int32)
        owner = np.concatenate(owners)
        return np.bincount(word[owner], minlength=len(words)), np.concatenate(pieces)[np.argsort(owner, kind="stable")]


def pair_counts(counts: DataFrame, pieces: Pieces) -> DataFrame:
    """(before, id, n): how often a subword stands after another in the words of the training rows.

    Before a word's first subword stands -1; after its last one comes -1.
    """
    shared = counts.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = shared.value, []

        def told() -> pa.RecordBatch:
            pairs, n = (np.concatenate([h[k] for h in held] or [np.zeros(0, np.int64)]) for k in (0, 1))
            pairs, which = np.unique(pairs, return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, which, n)
            held[:] = [(pairs, total)]
            return pa.RecordBatch.from_arrays([pa.array((pairs >> 32) - 1), pa.array((pairs & 0xFFFFFFFF) - 1), pa.array(total)], names=["before", "id", "n"])

        for batch in batches:
            sizes, ids = own.cut([w.encode() for w in batch.column("word").to_pylist()])
            n = batch.column("n").to_numpy()
            ends = np.cumsum(sizes)
            before, after = np.insert(ids.astype(np.int64) + 1, ends - sizes, 0), np.insert(ids.astype(np.int64) + 1, ends, 0)
            held.append((before << 32 | after, np.repeat(n, sizes + 1)))
            if len(held) > BATCHES_AT_ONCE:
                out = told()
                if len(out) > PAIRS_AT_ONCE:
                    held.clear()
                    yield out
        yield told()

    return counts.mapInArrow(run, "before long, id long, n long").groupBy("before", "id").agg(F.sum("n").alias("n"))


class Classes:
    """What counts say of subwords: their classes, the classes that follow each, and the shares of a class.

    All arrays are over the ids of the vocabulary; ``counts`` are of all subwords, ``first`` of words' first ones.
    """

    def __init__(self, counts: np.ndarray, first: np.ndarray, end: int):
        self.end, self.n = end, OWN_CLASSES + 2 * SHARED_CLASSES
        order = np.concatenate([[end], [i for i in np.argsort(-counts, kind="stable") if i != end]]).astype(np.int64)
        self.of = np.zeros(len(counts), np.int16)
        self.of[order[:OWN_CLASSES]] = np.arange(min(OWN_CLASSES, len(order)))
        for k, rest in enumerate((order[OWN_CLASSES:][first[order[OWN_CLASSES:]] > 0], order[OWN_CLASSES:][first[order[OWN_CLASSES:]] == 0])):
            if len(rest):
                mass = np.cumsum(counts[rest] + ADD)
                self.of[rest] = OWN_CLASSES + k * SHARED_CLASSES + np.minimum(SHARED_CLASSES - 1, mass * SHARED_CLASSES / mass[-1]).astype(np.int16)
        smooth = counts + ADD
        self.log_share = np.log(smooth / np.bincount(self.of, smooth, minlength=self.n)[self.of])
        self.all_mass = np.bincount(self.of, smooth, minlength=self.n) / smooth.sum()
        begins = np.bincount(self.of, first, minlength=self.n) + ADD * self.all_mass
        self.begin_mass = begins / begins.sum()

    def learn(self, followed: np.ndarray, last: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], known: np.ndarray | None = None) -> None:
        """followed: (ids, classes) counts inside words; last: counts of words' last subwords; pairs: before, id and count of those held here.

        known: what of ``followed`` is known one by one, here or elsewhere; without it, the pairs held here.
        """
        before, after, n = pairs
        if known is None:
            known = np.zeros_like(followed)
            np.add.at(known, (before, self.of[after]), n)
        cells = np.flatnonzero(followed)
        self.cells, self.times, self.left_over, self.last = cells.astype(np.int32), followed.ravel()[cells], (followed - known).ravel()[cells], last
        self.derive()
        cell = before, self.of[after]
        self.known_share = np.log((n + np.exp(self.log_left[cell] + self.log_share[after]) * (followed[cell] + 1)) / (followed[cell] + 1))
        self.known = Numbers(before << 32 | after)

    def derive(self) -> None:
        """The dense tables from the cells that have counts."""
        followed, left = np.zeros((len(self.of), self.n)), np.ones((len(self.of), self.n))
        followed.ravel()[self.cells] = self.times
        left.ravel()[self.cells] += self.left_over
        self.direct = attention.direct_rows(np.maximum(followed + self.last[:, None] * self.begin_mass + self.all_mass, 1e-9))
        self.log_left = np.log(left / (followed + 1)).astype(np.float32)

    def __getstate__(self) -> dict:
        """Without the dense tables, which are large and quickly derived."""
        return {k: v for k, v in vars(self).items() if k not in ("direct", "log_left")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self.derive()

    def shares_and_held(self, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logs of the shares of ids after others in a word, those of pairs not held here as if they had not occurred; and which are held."""
        place = self.known.find(before.astype(np.int64) << 32 | ids)
        out = self.log_left[before, self.of[ids]] + self.log_share[ids]
        out[place >= 0] = self.known_share[place[place >= 0]]
        return out, place >= 0

    def shares(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.shares_and_held(before, ids)[0]


def learned_classes(counts: DataFrame, ends: int, pieces: Pieces, kept_pairs: int, scratch: Scratch) -> tuple[Classes, DataFrame]:
    """The classes, and (pair, plus): what each pair's count adds to the log10 of its share.

    At most a row for each id, for each id and class, and ``kept_pairs`` reach the driver.
    """
    pairs = scratch.table(pair_counts(counts, pieces), "subword-pairs")

    def summed(rows: DataFrame, *keys: str) -> list[np.ndarray]:
        got = rows.groupBy(*keys).agg(F.sum("n").alias("n")).toArrow()
        return [got.column(k).to_numpy().astype(np.int64) for k in (*keys, "n")]

    total, first, last = np.zeros(pieces.top), np.zeros(pieces.top), np.zeros(pieces.top)
    for out, rows, key in ((total, pairs.where("id >= 0"), "id"), (first, pairs.where("before < 0"), "id"), (last, pairs.where("id < 0"), "before")):
        at, n = summed(rows, key)
        out[at] = n
    for out in (total, first, last):
        out[pieces.end] += ends
    out = Classes(total, first, pieces.end)
    inside = pairs.where("before >= 0 and id >= 0")
    named = pairs.sparkSession.createDataFrame(pa.table({"id": np.arange(pieces.top), "class": out.of.astype(np.int64), "share": np.exp(out.log_share)}))
    before, kind, n = summed(inside.join(F.broadcast(named), "id"), "before", "class")
    followed = np.zeros((pieces.top, out.n))
    followed[before, kind] = n
    frequent = most_frequent(inside, kept_pairs, scratch).toArrow()
    out.learn(followed, last, tuple(frequent.column(k).to_numpy().astype(np.int64) for k in ("before", "id", "n")), followed)
    pair = F.shiftleft("before", 32).bitwiseOR(F.col("id"))
    return out, inside.join(F.broadcast(named), "id").select(pair.alias("pair"), (F.log1p(F.col("n") / F.col("share")) / math.log(10)).alias("plus"))


def words_of(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """How many words each text has, the distinct lower-cased words, and the place among these of each word."""
    folded = [t.encode().translate(LOWER_BYTES) for t in texts]
    text = np.frombuffer(b" " + b" ".join(folded) + b" ", np.uint8)
    solid = SOLID[text]
    starts, ends = (np.flatnonzero(x) + 1 for x in (solid[1:] & ~solid[:-1], solid[:-1] & ~solid[1:]))
    lengths = np.diff(np.searchsorted(starts, np.cumsum([1] + [len(t) + 1 for t in folded])))
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text[solid])]).dictionary_encode()
    return lengths, words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()


class Reader:
    """Texts to words, class ids and base scores, in a worker.

    Words are cut once while they are remembered; they are forgotten together, between two readings, when they are many or long.
    """

    def __init__(self, pieces: Pieces, classes: Classes, frequent: list[tuple[str, int]], tokens: int, distinct: int, ends: int, scoring: bool = True):
        self.pieces, self.classes, self.scoring = pieces, classes, scoring
        logs = np.log10((np.array([n for _, n in frequent], float) + ADD) / (tokens + ADD * (distinct + 1)))
        self.base_of = dict(zip((w.encode() for w, _ in frequent), logs.tolist(), strict=True))
        self.end_base = float(np.log10((ends + ADD) / (tokens + ADD * (distinct + 1))))
        self.end_known = int(ends > 0)
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.words: list[bytes] = []
        #: By word: how many pieces, the log share of those after its first class, base score, how many pairs are counted elsewhere.
        self.sizes, self.share, self.base, self.n_pairs = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        self.stored, self.pairs = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Cuts words that are not remembered, and scores what does not hang on their neighbours."""
        self.number.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))
        self.words += words
        sizes, stored = self.pieces.cut(words)
        self.sizes, self.stored = np.concatenate([self.sizes, sizes]), np.concatenate([self.stored, stored])
        if not self.scoring:
            return
        share = self.classes.log_share[stored]
        later = np.ones(len(stored), bool)
        later[np.cumsum(sizes) - sizes] = False
        later = np.flatnonzero(later)
        share[later], held = self.classes.shares_and_held(stored[later - 1], stored[later])
        word_of = np.repeat(np.arange(len(sizes)), sizes)
        later = later[~held]
        self.share = np.concatenate([self.share, np.bincount(word_of, share, minlength=len(sizes))])
        self.base = np.concatenate([self.base, np.array([self.base_of.get(w, np.nan) for w in words])])
        self.pairs = np.concatenate([self.pairs, stored[later - 1].astype(np.int64) << 32 | stored[later]])
        self.n_pairs = np.concatenate([self.n_pairs, np.bincount(word_of[later], minlength=len(sizes))])

    def sequences(self, texts: list[str]) -> dict:
        """One sequence of subword ids with a start and an end for each text; for scoring also its words, and the pairs whose counts are elsewhere."""
        lengths, distinct, ids = words_of(texts)
        if len(self.words) > REMEMBERED or len(self.stored) > 8 * REMEMBERED:
            self.forget()
        number = np.array([self.number.get(w, -1) for w in distinct], np.int64)
        if len(fresh := np.flatnonzero(number < 0)):
            number[fresh] = len(self.words) + np.arange(len(fresh))
            self.learn([distinct[i] for i in fresh])
        ids = number[ids]
        owner = np.repeat(np.arange(len(texts)), lengths)
        first = np.cumsum(self.sizes) - self.sizes
        many = self.sizes[ids]
        per_text = np.bincount(owner, many, minlength=len(texts)).astype(np.int64)
        # Each text: a start, its pieces, an end.
        starts = np.cumsum(per_text + 2) - (per_text + 2)
        sequence = np.full(int((per_text + 2).sum()), self.classes.end, np.int32)
        piece = np.arange(int(many.sum()))
        # From a piece's place among all to its seat, and to where its word is stored.
        begin = np.cumsum(many) - many
        sequence[piece + np.repeat(2 * owner + 1, many)] = self.stored[piece + np.repeat(first[ids] - begin, many)]
        out = {"sequence": sequence, "starts": starts, "inputs": per_text + 1}
        if not self.scoring:
            return out
        inside = np.bincount(owner, self.share[ids], minlength=len(texts))
        times = self.n_pairs[ids]
        pairs = self.pairs[np.arange(int(times.sum())) + np.repeat((np.cumsum(self.n_pairs) - self.n_pairs)[ids] - (np.cumsum(times) - times), times)]
        n_pairs = np.bincount(owner, times, minlength=len(texts)).astype(np.int64)
        return out | {"words": self.words, "ids": ids, "owner": owner, "lengths": lengths, "inside": inside, "base": self.base, "pairs": pairs, "n_pairs": n_pairs}


def training_part(train: DataFrame, id_col: str, k: int, one_in: int) -> DataFrame:
    """The documents of round ``k``: as many rounds as ``one_in`` read all."""
    return train.where(F.pmod(F.xxhash64(id_col), F.lit(one_in)) == k % one_in)


def train_model(train: DataFrame, id_col: str, text_col: str, reader, n_inputs: int, n_classes: int, rounds: int, one_in: int) -> attention.Params:
    """Rounds of local training and averaging.  Weights travel in rows of ``WIDTH``, of the embeddings those that a task has moved."""
    sc, d = train.sparkSession.sparkContext, attention.WIDTH
    params = attention.start(n_inputs, n_classes, SEED)
    for k in range(rounds):
        shared = sc.broadcast(attention.flat(params))
        part = training_part(train, id_col, k, one_in).select(F.col(text_col).alias("body"))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = reader()
            known, p, seen, rng = own.classes, attention.unflat(shared.value, n_inputs, n_classes), 0, np.random.default_rng(SEED)
            used = np.zeros(n_inputs, np.int64)
            for batch in batches:
                for _, texts in slices(batch, "body", SLICE):
                    s = own.sequences(texts)
                    at, of = attention.windows(s["starts"], s["inputs"], attention.CONTEXT)
                    order = rng.permutation(len(at))
                    at, of = at[order], of[order]
                    padded = np.concatenate([s["sequence"], np.zeros(attention.CONTEXT + 1, np.int32)])
                    place = at[:, None] + np.arange(attention.CONTEXT)
                    inside = (place < (s["starts"] + s["inputs"])[of][:, None]).astype(np.float32)
                    x = padded[place]
                    p = attention.train(p, known.direct, x, known.of[padded[place + 1]], inside, RATE / (1 + k))
                    seen += len(at)
                    used += np.bincount(x.ravel(), inside.ravel(), n_inputs).astype(np.int64)
            if seen:
                values = attention.flat(p)
                values = np.pad(values, (0, -len(values) % d)).reshape(-1, d).astype(float)
                weight = np.concatenate([used, np.full(len(values) - n_inputs, seen)])
                moved = np.flatnonzero(weight)
                columns = [pa.array(moved), pa.array(weight[moved]), *(pa.array(values[moved, j] * weight[moved]) for j in range(d))]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "weight", *(f"v{j}" for j in range(d))])

        sums = part.mapInArrow(run, "place long, weight long, " + ", ".join(f"v{j} double" for j in range(d))).groupBy("place")
        means = sums.agg(*((F.sum(f"v{j}") / F.sum("weight")).alias(f"v{j}") for j in range(d))).toArrow()
        if len(means):
            values = attention.flat(params)
            size = len(values)
            values = np.pad(values, (0, -size % d)).reshape(-1, d)
            values[means.column("place").to_numpy()] = np.stack([means.column(f"v{j}").to_numpy() for j in range(d)], 1)
            params = attention.unflat(values.ravel()[:size], n_inputs, n_classes)
    return params


def lm_score(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", frequent_words: int = FREQUENT_WORDS, kept_pairs: int = KEPT_PAIRS, rounds: int = ROUNDS, train_one_in: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    ``train_one_in``: a round reads one training document in so many; by default one in ``rounds``, so all are read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    part = fold(F.col(id_col), FOLDS)
    train = docs.where(part > 0)
    counts = scratch.table(word_counts(train, text_col), "word-counts")
    ends = train.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = sums.n + ends, sums.v + (ends > 0)
    pieces = Pieces(Vocabulary(tokenizer_file))
    classes, pairs = learned_classes(counts, ends, pieces, kept_pairs, scratch)
    frequent = [(r.word, r.n) for r in most_frequent(counts.where(F.octet_length("word") <= LONGEST), frequent_words, scratch).collect()]
    shared, common = spark.sparkContext.broadcast((pieces, classes)), spark.sparkContext.broadcast(frequent)
    trained = train_model(train, id_col, text_col, lambda: Reader(*shared.value, [], tokens, distinct, ends, scoring=False), pieces.top, classes.n, rounds, train_one_in or rounds)
    params = spark.sparkContext.broadcast(attention.flat(trained))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value, common.value, tokens, distinct, ends)
        known_of = reader.classes
        scorer = attention.Scorer(attention.unflat(params.value, reader.pieces.top, known_of.n), known_of.direct)
        for batch in batches:
            for start, texts in slices(batch, "body", SLICE):
                own, s = batch.slice(start, len(texts)), reader.sequences(texts)
                known = ~np.isnan(s["base"])[s["ids"]] if len(s["ids"]) else np.zeros(0, bool)
                count = lambda pick, weights=None, s=s: np.bincount(s["owner"][pick], weights, minlength=len(s["lengths"]))
                base = count(known, s["base"][s["ids"][known]]) if known.any() else np.zeros(len(texts))
                rare = [s["words"][i] for i in s["ids"][~known]]
                ends_at = np.concatenate([[0], np.cumsum(count(~known))]).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(ends_at), pa.array(rare, pa.binary()).cast(pa.string()))
                ends_at = np.concatenate([[0], np.cumsum(s["n_pairs"])]).astype(np.int32)
                pairs_left = pa.ListArray.from_arrays(pa.array(ends_at), pa.array(s["pairs"]))
                logs = scorer.totals(s["sequence"], known_of.of[s["sequence"]], s["starts"], s["inputs"]) + s["inside"] + known_of.log_share[known_of.end]
                columns = [own.column("row"), own.column("doc_id"), own.column("held_out"), pa.array(s["lengths"] + 1), pa.array(count(known).astype(np.int64) + reader.end_known), pa.array(base + reader.end_base), pa.array(logs / np.log(10)), rest, pairs_left]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rest", "pairs"])

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), (part == 0).alias("held_out"), F.col(text_col).alias("body"))
    schema = f"row long, doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, known long, base double, score double, rest array<string>, pairs array<long>"
    scored = scratch.table(slim.mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode("rest").alias("word")).join(counts, "word", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + ADD) / F.lit(tokens + ADD * (distinct + 1)))
    added = rare.groupBy("row").agg(F.count("n").alias("more"), F.sum(log).alias("plus"))
    known_pairs = scored.select("row", F.explode("pairs").alias("pair")).join(pairs, "pair").groupBy("row").agg(F.sum("plus").alias("told"))
    score = F.col("score") + F.coalesce("told", F.lit(0.0))
    return scored.join(added, "row", "left").join(known_pairs, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("plus", F.lit(0.0))).alias("base_score"), score.alias("score"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"), tokenizer_path())
