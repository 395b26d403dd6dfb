"""Toxicity with a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel counts common subsequences of three letters of two strings, each
weighted by a decay to the power of its spans, so gaps and inserted characters
cost a little and do not break a match.  Before that a word is folded: lower
case, no marks, digits and signs that stand for letters replaced; runs of single
letters are read as one word.

Landmarks are strings from the labelled sample that go with toxic documents (by
G-test), no two near each other.  A word's feature for a landmark is the kernel's
value as a share of the landmark's own, less a fixed part that chance explains;
it is 0 by definition if the word lacks more letters of the landmark than one in
seven.  A sentence's features are the highest over its words, multiplied by the
inverse root of the landmarks' own table of features (made symmetric), as in a
Nyström map, of features that are cut off below.  A linear
support vector machine is trained on labelled sentences: those with a feature bear
their document's label, and a clean document or one without features adds a
sentence without any; documents weigh alike within a class.  A document's score
is that of its highest sentence, calibrated to a probability.
Each distinct word's features are worked out once.

The sample has at most ``per_class`` labelled documents of either class (a
documented bound; they are chosen by a hash of the id, and of rows with the same
id the text with the least hash is taken).  There are at most ``landmarks``
landmarks, the strongest ones; each needs ``SUPPORT`` documents and ``EVIDENCE``.
Landmarks are beginnings of words or of pieces of long ones, of five to ten
characters with the sign that stands before a word; words of up to four letters
count whole, with the sign after them too.

Defined results: null and empty texts have no words and get the score of a
sentence without features; rows with a null id are not held out and teach
nothing; without labels of both classes the score is the share of toxic labels
(0 without any); an empty table gives an empty table; repeated rows get equal
rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import fold, slices, table

FOLDS, PER_CLASS, LANDMARKS = 5, 1500, 128
ORDER, DECAY = 3, 0.6
#: Nats of evidence that a landmark needs; among a million strings chance gives about six at this level.
EVIDENCE = 12
#: Toxic documents of the sample, near copies left out, that a landmark must stand in.
SUPPORT = 5
#: Shares of a landmark's own kernel value up to this one count as nothing.
LEAST = 0.5
SHORTEST, LONGEST, WHOLE = 5, 10, 4
PAIRS_AT_ONCE = 20_000
#: Entries of a worker's memory of words' features.
MEMORY = 300_000
#: Of the hashes that find copies in the sample.
PRIME, FACTORS = 4294967291, (2654435761, 2246822519, 3266489917, 668265263, 374761393)
#: Longer words are read in overlapping pieces of this length; the highest weight counts.
PIECE = 40
#: Signs that stand for letters, and marks that are left out.
SIGNS = str.maketrans("0134579@$!|", "oieastgasii", "\"#%&'()*+,-./:;<=>?[\\]^_`{}~268")
#: Stands before a folded word, so that a match at a word's beginning counts for more.
START = "~"
SINGLE = re.compile(r"(?<!\S)\w(?: \w){2,}(?!\S)")


def folded(word: str) -> str:
    word = word.lower().rstrip("!?.,;:|").translate(SIGNS)
    return f"{START}{word}{START * (len(word) <= WHOLE)}" if word else ""


def pieces_of(word: str) -> list[str]:
    """A folded word, or the overlapping pieces of a long one."""
    return [word] if len(word) <= PIECE else [word[a : a + PIECE] for a in range(0, len(word) - PIECE // 2, PIECE // 2)]


def codes(words: list[str], fill: int) -> np.ndarray:
    """Code points of words, padded on the right with ``fill``."""
    width = max(map(len, words), default=0)
    out = np.full((len(words), max(1, width)), fill, np.int32)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.int32)
    return out


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The gap-weighted subsequence kernel of the rows of s with the rows of t (padded with -1 and -2)."""
    width = t.shape[1]
    step = np.arange(width)
    reach = np.where(step[:, None] <= step, DECAY ** (step - step[:, None]).clip(0), 0).astype(np.float32)
    partial = [np.zeros(t.shape, np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(len(t), np.float32)
    square = np.float32(DECAY**2)
    shifted = np.zeros(t.shape, np.float32)
    for x in s.T:
        match = (t == x[:, None]) * square
        shifted[:, 1:] = partial[-1][:, :-1]
        total += (shifted * match).sum(1)
        for i in range(ORDER - 2, 0, -1):
            shifted[:, 1:] = partial[i - 1][:, :-1]
            partial[i] = np.float32(DECAY) * partial[i] + (shifted * match) @ reach
        partial[0] = np.float32(DECAY) * partial[0] + match @ reach
    return total


def letter_masks(words: list[str]) -> np.ndarray:
    c = codes(words, -1)
    bit = np.where(c >= 0, np.uint64(1) << ((c - 97) % 61).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bit, axis=1)


class Landmarks:
    def __init__(self, words: list[str]):
        self.words = words
        self.codes = codes(words, -2)
        self.own = np.maximum(kernel(np.where(self.codes == -2, -1, self.codes), self.codes), 1e-9) if words else np.zeros(0)
        self.masks = letter_masks(words) if words else np.zeros(0, np.uint64)
        letters = np.bitwise_count(self.masks).astype(int)
        self.need = letters - (letters >= 7)

    def features(self, words: list[str]) -> np.ndarray:
        """(words, landmarks) kernel values against each landmark's own, at most 1."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        if not words or not self.words:
            return out
        by_length = np.argsort([len(w) for w in words], kind="stable")
        masks = letter_masks([words[k] for k in by_length])
        for a in range(0, len(words), 4096):
            rows = by_length[a : a + 4096]
            i, j = np.nonzero(np.bitwise_count(masks[a : a + 4096, None] & self.masks) >= self.need)
            c = codes([words[k] for k in rows], -1)
            for b in range(0, len(i), PAIRS_AT_ONCE):
                p, q = i[b : b + PAIRS_AT_ONCE], j[b : b + PAIRS_AT_ONCE]
                share = kernel(c[p], self.codes[q]) / self.own[q]
                out[rows[p], q] = np.clip((share - LEAST) / (1 - LEAST), 0, 1)
        return out


def sentences(text: str) -> list[list[str]]:
    """Folded words of each sentence; a sentence ends with a line or a word that ends in a full stop, ! or ?."""
    out: list[list[str]] = [[]]
    for word in SINGLE.sub(lambda m: m.group().replace(" ", ""), text).replace("\n", " . ").split():
        if short := folded(word):
            out[-1].append(short)
        if word[-1] in ".!?":
            out.append([])
    return [s for s in out if s]


def without_copies(docs: list[list[list[str]]]) -> list[int]:
    """Documents of the sample less near copies of earlier ones: four of five least hashes of word triples agree."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for k, sents in enumerate(docs):
        words = [w for s in sents for w in s]
        hashes = [crc32(" ".join(x).encode()) for x in zip(words, words[1:], words[2:], strict=False)]
        least = [min((h * f % PRIME for h in hashes), default=-k - 1) for f in FACTORS]
        fours = {(i, hash((*least[:i], *least[i + 1 :]))) for i in range(len(least))}
        if not fours & seen:
            kept.append(k)
        seen |= fours
    return kept


def choose_landmarks(docs: list[list[list[str]]], toxic: np.ndarray, limit: int) -> list[str]:
    """Word beginnings by how strongly they go with toxic documents, less those too near to stronger ones."""
    count = {0: Counter(), 1: Counter()}
    for sents, y in zip(docs, toxic, strict=True):
        words = {p for s in sents for w in s for p in pieces_of(w) if len(p) >= SHORTEST}
        count[int(y)].update({w if w.endswith(START) else w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)})
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    ranked = []
    for s, a in count[1].items():
        b = count[0][s]
        if a >= SUPPORT and a * n0 > 6 * (b + 0.5) * n1:
            share = (a + b) / (n1 + n0)
            g = a * np.log(a / (n1 * share)) + (b * np.log(b / (n0 * share)) if b else 0)
            if g >= EVIDENCE:
                ranked.append((-round(g, 6), -len(s), s))
    chosen: list[int] = []
    ranked = [s for _, _, s in sorted(ranked)][: 20 * limit]
    near = Landmarks(ranked).features(ranked)
    for k in range(len(ranked)):
        if len(chosen) < limit and all(near[k, c] < 0.5 and near[c, k] < 0.5 for c in chosen):
            chosen.append(k)
    return [ranked[k] for k in chosen]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, rounds: int = 20) -> np.ndarray:
    """Weights (the last one is the intercept) of a linear machine with squared hinge loss, by Newton steps; y is -1 or 1."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        on = y * (x @ w) < 1
        a = x[on] * (cost * weight[on, None])
        new = np.linalg.solve(ridge + a.T @ x[on], a.T @ y[on])
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w


class Model:
    """Landmarks, their weights, the intercept and the calibration."""

    def __init__(self, landmarks: Landmarks, beta: np.ndarray, bias: float, slope: float, shift: float):
        self.landmarks, self.beta, self.bias, self.slope, self.shift = landmarks, beta, bias, slope, shift
        self.memory: dict[str, np.ndarray | None] = {}

    def pieces(self, words: list[str]) -> np.ndarray:
        """Features of folded words; of a long one the highest over its pieces."""
        if all(len(w) <= PIECE for w in words):
            return self.landmarks.features(words)
        cut = [(k, p) for k, w in enumerate(words) for p in pieces_of(w)]
        out = np.zeros((len(words), len(self.landmarks.words)), np.float32)
        np.maximum.at(out, [k for k, _ in cut], self.landmarks.features([p for _, p in cut]))
        return out

    def features(self, words: list[str]) -> list[np.ndarray | None]:
        """Features of folded words, None where there are none."""
        memory = self.memory
        if len(memory) > MEMORY:
            memory.clear()
        new = [w for w in set(words) if w not in memory]
        values = self.pieces(new)
        memory.update((w, values[k].copy() if hit else None) for k, (w, hit) in enumerate(zip(new, values.any(1).tolist(), strict=True)))
        return [memory[w] for w in words]

    def score(self, texts: list[str]) -> np.ndarray:
        number: dict[str, int] = {}
        ids, lengths = [], []
        for text in texts:
            words = SINGLE.sub(lambda m: m.group().replace(" ", ""), text).replace("\n", " . ").split()
            ids += [number.setdefault(w, len(number)) for w in words]
            ids.append(number.setdefault(".", len(number)))
            lengths.append(len(words) + 1)
        raw = list(number)
        found = self.features([folded(w) for w in raw])
        ids = np.array(ids, np.int64)
        ends = np.array([w[-1] in ".!?" for w in raw], bool)[ids]
        sentence = np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int64)
        best = np.full(len(texts), self.bias)
        at = np.flatnonzero(np.array([v is not None for v in found], bool)[ids])
        if len(at):
            named, place = np.unique(sentence[at], return_inverse=True)
            highest = np.zeros((len(named), len(self.landmarks.words)), np.float32)
            np.maximum.at(highest, place, np.array([found[k] for k in ids[at]]))
            doc = np.searchsorted(sentence[np.cumsum(lengths) - lengths], named, "right") - 1
            np.maximum.at(best, doc, highest @ self.beta + self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -50, 50)))


def calibrated(s: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve of the score.

    The slope has the highest likelihood; one half lies at the cut with the fewest
    errors for the share of toxic documents.
    """
    y = np.where(toxic > 0, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((1 - toxic).sum() + 2))
    x = np.stack([s, np.ones(len(s))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w += np.clip(np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-4 * np.eye(2), x.T @ (y - p) - 1e-4 * w), -2, 2)
    levels = np.unique(s)
    cuts = np.concatenate([(levels[1:] + levels[:-1]) / 2, levels[-1:] + 1])
    caught = 1 - np.searchsorted(np.sort(s[toxic > 0]), cuts) / toxic.sum()
    blamed = 1 - np.searchsorted(np.sort(s[toxic == 0]), cuts) / (1 - toxic).sum()
    slope = max(float(w[0]), 1e-3)
    return slope, -slope * float(cuts[np.argmax(share * caught - (1 - share) * blamed)])


def fit(texts: list[str], toxic: np.ndarray, share: float, landmarks: int = LANDMARKS) -> Model:
    """The model from a labelled sample; ``share``: of toxic among all labels that may be learned from."""
    docs = [sentences(t) for t in texts]
    unlike = without_copies(docs)
    texts, docs, toxic = [texts[k] for k in unlike], [docs[k] for k in unlike], toxic[unlike]
    if not toxic.any() or toxic.all():
        flat = min(max(share, 1e-9), 1 - 1e-9)
        return Model(Landmarks([]), np.zeros(0), 0.0, 0.0, float(np.log(flat / (1 - flat))))
    marks = Landmarks(choose_landmarks(docs, toxic, landmarks))
    words = sorted({w for d in docs for s in d for w in s})
    place, values = {w: k for k, w in enumerate(words)}, Model(marks, np.zeros(0), 0.0, 0.0, 0.0).pieces(words)
    rows, owner, weight = [], [], []
    for k, d in enumerate(docs):
        found = [v for s in d if (v := values[[place[w] for w in s]].max(0, initial=0)).any()] if len(marks.words) else []
        found += [np.zeros(len(marks.words))] * (not toxic[k] or not found)
        rows += found
        owner += [k] * len(found)
        weight += [1 / len(found)] * len(found)
    x, sign, weight = np.array(rows), np.where(toxic > 0, 1.0, -1.0)[owner], np.array(weight)
    for y in (-1, 1):
        weight[sign == y] *= len(docs) / 2 / weight[sign == y].sum()
    half = (marks.features(marks.words) + marks.features(marks.words).T) / 2
    level, axes = np.linalg.eigh(half + 1e-3 * np.eye(len(half))) if len(half) else (np.zeros(0), np.zeros((0, 0)))
    white = axes / np.sqrt(np.maximum(level, 1e-2)) @ axes.T if len(half) else np.zeros((0, 0))
    w = svm(x @ white, sign, weight)
    model = Model(marks, (white @ w[:-1]).astype(np.float32), float(w[-1]), 1.0, 0.0)
    raw = np.array([np.log(p / (1 - p)) for p in np.clip(model.score(texts), 1e-15, 1 - 1e-15)])
    model.slope, model.shift = calibrated(raw, toxic, share)
    return model


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_class: int) -> Model:
    """Fits on at most ``per_class`` labelled rows of either class, outside the held-out fold."""
    known = labels.where((fold(F.col("doc_id"), FOLDS) > 0) & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("key"), F.col("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic").alias("s")).first().s or 0.0
    by_hash = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("key"), "key").limit(per_class)
    picked = by_hash(1).unionByName(by_hash(0))
    # One text for each picked id, however many rows have it: at most 2 * per_class texts reach the driver.
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("body")).join(F.broadcast(picked.dropDuplicates(["key"])), "key")
    rows = texts.groupBy("key").agg(F.min(F.struct(F.xxhash64("body"), "body")).alias("t"), F.max("toxic").alias("toxic")).orderBy("key").select("t.body", "toxic").collect()
    return fit([r.body or "" for r in rows], np.array([r.toxic for r in rows], int), share)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, id_col, text_col, per_class))
    slim = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), FOLDS) == 0).alias("held_out"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start, texts in slices(batch, "body"):
                own, scores = batch.slice(start, len(texts)), model.score(texts)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
