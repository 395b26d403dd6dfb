"""N-gram Jaccard self-join by signature trees.

A document's set holds its distinct 5-word shingles, as 64-bit hashes.  Equal sets
are one class from the start, so copies cost nothing further.

Where sets meet: with all shingles in one global order, two sets of similarity
0.8 or more share one of their first ``n - ceil(0.8 n) + 1`` shingles.  The order
puts frequent shingles last (a bounded list, counted in a sample of documents;
the list moves work, not results), so passages that many documents share seldom
bring strangers together.  A block holds the classes that share one such shingle.

First round: in each block every class is held against its neighbour and the
first one, which joins groups of near copies with few comparisons; first in the
blocks of a few shingles, then in all for classes still apart.  Second
round: blocks that still hold different components get a signature tree.  Its
leaves are the classes' bitmaps (a bit for each shingle hash, as many bits as
twice the set's size), in order of size; a node holds the OR of its bitmaps, its
size range and its largest slack (shingles that share a bit).  The tree is
walked against itself by pairs of nodes, and a pair is left as soon as sizes,
the largest possible overlap (common bits plus slack) or a common component rule
out a new link.  Classes of leaf pairs that remain meet once more in their blocks,
now with their whole sets, and are compared there; a task joins components as it
finds links.  So no link between different components is missed, and no list of
pairs is made: the first walk hands on classes of a block, the second fewer links
than its task has components.

Defined results: null and empty texts have an empty set (n_shingles 0) and are
their own component; a text of 1 to 4 words has one shingle, the whole sequence;
a null id joins a component but never names it unless all ids are null; an empty
table gives an empty table; repeated rows belong to one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.components import connected_components
from docloom.llm.shared import LOWER_BYTES, Scratch, most_frequent, slices, table

WORDS = 5
#: Frequent shingles that go last in the order, at most; documents in the sample that counts them: one in SAMPLE.
FREQUENT, SAMPLE, FREQUENT_FROM = 200_000, 16, 8
#: A frequent shingle's block is cut in so many parts in the first round.
SALTS = 64
#: Ids up to this many are broadcast to pick texts (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
#: Of a class's first shingles those with the least hashes, so many, that the first round looks at before it looks at all.
EARLY = 8
#: Tasks over which blocks of the same first class may be spread; pairs that a task remembers.
DEALS, REMEMBERED = 4, 500_000
#: Sets that one set is compared with at a time.
COMPARED = 512
FANOUT = 8
PAIRS_AT_ONCE = 50_000
MULTIPLIERS = np.random.default_rng(8).integers(1 << 62, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each text."""
    split = [t.encode().translate(LOWER_BYTES).split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for words in split for w in words]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64)
    h = scrambled(hashes[ids]) if ids else np.zeros(0, np.uint64)
    spread = max(0, len(h) - WORDS + 1)
    rolled = np.zeros(spread, np.uint64)
    for k in range(WORDS):
        rolled += h[k : k + spread] * MULTIPLIERS[k]
    rolled = scrambled(rolled).view(np.int64)
    out, at = [], 0
    for n in lengths.tolist():
        if n >= WORDS:
            out.append(np.unique(rolled[at : at + n - WORDS + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for x in h[at : at + n]:
                whole = scrambled(whole * MULTIPLIERS[0] + x)
            out.append(whole.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += n
    return out


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit for each hash, in the smallest power of two from 64 that is at least twice the number of hashes."""
    width = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[shingles & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def sample_counts(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """The hashes of frequent shingles, at most FREQUENT of them."""
    part = docs.where(F.pmod(F.xxhash64(id_col), F.lit(SAMPLE)) == 0).select(F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "body"):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(texts)))], names=["token"])

    counted = part.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    return most_frequent(counted, FREQUENT, scratch).select("token")


def signatures(docs: DataFrame, frequent: np.ndarray, scratch: Scratch) -> DataFrame:
    """A stored row for each row of ``docs`` (row, doc_id, body): n, digest of the set, bitmap, first shingles in the order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in batches:
            for start, texts in slices(batch, "body"):
                own, sets, tokens = batch.slice(start, len(texts)), shingle_sets(texts), []
                for s in sets:
                    first = len(s) - (4 * len(s) + 4) // 5 + 1 if len(s) else 0
                    at = np.minimum(np.searchsorted(late, s), max(0, len(late) - 1))
                    is_late = late[at] == s if len(late) else np.zeros(len(s), bool)
                    tokens.append(np.concatenate([s[~is_late], s[is_late]])[:first])
                ends = np.cumsum([0, *map(len, tokens)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens)))
                digests = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                columns = [own.column("row"), own.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n", "digest", "bits", "tokens"])

    return scratch.table(docs.mapInArrow(run, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, digest binary, bits binary, tokens array<long>"), "signatures")


def popcount(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(-1, dtype=np.int64)


class SignatureTree:
    """Levels of nodes over bitmaps of one width; level 0 holds the sets, in order of size."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, label: np.ndarray):
        self.levels = [(n, n, n - popcount(bits), label, bits)]
        while len(self.levels[-1][0]) > 1:
            low, high, slack, one, union = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            same = np.minimum.reduceat(one, at) == np.maximum.reduceat(one, at)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at), np.where(same, one[at], -1), np.bitwise_or.reduceat(union, at)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``nodes``, child) pairs."""
        first = nodes * FANOUT
        many = np.minimum(first + FANOUT, len(self.levels[level - 1][0])) - first
        back = np.repeat(np.arange(len(nodes)), many)
        return back, first[back] + np.arange(len(back)) - np.repeat(np.cumsum(many) - many, many)


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets below the nodes i and j may be linked and are in different components."""
    (low_a, high_a, slack_a, one_a, bits_a), (low_b, high_b, slack_b, one_b, bits_b) = a, b
    ok = (5 * high_a[i] >= 4 * low_b[j]) & (5 * high_b[j] >= 4 * low_a[i]) & ~((one_a[i] >= 0) & (one_a[i] == one_b[j]))
    at = np.flatnonzero(ok)
    most = np.minimum(slack_a[i[at]], slack_b[j[at]]) + popcount(bits_a[i[at]] & bits_b[j[at]])
    ok[at] = 9 * most >= 4 * (low_a[i[at]] + low_b[j[at]])
    return ok


def dual_traversal(a: SignatureTree, b: SignatureTree, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of sets that the bounds leave, of two trees or of one with itself (i < j)."""
    work = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while work:
        la, lb, i, j = work.pop()
        if len(i) > PAIRS_AT_ONCE:
            half = len(i) // 2
            work += [(la, lb, i[:half], j[:half]), (la, lb, i[half:], j[half:])]
            continue
        ok = possible(a.levels[la], b.levels[lb], i, j)
        if itself and la == lb:
            ok &= i <= j if la else i < j
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            yield i, j
            continue
        if la >= lb and la:
            back, i = a.children(la, i)
            j, la = j[back], la - 1
            if itself and lb == la + 1:
                back, j = b.children(lb, j)
                i, lb = i[back], lb - 1
        else:
            back, j = b.children(lb, j)
            i, lb = i[back], lb - 1
        work.append((la, lb, i, j))


def block_pairs(cls: np.ndarray, n: np.ndarray, label: np.ndarray, bits: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes of one block that may be linked: a tree for each bitmap width, against itself and the next width."""
    order = np.lexsort((cls, n))
    widths = np.array([len(b) for b in bits])[order]
    cls, n, label = cls[order], n[order], label[order]
    groups = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
    matrix = {w: np.frombuffer(b"".join(bits[order[k]] for k in at), np.uint64).reshape(len(at), -1) for w, at in groups.items()}
    for w, at in groups.items():
        tree = SignatureTree(n[at], matrix[w], label[at])
        for i, j in dual_traversal(tree, tree, True):
            yield cls[at[i]], cls[at[j]]
        if (wide := groups.get(2 * w)) is not None:
            half = matrix[w].shape[1]
            folded = matrix[2 * w][:, :half] | matrix[2 * w][:, half:]
            for i, j in dual_traversal(tree, SignatureTree(n[wide], folded, label[wide]), False):
                yield cls[at[i]], cls[wide[j]]


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal ``block`` in sorted batches, also across batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            if rest and rest[0].column("block")[0].as_py() != keys[s]:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(s, e - s))
    if rest:
        yield pa.Table.from_batches(rest)


def tree_classes(blocks: DataFrame) -> DataFrame:
    """(block, deal, cls, label) of the classes that the trees leave in a pair, from rows (block, deal, cls, n, label, bits).

    Blocks of the same first class mostly hold the same classes, so they are dealt
    to a few tasks, and a task counts each pair once (as long as it remembers it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for block in by_block(batches):
            if block.num_rows > 1:
                columns, held = [block.column(c).to_numpy() for c in ("cls", "n", "label")], np.zeros(0, np.int64)
                for a, b in block_pairs(*columns, block.column("bits").to_pylist()):
                    new = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)) - given
                    given = new if len(given) > REMEMBERED else given
                    given |= new
                    held = np.unique(np.concatenate([held, *zip(*new, strict=True)]))
                if len(held):
                    yield from block.select(["block", "deal", "cls", "label"]).filter(pa.array(np.isin(columns[0], held))).to_batches()

    return blocks.repartition("deal").sortWithinPartitions("deal", "block").mapInArrow(run, "block long, deal long, cls long, label long")


class Joined:
    """Components of labels, as a task joins them."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(p, p)
            x = p
        return x

    def roots(self, labels: np.ndarray) -> np.ndarray:
        return np.array([self.top(x) for x in labels.tolist()], np.int64)


def block_links(cls: np.ndarray, label: np.ndarray, sets: list[np.ndarray], joined: Joined) -> tuple[list[int], list[int]]:
    """Links (a, b) of a block's classes with these sets; each joins two components that were apart."""
    n, root = np.array([len(s) for s in sets], np.int64), joined.roots(label)
    codes, ends = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32), np.cumsum(n)
    codes, has = np.split(codes, ends[:-1]), np.zeros(int(codes.max()) + 1, bool)
    order = np.argsort(cls)
    place = lambda c: order[np.searchsorted(cls, c, sorter=order)]
    out: tuple[list[int], list[int]] = ([], [])
    for a, b in block_pairs(cls, n, root, [bitmap(s) for s in sets]):
        a, b = place(a), place(b)
        by_a = np.argsort(a, kind="stable")
        a, b = a[by_a], b[by_a]
        cuts = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            i = a[s]
            has[codes[i]] = True
            for k in range(s, e, COMPARED):
                others = b[k : min(e, k + COMPARED)]
                others = others[root[others] != root[i]]
                if not len(others):
                    continue
                begin = np.cumsum(n[others]) - n[others]
                common = np.add.reduceat(has[np.concatenate([codes[j] for j in others])], begin, dtype=np.int64)
                for j in others[100 * common >= 80 * (n[i] + n[others] - common)].tolist():
                    if (low := min(root[i], root[j])) != (high := max(root[i], root[j])):
                        joined.parent[int(high)] = int(low)
                        root[root == high] = low
                        out[0].append(int(cls[i]))
                        out[1].append(int(cls[j]))
            has[codes[i]] = False
    return out


def linked(blocks: DataFrame) -> DataFrame:
    """(a, b): links that join components, from rows (block, deal, cls, label, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        for block in by_block(batches):
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in block.column("shingles")]
            a, b = block_links(block.column("cls").to_numpy(), block.column("label").to_numpy(), sets, joined)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.repartition("deal").sortWithinPartitions("deal", "block").mapInArrow(run, "a long, b long").distinct()


def whole_sets(needed: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, shingles) of the classes in ``needed`` (cls)."""
    needed = classes.join(needed.distinct(), "cls", "left_semi").select("cls", "digest", F.xxhash64("first_id").alias("key"))
    needed = scratch.table(needed, "needed")
    keys = needed.select("key").distinct()
    if keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    bodies = docs.select(F.xxhash64("doc_id").alias("key"), "body").join(keys, "key", "left_semi").select("body")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "body"):
                sets = [s.tobytes() for s in shingle_sets(texts)]
                yield pa.RecordBatch.from_arrays([pa.array([blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["digest", "shingles"])

    sets = bodies.mapInArrow(full, "digest binary, shingles binary").join(needed.select("cls", "digest"), "digest").groupBy("cls").agg(F.first("shingles").alias("shingles"))
    return scratch.table(sets, "sets")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more: bitmaps first, then the whole sets."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    def by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")), strict=True):
                if not (fits := 5 * min(n, m) >= 4 * max(n, m)):
                    keep.append(fits)
                    continue
                p, q = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                # Such sizes are at most one width apart.  A folded bitmap has more shingles that share a bit, so slack is counted after.
                q = q if len(q) == len(p) else q[: len(p)] | q[len(p) :]
                slack = min(min(n, m) - popcount(p), max(n, m) - popcount(q))
                keep.append(9 * int(slack + popcount(p & q)) >= 4 * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = scratch.table(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(by_bits, "a long, b long"), "pairs")
    sets = whole_sets(left.select(F.col("a").alias("cls")).union(left.select("b")), classes, docs, scratch)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= 80 * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (sets.select(F.col("cls").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    return scratch.table(left.join(x, "a").join(y, "b").mapInArrow(exact, "a long, b long"), "links-found")


def jaccard_components(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, doc_id, n_shingles, component_id) for each row of ``docs`` (row, doc_id, body)."""
    spark = docs.sparkSession
    frequent = np.array(sorted(r.token for r in sample_counts(docs, "doc_id", "body", scratch).collect()), np.int64)
    rows = signatures(docs, frequent, scratch)
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in ("n", "bits", "tokens")))
    classes = scratch.table(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    late = F.broadcast(spark.createDataFrame([(int(t),) for t in frequent], "token long").withColumn("late", F.lit(True)))
    tokens = classes.select("cls", "n", F.posexplode("tokens").alias("pos", "token")).join(late, "token", "left")
    salt = F.when(F.col("late"), F.pmod(F.xxhash64("token", "cls"), F.lit(SALTS))).otherwise(0)
    w = Window.partitionBy("token", "salt").orderBy("n", "cls")
    ordered = tokens.withColumn("salt", salt).withColumn("early", F.col("pos") < EARLY)
    runs = ordered.select("token", "salt", "cls", "n", "late", "early", F.lag("cls").over(w).alias("prev"), F.lead("cls").over(w).alias("next"))
    runs = scratch.table(runs.where("prev is not null or next is not null or late").select("token", "salt", "cls", "n", "early"), "runs")

    def neighbours(rows: DataFrame) -> DataFrame:
        """(a, b): classes next to each other in a run, or to its first one, whose labels differ and whose sizes allow a link."""
        told = rows.select("cls", "n", "label", F.lag(F.struct("cls", "n", "label")).over(w).alias("prev"), F.first(F.struct("cls", "n", "label")).over(w).alias("head"))
        both = told.select("cls", "n", "label", F.explode(F.array("prev", "head")).alias("x")).where("x is not null and x.label != label and 5 * x.n >= 4 * n")
        return both.select(F.least("x.cls", "cls").alias("a"), F.greatest("x.cls", "cls").alias("b")).distinct()

    def labelled(links: DataFrame) -> DataFrame:
        """runs with the component of each class by these links."""
        labels = scratch.table(connected_components(links, scratch), "labels")
        return scratch.table(runs.join(labels, F.col("cls") == F.col("node"), "left").select("token", "salt", "cls", "n", "early", F.coalesce("root", "cls").alias("label")), "members")

    early = verified(neighbours(runs.where("early").withColumn("label", F.col("cls"))), classes, docs, scratch)
    links = early.unionByName(verified(neighbours(labelled(early)), classes, docs, scratch))
    members = labelled(links)
    mixed = members.groupBy("token").agg(F.count("*").alias("many"), F.bit_xor(F.xxhash64("cls")).alias("list"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("cls").alias("head")).where("low != high")
    # Shingles with the same classes make the same block; one of them is enough.
    chosen = mixed.groupBy("many", "list", "head").agg(F.min("token").alias("token")).select("token", F.xxhash64("head", F.pmod("token", F.lit(DEALS))).alias("deal"))
    blocks = members.join(chosen, "token").join(classes.select("cls", "bits"), "cls").select(F.col("token").alias("block"), "deal", "cls", "n", "label", "bits")
    asked = scratch.table(tree_classes(blocks), "tree-classes")
    more = scratch.table(linked(asked.join(whole_sets(asked.select("cls"), classes, docs, scratch), "cls").select("block", "deal", "cls", "label", "shingles")), "links-found")

    roots = connected_components(links.unionByName(more), scratch)
    named = classes.select("cls", "digest", "first_id").join(roots, F.col("cls") == F.col("node"), "left").select("digest", "first_id", F.coalesce("root", "cls").alias("root"))
    named = scratch.table(named, "named")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.select("row", "doc_id", "n", "digest").join(named.join(smallest, "root").select("digest", "component_id"), "digest", "left").select("row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    return jaccard_components(slim, scratch).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, and all without a shingle."""
    stored = scratch.table(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "docs-by-row")
    slim = stored.select("row", F.col(f"doc.{id_col}").alias("doc_id"), F.col(f"doc.{text_col}").alias("body"))
    found = jaccard_components(slim, scratch)
    first = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x")).select("x.row")
    kept = first.unionByName(found.where("n_shingles = 0").select("row"))
    return stored.join(kept, "row", "left_semi").select("doc.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
