"""Conversation repair, centroid clustering and token files against brute force: nulls, ties, repeated rows, empty tables, clashing names, long texts."""

import hashlib
import io
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import addressable, centroids, conversation_repair, token_files
from docloom.llm.shared import Scratch, table
from tests.conftest import SF

# Conversation repair

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def all_audits(turns, most):
    """Every (cost, audit, roles) of at most ``most`` inserts that ends in the grammar."""

    def go(k, roles, cost, audit, left):
        if k == len(turns):
            if GRAMMAR.match("".join(r[0] for r in roles)):
                yield cost, audit, roles
        else:
            initial, fault = turns[k]
            cut = 3 if fault == 1 else 0
            yield from go(k + 1, roles, cost + 4, audit + "D", left)
            if fault != 2:
                if initial:
                    yield from go(k + 1, [*roles, initial], cost + cut, audit + "K", left)
                for r in "ua":
                    yield from go(k + 1, [*roles, r], cost + 3 + cut, audit + "R", left)
        if left:
            for r in "ua":
                yield from go(k, [*roles, r], cost + 3, audit + "I", left - 1)

    return go(0, [], 0, "", most)


def test_cheapest_equals_all_edits():
    rng = np.random.default_rng(4)
    cases = [list(c) for n in range(3) for c in itertools.product(itertools.product("sua", range(3)), repeat=n)]
    cases += [[("sua"[rng.integers(3)] if rng.random() < 0.9 else "", int(rng.integers(3))) for _ in range(rng.integers(3, 5))] for _ in range(60)]
    for turns in cases:
        want = min(all_audits(turns, 3))
        assert conversation_repair.cheapest(turns) == want[:2], turns


def dijkstra(turns):
    """Cost of repair by shortest paths over (turn, state), without layers."""
    best = {(0, 0): 0}
    todo = {(0, 0)}
    while todo:
        k, q = node = min(todo, key=best.get)
        todo.discard(node)
        steps = [((k, conversation_repair.turned(q)), 3)]
        if k < len(turns):
            initial, fault = turns[k]
            cut = 3 if fault == 1 else 0
            steps.append(((k + 1, q), 4))
            if fault != 2:
                steps.append(((k + 1, conversation_repair.turned(q)), 3 + cut))
                kept = conversation_repair.kept_role(q, initial)
                steps += [((k + 1, kept), cut)] if kept is not None else []
        for to, cost in steps:
            if best[node] + cost < best.get(to, 1 << 30):
                best[to] = best[node] + cost
                todo.add(to)
    return min(best[len(turns), q] for q in (0, 3) if (len(turns), q) in best)


def test_long_conversation_in_layers():
    rng = np.random.default_rng(5)
    turns = [("sua"[rng.integers(3)], int(rng.choice([0, 0, 0, 1, 2]))) for _ in range(700)]
    cost, audit = conversation_repair.cheapest(turns)
    assert cost == dijkstra(turns)
    assert len(audit) - audit.count("I") == 700
    long = conversation_repair.cheapest([("u", 0), ("a", 0)] * 100_000 + [("a", 0)])
    assert long == (3, "K" * 200_000 + "IK")


CONVERSATIONS = "conv_id long, turn long, role string, text string, conv long, digest string, n int, found string, kind string"


def conversation_rows():
    rng = np.random.default_rng(6)
    texts = ["Yes.", "No", "Well then!", "   ", "", None, "Is it?  \n", "same text.", "Ünïcode…", "tab\t"]
    rows = [(int(c), int(t), ["user", "assistant", "system", "tool", "", None][rng.choice(6, p=[0.4, 0.35, 0.1, 0.05, 0.05, 0.05])], texts[rng.integers(len(texts))]) for c in range(60) for t in range(rng.integers(1, 9))]
    rows += [(100, None, "user", "first."), (100, 5, "assistant", "late."), (100, 5, "assistant", "late."), (100, 5, "user", "tied."), (None, 1, "user", "no id."), (None, 2, "assistant", "none."), (None, None, None, None)]
    rows += [(200, t, "user" if t % 2 else "assistant", "x" * 1_000_000 + "." if t == 3 else f"turn {t}.") for t in range(1, 40)]
    return rows


def plain_repair(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, told, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            told.append((role[:1], 1 if fault == "truncated" else 2 if fault else 0))
            if fault:
                counts[fault] += 1
        numbers = {t for t, _, _ in turns if t is not None}
        cost, audit = conversation_repair.cheapest(told)
        k, roles = 0, []
        for edit in audit:  # the audit alone says what the repaired conversation is
            turn = "assistant" if roles and roles[-1][0][:1] == "u" else "user"
            if edit == "I":
                roles.append((turn, ""))
                continue
            if edit != "D":
                roles.append((turns[k][1] if edit == "K" else turn, turns[k][2]))
            k += 1
        assert GRAMMAR.match("".join(r[:1] for r, _ in roles))
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (_, a, _), (_, b, _) in itertools.pairwise(turns))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in roles).encode()).hexdigest()
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *counts.values(), illegal, cost, audit, sha)
    return out


def test_repair_of_awkward_conversations(spark):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, "d", 2, "f", "k") for r in rows], CONVERSATIONS).repartition(3)
    got = conversation_repair.repaired(df).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain_repair(rows)
    assert len(got) == len({r[0] for r in rows})
    assert conversation_repair.repaired(df.limit(0)).collect() == []


def test_conversation_without_rows(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert tuple(conversation_repair.repaired(df).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# Delta Lloyd


def plain_lloyd(vectors, k=8, rounds=10):
    """(id, cluster, distance) of (id, integer components) by Lloyd's rounds in full."""
    start = sorted(vectors, key=lambda v: (hashlib.sha256(f"3:{'null' if v[0] is None else v[0]}".encode()).hexdigest(), v[1]))[:k]
    cents = [list(x) for _, x in start]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        owned = defaultdict(list)
        for _, x in vectors:
            owned[nearest(x)[1]].append(x)
        cents = [[sum(col) // len(owned[i]) for col in zip(*owned[i], strict=True)] if owned[i] else c for i, c in enumerate(cents)]
    return [(v, nearest(x)[1], nearest(x)[0]) for v, x in vectors], cents


def test_delta_lloyd_on_awkward_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(0, 1, (12, 64))
    rows = [(int(i), (base[i % 12] * 0.2 + rng.normal(0, 0.02, 64)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (900, [0.0] * 64), (901, [5.0] * 64), (902, [-1e30] * 64), (903, [-1e30] * 64)]
    bad = [(800, None), (801, []), (802, [0.1] * 63), (803, [0.1] * 65), (804, [None, *[0.1] * 63]), (805, [float("nan"), *[0.1] * 63]), (806, [float("inf"), *[0.1] * 63])]
    df = spark.createDataFrame([(*r, 1, 2, "r") for r in rows + bad], "vec_id long, embedding array<float>, cluster int, distance long, row string").repartition(4)
    got = centroids.clusters(df).collect()
    whole = [(v, [int(max(-(1 << 26), min(1 << 26, np.floor(1024 * float(np.float32(x)))))) for x in e]) for v, e in rows]
    want, cents = plain_lloyd(whole)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.inertia == sum(d for _, _, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()
    few = centroids.clusters(df.where("vec_id in (900, 901)")).collect()
    assert sorted((r.vec_id, r.distance) for r in few) == [(900, 0), (901, 0)]
    assert centroids.clusters(df.where("vec_id between 800 and 806")).collect() == []


def test_delta_rounds_compare_what_changed():
    rng = np.random.default_rng(9)
    x, cents = rng.integers(-1000, 1000, (500, 64)), rng.integers(-1000, 1000, (8, 64))
    owner, distance = centroids.owners(x, np.full(500, -1), np.zeros(500, np.int64), cents, np.arange(8))
    assert (owner == centroids.squared(x, cents).argmin(1)).all()
    new = cents.copy()
    new[[2, 5]] = x[:2]
    after, nearer = centroids.owners(x, owner, distance, new, np.array([2, 5]))
    full = centroids.squared(x, new)
    assert (after == full.argmin(1)).all() and (nearer == full.min(1)).all()
    sums = np.zeros((8, 64), np.int64)
    for t in centroids.transfers(x, np.full(500, -1), owner, 8) + centroids.transfers(x, owner, after, 8):
        sums[t["cluster"]] += t["total"]
    assert all((sums[c] == x[after == c].sum(0)).all() for c in range(8))
    huge = np.array([[1 << 26] * 64, [-(1 << 26)] * 64])
    assert centroids.squared(huge, huge).tolist() == [[0, 64 << 54], [64 << 54, 0]]


def test_buckets_meet_without_a_shuffle(spark):
    scratch = Scratch(spark)
    tables = centroids.Bucketed(scratch, 4)
    rows = spark.range(1000).select(F.col("id").alias("row"), F.col("id").alias("x"))
    a, b = (spark.table(tables.write(rows.repartition(4, "row"), "side")) for _ in range(2))
    plan = a.hint("merge").join(b.select("row"), "row")._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan
    scratch.close()


# Token files


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.tokenizer_path())


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.integers(1, 32))
def test_codes_round_trip(values, bits):
    ids = np.array(values, np.uint32) >> np.uint32(32 - bits)
    tokens = addressable.Tokens(io.BytesIO(addressable.encoded(ids, np.array([0, len(ids) // 2, len(ids)]), [None, -5])))
    assert tokens.read(0, len(ids)).tolist() == ids.tolist()
    low, high = len(ids) // 3, len(ids) - len(ids) // 4
    assert tokens.read(low, max(low, high)).tolist() == ids[low : max(low, high)].tolist()
    assert [tokens.token(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
    assert tokens.names(0, 2) == [None, -5] and tokens.first(0, 3).tolist() == [0, len(ids) // 2, len(ids)]


def test_one_token_reads_little():
    class Counted(io.BytesIO):
        got = 0

        def read(self, n=-1):
            self.got += n
            return super().read(n)

    ids = np.random.default_rng(2).integers(0, 50_000, 1_300_000).astype(np.uint32)
    f = Counted(addressable.encoded(ids, np.array([0, len(ids)]), [1]))
    tokens = addressable.Tokens(f)
    f.got = 0
    places = np.random.default_rng(3).integers(0, len(ids), 50)
    assert [tokens.token(int(i)) for i in places] == ids[places].tolist()
    assert f.got < 50 * 120 * len(tokens.levels)
    with pytest.raises(IndexError):
        tokens.token(len(ids))
    with pytest.raises(ValueError):
        addressable.Tokens(io.BytesIO(bytes(64)))


PIECES = ["don't", "DON'T", "it's", "word", "Word,", "word.", "..", "İstanbul", "ΑΣ", "straße", "é", "́x", "가", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", "日本語", "3rd", "x1", " ", "\x1c", " ", "!", "a\x00b", "ǅ", "ﬁne", "'s", "s'", "Å", "K", "\U0001f600", ""]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=12), min_size=1, max_size=5), st.sampled_from([" ", "\n", "", "  ", "\t", "\r\n"]))
def test_words_equal_the_library(parts, joint):
    words = getattr(test_words_equal_the_library, "words", None) or token_files.Words(open(token_files.tokenizer_path()).read(), 50)
    test_words_equal_the_library.words = words
    texts = [joint.join(p).encode("utf-8", "ignore").decode() for p in parts]
    ids, sizes = words.encode(token_files.pa.array(texts, token_files.pa.large_string()))
    want = [e.ids + [1] for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def expected(rows, library):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [library.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows]
    return [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), x in zip(rows, ids, strict=True)]


def test_token_files(spark, library):
    rows = [(k, f"text number {k} says don't, " * (k % 50)) for k in range(300)] + [(1000, None), (1001, ""), (1002, "b" * 1_000_000), (1003, "many words " * 40_000), (-4, "negative id")]
    twice = [(5, "text twice"), (5, "text twice"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows + twice], "doc_id long, text string, id int, path string, start int").repartition(5)
    got = token_files.token_digests(df, token_files.tokenizer_path(), file_tokens=3000, slice_tokens=700, slice_bytes=5000).orderBy("start").collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(expected(rows + twice, library), key=str)
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    named = [r.doc_id for r in got if r.doc_id is not None]
    assert named == sorted(named)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert token_files.token_digests(df.limit(0), token_files.tokenizer_path()).collect() == []


def test_files_by_single_tokens(spark, library):
    docs = table(spark, SF, "documents")
    scratch = Scratch(spark)
    files = token_files.with_starts(token_files.write_tokens(docs, token_files.tokenizer_path(), scratch, file_tokens=20_000, slice_bytes=30_000)).orderBy("start").collect()
    assert len(files) > 3 and sum(f.docs for f in files) == docs.count()
    store, _ = token_files.opened(scratch.root)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for f in files:
        with store.open_input_file(f.path) as opened:
            tokens = addressable.Tokens(opened)
            first = tokens.first(0, tokens.docs + 1)
            doc = tokens.docs // 2
            ids = library.encode(texts[tokens.names(doc, doc + 1)[0]] or "", add_special_tokens=False).ids + [1]
            assert [tokens.token(int(first[doc]) + i) for i in range(len(ids))] == ids
    scratch.close()


def test_starts_over_many_parts(spark):
    rows = [(p, f, f"{p}-{f}", 1, (p * 7 + f) % 5) for p in range(0, 5000, 3) for f in range(p % 3 + 1)]
    got = token_files.with_starts(spark.createDataFrame(rows, token_files.FILES)).orderBy("part", "file").collect()
    assert [r.start for r in got] == np.cumsum([0, *(r[4] for r in rows)])[:-1].tolist()
