"""Each operator against brute force on small, awkward tables: nulls, empty and long texts, ties, repeated rows, extra columns."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from docloom.llm import attention, bpe, components, exact_dedup, jaccard_join, language_id, lm_score, mixing, pii, quality, toxicity, url_filter
from docloom.llm.shared import Scratch
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest int, size string, n int, body string"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return (text or "").encode().split()


def rng_texts(n, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "of", "and", "Ärger", "été", "niño", "loop", "stone", "river", "cloud", "Token", "12", "x-ray", "don't"]
    return [" ".join(rng.choice(vocabulary, rng.integers(8, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    texts = rng_texts(40)
    base = texts[0] + " " + texts[1]
    near = base.split()
    near[3] = "changed"
    special = [None, "", "   \n\t", "One", "one two three", base, base.upper(), " ".join(near), "a b c d e f g h i j " * 400, "x" * 50_000, "mail bob@site.example.com now", "日本語 テキスト   nbsp sep"]
    out = [(k, t, ["en", "fr", None][k % 3], ["s1", "s2", "s3", None][k % 4], 0) for k, t in enumerate(texts + special)]
    out += [out[5], out[5], (None, "null id text with some words", "en", "s1", 0), (None, None, None, None, None)]
    return [(*r, "r", 1, "s", 2, "b") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(spark, docs, rows, empty):
    got = mixing.mixed_sizes(docs, block_words=50, shards=4).collect()
    assert len(got) == len(rows)
    size = {k: len(words(t)) for k, t, *_ in rows}
    totals = Counter()
    for r in rows:
        totals[r[3]] += len(words(r[1]))
    order = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_sources, left = {}, set(order), 1.5 * sum(totals.values())
    while True:
        share = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if share * weight[s] > 2 * totals[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_sources}
            break
        for s in full:
            target[s] = 2 * totals[s]
            left -= target[s]
        open_sources -= full
    by_id = {k: s for k, _, _, s, *_ in rows if k is not None}
    taken, largest = Counter(), Counter()
    for r in got:
        if r.doc_id is not None:
            assert r["size"] == size[r.doc_id] and r.source_size == totals[by_id[r.doc_id]]
            assert r.target == pytest.approx(target[by_id[r.doc_id]])
            taken[by_id[r.doc_id]] += r.taken
            largest[by_id[r.doc_id]] = max(largest[by_id[r.doc_id]], r["size"])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r["size"] * len(r.shards) or r["size"] == 0
    for s in order[1:]:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.mixed_sizes(docs.coalesce(1), block_words=50, shards=4)
    key = lambda x: sorted((r.doc_id is None, r.doc_id or 0, r.taken) for r in x)
    assert key(again.collect()) == key(got)
    assert mixing.mixed_sizes(empty).count() == 0


def test_mixture_rows(spark, docs):
    scratch = Scratch(spark)
    mixed = mixing.mixture(docs, scratch, shards=3)
    assert mixed.columns == docs.columns
    plan = {r.doc_id: r.taken for r in mixing.mixed_sizes(docs, shards=3).collect() if r.doc_id not in (None, 5)}
    seen = Counter(r.doc_id for r in mixed.collect())
    assert all(seen[k] * max(1, len(words(t))) == plan[k] for k, t in ((r.doc_id, r.text) for r in docs.collect() if r.doc_id in plan) if words(t))


def test_splitting_tree():
    quotas = np.array([100, 0, 7, 1000])
    parts = np.zeros((4, 5), np.int64)
    for shard, which, blocks in mixing.split(np.arange(4), quotas, 0, 5, 1, seed=1):
        parts[which, shard] = blocks
    assert (parts.sum(1) == quotas).all() and (parts >= 0).all()
    assert parts.sum(0).max() - parts.sum(0).min() <= 3
    ranges = {k: dict(zip(which.tolist(), blocks.tolist(), strict=True)) for k, which, blocks in mixing.split(np.arange(4), quotas, 0, 5, 2, seed=1)}
    assert sorted(ranges) == [0, 1, 2] and sum(sum(r.values()) for r in ranges.values()) == quotas.sum()


def test_mixing_intervals(spark, monkeypatch):
    """Stretches of a source lie end to end, and shards are as long as one another, over ranges of shards."""
    monkeypatch.setattr(mixing, "RANGE_SHARDS", 4)
    quotas = [("0a", 1000), ("0b", 333), ("0c", 0), ("1", 1)]
    got = mixing.shard_intervals(spark.createDataFrame(quotas, "src string, quota long"), 11, 3, Scratch(spark)).collect()
    for src, quota in quotas:
        runs = sorted((r.first, r["last"], r.shard) for r in got if r.src == src)
        assert sum(b - a for a, b, _ in runs) == quota and [a for a, *_ in runs] == [0, *(b for _, b, _ in runs)][: len(runs)]
        assert [s for *_, s in runs] == sorted({s for *_, s in runs})
    lengths = Counter()
    for r in got:
        lengths[r.shard] += r["last"] - r.first
    assert set(lengths) == set(range(11)) and max(lengths.values()) - min(lengths.values()) <= 4


def test_mixing_by_joins(spark, docs, monkeypatch):
    """The shuffled form deals the same shards as the broadcast one."""
    key = lambda df: sorted((str(r.doc_id), r.taken, sorted(r.shards)) for r in df.collect())
    want = key(mixing.mixed_sizes(docs, block_words=50, shards=4))
    monkeypatch.setattr(mixing, "BROADCAST_STRETCHES", 0)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert key(mixing.mixed_sizes(docs, block_words=50, shards=4)) == want


def test_mixing_of_huge_sources(spark):
    """Sizes of 2 * 10^9 blocks of the usual length and more: blocks get longer, targets stay exact."""
    scratch = Scratch(spark)
    rows = spark.range(40).select("id", F.col("id").alias("row"), F.when(F.col("id") < 30, "0a").otherwise("0b").alias("src"), F.lit(500_000_000_000).alias("size"))
    got = mixing.mix(scratch.table(rows, "huge"), scratch, shards=5).collect()
    assert sum(r["size"] for r in got) * mixing.SHARE / mixing.BLOCK_WORDS > 2e9
    for n, ids in ((30, range(30)), (10, range(30, 40))):
        mine = [r for r in got if r.id in ids]
        assert len(mine) == n and abs(sum(r.taken for r in mine) - mine[0].target) <= 500_000_000_000
        assert all(len(r.draws) * r["size"] == r.taken and all(0 <= d.shard < 5 for d in r.draws) for r in mine)


def test_mixing_of_many_sources(spark):
    scratch = Scratch(spark)
    rows = spark.range(200_000).select("id", F.col("id").alias("row"), F.format_string("0%06d", "id").alias("src"), (F.col("id") % 7).alias("size"))
    got = mixing.mix(scratch.table(rows, "many"), scratch, shards=3, block_words=2)
    r = got.agg(F.count("*").alias("n"), F.sum("target").alias("target"), F.sum("size").alias("size"), F.max(F.size("draws") * F.col("size") - F.col("taken")).alias("off"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).first()
    assert r.n == 200_000 and r.target == pytest.approx(1.5 * r["size"]) and r.off == 0 and r.over <= 0


def test_url_filter(spark):
    urls = ["http://a.example.net/en/1", "HTTP://A.Example.NET/fr/", "https://x.org/fr/a?b", "https://x.org?fr/", "http://example.com/de/x#y", "http://xexample.com/de/", "ftp://net", "http://net/", "no scheme", "", None, "http://example.net:80/en/", "http://x.org/fr", "a\nb://Q.net/z"]
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string, path string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")

    def brute(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].encode().translate(LOWER).decode(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, rules).collect()}
    assert got == {(k, *brute(u)) for k, u in enumerate([*urls, urls[0]])}
    assert {r.verdict for r in url_filter.url_filter(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("counters", [1, 1024])
def test_exact_dedup(docs, rows, empty, counters):
    groups = defaultdict(list)
    for k, t, *_ in rows:
        groups[(t or "").encode().translate(LOWER)].append(k)
    got = exact_dedup.exact_dedup(docs, counters=counters).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    by_hash = {hashlib.sha256(t).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_drop_copies(spark, docs, rows):
    left = exact_dedup.drop_copies(docs, Scratch(spark))
    assert left.columns == docs.columns
    assert left.count() == len({(t or "").encode().translate(LOWER) for _, t, *_ in rows})


def test_misra_gries_finds_all_frequent():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    values = [b"hot"] * 400 + [b"warm"] * 150 + [bytes([a, b]) for a, b in rng.integers(0, 200, (600, 2))]
    rng.shuffle(values)
    batches = [pa.RecordBatch.from_arrays([pa.array(values[k : k + 50], pa.binary())], names=["digest"]) for k in range(0, len(values), 50)]
    kept = next(exact_dedup.misra_gries(iter(batches), 9)).column("digest").to_pylist()
    assert {b"hot", b"warm"} <= set(kept) and len(kept) <= 9


def brute_counts(text):
    w, text = words(text), text or ""
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))


def test_quality_counts(docs, rows, empty):
    got = quality.quality_rules(docs).collect()
    assert Counter(tuple(r[c] for c in quality.COUNTS[:5]) for r in got) == Counter(brute_counts(t) for _, t, *_ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(empty).count() == 0


def test_quality_patterns_have_one_verdict(spark):
    verdicts, right, overruled = {}, [], []
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        told = quality.judged(quality.with_counts(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")))
        labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").select("doc_id", "quality")
        rows = told.where("not base_failed").withColumn("doc_id", F.col("doc.doc_id")).join(labels, "doc_id", "left")
        names = [f"vote_{k}" for k in quality.votes()]
        for r in rows.groupBy(*names, "kept", "quality").count().collect():
            bad = tuple(k for k in names if r[k] < 0)
            verdicts.setdefault(bad, set()).add(r.kept)
            if r.quality is not None:
                right += [(r.kept == (r.quality == 1))] * r["count"]
                overruled += [(r.kept == (r.quality == 1))] * r["count"] if r.kept == bool(bad) else []
    assert all(len(v) == 1 for v in verdicts.values()), verdicts
    assert np.mean(right) > 0.999 and len(right) > 4000
    assert not overruled or np.mean(overruled) > 0.5
    assert verdicts[("vote_symbols", "vote_symbol_share")] == {False}


def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    told = quality.quality_rules(docs).join(labels, "doc_id").where("not base_failed")
    right = told.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.95


def test_label_model_is_expectation_maximisation():
    """Against the same steps written out document by document."""
    rng = np.random.default_rng(3)
    patterns = np.unique(rng.choice([-1, 0, 1], (12, 3), p=[0.2, 0.3, 0.5]), axis=0)
    weights = rng.integers(1, 40, len(patterns))
    votes = [tuple(p) for p, n in zip(patterns.tolist(), weights, strict=True) for _ in range(n)]
    add = quality.WEIGHT * len(votes)
    own, other, good = quality.PRIOR
    belief = []
    for v in votes:
        agreed = [(sum(u[j] == -1 and u.count(-1) > 1 for u in votes) + add / 4) / (sum(u[j] == -1 for u in votes) + add) for j in range(3)]
        borne = [a * (x == -1) for a, x in zip(agreed, v, strict=True)]
        junk = [min(1, 2 * x) if v.count(-1) == 1 else x / max(sum(borne), 1e-9) for x in borne]
        belief.append([1 - sum(junk), *junk])
    for _ in range(7):
        share, rate = [], []
        for c in range(4):
            share.append(max(sum(b[c] for b in belief) - (quality.NEEDED * len(votes) if c else 0), 1e-6 * len(votes)))
            rate.append([])
            for j in range(3):
                expected = good if c == 0 else own if c == j + 1 else other
                said = sum(b[c] for b, v in zip(belief, votes, strict=True) if v[j])
                rate[c].append((sum(b[c] for b, v in zip(belief, votes, strict=True) if v[j] == -1) + add * expected) / (said + add))
        belief = []
        for v in votes:
            like = [share[c] * math.prod(1 if not x else rate[c][j] if x == -1 else 1 - rate[c][j] for j, x in enumerate(v)) for c in range(4)]
            belief.append([x / sum(like) for x in like])
    got = dict(zip(map(tuple, patterns.tolist()), quality.estimate(patterns.astype(float), weights.astype(float), rounds=7), strict=True))
    assert [got[v] for v in votes] == pytest.approx([b[0] for b in belief], abs=1e-9)


def test_noisy_rule_is_overruled():
    """Rule 0 votes bad on every sixth document by chance; the others find the same junk, each of them on two thirds of it."""
    rng = np.random.default_rng(8)
    junk = rng.random(20_000) < 0.1
    bad = np.stack([rng.random(20_000) < 1 / 6, *(junk & (rng.random(20_000) < 2 / 3) for _ in range(3))], 1)
    votes, weights = np.unique(np.where(bad, -1, 1), axis=0, return_counts=True)
    p = dict(zip(map(tuple, votes.tolist()), quality.estimate(votes.astype(float), weights.astype(float)), strict=True))
    assert p[-1, 1, 1, 1] > 0.9 and p[1, 1, 1, 1] > 0.9
    assert all(q < 0.5 for v, q in p.items() if -1 in v[1:])


def test_label_model_judges_alike_at_any_size():
    patterns = np.array([[1, 1, 1, 1], [-1, 1, 1, 1], [1, -1, 0, -1], [1, 0, 1, 1]], float)
    weights = np.array([9000.0, 30, 600, 200])
    assert quality.estimate(patterns, weights * 10_000) == pytest.approx(quality.estimate(patterns, weights), abs=1e-6)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def test_bpe(docs, rows, empty, tokenizer):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(docs, bpe.tokenizer_path(), lexicon_words=20).collect()}
    want = set()
    for k, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want.add((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == want
    assert bpe.bpe_digests(empty, bpe.tokenizer_path()).count() == 0


def test_bpe_round_trip(docs, rows):
    encoded = bpe.bpe_encode(docs, bpe.tokenizer_path(), lexicon_words=50)
    back = bpe.bpe_decode(encoded, bpe.tokenizer_path())
    assert Counter(r.decoded for r in back.select("decoded").collect()) == Counter(t or "" for _, t, *_ in rows)


def test_bpe_strange_strings(tokenizer):
    vocabulary = bpe.Vocabulary(bpe.tokenizer_path())
    coder = bpe.Coder(vocabulary, bpe.Lexicon(bpe.Lexicon.compile({w.encode(): vocabulary.merge(w.encode()) for w in ("the", " the", " then", "é")})))
    rng = np.random.default_rng(5)
    letters = list("ab 'sreTHE \n\t.,12é日　\x85\x1c") + ["<|endoftext|>", "😀"]
    for _ in range(300):
        text = "".join(rng.choice(letters, rng.integers(0, 60)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids and coder.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)
    for text in ("a" * 3000, "abc" * 500):
        assert coder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_transducer_is_minimal_and_exact():
    entries = {w: [k] for k, w in enumerate(sorted([b"tap", b"taps", b"top", b"tops", b"stop", b"stops"]))}
    lexicon = bpe.Lexicon(bpe.Lexicon.compile(entries))
    assert lexicon.find([*entries, b"t", b"stopss", b""]).tolist() == [*range(6), -1, -1, -1]
    assert len(lexicon.final) == 7
    assert bpe.Lexicon(bpe.Lexicon.compile({})).find([b"x"]).tolist() == [-1]


def test_language(spark, docs, empty):
    got = language_id.identify_language(docs).collect()
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    texts = dict((r.doc_id, r.text) for r in docs.collect())
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", texts[r.doc_id] or "")) for r in got if r.doc_id is not None)
    assert language_id.identify_language(empty).count() == 0
    real = spark.read.parquet(f"{SF}/documents.parquet")
    told = language_id.identify_language(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out")
    assert told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def brute_language(rows, lang_of):
    """Word-first back-off over plain dictionaries: {id: (language, score)}."""
    counts = {k: defaultdict(Counter) for k in range(5)}
    split = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    pieces = lambda t, n: [t[k : k + n] for k in range(max(1, len(t) - n + 1))]
    for k, t in rows:
        if k is not None and zlib.crc32(str(k).encode()) % 5 and lang_of[k] is not None:
            for w in split(t):
                counts[0][w][lang_of[k]] += 1
                for n in (1, 2, 3, 4):
                    for g in pieces(f"^{w}$", n):
                        counts[n][g][lang_of[k]] += 1
    languages = sorted({x for c in counts[0].values() for x in c})
    below = {n: {x: sum(c[x] for c in counts[n].values()) + 0.5 * (len(counts[n]) + 1) for x in languages} for n in counts}

    def logs(unit, n):
        if unit in counts[n]:
            return [math.log((counts[n][unit][x] + 0.5) / below[n][x]) for x in languages]
        if n == 1:
            return [math.log(1e-6)] * len(languages)
        return [float(np.mean(x)) for x in zip(*(logs(g, n - 1) for g in pieces(unit, n - 1)), strict=True)]

    out = {}
    for k, t in rows:
        words = split(t)
        total = [sum(x) for x in zip(*((logs(w, 0) if w in counts[0] else [float(np.mean(x)) for x in zip(*(logs(g, 4) for g in pieces(f"^{w}$", 4)), strict=True)]) for w in words), strict=True)]
        if words:
            best = max(total)
            out[k] = (languages[total.index(best)], 1 / sum(math.exp((x - best) / math.sqrt(len(words))) for x in total))
        else:
            out[k] = ("und", 0.0)
    return out


@pytest.mark.parametrize("max_words", [4, 10_000])
def test_language_is_word_first_back_off(spark, max_words):
    rng = np.random.default_rng(12)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sche", "lo", "rn", "é"], "cc": ["ka", "xi", "ñu", "o"]}
    rows, langs = [], {}
    for k in range(60):
        lang = sorted(syllables)[k % 3]
        rows.append((k, " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(12))))
        langs[k] = lang if k % 7 else None
    rows += [(100, "zzz qqqqq 日本 x"), (101, "Ka " + "lo" * 300), (102, "12 ² ३"), (103, None)]
    langs |= dict.fromkeys(range(100, 104))
    docs = spark.createDataFrame([(k, t, langs[k]) for k, t in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify_language(docs, max_words=max_words).collect()}
    for k, (lang, score) in brute_language(rows, langs).items():
        assert got[k].lang_pred == lang and got[k].score == pytest.approx(score, rel=1e-6)


def test_jaccard(docs, rows, empty):
    def shingles(t):
        w = [x.translate(LOWER) for x in words(t)]
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(k, shingles(t)) for k, t, *_ in rows]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[top(i)] = top(j)
    smallest = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            smallest[top(i)] = min(k, smallest.get(top(i), k))
    want = Counter((k, len(s), smallest.get(top(i)) if s else k) for i, (k, s) in enumerate(sets))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()) == want
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_tree_loses_no_link():
    rng = np.random.default_rng(9)
    bases = [rng.integers(0, 1 << 62, 120) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[: 120 - d], rng.integers(0, 1 << 62, d)])) for b in bases for d in (0, 5, 10, 15, 30, 60)]
    n, bits = np.array([len(s) for s in sets]), [jaccard_join.bitmap(s) for s in sets]
    cls = np.arange(len(sets))
    found = {tuple(sorted(p)) for a, b in jaccard_join.block_pairs(cls, n, cls, bits) for p in zip(a.tolist(), b.tolist(), strict=True)}
    linked = {(i, j) for j in cls for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert linked <= found and len(found) < len(cls) * (len(cls) - 1) // 4


def test_links_across_widths_of_bitmaps(spark):
    # 64 and 70 shingles have bitmaps of 128 and 256 bits; 60 of them in common are 0.81.
    rng, rows = np.random.default_rng(4), []
    for k in range(60):
        w = [f"w{x}" for x in rng.integers(0, 1 << 40, 84)]
        rows += [(2 * k, " ".join(w[:68])), (2 * k + 1, " ".join(w[74:78] + w[4:74]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (64 + 6 * (i % 2), i - i % 2) for i in range(120)}


def test_near_copies_give_no_list_of_pairs(spark):
    # 150 sets that share 100 shingles of 119 to 126: candidates of each other by their bitmaps, of which few are links.
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 100)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 1 << 62, 19 + k % 8)])) for k in range(150)]
    sets += [np.unique(np.concatenate([s[1:], rng.integers(0, 1 << 62, 1)])) for s in sets[:50]]
    cls, many = np.arange(200), len(sets)
    candidates = sum(len(a) for a, _ in jaccard_join.block_pairs(cls, np.array([len(s) for s in sets]), cls, [jaccard_join.bitmap(s) for s in sets]))
    assert candidates > 10 * many
    rows = [(1, 1, int(c), len(sets[c]), int(c), jaccard_join.bitmap(sets[c]), sets[c].tobytes()) for c in cls]
    blocks = spark.createDataFrame(rows, "block long, deal long, cls long, n long, label long, bits binary, shingles binary")
    asked = jaccard_join.tree_classes(blocks.drop("shingles"))
    assert 0 < asked.count() <= many
    found = {(r.a, r.b) for r in jaccard_join.linked(asked.join(blocks.select("cls", "shingles"), "cls").select("block", "deal", "cls", "label", "shingles")).collect()}
    alike = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
    assert all(alike(a, b) for a, b in found) and len(found) < many
    parts = [list(range(many)), list(range(many))]
    for part, links in zip(parts, (found, {(a, b) for a in range(many) for b in range(a) if alike(a, b)}), strict=True):
        for a, b in links:
            x, y = sorted((part[a], part[b]))
            part[:] = [x if p == y else p for p in part]
    assert parts[0] == parts[1]


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 130)]
    parent = {x: x for p in links for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.connected_components(df, Scratch(spark), one_task).collect()}
    assert got == {x: top(x) for p in links if p[0] != p[1] for x in p}
    assert components.connected_components(df.limit(0), Scratch(spark), one_task).count() == 0


def test_lm_base(docs, rows, empty):
    low = {k: [w.translate(LOWER) for w in words(t)] + [None] for k, t, *_ in rows}
    train = Counter()
    for k, t, *_ in rows:
        if k is not None and zlib.crc32(str(k).encode()) % 10:
            train.update(low[k])
    n, v = sum(train.values()), len(train)
    got = lm_score.lm_score(docs, bpe.tokenizer_path(), frequent_words=6, rounds=1, train_one_in=2).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            w = low[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(train[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
            assert r.score < 0 and math.isfinite(r.score)
    assert lm_score.lm_score(empty, bpe.tokenizer_path(), rounds=1).count() == 0


def test_lm_trains_on_every_document(docs, rows, monkeypatch):
    read, part = [], lm_score.training_part

    def noted(*args):
        out = part(*args)
        read.extend(r.doc_id for r in out.select("doc_id").collect())
        return out

    monkeypatch.setattr(lm_score, "training_part", noted)
    lm_score.lm_score(docs, bpe.tokenizer_path())
    assert sorted(read) == sorted(k for k, *_ in rows if k is not None and zlib.crc32(str(k).encode()) % 10)


def test_lm_knows_pairs_beyond_the_broadcast_ones(docs):
    told = [sorted((str(r.doc_id), r.score) for r in lm_score.lm_score(docs, bpe.tokenizer_path(), kept_pairs=kept, rounds=0, train_one_in=1).collect()) for kept in (5, 200_000)]
    assert [x for _, x in told[0]] == pytest.approx([x for _, x in told[1]], abs=1e-3)


def test_attention_scores_and_gradient():
    rng = np.random.default_rng(2)
    p = attention.start(7, 16, 1)
    p["w2"], p["w3"] = p["w2"] * 50, p["w3"] * 50
    direct = attention.direct_rows(rng.dirichlet(np.ones(16), 7))
    sequence, kind = rng.integers(0, 7, 60), rng.permutation(16)[:7]
    starts, inputs = np.array([1, 30]), np.array([28, 29])
    totals = attention.Scorer(p, direct).totals(sequence, kind[sequence], starts, inputs)
    for total, s, n in zip(totals, starts, inputs, strict=True):
        want = 0.0
        for k in range(n):
            first = 0 if k < attention.CONTEXT else (k - attention.CONTEXT + attention.STRIDE) // attention.STRIDE * attention.STRIDE
            x = np.zeros((1, attention.CONTEXT), np.int64)
            x[0, : k - first + 1] = sequence[s + first : s + k + 1]
            logs = attention.forward(p, x, direct)[0, k - first].astype(float)
            assert np.exp(logs).sum() == pytest.approx(1, rel=1e-4)
            want += logs[kind[sequence[s + k + 1]]]
        assert total == pytest.approx(want, rel=1e-3)
    x, y, w = rng.integers(0, 7, (3, attention.CONTEXT)), rng.integers(0, 16, (3, attention.CONTEXT)), np.ones((3, attention.CONTEXT), np.float32)
    q, direct = {k: v.astype(np.float64) for k, v in p.items()}, tuple(d.astype(np.float64) for d in direct)
    loss, g = attention.gradient(q, x, direct, y, w)
    assert loss == pytest.approx(-np.take_along_axis(attention.forward(q, x, direct), y[..., None], -1).mean(), rel=1e-5)
    for name in q:
        at = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        up, down = ({k: v.copy() for k, v in q.items()} for _ in range(2))
        up[name][at] += 1e-6
        down[name][at] -= 1e-6
        slope = (attention.gradient(up, x, direct, y, w)[0] - attention.gradient(down, x, direct, y, w)[0]) / 2e-6
        assert g[name][at] == pytest.approx(slope, rel=2e-2, abs=1e-5)
    before = attention.gradient(p, x, direct, y, w)[0]
    trained = attention.train(p, direct, np.repeat(x, 50, 0), np.repeat(y, 50, 0), np.repeat(w, 50, 0), 0.01, batch=30)
    assert attention.gradient(trained, x, direct, y, w)[0] < before


def test_lm_cuts_words_by_longest_piece():
    vocabulary = bpe.Vocabulary(bpe.tokenizer_path())
    pieces = lm_score.Pieces(vocabulary)
    by_bytes = {b: i for i, b in vocabulary.bytes_of.items() if i not in vocabulary.special.values()}
    texts = ["the", "unbelievable", "x" * 300, "Straße", "日本語テキスト", "a", "naïveté,", "\u00a0", "1234567890-=", "internationalisation"]
    got_sizes, got = pieces.cut([t.encode() for t in texts])
    want = []
    for t in texts:
        whole, out = b" " + t.encode(), []
        for rest in (whole[k : k + lm_score.STRETCH] for k in range(0, len(whole), lm_score.STRETCH)):
            while rest:
                n = max(k for k in range(1, len(rest) + 1) if rest[:k] in by_bytes)
                out.append(by_bytes[rest[:n]])
                rest = rest[n:]
        want.append(out)
    assert got_sizes.tolist() == [len(x) for x in want] and got.tolist() == [i for x in want for i in x]
    assert [len(x) for x in pieces.cut([])] == [0, 0]


def test_lm_reader_cuts_a_word_once(monkeypatch):
    pieces = lm_score.Pieces(bpe.Vocabulary(bpe.tokenizer_path()))
    flat = np.ones(pieces.top)
    known = lm_score.Classes(flat, flat, pieces.end)
    known.learn(np.zeros((pieces.top, known.n)), flat, tuple(np.zeros(0, np.int64) for _ in range(3)))
    texts = ["The river\tthe Stone\r\nRIVER", "", " \x0b", "\u00a0 Ärger\u2003x été\x1cx", "stone " * 50, "a" * 200, "river cloud the"]
    cut, kept = [], lm_score.Pieces.cut
    monkeypatch.setattr(lm_score.Pieces, "cut", lambda self, words: cut.extend(words) or kept(self, words))
    for remembered in (lm_score.REMEMBERED, 3):
        monkeypatch.setattr(lm_score, "REMEMBERED", remembered)
        reader = lm_score.Reader(pieces, known, [("the", 3), ("Ärger".lower(), 2)], 10, 4, 2)
        cut.clear()
        for some in (texts[:3], texts, texts[::-1], [""]):
            got = reader.sequences(some)
            assert got["lengths"].tolist() == [len(words(t)) for t in some]
            assert [got["words"][i] for i in got["ids"]] == [w for t in some for w in t.encode().translate(LOWER).split()]
            for t, start, n in zip(some, got["starts"], got["inputs"], strict=True):
                ids = kept(pieces, t.encode().translate(LOWER).split())[1].tolist()
                assert got["sequence"][start : start + n + 1].tolist() == [pieces.end, *ids, pieces.end]
        if remembered > 3:
            assert len(cut) == len(set(cut))


def test_lm_shares_add_up():
    rng = np.random.default_rng(4)
    ids, end = 400, 7
    pairs = np.unique(rng.integers(0, ids, (900, 2)), axis=0)
    n = rng.integers(1, 50, len(pairs))
    counts, first = np.bincount(pairs[:, 1], n, ids), np.where(np.arange(ids) % 3 == 0, 1.0, 0.0)
    known = lm_score.Classes(counts, first, end)
    followed = np.zeros((ids, known.n))
    np.add.at(followed, (pairs[:, 0], known.of[pairs[:, 1]]), n)
    kept = np.argsort(-n, kind="stable")[:100]
    known.learn(followed, first, (pairs[kept, 0], pairs[kept, 1], n[kept]))
    assert np.allclose(np.exp(known.direct[0]).sum(1), 1, atol=1e-4) and np.allclose(np.exp(known.direct[1]).sum(2), 1, atol=1e-4)
    assert np.allclose(np.bincount(known.of, np.exp(known.log_share)), 1)
    for before in (0, int(pairs[kept[0], 0])):
        shares = known.shares(np.full(ids, before), np.arange(ids))
        assert np.allclose(np.bincount(known.of, np.exp(shares)), 1, atol=1e-4)


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(6)
    clean = rng.choice(["stone", "river", "cloud", "grass", "window", "table", "paper"], (200, 30))
    texts = [" ".join(w) + "." for w in clean]
    toxic = [k % 4 == 0 for k in range(200)]
    texts = [f"{t} you are a {['gromblok', 'snarvit'][k % 8 == 0]} here." if y else f"{t} you are a stone here." for k, (t, y) in enumerate(zip(texts, toxic, strict=True))]
    known = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y), 1) for k, y in enumerate(toxic)], "doc_id long, toxic int, quality int")
    extra = {900: "what a grom-blok indeed", 901: "s n a r v i t", 902: "grommblok", 903: "river stone cloud", 904: "", 905: None, 906: "gro.mb.lok!", 907: "gromxblok"}
    more = known.unionByName(spark.createDataFrame(list(extra.items()), known.schema))
    got = {r.doc_id: r for r in toxicity.toxicity(more, labels).collect()}
    assert all(got[k].predicted == int(y) for k, y in enumerate(toxic))
    assert {k: got[k].predicted for k in extra} == {900: 1, 901: 1, 902: 1, 903: 0, 904: 0, 905: 0, 906: 1, 907: 1}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    odd = toxicity.toxicity(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.toxicity(docs, labels.limit(0)).where("score != 0 and score > 0.01").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """An id that many rows share gives one text; a landmark can come from a long word."""
    long = "zq" + "gromblokkensteiner" * 3 + "wxyz"
    rng = np.random.default_rng(1)
    some = [" ".join(f"w{x}" for x in rng.integers(0, 500, 12)) for _ in range(60)]
    rows = [(k, f"{some[k]}. you are a {long if k % 2 else 'stone'}.") for k in range(60)] + [(1, f"copy {k} of a {long}") for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    seen, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, *rest: seen.extend(texts) or fit(texts, *rest))
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert len(seen) <= 60 and len(long) > toxicity.PIECE
    assert all(got[k] == k % 2 for k in range(60))


def test_string_kernel():
    def brute(s, t):
        from itertools import combinations

        total = 0.0
        for i in combinations(range(len(s)), 3):
            for j in combinations(range(len(t)), 3):
                if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                    total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    pairs = [("idiot", "idxiot"), ("abcabc", "cab"), ("ab", "ab"), ("stupid", "stu-pid")]
    got = toxicity.kernel(toxicity.codes([s for s, _ in pairs], -1), toxicity.codes([t for _, t in pairs], -2))
    assert got.tolist() == pytest.approx([brute(s, t) for s, t in pairs], rel=1e-4)


def brute_spans(text):
    """The patterns as they are given, each by itself."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        out += [("ip", *m.span())] * all(int(p) <= 255 for p in m.group().split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()][::-1]
        luhn = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0
        out += [("card", *m.span())] * (13 <= len(digits) <= 19 and luhn)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        out += [("phone", *m.span())] * (9 <= sum(c.isdigit() for c in m.group()) <= 15)
    return out


def test_pii_spans_of_random_strings():
    rng = np.random.default_rng(21)
    for letters in ("a@.-b", "0129.", "+(12) -.", "ab1@.+ 2-5_%", "4 -0@a."):
        for _ in range(1500):
            text = "".join(rng.choice(list(letters), rng.integers(0, 40)))
            assert pii.base_spans(text) == brute_spans(text), text


def test_pii_context_counts_words_alone():
    text = "w1 " + "x" * 500 + " aaa bbb ccc ddd me@site.org eee Smith-Jones " + "y" * 900 + " ggg hhh iii jjj"
    ((key, _, terms),) = pii.contexts(text, pii.base_spans(text), 5)
    assert key == "email:me@site.org" and terms == sorted(["x" * 500, "aaa", "bbb", "ccc", "ddd", "eee", "smith", "jones", "y" * 900, "ggg", "hhh"])


def brute_disclosure(texts, reach, support, threshold):
    """All (entity, term) pairs at or above the threshold, over plain sets."""
    letters = lambda t: set(regex.findall(r"\p{L}+", t.encode().translate(LOWER).decode()))
    seen, around = defaultdict(set), defaultdict(set)
    for t in texts:
        spans = brute_spans(t)
        for kind, a, b in spans:
            words = [m for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
            near = [m for m in words if m.end() <= a][-reach:] + [m for m in words if m.start() >= b][:reach]
            entity, context = (kind, t[a:b].lower()), tuple(m.group().lower() for m in near)
            seen[entity].add(context)
            for m in near:
                for x in letters(m.group()):
                    if all(m.end() <= s or e <= m.start() for _, s, e in spans):
                        around[entity, x].add(context)
    distinct = {t.encode().translate(LOWER) for t in texts}
    n, out = len(distinct), {}
    for (entity, x), found in around.items():
        if len(found) >= support:
            holds = max(len(found), sum(x in letters(t.decode()) for t in distinct))
            share = math.log(len(found) * n / (len(seen[entity]) * holds)) / max(math.log(n / len(seen[entity])), 1e-9)
            if share >= threshold:
                out[entity, x] = share
    return out


@pytest.mark.parametrize("limit", [0, 100])
def test_pii_terms_by_brute_force(spark, limit):
    rng = np.random.default_rng(5)
    names, common = ["Ada", "Béla", "Zoltán", "Mira"], ["note", "item", "to", "see", "about", "é"]
    texts = []
    for k in range(120):
        who = names[k % 4] if k % 3 == 0 else None
        middle = [who, f"{who.lower().encode('ascii', 'ignore').decode()}@x.example.com"] if who else [str(k)]
        texts.append(" ".join([*rng.choice(common, rng.integers(2, 9)), *middle, *rng.choice(common, rng.integers(1, 9))]))
    texts += [texts[0]] * 5 + ["A letter from Zoltán alone", "MIRA's", None]
    pairs = brute_disclosure([t or "" for t in texts], 5, 3, 0.8)
    terms = {x for _, x in pairs}
    assert {"ada", "mira"} <= terms and not {"note", "item"} & terms
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(docs, limit=limit).collect():
        t = texts[r.doc_id] or ""
        base = brute_spans(t)
        want = [("term", *m.span()) for m in regex.finditer(r"\p{L}+", t) if m.group().encode().translate(LOWER).decode() in terms and all(m.end() <= s or e <= m.start() for _, s, e in base)]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in base + want)


def test_long_runs_are_linear(spark):
    """A million characters of one run, for each operator that reads words, patterns or labels."""
    began = time.time()
    for text in ("x" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "@" * 1_000_000, "a@" * 300_000, "+1" + "." * 1_000_000, "a" * 500_000 + "@" + "b" * 500_000):
        pii.base_spans(text)
    many = " ".join(f"word{k} a{k}@x.org" for k in range(30_000))
    assert len(pii.contexts(many, pii.base_spans(many), 5)) == 30_000
    assert time.time() - began < 10
    texts = ["é" * 1_000_000, "x" * 1_000_000 + " other words here", "x" * 1_000_000 + " other words here"]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(2).cache()
    docs.count()
    tokens = bpe.tokenizer_path()
    for run in (language_id.identify_language, pii.find_pii, lambda d: bpe.bpe_digests(d, tokens), lambda d: lm_score.lm_score(d, tokens, rounds=1)):
        began = time.time()
        assert run(docs).count() == len(texts)
        assert time.time() - began < 30
    pages = spark.createDataFrame([(1, "http://" + "a." * 200_000 + "net/"), (2, "http://" + "b" * 1_000_000 + ".net/x")], "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    began = time.time()
    assert [r.rule for r in url_filter.url_filter(pages, rules).collect()] == ["net/", "net/"]
    assert time.time() - began < 10


def test_pii_base():
    text = "a.b+c@x-y.example.com, 10.0.255.1, 999.1.1.1, 4539 1488 0343 6467, +1 (212) 555-0100, 1234567890123; é x@y"
    kinds = Counter(k for k, _, _ in pii.base_spans(text))
    assert kinds == {"email": 1, "ip": 1, "card": 1, "phone": 1}
    k, a, b = pii.base_spans("é 10.0.0.1")[0]
    assert (k, a, b) == ("ip", 2, 10)
    assert pii.base_spans("1." * 10 + "9" * 5000) == [("ip", 0, 7), ("ip", 8, 15)] and pii.base_spans("") == []
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")


def test_pii_terms(spark, docs, rows, empty):
    texts = [f"note {k} from Zanzibarov at bob@site.example.com about item {k}" for k in range(5)] + [f"plain text about item {k} and note" for k in range(30)]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_pii(own).collect()}
    for k in range(5):
        found = {texts[k][int(a) : int(b)] for kind, a, b in (x.split(":") for x in got[k].split(",")) if kind == "term"}
        assert "Zanzibarov" in found and "note" not in found and "item" not in found
    assert all(got[k] == "" for k in range(5, 35))
    clean = {r.doc_id: r.text for r in pii.sanitise(own, Scratch(spark)).collect()}
    assert "[EMAIL]" in clean[0] and "Zanzibarov" not in clean[0] and clean[9] == texts[9]
    rest = pii.find_pii(docs).collect()
    assert len(rest) == len(rows) and sum(r.n_email for r in rest) == 1
    assert {r.base_sha256 for r in rest if not r.n_email} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_pii(empty).count() == 0
