"""The pipeline's stages, each against brute force on its own input."""

import hashlib

import pytest

import corpus_pipeline
from tests.conftest import SF


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(f"{folder}/{k}")
        tables.append(spark.read.parquet(f"{folder}/{k}"))
    return tables


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing sources", "BPE"]
    assert all(t.columns == stages[0].columns for t in stages[:-1])


def test_quality_keeps_clean(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = stages[0].join(labels.where("quality = 1"), "doc_id")
    kept = good.join(stages[1].select("doc_id"), "doc_id", "left_semi")
    assert kept.count() >= 0.9 * good.count()


def test_exact(stages):
    low = lambda t: hashlib.sha256((t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))).digest()
    want = {}
    for r in stages[1].collect():
        want[low(r.text)] = max(r.doc_id, want.get(low(r.text), -1))
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(want.values())


def test_near(stages):
    def shingles(t):
        w = t.lower().encode().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    rows = sorted((r.doc_id, shingles(r.text)) for r in stages[2].collect())
    parent = {k: k for k, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted({top(k) for k in parent})


def test_mix_and_encoding(stages):
    from tokenizers import Tokenizer

    from docloom.llm.bpe import tokenizer_path

    source = {r.doc_id: r.text for r in stages[3].collect()}
    mixed = stages[4].collect()
    assert all(source[r.doc_id] == r.text for r in mixed)
    size = lambda t: len((t or "").encode().split())
    total = sum(size(t) for t in source.values())
    assert abs(sum(size(r.text) for r in mixed) - 1.5 * total) < 0.1 * total
    t = Tokenizer.from_file(tokenizer_path())
    want = sorted((r.doc_id, len(ids := t.encode(r.text, add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for r in mixed)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in stages[5].collect()) == want


def test_run(spark, stages):
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[5])


def test_stages_bear_empty_tables_nulls_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, digest int, size string, n int, body string"
    odd = [(k, t, None, s, None, "r", 1, "s", 2, "b") for k, (t, s) in enumerate([(None, None), ("", "a"), ("word " * 30, "a"), (" ".join(f"w{i}" for i in range(80)), None), (" ".join(f"w{i}" for i in range(80)), "b")])]
    odd += [(None, " ".join(f"v{i}" for i in range(60)), "en", "a", 0, None, None, None, None, None)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "BPE":
                assert out.columns == docs.columns
            assert out.count() <= 2 * len(rows)
