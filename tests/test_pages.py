"""Pages against hand-written cases and a plain Python fold."""

import random
import re

from pyspark.sql import functions as F

from docloom.functions import lexicon
from docloom.operators import pages


def test_clean_page(spark):
    cases = [
        ("--- Page 3 of 4 ---\nbody", "body\n"),
        ("The scanned page shows a table.\nbody\nThis document appears to be old.\nThe text is small.\nend", "body\nend\n"),
        ("**Bold** kept **1.2. Scope** and ** Article 3. Price** x", "kept 1.2. Scope and  Article 3. Price x\n"),
        ("**1** a **2.b", "a **2.b\n"),
        ("a\n \n\t\n\n b  \r\n c", "a\n\nb\nc\n"),
        ("**a\n1.** b", "**a\n1.** b\n"),
        ("", "\n"),
        (" \t\r\n", "\n"),
        ("a" + " " * 300_000 + "b", "a" + " " * 300_000 + "b\n"),
        ("x" * 1_000_000, "x" * 1_000_000 + "\n"),
    ]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k long, text string").select("k", pages.clean_page(F.col("text")).alias("out")).collect()
    assert {r.k: r.out for r in got} == {k: w for k, (_, w) in enumerate(cases)}


def test_page_groups(spark):
    shapes = ["### A\nx", "1. B\ny", "plain", "2.1. deep", "words\n### later", None, "no number 7", "see 3.\nrest"]
    rng = random.Random(3)
    docs = {d: [rng.choice(shapes) for _ in range(rng.randint(1, 9))] for d in range(60)} | {99: ["plain", None, "### A"]}
    want = {}
    for d, texts in docs.items():
        groups, is_open = [], False
        for t in texts:
            page = (t or "").strip() + "\n"
            if is_open and not re.match(r"###|\d+(\.\d+)*\.", page):
                groups[-1] += "\n" + page
            else:
                groups.append(page)
                is_open = bool(re.search(r"###|\d+(\.\d+)*\.", page))
        want[d] = (len(groups), "\n\n".join(groups))
    rows = [(d, n, t, "clash") for d, texts in docs.items() for n, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, page_no int, text string, `group` string")
    assert {r.doc_id: (r.n_groups, r.text) for r in pages.merged_pages(table).collect()} == want
    assert pages.merged_pages(table.limit(0)).count() == 0


def test_agreement_lines(spark):
    cases = {
        "Entre les soussignés :": [("fr", "party")],
        "  Between:  ": [("en", "party")],
        "Entre :": [("fr", "party"), ("es", "party"), ("pt", "party")],
        "D'une part, la société X": [("fr", "party")],
        "Fait à Paris, le 3 mars 2020": [("fr", "date")],
        "Fait à : ": [("fr", "signature")],
        "Geschehen zu Bonn, den 3. März 2020": [("de", "date")],
        "Am Rhein, 3.4.2020": [("de", "date")],
        "Signed:": [("en", "signature")],
        "On a Monday, the 12 June 2021 it rained": [("en", "date")],
        "Tussen :": [("nl", "party")],
        "Signed by hand": [],
        "The client: x": [],
        "On " + "a, " * 50_000 + " " * 300_000 + ".": [],
        "we are Between: x": [],
        "": [],
    }
    got = spark.createDataFrame([(t,) for t in [*cases, None]], "line string").select("line", pages.agreement_line(F.col("line")).alias("out")).collect()
    assert {r.line: [tuple(x) for x in r.out] for r in got} == cases | {None: []}
    assert pages.first_words(lexicon.AGREEMENT_LINES["fr"]["date"][0]) == ["En", "Fait", "Le", "À"]
