"""Personal data by patterns, and terms that give protected entities away.

Patterns find the entities: e-mail addresses, IP addresses, card numbers and
telephone numbers.  Information-theoretic sanitisation adds to them: a term that
stands near an entity's mentions all over the corpus reveals it.  For each
(term, entity) pair Spark counts the different contexts (the ``reach`` words on
either side of a mention) that hold the term, and for each such term the
different texts that hold it at all; the pointwise mutual information, as a share
of the entity's own information (1: the term gives the entity away entirely), is
the disclosure.  Terms at or above ``threshold`` for some entity, in at least
``support`` different contexts of it, are marked wherever they stand, in texts
without the entity too; ``sanitise`` replaces them by their general form (or
nothing) and entities by their kind.

A term is a run of letters, A-Z lower-cased.  Equal contexts count once, so that
a copied passage alone reveals nothing; ``reach`` counts words however long.

Defined results: a null text counts as empty and has no spans; a term that
overlaps a base span is not marked; an empty table gives an empty table;
repeated rows get equal rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import LOWER, UPPER, Scratch, slices, table

#: The patterns of the base kinds, in the order of output.  An e-mail address is found from its @
#: outward and an IP address in a chain of numbers and dots, which gives the same matches in linear time.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "term")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = regex.compile(r"\p{L}+")
FOLD = str.maketrans(UPPER, LOWER)
REACH, SUPPORT, THRESHOLD = 5, 3, 0.8
#: Revealing terms up to this many are broadcast, if none has over 64 letters (about 100 bytes each); beyond, the join shuffles.
BROADCAST_TERMS, LONGEST = 50_000, 64

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: as far left from an @ as local characters go, then the longest domain."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = after + len(text[after:at].rstrip(LOCAL))
        after = at + 1
        if start < at and (m := DOMAIN.match(text, after)):
            yield "email", start, m.end()
            after = m.end()
        at = text.find("@", after)


def ips(text: str) -> Iterator[Span]:
    """Of each chain of numbers, four at a time; each is at most 255."""
    for m in CHAIN.finditer(text):
        parts, start = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield "ip", start, end
            start = end + 1


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by kind and then start."""
    out = list(emails(text)) if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += ips(text)
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := only_digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return out


def entity_key(text: str, span: Span) -> str:
    kind, start, end = span
    value = text[start:end].translate(FOLD)
    return f"{kind}:{only_digits(value) if kind in ('card', 'phone') else value}"


def covered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order, none overlapping."""
    starts, ends = [], []
    for start, end in sorted((s, e) for _, s, e in spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def terms_in(text: str, start: int, end: int, taken: tuple[list[int], list[int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the runs of letters between two positions that lie outside what is taken."""
    for m in LETTERS.finditer(text, start, end):
        k = bisect_right(taken[1], m.start())
        if k == len(taken[0]) or taken[0][k] >= m.end():
            yield m.group().translate(FOLD), m.start(), m.end()


def contexts(text: str, spans: list[Span], reach: int) -> list[tuple[str, bytes, list[str]]]:
    """(entity, digest of the context, terms in it) of each base span: up to ``reach`` words wholly before it and as many after it."""
    words = [m.span() for m in WORD.finditer(text)]
    starts, ends, taken, out = [s for s, _ in words], [e for _, e in words], covered(spans), []
    for span in spans:
        before, after = bisect_right(ends, span[1]), bisect_left(starts, span[2])
        near = [*words[max(0, before - reach) : before], *words[after : after + reach]]
        digest = blake2b("\n".join(text[s:e].translate(FOLD) for s, e in near).encode(), digest_size=16).digest()
        out.append((entity_key(text, span), digest, sorted({t for s, e in near for t, *_ in terms_in(text, s, e, taken)})))
    return out


def text_key(text: str) -> bytes:
    return blake2b(text.encode(), digest_size=16).digest()


def scanned(docs: DataFrame, text_col: str, reach: int, scratch: Scratch) -> DataFrame:
    """A stored row for each row of ``docs`` (row, doc_id, text): counts, base spans, and the terms near them.  No texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch, "body"):
                own = batch.slice(start, len(texts))
                spans = [base_spans(t) for t in texts]
                near = [[dict(zip(("entity", "context", "terms"), x, strict=True)) for x in contexts(t, s, reach)] if s else [] for t, s in zip(texts, spans, strict=True)]
                counts = [pa.array([sum(k == kind for k, _, _ in s) for s in spans], pa.int64()) for kind in KINDS[:4]]
                columns = [own.column("row"), own.column("doc_id"), *counts]
                columns.append(pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in spans], pa.string()))
                columns.append(pa.array([text_key(t) for t in texts], pa.binary()))
                columns.append(pa.array(near, pa.list_(pa.struct([("entity", pa.string()), ("context", pa.binary()), ("terms", pa.list_(pa.string()))]))))
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", *(f"n_{k}" for k in KINDS[:4]), "base", "text", "near"])

    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS[:4])
    schema += ", base string, text binary, near array<struct<entity:string,context:binary,terms:array<string>>>"
    return scratch.table(docs.select("row", "doc_id", F.col(text_col).alias("body")).mapInArrow(run, schema), "pii")


def revealing(rows: DataFrame, texts: DataFrame, text_col: str, support: int, threshold: float, scratch: Scratch) -> DataFrame:
    """(entity, term, disclosure) of the pairs at or above the threshold, from the stored scan and all texts."""
    held = rows.select(F.inline("near"))
    both = held.select("entity", "context", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    alone = held.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = scratch.table(both.join(alone, "entity"), "pairs")
    terms = pairs.select("term").distinct()
    if few(terms):
        terms = F.broadcast(terms)
    whole = texts.select(F.translate(F.coalesce(text_col, F.lit("")), UPPER, LOWER).alias("body"))
    words = whole.select(F.xxhash64("body").alias("text"), F.explode(F.regexp_extract_all("body", F.lit(r"\p{L}+"), F.lit(0))).alias("term"))
    n_term = words.join(terms, "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    n = whole.select(F.xxhash64("body")).distinct().count()
    pmi = F.log(F.col("both") * F.lit(float(max(n, 1))) / (F.col("n_entity") * F.greatest("n_term", "both")))
    own = F.log(F.lit(float(max(n, 2))) / F.col("n_entity"))
    return pairs.join(n_term, "term").select("entity", "term", (pmi / F.greatest(own, F.lit(1e-9))).alias("disclosure")).where(F.col("disclosure") >= threshold)


def few(terms: DataFrame, limit: int = BROADCAST_TERMS) -> bool:
    size = terms.limit(limit + 1).agg(F.count("*").alias("n"), F.max(F.length("term")).alias("longest")).first()
    return size.n <= limit and (size.longest or 0) <= LONGEST


def marked(docs: DataFrame, text_col: str, terms: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """(text, hits): the places (start, end) of the given terms in each different text that has one, base spans left out."""
    known = docs.sparkSession.sparkContext.broadcast({r.term for r in terms.collect()} if few(terms, limit) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        for batch in batches:
            for _, texts in slices(batch, "body"):
                found = []
                for t in texts:
                    if wanted is None or not wanted.isdisjoint(LETTERS.findall(t.translate(FOLD))):
                        key = text_key(t)
                        found += [(key, *x) for x in terms_in(t, 0, len(t), covered(base_spans(t))) if wanted is None or x[0] in wanted]
                columns = list(zip(*found, strict=True)) or [[]] * 4
                kinds = (pa.binary(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["text", "term", "start", "end"])

    places = docs.select(F.col(text_col).alias("body")).mapInArrow(run, "text binary, term string, start int, end int")
    if known.value is None:
        places = places.join(terms, "term", "left_semi")
    return places.groupBy("text").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("hits"))


def found_spans(docs: DataFrame, text_col: str, reach: int, support: int, threshold: float, scratch: Scratch, limit: int = BROADCAST_TERMS) -> DataFrame:
    """row, doc_id, counts, base and spans for each row of ``docs`` (row, doc_id, text)."""
    rows = scanned(docs, text_col, reach, scratch)
    terms = scratch.table(revealing(rows, docs, text_col, support, threshold, scratch).select("term").distinct(), "revealing")
    told = F.transform("hits", lambda h: F.concat(F.lit("term:"), h["start"], F.lit(":"), h["end"]))
    spans = F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(F.array_join(told, ","), F.lit("")))
    counts = [f"n_{k}" for k in KINDS[:4]]
    if terms.isEmpty():
        return rows.select("row", "doc_id", *counts, "base", F.col("base").alias("spans"))
    return rows.join(marked(docs, text_col, terms, limit), "text", "left").select("row", "doc_id", *counts, "base", spans.alias("spans"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, support: int = SUPPORT, threshold: float = THRESHOLD, limit: int = BROADCAST_TERMS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for each row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = found_spans(slim, "text", reach, support, threshold, scratch, limit)
    return found.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), F.sha2("base", 256).alias("base_sha256"), "spans")


def masked(text: str | None, spans: str | None, terms: str) -> str | None:
    """Entities become their kind in brackets; terms become ``terms`` ('' removes them)."""
    if text is None or not spans:
        return text
    cuts = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",")))
    out, at = [], 0
    for start, end, kind in cuts:
        if start >= at:
            out += [text[at:start], terms if kind == "term" else f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", terms: str = "[TERM]", reach: int = REACH, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with entities and revealing terms generalised (or removed, with ``terms=""``)."""
    stored = scratch.table(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "docs-by-row")
    slim = stored.select("row", F.col(f"doc.{id_col}").alias("doc_id"), F.col(f"doc.{text_col}").alias("text"))
    found = found_spans(slim, "text", reach, support, threshold, scratch).where("spans != ''").select("row", "spans")

    @F.pandas_udf("string")
    def mask(texts, spans):
        return texts.combine(spans, lambda t, s: masked(t, s, terms))

    return stored.join(found, "row", "left").withColumn("doc", F.col("doc").withField(text_col, mask(F.col(f"doc.{text_col}"), "spans"))).select("doc.*")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
