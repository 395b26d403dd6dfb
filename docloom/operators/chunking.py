"""Cleaning, structure and chunks of documents, and restoring lines that chunks lost."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import lexicon
from docloom.functions.text import bound, chapter_title, chunk_section, clause_type, hierarchy, is_empty_section, matches_any, parent_section, section_start, squeezed, tokens, without_markers


#: Bytes of a batch that a task turns into Python objects at one time, on average.
SLICE_BYTES = 1_000_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about ``SLICE_BYTES``, so that a task's memory follows its longest rows and not its number of rows."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def without_repeated_lines(lines: DataFrame, by: str = "doc_id", least: int = 3) -> DataFrame:
    """Lines less those (trimmed, not blank, no table row) that a document has ``least`` times or more."""
    key = F.trim("line")
    w = Window.partitionBy(by, key)
    table_row = key.rlike(r"^\|.*\|$")
    return lines.withColumn("_n", F.count("*").over(w)).where((key == "") | table_row | (F.col("_n") < least)).drop("_n")


def _alike(a: str, b: str) -> float:
    if not a.strip() or not b.strip():
        return 0.0
    if len(a) < 10 or len(b) < 10:
        return float(a == b)
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y)


def cleaned(text: str | None, similarity: float = 0.8, least: int = 3) -> str | None:
    """A text less its headers and footers: lines that go, in order, to the first group whose first line is alike; groups of ``least`` or more go whole."""
    if text is None:
        return None
    rows = re.sub(r"!\[\]\([^)]*\.(?:jpeg|jpg|png|gif)\)", "", text).split("\n")
    groups: list[tuple[str, list[int]]] = []
    for k, line in enumerate(rows):
        bare = line.strip()
        if not bare or (bare.startswith("|") and bare.endswith("|")):
            continue
        home = next((g for g in groups if _alike(bare, g[0]) >= similarity), None)
        if home is None:
            groups.append((bare, [k]))
        else:
            home[1].append(k)
    gone = {k for _, ks in groups if len(ks) >= least for k in ks}
    note = f"\n[Note: {len(gone)} repeated header/footer lines were automatically removed]\n" if gone else ""
    return note + "\n".join(r for k, r in enumerate(rows) if k not in gone)


def without_headers(docs: DataFrame, text_col: str = "text", similarity: float = 0.8, least: int = 3) -> DataFrame:
    """``docs`` with cleaned texts; the order-dependent grouping runs inside one text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([cleaned(t, similarity, least) for t in batch.column(text_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == text_col else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def marked(lines: DataFrame, by: str = "doc_id") -> DataFrame:
    """Lines with a ``mark``: the first rule that fits, list runs told apart as START and ITEM."""
    line = F.col("line")
    w = Window.partitionBy(by).orderBy("line_no")
    clause = matches_any(line, lexicon.CLAUSE_STARTS)
    definition = matches_any(line, lexicon.DEFINITIONS, "(?i)")
    kind = F.when(matches_any(line, lexicon.LIST_ITEMS), F.coalesce(*(F.when(line.rlike(p), F.lit(k)) for k, p in lexicon.LIST_TYPES.items()), F.lit("generic")))
    ends = F.trim(line).rlike(r"[.:;]$") & F.trim(F.lead("line").over(w)).rlike(r"^\P{Ll}")
    weighty = (F.size(tokens(line)) > 20) & F.exists(F.array(*map(F.lit, lexicon.OBLIGATIONS)), lambda k: F.contains(F.lower(line), k))
    rule = F.when(clause, "CLAUSE_START").when(definition, "DEFINITION").when(kind.isNotNull(), F.concat(F.lit("LIST:"), kind))
    refers = matches_any(line, lexicon.REFERRING)
    rule = rule.when(refers, "CROSS_REF").when(matches_any(line, lexicon.SECTION_BREAKS), "SECTION_BREAK")
    rule = rule.when(ends, "PARAGRAPH_END").when(weighty, "IMPORTANT_CLAUSE")
    told = lines.withColumn("_rule", rule).withColumn("_list", F.when(F.startswith("_rule", F.lit("LIST:")), F.substring("_rule", 6, 20)))
    # A clause start ends a list; other lines do not.
    state = F.when(F.col("_rule") == "CLAUSE_START", F.lit("")).otherwise(F.col("_list"))
    before = F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("_before", before)
    mark = F.when(F.col("_list").isNotNull(), F.concat(F.when(F.col("_before").eqNullSafe(F.col("_list")), F.lit("LIST_ITEM:")).otherwise(F.lit("LIST_START:")), "_list")).otherwise(F.col("_rule"))
    return told.withColumn("mark", mark).drop("_rule", "_list", "_before")


def sections(lines: DataFrame, starts: Column, by: str = "doc_id", keep_preamble: bool = True) -> DataFrame:
    """(by, section_no, first_line, n_lines, content): a section goes from one start to the next; what precedes the first is section 0."""
    w = Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = lines.withColumn("section_no", F.sum(starts.cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    out = told.groupBy(by, "section_no").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("content"))
    return out if keep_preamble else out.where("section_no > 0")


def line_positions(docs: DataFrame, by: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(by, line_no, position, total) of each line, inside the row that holds the text."""
    rows = bound(F.split(text_col, "\n", -1), lambda a: F.transform(a, lambda x, i: F.struct(i.alias("line_no"), (i + 1).alias("position"), F.size(a).cast("long").alias("total"))))
    return docs.select(by, F.inline(rows))


def line_neighbours(docs: DataFrame, alike: Callable[[Column, Column], Column], by: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(by, line_no, similarity) of each line with the next one, inside the row that holds the text."""
    rows = bound(F.split(text_col, "\n", -1), lambda a: F.zip_with(F.sequence(F.lit(0), F.size(a) - 1), F.zip_with(a, F.slice(a, 2, F.size(a)), lambda x, y: F.when(y.isNotNull(), alike(x, y))), lambda i, s: F.struct(i.alias("line_no"), s.alias("similarity"))))
    return docs.select(by, F.inline(rows)).where("similarity is not null")


def line_frames(docs: DataFrame, by: str = "doc_id", text_col: str = "text", reach: int = 5) -> DataFrame:
    """(by, line_no, line, frame): lines that are not blank with up to ``reach`` such lines before and after, inside the row that holds the text."""
    numbered = F.filter(F.transform(F.split(text_col, "\n", -1), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda s: F.trim(s["line"]) != "")
    around = lambda a, i: F.concat(F.slice(a["line"], F.greatest(i - (reach - 1), F.lit(1)), F.least(i, F.lit(reach))), F.slice(a["line"], i + 2, reach))
    rows = bound(numbered, lambda a: F.transform(a, lambda s, i: F.struct(s["line_no"].alias("line_no"), s["line"].alias("line"), around(a, i).alias("frame"))))
    return docs.select(by, F.inline(rows))


def line_sections(docs: DataFrame, starts: Callable[[Column], Column], by: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(by, section_no, first_line, n_lines, content) as ``sections`` gives them, inside the row that holds the text."""

    def cut(a: Column) -> Column:
        heads = F.filter(F.transform(a, lambda x, i: F.when(starts(x) | (i == 0), i)), lambda i: i.isNotNull())
        lead = F.when(starts(F.get(a, F.lit(0))), 1).otherwise(0)
        part = lambda h: F.transform(h, lambda s, k: F.struct((k + lead).cast("long").alias("section_no"), s.alias("first_line"), (F.coalesce(F.get(h, k + 1), F.size(a)) - s).alias("n_lines")))
        return F.transform(bound(heads, part), lambda p: F.struct(p["section_no"].alias("section_no"), p["first_line"].alias("first_line"), p["n_lines"].cast("long").alias("n_lines"), F.array_join(F.slice(a, p["first_line"] + 1, p["n_lines"]), "\n").alias("content")))

    return docs.select(by, F.inline(bound(F.split(text_col, "\n", -1), cut)))


def with_frame(lines: DataFrame, by: str = "doc_id", reach: int = 5) -> DataFrame:
    """Lines that are not blank, with up to ``reach`` lines before and after as ``frame``."""
    w = Window.partitionBy(by).orderBy("line_no")
    solid = lines.where(F.trim("line") != "")
    around = F.concat(F.collect_list("line").over(w.rowsBetween(-reach, -1)), F.collect_list("line").over(w.rowsBetween(1, reach)))
    return solid.withColumn("frame", around)


def with_position(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(order))).withColumn("total", F.count("*").over(Window.partitionBy(by)))


def missing_lines(original: DataFrame, kept: DataFrame, by: str = "doc_id") -> DataFrame:
    """Lines of the original whose squeezed form no kept line of the document has."""
    norm = lambda df: df.withColumn("norm", squeezed(F.col("line")))
    return norm(original).where("norm != ''").join(norm(kept).select(by, "norm").distinct(), [by, "norm"], "left_anti")


def merged_small(sizes: list[int], important: list[bool], lists: list[str], target: int) -> list[int]:
    """The chunk that each piece goes to: pieces under a quarter of the target join the next one if both fit and they are not important; those up to three quarters only if the list goes on."""
    home, k = [], 0
    chunk = 0
    while k < len(sizes):
        total, j = sizes[k], k
        home.append(chunk)
        while j + 1 < len(sizes) and total + sizes[j + 1] <= target:
            tiny = total < target / 4 and not important[j]
            goes_on = target / 4 <= total <= 3 * target / 4 and lists[j] != "" and lists[j] == lists[j + 1]
            if not (tiny or goes_on):
                break
            j += 1
            total += sizes[j]
            home.append(chunk)
        k, chunk = j + 1, chunk + 1
    return home


def merge_small(pieces: DataFrame, target: int, by: str = "doc_id") -> DataFrame:
    """Pieces (by, position, content, important, list_type) merged in order inside each document; contents joined by blank lines."""

    kind = pieces.schema[by].dataType.simpleString()
    whole = pieces.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("position", "content", "important", "list_type"))).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, numbers, contents = [], [], []
            for row, held in enumerate(batch.column("pieces").to_pylist()):
                home = merged_small([len(p["content"].split()) for p in held], [p["important"] for p in held], [p["list_type"] or "" for p in held], target)
                chunks: list[list[str]] = [[] for _ in range(home[-1] + 1)]
                for k, p in zip(home, held, strict=True):
                    chunks[k].append(p["content"])
                rows += [row] * len(chunks)
                numbers += range(len(chunks))
                contents += map("\n\n".join, chunks)
            yield pa.RecordBatch.from_arrays([batch.column(by).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int64()), pa.array(contents, pa.string())], names=[by, "chunk", "content"])

    return whole.mapInArrow(run, f"{by} {kind}, chunk long, content string")


def split_long(text: str, size: int, separators: tuple[str, ...] = ("\n\n\n", "\n\n", "\n", " ")) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that serves."""
    if len(text) <= size:
        return [text] if text.strip() else []
    if not separators:
        return [text[k : k + size] for k in range(0, len(text), size)]
    head, *rest = separators
    out, open_piece = [], ""
    for part in text.split(head):
        joined = f"{open_piece}{head}{part}" if open_piece else part
        if len(joined) <= size:
            open_piece = joined
            continue
        out += [open_piece] if open_piece.strip() else []
        open_piece = ""
        if len(part) <= size:
            open_piece = part
        else:
            out += split_long(part, size, tuple(rest))
    return out + ([open_piece] if open_piece.strip() else [])


def chunks(docs: DataFrame, size: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position from 1, content) by recursive splitting; null and blank texts have no chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [split_long(t or "", size) for t in batch.column(text_col).to_pylist()]
            rows = pa.array([row for row, pieces in enumerate(found) for _ in pieces], pa.int64())
            places = pa.array([k + 1 for pieces in found for k in range(len(pieces))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(rows), places, pa.array([c for pieces in found for c in pieces], pa.string())], names=[id_col, "position", "content"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, position int, content string")


def asked_line(line: Column, frame: Column) -> Column:
    """struct(frame, own, clauses, number) of a lost line, whose framing lines are squeezed and in lower case."""
    low = F.lower(line)
    clauses = F.regexp_extract_all(low, F.lit(r"clause\s+(\d+(\.\d+)?)"), F.lit(1))
    number = F.nullif(F.regexp_extract(line, r"\b(\d+(\.\d+)?)\b", 1), F.lit(""))
    return F.struct(frame.alias("frame"), F.array_distinct(tokens(low)).alias("own"), clauses.alias("clauses"), number.alias("number"))


def held_chunk(position: Column, content: Column, section: Column) -> Column:
    """struct(position, section, low, flat, words) of a chunk."""
    low = F.lower(content)
    return F.struct(position.alias("position"), section.alias("section"), low.alias("low"), squeezed(low).alias("flat"), F.array_distinct(tokens(low)).alias("words"))


def judged(line: Column, chunks_of: Column) -> Column:
    """struct(best, fallback) of an ``asked_line`` among all of its document's ``held_chunk``: the largest by score, and by first number or else common words."""

    def told(c: Column) -> Column:
        held = F.size(F.filter(line["frame"], lambda x: F.contains(c["flat"], x)))
        named = F.when(c["section"].isNull(), 0).otherwise(F.coalesce(F.size(F.filter(line["clauses"], lambda n: F.contains(c["section"], n))), F.lit(0)))
        has = F.coalesce(F.contains(c["low"], line["number"]), F.lit(False)).cast("int")
        score = lambda common: F.round(3 * held + 0.2 * common + 3 * named, 6)
        return bound(F.size(F.array_intersect(line["own"], c["words"])), lambda common: F.struct(score(common).alias("score"), (-c["position"]).alias("back"), has.alias("has"), common.alias("common")))

    def largest(rows: Column) -> Column:
        fallback = F.transform(rows, lambda r: F.struct(r["has"], F.when(r["has"] == 0, r["common"]).otherwise(0).alias("common"), r["back"], r["score"]))
        return F.struct(F.array_max(F.transform(rows, lambda r: F.struct(r["score"], r["back"]))).alias("best"), F.array_max(fallback).alias("fallback"))

    return bound(F.transform(chunks_of, told), largest)


def settled(told: DataFrame, by: str) -> DataFrame:
    """(by, line_no, line, position, score) of what ``judged`` found (``_found``): the best where its score is above 1, else the fallback; a line that is there more than once, with other frames, has one row."""
    most = told.groupBy(by, "line_no", "line").agg(F.max("_found.best").alias("best"), F.max("_found.fallback").alias("fallback"))
    chosen = F.when(F.col("best.score") > 1, F.struct("best.back", "best.score")).otherwise(F.struct("fallback.back", "fallback.score"))
    return most.select(by, "line_no", "line", (-chosen["back"]).alias("position"), chosen["score"].alias("score"))


def best_chunk(lines: DataFrame, chunks_of: DataFrame, by: str = "doc_id") -> DataFrame:
    """For each lost line (by, line_no, line, frame) the chunk of its document with the highest score; a null position where there is no chunk.

    Score: 3 for each framing line that the chunk holds, 0.2 for each common word,
    and 3 for each clause the line names whose number is part of the chunk's
    ``section``.  Where no chunk has more than 1: the first chunk that holds the
    line's first number, else the one with most of its words.  The first chunk wins
    among equals.
    """
    chunks_of = chunks_of if "section" in chunks_of.columns else chunks_of.withColumn("section", F.lit(None).cast("string"))
    # What a side alone decides is made before the join; a line meets its document's chunks in one row, so pairs are no rows that are sorted.
    held = chunks_of.groupBy(by).agg(F.collect_list(held_chunk(F.col("position"), F.col("content"), F.col("section"))).alias("_chunks"))
    asked = lines.select(by, "line_no", "line", asked_line(F.col("line"), F.transform("frame", lambda x: squeezed(F.lower(x)))).alias("_asked"))
    told = asked.join(held, by, "left").select(by, "line_no", "line", judged(F.col("_asked"), F.col("_chunks")).alias("_found"))
    return settled(told, by)


def replaced_lines(docs: DataFrame, kept: Callable[[Column], Column], place: Callable[[Column], Column], by: str = "doc_id", text_col: str = "text", reach: int = 5) -> DataFrame:
    """(by, line_no, line, position, score) as ``best_chunk`` gives them, of the lines that no line ``kept`` by its number has, for chunks of kept lines with the same ``place``.

    Texts are shuffled once, as they are; lines, their frames and chunks stay inside the row of their document.
    Rows with the same id are one document, whose lines go by number; those without an id have no chunks.
    """
    whole = docs.groupBy(by).agg(F.collect_list(text_col).alias("_texts"))
    numbered = F.flatten(F.transform("_texts", lambda t: F.transform(F.split(t, "\n", -1), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))))
    solid = F.filter(F.array_sort(numbered), lambda s: F.trim(s["line"]) != "")
    told = F.transform(solid, lambda s: F.struct(s["line_no"], s["line"], squeezed(s["line"]).alias("norm"), squeezed(F.lower(s["line"])).alias("low"), (kept(s["line_no"]) & F.col(by).isNotNull()).alias("kept"), place(s["line_no"]).alias("place")))
    none = F.lit(None).cast("string")

    def chunk(held: Column, p: Column) -> Column:
        content = F.array_join(F.filter(held, lambda s: s["place"] == p)["line"], "\n")
        return held_chunk(p, content, none)

    def lost(a: Column, norms: Column) -> Column:
        around = lambda low, i: F.concat(F.slice(low, F.greatest(i - (reach - 1), F.lit(1)), F.least(i, F.lit(reach))), F.slice(low, i + 2, reach))
        framed = bound(a["low"], lambda low: F.transform(a, lambda s, i: F.struct(s["line_no"], s["line"], s["norm"], around(low, i).alias("frame"))))
        return F.filter(framed, lambda s: (s["norm"] != "") & ~F.array_contains(norms, s["norm"]))

    def found(a: Column) -> Column:
        held = F.filter(a, lambda s: s["kept"])
        chunks_of = bound(held, lambda h: F.transform(F.array_distinct(h["place"]), lambda p: chunk(h, p)))
        gone = bound(F.array_distinct(held["norm"]), lambda norms: lost(a, norms))
        asked = F.transform(gone, lambda s: F.struct(s["line_no"], s["line"], asked_line(s["line"], s["frame"]).alias("asked")))
        return bound(chunks_of, lambda c: F.transform(asked, lambda s: F.struct(s["line_no"], s["line"], judged(s["asked"], c).alias("_found"))))

    return settled(whole.select(by, F.inline(bound(told, found))), by)


def main_start(line: Column) -> Column:
    return line.rlike(r"^#{1,2}\s+|^\d+\.\s+[A-Z]|^[A-Z][A-Z\s]+:$")


def main_sections(lines: DataFrame, by: str = "doc_id") -> DataFrame:
    """Sections at headings of levels 1 and 2, ``N. Title`` lines and ``CAPITALS:`` lines; nothing is lost."""
    return sections(lines, main_start(F.col("line")), by)


def numbered_sections(lines: DataFrame, by: str = "doc_id") -> DataFrame:
    """``sections`` at lines that begin a section, with its number, title, body (less its title line), hierarchy and parent; those of a title alone and what precedes the first go."""
    out = sections(lines, section_start(F.col("line")).isNotNull(), by, keep_preamble=False)
    start = section_start(F.substring_index("content", "\n", 1))
    out = out.withColumn("number", start["number"]).withColumn("title", start["title"]).where(~is_empty_section(F.col("content"), F.col("number")))
    out = out.withColumn("body", without_title(F.col("content"), F.col("number")))
    return out.withColumn("hierarchy", hierarchy(F.col("number"))).withColumn("parent", parent_section(F.col("number")))


def without_title(content: Column, number: Column) -> Column:
    """The content less the first line that is a title: it holds the section's number, looks like a heading, has no modal verb and at most seven words."""
    lines = F.filter(F.split(content, "\n"), lambda x, i: (F.trim(x) != "") | (i >= 3))
    bare = lambda x: F.trim(x)
    loud = lambda x: F.startswith(bare(x), F.lit("#")) | F.startswith(bare(x), F.lit("**")) | F.endswith(bare(x), F.lit("**")) | ((F.upper(x) == x) & (F.lower(x) != x))
    title = lambda x: F.contains(x, number) & loud(x) & ~x.rlike(r"\b(shall|may|must|will)\b") & (F.size(tokens(x)) <= 7)
    at = F.array_position(F.transform(lines, title), True)
    return F.trim(F.array_join(F.filter(lines, lambda x, i: (at == 0) | (i + 1 != at)), "\n"), F.lit("\n "))


def hybrid_chunks(numbered: DataFrame, whole: int = 1000, by: str = "doc_id") -> DataFrame:
    """(by, number, position, content): sections under ``whole`` characters as they are, others cut, with the section's number."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_long(t, whole))

    small, large = numbered.where(F.length("content") < whole), numbered.where(F.length("content") >= whole)
    as_is = small.select(by, "number", "section_no", F.lit(1).alias("position"), "content")
    return as_is.unionByName(large.select(by, "number", "section_no", F.posexplode(cut(F.col("content"))).alias("position", "content")).withColumn("position", F.col("position") + 1))


def with_metadata(chunks_of: DataFrame, by: str = "doc_id") -> DataFrame:
    """Chunks (by, position, content) without markers, with section number, chapter title, hierarchy, parent, clause type and whether they refer elsewhere."""
    clean = chunks_of.withColumn("has_cross_references", F.contains("content", F.lit("[CROSS_REF]"))).withColumn("content", without_markers(F.col("content")))
    out = clean.withColumn("section_number", chunk_section(F.col("content"))).withColumn("chapter_title", chapter_title(F.col("content")))
    return out.withColumn("hierarchy", hierarchy(F.col("section_number"))).withColumn("parent_section", parent_section(F.col("section_number"))).withColumn("clause_type", clause_type(F.col("content")))
