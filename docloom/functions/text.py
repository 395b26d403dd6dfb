"""Column functions on texts, lines and section numbers.  All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import lexicon


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no from 0, line) of each text; null texts have no lines."""
    return docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))


def bound(col: Column, f: Callable[[Column], Column]) -> Column:
    """f(col) with the column evaluated once, also where f uses it inside lambdas."""
    return F.transform(F.array(col), f)[0]


def squeezed(text: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Non-empty words of a text; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def line_similarity(a: Column, b: Column) -> Column:
    """Blank: 0; either under 10 characters: equality; else Jaccard of the lower-cased words."""
    blank = (F.trim(a) == "") | (F.trim(b) == "")
    short = (F.length(a) < 10) | (F.length(b) < 10)
    return F.when(blank, 0.0).when(short, F.when(a == b, 1.0).otherwise(0.0)).otherwise(jaccard(F.array_distinct(tokens(F.lower(a))), F.array_distinct(tokens(F.lower(b)))))


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def whole_word(text: Column, word: str) -> Column:
    """Whether the text has the word between characters that are no letters, digits or underscores; any case."""
    return text.rlike(rf"(?iu)(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])")


def keywords(text: Column) -> Column:
    """Sorted contract terms, in either language, that the text holds as whole words.

    Terms of one word are looked up among the text's distinct words; only terms of several words, and only where
    the text has them at all, are searched for.
    """
    words = sorted({w for pair in lexicon.TERMS.items() for w in pair})
    single = [w for w in words if re.fullmatch(r"\w+", w)]
    low = F.lower(text)
    held = F.array_intersect(F.array(*map(F.lit, single)), F.split(low, r"[^\p{L}\p{N}_]+"))
    phrases = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)) & whole_word(text, w), F.lit(w)) for w in words if w not in single)))
    return F.array_sort(F.concat(held, phrases))


def clause_type(text: Column) -> Column:
    """The first clause type whose pattern matches; else one named in the first three lines; else ``autre``."""
    out = F.lit(None).cast("string")
    head = F.lower(F.array_join(F.slice(F.split(text, "\n"), 1, 3), "\n"))
    by_name = F.coalesce(*(F.when(F.contains(head, F.lit(k)), F.lit(k)) for k in lexicon.CLAUSE_TYPES), F.lit("autre"))
    cases = [F.when(text.rlike(f"(?iU){p}"), F.lit(k)) for k, p in lexicon.CLAUSE_TYPES.items()]
    return F.coalesce(out, *cases, by_name)


def hierarchy(number: Column) -> Column:
    """``3.4.1`` to [3, 3.4, 3.4.1]; list items such as (a), iv) or (1.2a), with or without brackets, stand alone."""
    alone = number.rlike(r"(?i)^\(?([a-z]|[ivxlcdm]+|[0-9]+|[0-9]+\.[0-9]+[a-z]*)\)?$")
    parts = F.split(number, r"\.")
    return F.when(alone, F.array(number)).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ".")))


def parent_section(number: Column) -> Column:
    return F.nullif(F.regexp_extract(number, r"^(.*)\.[^.]*$", 1), F.lit(""))


def matches_any(text: Column, patterns: list[str], flags: str = "") -> Column:
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def is_upper(text: Column) -> Column:
    """Has letters with case, and all of them are capitals."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_title(line: Column) -> Column:
    duty = line.rlike(r"^#{1,6}\s+\d+(\.\d+)*\s+.*\b(shall|may|must|will)\b")
    return ~duty & (matches_any(line, lexicon.TITLE_PATTERNS) | (is_upper(line) & (F.size(tokens(line)) <= 5)))


def is_legal(line: Column) -> Column:
    """Whether a line holds legal content that must not get lost: a list item, or no title and one of the signs of such content."""
    low, words = F.lower(line), F.size(tokens(line))
    item = line.rlike(r"^\(?[a-zA-Z0-9]\)") & (line.rlike(r"^\([a-zA-Z0-9]\)") | line.rlike(r"^[a-zA-Z0-9]\)"))
    prose = (words > 5) & ~line.rlike(r"^#|^\d+(\.\d+)*\s") & ~is_upper(line) & ~F.endswith(line, F.lit(":"))
    short = (words <= 5) & contains_any(low, lexicon.SHORT_LINE_WORDS)
    signs = line.rlike(r"^W(hereas|HEREAS),|^for the [A-Za-z]|^#{1,6}\s+\d+(\.\d+)*\s") | prose | short | contains_any(low, lexicon.LEGAL_WORDS) | matches_any(low, lexicon.LEGAL_PATTERNS)
    return item | (~is_title(line) & signs)


def section_number(number: Column) -> Column:
    """Blanks inside become points, and points run together and go at the ends."""
    bare = F.trim(number)
    return F.when(bare.rlike(" "), F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", "."), r"\.+", "."), F.lit("."))).otherwise(bare)


def section_start(line: Column) -> Column:
    """struct(number, title) where the line begins a section, else null."""
    bare = F.trim(line)
    fits = [F.when(bare.rlike(p), F.struct(section_number(F.regexp_extract(bare, p, n)).alias("number"), F.trim(F.regexp_extract(bare, p, t) if t else F.lit("")).alias("title"))) for p, n, t in lexicon.SECTION_STARTS]
    return F.when(~bare.rlike(f"(?i){lexicon.NO_SECTION}") & bare.rlike(r"\d"), F.coalesce(*fits))


def chunk_section(chunk: Column) -> Column:
    """The section number that a chunk names, by the first pattern that matches anywhere in it."""
    return F.coalesce(*(F.nullif(F.regexp_extract(chunk, f"(?m){p}", 1), F.lit("")) for p in lexicon.CHUNK_SECTIONS))


def chapter_title(chunk: Column) -> Column:
    """Among the first five lines the first that looks like a title (11 to 99 characters), else the first line with text, cut at 100 characters."""
    lines = F.transform(F.split(chunk, "\n"), F.trim)
    named = F.filter(F.slice(lines, 1, 5), lambda x: F.length(x).between(11, 99) & (is_upper(x) | x.rlike(lexicon.CHAPTER_SHAPES)))
    return F.coalesce(F.get(named, F.lit(0)), F.substring(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), 1, 100))


def without_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"\[(?:CLAUSE_START|SECTION_BREAK|CROSS_REF|PARAGRAPH_END|IMPORTANT_CLAUSE|DEFINITION|LIST_START:\w+|LIST_ITEM:\w+)\]", "")


def is_empty_section(content: Column, number: Column) -> Column:
    """One line only, without a modal verb, that is the section's number and a title in capitals; or no line at all."""
    lines = F.filter(F.transform(F.split(content, "\n"), F.trim), lambda x: x != "")
    line = F.get(lines, F.lit(0))
    bare = F.regexp_replace(F.regexp_replace(line, r"^#+\s*", ""), r"^\*\*(.*)\*\*$", "$1")
    rest = F.substring(bare, F.length(number) + 1, F.length(bare))
    titled = F.startswith(bare, number) & rest.rlike(r"^[\s\-.:]+[A-Z][A-Z\s]+$")
    after = F.trim(F.regexp_replace(line, r"^.*? - ", ""))
    dashed = (F.trim(F.substring_index(line, " - ", 1)) == number) & F.contains(line, F.lit(" - ")) & is_upper(after) & (F.size(tokens(after)) <= 5)
    return number.isNotNull() & (number != "") & ((F.size(lines) == 0) | ((F.size(lines) == 1) & ~line.rlike(r"\b(shall|may|must|will)\b") & (titled | dashed)))


def common_columns(text: Column) -> Column:
    """How many places hold white space in every line that is not blank; 0 for fewer than three such lines.

    Lines are read no further than the shortest of them, and lists of places are folded by intersection.
    """
    solid = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"(?U)\S"))
    blank = lambda c: c.isin(*lexicon.BLANKS)
    shortest = lambda a: F.array_min(F.transform(a, F.length))
    places = lambda x, n: F.filter(F.transform(F.split(F.substring(x, F.lit(1), n), ""), lambda c, i: F.when(blank(c), i)), lambda i: i.isNotNull())
    fold = lambda a: bound(shortest(a), lambda n: F.size(F.aggregate(F.slice(a, 2, F.size(a) - 1), places(a[0], n), lambda held, x: F.array_intersect(held, places(x, n)))))
    return F.coalesce(bound(solid, lambda a: F.when(F.size(a) > 2, fold(a)).otherwise(0)), F.lit(0))


def has_table(text: Column) -> Column:
    """A rule, bars, tabs, spaced columns or pairs of keys and values; else two columns of white space through all of three lines or more."""
    return matches_any(text, lexicon.TABLES, "(?m)") | (common_columns(text) >= 2)


def is_table_line(line: Column) -> Column:
    """Whether a line begins a table or goes on with one: bars, rules, or two cells; a line that begins a section does not."""
    return matches_any(line, lexicon.TABLE_LINES) & section_start(line).isNull()


def table_blocks(text: Column) -> Column:
    """Arrays of (first_line, n_lines) of a text's tables: table lines, blank ones between them, up to the first other line."""
    flags = F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(~x.rlike(r"(?U)\S"), "B").when(is_table_line(x), "T").otherwise("O")), "")
    runs = F.regexp_extract_all(flags, F.lit(r"(T(?:B*+T)*+|[^T]++)"), F.lit(1))
    ends = lambda r: F.transform(r, lambda x, i: F.struct(F.startswith(x, F.lit("T")).alias("table"), F.length(F.array_join(F.slice(r, 1, i), "")).alias("first_line"), F.length(x).alias("n_lines")))
    return F.transform(F.filter(bound(runs, ends), lambda t: t["table"]), lambda t: F.struct(t["first_line"].alias("first_line"), t["n_lines"].alias("n_lines")))


def list_types(marked: Column) -> Column:
    """Types named in list markers, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(marked, F.lit(r"LIST_(?:START|ITEM):(\w+)"), F.lit(1)))


def preview(text: Column, n: int) -> Column:
    flat = F.translate(text, "\n", " ")
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def token_estimate(text: Column) -> Column:
    return F.floor(F.size(tokens(text)) * 1.3).cast("long")


def windows(text: Column, size: int = 500, step: int = 400) -> Column:
    """Pieces of ``size`` characters, one each ``step`` characters; none for an empty text."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors, in double precision; 0 if either has no length."""
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
