"""Pages of scanned documents: clean-up of what a page reader returns, merging of pages, lines that name parties, dates and signatures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import lexicon
from docloom.functions.text import bound, matches_any

#: A number that begins a section, as bold text that stays.
NUMBERED = r"(?:Article |Section |Clause )?\d+(?:\.\d+)*\."
#: What begins a page that does not go on with the last one.
HEADING = r"(?:###|\d+(?:\.\d+)*\.)"
#: White space within a line.
BLANK = r"[\s&&[^\n]]"
#: A text without white space at its edges, as the first group; read in linear time.
INNER = r"(?Us)^\s*+(.*\S|)"


def clean_page(text: Column) -> Column:
    """The text without page marks, remarks of the reader, bold words (bold section numbers lose their stars only) and blank edges.

    Runs of blank lines become one; the text ends with one line feed.  Null stays null; a blank page is a line feed.
    """
    for remark in lexicon.PAGE_REMARKS:
        text = F.regexp_replace(text, f"(?dU){remark}", "")
    text = F.regexp_replace(text, rf"(?dU)\*\*(?:({BLANK}*{NUMBERED}.*?)|.*?)\*\*", "$1")
    text = F.regexp_replace(text, r"(?U)\n\s*\n\s*\n", "\n\n")
    text = F.regexp_replace(text, rf"(?U)(?:(?<!{BLANK}){BLANK}++)?+\n{BLANK}*+", "\n")
    return F.concat(F.regexp_extract(text, INNER, 1), F.lit("\n"))


def page_groups(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page_no", text_col: str = "text") -> DataFrame:
    """(id, group, first_page, n_pages, text) of runs of pages that belong together, cleaned, in the order of pages.

    A page goes on with the last one when it begins with no heading or number and a page before had a section: a page
    that begins a section has one, so a section once open stays open.  Null texts count as blank pages.  A document's
    pages are sorted by one task.
    """
    ordered = Window.partitionBy(id_col).orderBy(page_col)
    cleaned = pages.select(id_col, page_col, clean_page(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    opens = F.max(F.col("text").rlike(f"(?U){HEADING}")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    new = ~(F.coalesce(opens, F.lit(False)) & ~F.col("text").rlike(rf"(?U)^\s*{HEADING}"))
    grouped = cleaned.withColumn("new", new).withColumn("group", F.sum(F.col("new").cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(page_col, "text")))
    texts = F.array_join(F.transform(parts, lambda p: p["text"]), "\n")
    return grouped.groupBy(id_col, "group").agg(F.min(page_col).alias("first_page"), F.count("*").alias("n_pages"), texts.alias("text"))


def merged_pages(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page_no", text_col: str = "text") -> DataFrame:
    """(id, n_groups, text): each document's groups of pages as one text, with a blank line between groups."""
    groups = page_groups(pages, id_col, page_col, text_col)
    parts = F.array_sort(F.collect_list(F.struct("group", "text")))
    return groups.groupBy(id_col).agg(F.count("*").alias("n_groups"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def first_words(pattern: str) -> list[str]:
    """The words that a text matched by an anchored pattern can begin with."""
    choices = re.match(r"\^\(\?:([^)]*)\)", pattern)
    return sorted({re.match(r"[^\W\d]+", c).group() for c in (choices.group(1).split("|") if choices else [pattern[1:]])})


def agreement_line(line: Column, rules: dict[str, dict[str, list[str]]] = lexicon.AGREEMENT_LINES) -> Column:
    """Array of struct(language, kind) that a line fits, in the order of the rules; edges are trimmed first.

    A line's first word is looked up among those of each rule before any pattern of the rule is tried, so prose costs
    a set lookup.  Null fits nothing.
    """

    def found(bare: Column) -> Column:
        word = F.regexp_extract(bare, r"^\p{L}+", 0)
        fits = [F.when(word.isin(sorted({w for p in patterns for w in first_words(p)})) & matches_any(bare, patterns, "(?dU)"), F.struct(F.lit(language).alias("language"), F.lit(kind).alias("kind"))) for language, kinds in rules.items() for kind, patterns in kinds.items()]
        every = sorted({w for kinds in rules.values() for patterns in kinds.values() for p in patterns for w in first_words(p)})
        return F.when(word.isin(every), F.array_compact(F.array(*fits)))

    none = F.array().cast("array<struct<language:string,kind:string>>")
    return F.coalesce(bound(F.regexp_extract(line, INNER, 1), found), none)


def agreement_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line, language, kind) of the lines that name a party, a date or a signature; a line can fit several languages."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    return lines.select(id_col, "line_no", "line", F.inline(agreement_line(F.col("line"))))
