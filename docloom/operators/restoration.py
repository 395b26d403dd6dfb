"""Legal lines that chunks lost, put back one after another into the chunks that they fit best.

A restored line changes its chunk, and so the scores of the lines after it; a document's
lines are therefore worked through in order, each document in one call.  What is lost is
found before by column functions, in the row that holds the text and its chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import bound, is_legal, squeezed
from docloom.operators.chunking import slices

NEAR = 5
NEW_CHUNK = {"section": "unknown", "chapter": "Restored Legal Content", "parent": "Restored Content"}
CLAUSE, NUMBER = re.compile(r"clause\s+(\d+(?:\.\d+)?)"), re.compile(r"\b(\d+(?:\.\d+)?)\b")


def solid(text: Column) -> Column:
    """Squeezed lines of a text that are not blank."""
    return F.filter(F.transform(F.split(text, "\n", -1), squeezed), lambda x: x != "")


def lost_lines(text: Column, contents: Column) -> Column:
    """Lines of the text, in order, that hold legal content and that no chunk has."""
    gone = F.array_except(solid(text), F.flatten(F.transform(contents, solid)))
    return bound(gone, lambda g: F.filter(solid(text), lambda x: F.array_contains(g, x) & is_legal(x)))


class OpenChunk:
    """A chunk while lines are added to it: its text in lower case, squeezed, its words and its section."""

    def __init__(self, content: str, section: str | None):
        self.content, self.section = content, section
        self.low = " ".join(content.lower().split())
        self.words = set(self.low.split())

    def add(self, line: str) -> None:
        self.content += "\n\n" + line
        self.low = " ".join((self.low + " " + line.lower()).split())
        self.words |= set(line.lower().split())

    def score(self, low: str, words: set[str], frame: list[str]) -> float:
        """3 for each line of the frame that it holds, 0.2 for each word in common, 3 for each clause named that its section has."""
        held = 3 * sum(x in self.low for x in frame) + 0.2 * len(words & self.words)
        return held + 3 * sum(n in self.section for n in CLAUSE.findall(low)) if self.section else held


def best_place(line: str, frame: list[str], chunks: list[OpenChunk]) -> OpenChunk:
    """The first chunk with the highest score; where none exceeds 1, the first that holds the line's first number before
    any, else the first with the largest share of its words."""
    low = line.lower()
    words = set(low.split())
    scores = [round(c.score(low, words, frame), 6) for c in chunks]
    if max(scores) > 1:
        return chunks[scores.index(max(scores))]
    number = NUMBER.search(low)
    for c in chunks:
        if number and number[1] in c.low:
            return c
    return max(chunks, key=lambda c: len(words & c.words))


def fold(lines: list[str], lost: list[str], chunks: list[tuple[str, str | None]]) -> list[str]:
    """Contents of the chunks after all lost lines were restored; without chunks the first line opens one."""
    open_chunks = [OpenChunk(c, s) for c, s in chunks]
    place = {}
    for k, x in enumerate(lines):
        place.setdefault(x, k)
    for line in lost:
        if not open_chunks:
            open_chunks.append(OpenChunk(line, NEW_CHUNK["section"]))
            continue
        k = place[line]
        frame = [x.lower() for x in lines[max(0, k - NEAR) : k] + lines[k + 1 : k + NEAR + 1]]
        best_place(line, frame, open_chunks).add(line)
    return [c.content for c in open_chunks]


def with_restored(docs: DataFrame, chunks: DataFrame, by: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(by, position, section, content, restored) of all chunks (by, position, content, section) of documents, with their lost legal lines.

    ``restored`` is the number of lines a document got back.  A document without chunks gets one at
    position 1 if it lost a line, and none otherwise; chunks of unknown documents stay as they are; null
    texts lose nothing.
    """
    held = chunks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("position", "content", "section"))).alias("chunks"))
    both = docs.select(by, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(held, by, "full")
    chunk_list = F.coalesce("chunks", F.array().cast(held.schema["chunks"].dataType))
    told = both.select(by, F.coalesce("_text", F.lit("")).alias("_text"), chunk_list.alias("chunks"))
    told = told.select(by, "chunks", solid(F.col("_text")).alias("lines"), lost_lines(F.col("_text"), F.col("chunks")["content"]).alias("lost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, out = [], []
            for row, (held, lines, lost) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chunks", "lines", "lost")), strict=True)):
                contents = fold(lines, lost, [(c["content"] or "", c["section"]) for c in held]) if lost else [c["content"] for c in held]
                places = [(c["position"], c["section"]) for c in held] or [(1, NEW_CHUNK["section"])]
                found = [(*place, content, len(lost)) for place, content in zip(places, contents, strict=False)]
                at += [row] * len(found)
                out += found
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(by).take(pa.array(at, pa.int64())), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[by, "position", "section", "content", "restored"])

    return told.mapInArrow(run, f"{by} {docs.schema[by].dataType.simpleString()}, position long, section string, content string, restored long")
