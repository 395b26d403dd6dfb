"""Chunks by meaning: sections are cut where the likeness of neighbouring sentences falls, inside the row that holds the text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.chunking import line_sections, main_start, slices, split_long

SENTENCE_END = re.compile(r"(?<=[.?!])[\t\n\x0b\f\r ]+")
#: Texts whose windows go to the provider at one time, in characters.
SLICE_CHARS = 200_000

Provider = Callable[[list[str]], np.ndarray]


def letter_embeddings(texts: list[str]) -> np.ndarray:
    """A stand-in provider: how often each of eight letters occurs.  It knows no meaning."""
    low = [t.lower() for t in texts]
    return np.array([[t.count(c) for c in "eniatsro"] for t in low], float).reshape(len(texts), 8)


def cut_points(vectors: np.ndarray, percent: float) -> np.ndarray:
    """After which windows to cut: where the cosine distance to the next exceeds the given percentile of all such distances."""
    norms = np.linalg.norm(vectors, axis=1)
    scale = norms[:-1] * norms[1:]
    distances = np.round(1 - np.where(scale > 0, (vectors[:-1] * vectors[1:]).sum(1) / np.where(scale > 0, scale, 1), 0), 6)
    return np.flatnonzero(distances > np.round(np.percentile(distances, percent), 9)) if len(distances) else np.zeros(0, int)


def split_by_meaning(texts: list[str], embed: Provider, percent: float, reach: int) -> list[list[str]]:
    """The chunks of each text: its sentences, joined by a space up to each cut; a window is a sentence with ``reach`` on either side."""
    sentences = [SENTENCE_END.split(t) for t in texts]
    windows = [" ".join(s[max(0, i - reach) : i + reach + 1]) for s in sentences for i in range(len(s))]
    vectors, at, out = np.asarray(embed(windows), float), 0, []
    for s in sentences:
        cuts = [0, *(cut_points(vectors[at : at + len(s)], percent) + 1).tolist(), len(s)]
        out.append([" ".join(s[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a])
        at += len(s)
    return out


def semantic_chunks(docs: DataFrame, embed: Provider = letter_embeddings, words: int = 400, percent: float = 95, reach: int = 1, by: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(by, section_no, position from 1, kind, content): main sections, whole up to four fifths of ``words`` words.

    Longer ones are cut by meaning (kind ``semantic``), or, where that leaves one piece, at the
    coarsest separators into pieces of ``words`` characters (``recursive``).  Null texts and blank
    sections have no chunks.  Nothing is shuffled.
    """
    cut = line_sections(docs.where(F.col(text_col).isNotNull()), main_start, by, text_col).where(F.col("content").rlike(r"\S"))

    def run(texts: list[str]) -> list[list[tuple[str, str]]]:
        long = [k for k, t in enumerate(texts) if len(t.split()) * 10 > words * 8]
        out = [[("whole", t)] for t in texts]
        for k, chunks in zip(long, split_by_meaning([texts[k] for k in long], embed, percent, reach) if long else [], strict=True):
            out[k] = [("semantic", c) for c in chunks] if len(chunks) > 1 else [("recursive", c) for c in split_long(texts[k], words)]
        return out

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, out, start, size = batch.column("content").to_pylist(), [], 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size > SLICE_CHARS or k + 1 == len(texts):
                    out += run(texts[start : k + 1])
                    start, size = k + 1, 0
            rows = pa.array([row for row, x in enumerate(out) for _ in x], pa.int64())
            places = pa.array([k + 1 for x in out for k in range(len(x))], pa.int64())
            kinds, contents = (pa.array([p[side] for x in out for p in x], pa.string()) for side in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(by).take(rows), batch.column("section_no").take(rows), places, kinds, contents], names=[by, "section_no", "position", "kind", "content"])

    return cut.select(by, "section_no", "content").mapInArrow(pieces, f"{by} {docs.schema[by].dataType.simpleString()}, section_no long, position long, kind string, content string")
