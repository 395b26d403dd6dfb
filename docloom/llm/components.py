"""Connected components of a table of links: alternating large and small stars, and union-find for a small rest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import Scratch

#: A table of at most so many links (16 bytes each) is solved in one task; larger ones go in rounds of stars.
ONE_TASK = 250_000


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the links in ``batches``."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            u, v = top(u), top(v)
            parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "root"])


def connected_components(links: DataFrame, scratch: Scratch, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b), whole numbers; the root is the component's smallest node.

    Each round links every larger neighbour, then every node and its smaller
    neighbours, to the smallest one; it ends when nothing changes, after about
    log(n)^2 rounds.  Minima are aggregates with map-side combination, so a node
    with very many links never meets in one task; each round is a written table.
    """
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    if edges.count() <= one_task:
        return scratch.table(edges.coalesce(1).mapInArrow(union_find, "node long, root long"), "roots")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(large.where("u != v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = scratch.table(small.where("u != v").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
