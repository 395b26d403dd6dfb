"""A knowledge graph over records: similarity and hierarchy edges, expansion, components and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import parent_section
from docloom.operators.vectors import VectorIndex, nearest, search_index
from docloom.sources.shared import stored


def similar_edges(records: DataFrame, threshold: float, n: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", index: VectorIndex | None = None) -> DataFrame:
    """Edges ``similar_to`` from each record to the n most similar others above ``threshold``, weighted by similarity, larger ids first among equals.

    Exact without an index, which compares each block of records with each other; with one, each record looks in the lists nearest to it.
    """
    asked = records.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("query_vector"))
    options = {"above": threshold, "others": True, "larger_first": True}
    found = search_index(index, asked, n, **options) if index else nearest(asked, records, n, id_col, vector_col, **options)
    return found.select(F.col("query_id").alias("source"), F.col("id").alias("target"), F.lit("similar_to").alias("relation"), F.col("similarity").alias("weight"), "rank")


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight), each pair once."""
    return edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max("weight").alias("weight"))


def contains_edges(sections: DataFrame, number_col: str = "section") -> DataFrame:
    """Edges from each section to those one level below it."""
    child = sections.select(F.col("id").alias("target"), parent_section(F.col(number_col)).alias("number"))
    parent = sections.select(F.col("id").alias("source"), F.col(number_col).alias("number"))
    return parent.join(child.where("number is not null"), "number").select("source", "target", F.lit("contains").alias("relation"), F.lit(1.0).alias("weight"))


def expand(seeds: DataFrame, edges: DataFrame, limit: int = 2) -> DataFrame:
    """One hop from each seed (seed): its targets in edge order (rank), at most ``limit``; distance 1 - weight."""
    w = Window.partitionBy("seed").orderBy("rank", "target")
    hop = seeds.join(edges, F.col("seed") == F.col("source")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return hop.select("seed", "target", "relation", (F.round(1 - F.col("weight"), 6) + F.lit(0.0)).alias("distance"))


def related(edges: DataFrame, nodes: DataFrame, relation: str | None = None) -> DataFrame:
    """Targets of each of the ``nodes`` (id), of one relation or of all; parallel edges stay."""
    kept = edges if relation is None else edges.where(F.col("relation") == relation)
    return kept.join(nodes.select(F.col("id").alias("source")).distinct(), "source", "left_semi")


def last_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """Nodes (id, ...), each id once: the row that was added last."""
    rest = [c for c in nodes.columns if c != "id"]
    return nodes.groupBy("id").agg(F.max_by(F.struct(*rest), F.col(order)).alias("n")).select("id", "n.*")


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n"))


def largest_communities(labels: DataFrame, preview: int = 5) -> DataFrame:
    """(community, size, members, place): the first ids of each, largest communities first.

    Ids are ranked inside hash parts first, so that a large community never meets in one task.
    """
    part = Window.partitionBy("community", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = labels.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= preview)
    first = few.groupBy("community").agg(F.slice(F.array_sort(F.collect_list("id")), 1, preview).alias("members"))
    sizes = labels.groupBy("community").agg(F.count("*").alias("size")).join(first, "community")
    return sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "community")).cast("long"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")


def kept(df: DataFrame) -> DataFrame:
    """A round's table, written and read again: a checkpoint would carry estimated sizes along, which square with each join of a table with itself.

    Its joins are shuffled: many rounds with a broadcast each would send the graph through the driver again and again.
    """
    return stored(df, "rounds").hint("merge")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is reachable; nodes without edges are their own.

    Labels take the minimum of their neighbours' and of their label's label, each
    round written, until none changes.
    """
    links = edges.select(F.col("source").alias("u"), F.col("target").alias("v"))
    links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    links = kept(links)
    labels = nodes.select("id", F.col("id").alias("component"))
    while True:
        near = links.join(labels, F.col("v") == F.col("id")).groupBy("u").agg(F.min("component").alias("low")).hint("merge")
        step = labels.join(near, F.col("id") == F.col("u"), "left").select("id", "component", F.least("component", F.coalesce("low", "component")).alias("next"))
        jump = step.select(F.col("id").alias("root"), F.col("next").alias("higher"))
        moved = kept(step.join(jump, F.col("next") == F.col("root"), "left").select("id", "component", F.least("next", F.coalesce("higher", "next")).alias("next")))
        labels = moved.select("id", F.col("next").alias("component"))
        if moved.where("component != next").isEmpty():
            return labels


def communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, community) by label propagation: each round a node takes the label of most weight around it, smaller labels first.

    Rounds go on, each written, until no label changes, or labels come back that
    were there before (a cycle); then each node takes the smallest label that it has
    in the cycle.  A deterministic stand-in for randomised modularity methods; it
    does not give their partitions.
    """
    links = undirected(edges)
    both = kept(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    labels = nodes.select("id", F.col("id").alias("community"))
    seen: dict[tuple, int] = {}
    rounds: list[DataFrame] = []
    while True:
        votes = both.join(labels, F.col("b") == F.col("id")).groupBy("a", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("a").agg(F.max_by("community", F.struct(F.round("w", 6), -F.col("community"))).alias("best")).hint("merge")
        labels = kept(labels.join(best, F.col("id") == F.col("a"), "left").select("id", F.coalesce("best", "community").alias("community")))
        state = tuple(labels.agg(F.bit_xor(F.xxhash64("id", "community")), F.sum("community")).first())
        rounds.append(labels)
        if state in seen:
            cycle = rounds[seen[state] + 1 :]
            out = cycle[0]
            for more in cycle[1:]:
                out = out.unionByName(more)
            return out.groupBy("id").agg(F.min("community").alias("community"))
        seen[state] = len(rounds) - 1


def community_stats(labels: DataFrame, label_col: str = "community") -> DataFrame:
    sizes = labels.groupBy(label_col).agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("communities"), F.round(F.avg("size"), 1).alias("mean_size"), F.max("size").alias("largest"), F.min("size").alias("smallest"))
