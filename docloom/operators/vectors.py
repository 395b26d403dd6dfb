"""Nearest vectors: exactly, block by block, and through an inverted-file index.

Both ways end in the same step: a task holds one block of records and one block of
queries, multiplies them as matrices, and hands on the best k of each query alone, so
what is shuffled afterwards is k rows for each query and block.  No pair is a row, but
where a query asks for every record within a threshold.

Rows without a vector, and vectors of another width than ``width``, are left out; a
vector without length is 0 alike to all.  Similarities are rounded to six places before
they are compared, and equals go by id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.shared import stored

#: Rows of a block, on average: what a task multiplies are two blocks.
BLOCK_ROWS = 10_000
#: Similarities that a task holds at once.
CELLS = 1_000_000
#: Where less than one in so many similarities is over the bound, only those are looked at.
FEW = 8
#: Rows of a block where every pair may be a row of the result.
PAIR_ROWS = 2_000
#: Largest number of lists of an index, and vectors that its centroids are fitted on, 256 a list at most.
MAX_LISTS, SAMPLE_ROWS = 4096, 65_536
FOUND = "query_id long, id long, similarity double"


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Unit vectors of a column of lists of equal length."""
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def best(queries: np.ndarray, query_ids: np.ndarray, records: np.ndarray, ids: np.ndarray, k: int, above: float | None, least: float | None, others: bool, larger_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, record, similarity) of the k best records of each query, as places in the two blocks."""
    order = np.argsort(-ids if larger_first else ids, kind="stable")
    records, ids = records[order], ids[order]
    out = []
    some = max(1, CELLS // max(1, len(records)))
    for low in range(0, len(queries), some):
        cos = queries[low : low + some] @ records.T
        few = np.flatnonzero(cos > above) if above is not None else None
        if few is not None and len(few) <= cos.size // FEW:  # the rest need not be rounded, nor searched for the k-th
            p, q = np.divmod(few, cos.shape[1])
            s = np.round(cos[p, q], 6)
            fits = np.ones(len(p), bool) if least is None else s >= least
            if others:
                fits &= query_ids[low + p] != ids[q]
            p, q, s = p[fits], q[fits], s[fits]
        else:
            seen = np.round(cos, 6)
            if others:
                seen[query_ids[low : low + some, None] == ids[None, :]] = -np.inf
            if above is not None:
                seen[cos <= above] = -np.inf
            if least is not None:
                seen[seen < least] = -np.inf
            at = min(k, seen.shape[1])
            edge = -np.partition(-seen, at - 1, axis=1)[:, at - 1]
            p, q = np.nonzero((seen >= edge[:, None]) & (seen > -np.inf))
            s = seen[p, q]
        rank = np.lexsort((q, -s, p))  # by query, likeness, place among ids
        p, q, s = p[rank], q[rank], s[rank]
        begin = np.concatenate([[0], np.bincount(p, minlength=len(cos)).cumsum()[:-1]])
        keep = np.arange(len(p)) - begin[p] < k
        out.append((p[keep] + low, q[keep], s[keep]))
    p, q, s = (np.concatenate(x) if x else np.zeros(0, int) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3
    return p, order[q], s


def _best_of_blocks(k: int, above: float | None, least: float | None, others: bool, larger_first: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        query_ids, ids = left.column("query_id").to_numpy(), right.column("id").to_numpy()
        p, q, s = best(matrix(left.column("vector"), left.num_rows), query_ids, matrix(right.column("vector"), right.num_rows), ids, k, above, least, others, larger_first)
        return pa.table({"query_id": query_ids[p], "id": ids[q], "similarity": s + 0.0})

    return run


def ranked(found: DataFrame, k: int, larger_first: bool = False) -> DataFrame:
    """The k best of each query over all blocks, with ``rank`` and ``distance``."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("id") if larger_first else F.asc("id"))
    out = found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return out.withColumn("distance", F.round(1 - F.col("similarity"), 6) + F.lit(0.0))


def _rows(df: DataFrame, id_col: str, vector_col: str, name: str, width: int | None, *more: Column) -> DataFrame:
    fits = F.col(vector_col).isNotNull() if width is None else F.size(vector_col) == width
    return df.where(F.col(id_col).isNotNull() & fits).select(F.col(id_col).cast("long").alias(name), F.col(vector_col).cast("array<float>").alias("vector"), *more)


def _grid(left: DataFrame, right: DataFrame, queries: int, records: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Each row of the queries in all blocks (i, j) of its row of the grid, each record in those of its column."""
    grid_rows, grid_columns = (max(1, -(-n // block_rows)) for n in (queries, records))
    # Both sides' places are ints: keys of different types are hashed differently and would not meet.
    own = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("i", own("query_id", grid_rows)).withColumn("j", every(grid_columns))
    return left, right.withColumn("j", own("id", grid_columns)).withColumn("i", every(grid_rows))


def nearest(queries: DataFrame, records: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", width: int | None = None, above: float | None = None, least: float | None = None, others: bool = False, larger_first: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, similarity, rank, distance): the k nearest records of each query (query_id, query_vector), exactly.

    Blocks of queries meet blocks of records in a grid, so any number of either fits.
    ``above`` keeps similarities over a bound, ``least`` rounded ones of at least a bound,
    ``others`` leaves out a query's own id.
    """
    left, right = _grid(_rows(queries, "query_id", "query_vector", "query_id", width), _rows(records, id_col, vector_col, "id", width), queries.count(), records.count(), block_rows)
    run = _best_of_blocks(k, above, least, others, larger_first)
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, FOUND)
    return ranked(found, k, larger_first)


def alike(queries: DataFrame, records: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int | None = None, others: bool = False, block_rows: int = PAIR_ROWS) -> DataFrame:
    """(query_id, id, similarity, distance) of every record that is at least as similar to a query (query_id, query_vector, least) as the query asks; without a bound all are.

    Pairs are rows here, so blocks are small: a task holds those of two blocks.
    """
    asked = _rows(queries, "query_id", "query_vector", "query_id", width, F.coalesce(F.col("least"), F.lit(-2.0)).alias("least"))
    left, right = _grid(asked, _rows(records, id_col, vector_col, "id", width), queries.count(), records.count(), block_rows)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids, ids, least = left.column("query_id").to_numpy(), right.column("id").to_numpy(), left.column("least").to_numpy()
        out = [pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})]
        x, y = matrix(left.column("vector"), left.num_rows), matrix(right.column("vector"), right.num_rows)
        some = max(1, CELLS // max(1, len(y)))
        for low in range(0, len(x) if len(y) else 0, some):
            seen = np.round(x[low : low + some] @ y.T, 6)
            fits = seen >= least[low : low + some, None]
            if others:
                fits &= query_ids[low : low + some, None] != ids[None, :]
            p, q = np.nonzero(fits)
            out.append(pa.table({"query_id": query_ids[p + low], "id": ids[q], "similarity": seen[p, q] + 0.0}))
        return pa.concat_tables(out)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, FOUND)
    return found.withColumn("distance", F.round(1 - F.col("similarity"), 6) + F.lit(0.0))


def alike_or_all(queries: DataFrame, records: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", width: int | None = None, others: bool = False) -> DataFrame:
    """``alike`` with one threshold for all queries; those without so similar a record get all records."""
    best = nearest(queries, records, 1, id_col, vector_col, width, others=others).select("query_id", F.when(F.col("similarity") >= threshold, threshold).alias("least"))
    return alike(queries.join(best, "query_id"), records, id_col, vector_col, width, others)


@dataclass
class VectorIndex:
    """Every record in the list of its nearest centroid.  ``records``: list, id, vector, stored by list; ``lists``: list, n."""

    centroids: np.ndarray
    records: DataFrame
    lists: DataFrame
    probes: int


def spherical_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors; an empty one takes a vector anew."""
    rng = np.random.default_rng(seed)
    centroids = x[np.sort(rng.permutation(len(x))[:k])]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=len(centroids)) == 0
        sums[empty] = x[rng.integers(0, len(x), int(empty.sum()))]
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def probes_for(x: np.ndarray, centroids: np.ndarray, k: int, recall: float, queries: int = 512) -> int:
    """How many lists hold the wanted share of the k nearest within the sample; a whole collection lies nearer, so this errs to more."""
    if len(x) < 2:
        return 1
    q = x[:: max(1, len(x) // queries)][:queries]
    own = (x @ centroids.T).argmax(1)
    near = np.argsort(-(q @ x.T), axis=1)[:, 1 : k + 1]
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def build_index(records: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int | None = None, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, k: int = 10, recall: float = 0.95) -> VectorIndex:
    """An index of all records.

    Its centroids, and how many lists a search probes for the wanted ``recall`` at ``k``,
    are fitted in the driver on at most ``sample_rows`` vectors, taken by hashes of ids;
    every record is then assigned and stored by list.  Without ``lists`` there are as many
    as the root of the number of records, ``MAX_LISTS`` at most.  Lists of more than
    ``BLOCK_ROWS`` are cut into blocks when they are searched, so none is ever held whole.
    """
    rows = _rows(records, id_col, vector_col, "id", width)
    n = rows.count()
    lists = min(lists or MAX_LISTS, MAX_LISTS, max(1, round(n**0.5)))
    share = min(1.0, 1.1 * sample_rows / max(n, 1))
    sampled = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)).limit(sample_rows).toArrow()
    x = matrix(sampled.column("vector"), sampled.num_rows)
    centroids = spherical_means(x, min(lists, len(x))) if len(x) else np.zeros((1, 1))
    probes = probes_for(x, centroids, k, recall)

    def assign(batches):
        for b in batches:
            own = (matrix(pa.chunked_array([b.column("vector")]), b.num_rows) @ centroids.T).argmax(1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column("id"), b.column("vector")], names=["list", "id", "vector"])

    told = rows.mapInArrow(assign, "list int, id long, vector array<float>")
    kept = stored(told.repartition("list", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // BLOCK_ROWS))))), "vector-index", ["list"])
    return VectorIndex(centroids, kept, stored(kept.groupBy("list").agg(F.count("*").alias("n")), "vector-lists"), probes)


def search_index(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, above: float | None = None, least: float | None = None, others: bool = False, larger_first: bool = False, width: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, similarity, rank, distance) of the k best records in the lists nearest to each query (query_id, query_vector)."""
    centroids, most = index.centroids, min(probes or index.probes, len(index.centroids))

    def probe(batches):
        for b in batches:
            near = np.argsort(-(matrix(pa.chunked_array([b.column("vector")]), b.num_rows) @ centroids.T), axis=1, kind="stable")[:, :most] if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vector"), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], names=["query_id", "vector", "lists"])

    rows = _rows(queries, "query_id", "query_vector", "query_id", width)
    told = stored(rows.mapInArrow(probe, "query_id long, vector array<float>, lists array<int>"), "probes").select("query_id", "vector", F.explode("lists").alias("key"))
    records = index.records.select("id", "vector", F.col("list").alias("key"))
    # Both tables of lists have a row a list, MAX_LISTS at most.
    sizes = F.broadcast(index.lists.select(F.col("list").alias("key"), F.col("n").alias("held")).join(_counts(told, "asked"), "key"))
    return ranked(_meet(told, records, sizes, block_rows, _best_of_blocks(k, above, least, others, larger_first)), k, larger_first)


def _counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias(name))


def _meet(queries: DataFrame, records: DataFrame, sizes: DataFrame, block_rows: int, run: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """``run`` over blocks of the queries and records of each key; ``sizes`` (key, asked, held) says how many blocks a key needs."""
    blocks = lambda n: F.ceil(F.col(n) / block_rows).cast("int")
    shape = sizes.select("key", blocks("asked").alias("columns"), blocks("held").alias("rows"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(shape, "key").select("key", F.pmod(F.xxhash64("query_id"), F.col("columns")).cast("int").alias("i"), every("rows").alias("j"), "query_id", "vector")
    right = records.join(shape, "key").select("key", every("columns").alias("i"), F.pmod(F.xxhash64("id"), F.col("rows")).cast("int").alias("j"), "id", "vector")
    return left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInArrow(run, FOUND)


def nearest_of_key(queries: DataFrame, records: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``nearest`` among the records of a query's key, exactly: queries (query_id, vector, key) against records (id, vector, key).

    Rows may stand under several keys; a record counts once for a query.  Keys with many rows are cut into blocks on both sides.
    """
    sizes = _counts(queries, "asked").join(_counts(records, "held"), "key")
    found = _meet(queries, records, sizes, block_rows, _best_of_blocks(k, None, None, False, False))
    return ranked(found.dropDuplicates(["query_id", "id"]), k)
