"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source gets a target in words: its share by weight of ``share`` times all
words, at most ``cap`` times its own words, the excess going to the others by
weight.  A source's documents stand in a permuted order (by a keyed hash); runs
of about ``block_words`` words are blocks.  The mix takes whole passes of a
source and then the blocks from the front of the order until the target is met,
to half a document.  The drawn blocks are the exact quotas of the tree: it
halves the list of output shards again and again, and draws how many blocks of
each source go to the left half without replacement.  A shard's blocks of a
source are consecutive in a permutation of the source's drawn blocks, so shards
are disjoint; the tree is drawn in tasks, a range of shards each; inside a shard, documents stand in a keyed random order.  There are
as many shards as the mix has ``shard_words`` words, and each is sorted in slices
of its random order by as many tasks as its words need.

The running sums that place documents in the order are sums of sums: sources are
cut into hash buckets of bounded size, and these into groups, so a source that
holds a third of all rows is spread over many tasks.

Defined results: a null text has size 0 and is never taken; null is a source of
its own, the last; an empty table gives an empty table; repeated rows are placed
one after the other; equal inputs give equal mixes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.shared import WORD_PATTERN, Scratch, bound, table

WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED, BLOCK_WORDS = 1.5, 2.0, 20, 5000
#: Words of the mix in one output shard, and in the slice of a shard that one task sorts, on average.
SHARD_WORDS, SLICE_WORDS = 8_000_000, 1_000_000
#: Rows of one hash bucket of a source, on average, and buckets whose sums are added up together.
BUCKET_ROWS, GROUP_BUCKETS = 100, 1000
#: Shards whose part of the tree one task draws.
RANGE_SHARDS = 256
#: Blocks of the mix, at most; blocks get longer beyond (from some 1.6 * 10^12 words on), as draws are bounded by 10^9.
MOST_BLOCKS = 500_000_000
#: Sources, and the stretches of their blocks in shards, are broadcast up to so many; beyond, joins shuffle.
BROADCAST_SOURCES, BROADCAST_STRETCHES = 100_000, 200_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null, in order of code points with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(src, source_size, target) from one row (src, source_size) for each source.

    The target is min(cap, level * weight); the level is found from running sums
    over the sources in the order in which they reach their caps.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    place = F.row_number().over(Window.orderBy("src")) - 1
    s = sizes.withColumn("weight", F.get(cycle, place % len(weights))).withColumn("most", cap * F.col("source_size"))
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), "src")
    from_last = Window.orderBy(F.desc(F.col("most") / F.col("weight")), F.desc("src"))
    rest = from_last.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("level", (share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "src", "level"))).over(every)["level"])
    return s.select("src", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most")).alias("target"))


def split(src: np.ndarray, quotas: np.ndarray, first: int, last: int, size: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(range, sources, quotas) of the ranges of ``size`` shards in [first, last), in order; only sources with a quota there.

    Ends are multiples of ``size`` but for the last.  Every node of the tree draws from a seed of its own, so what it
    draws does not depend on which task comes to it; no more than one path of the tree is held.
    """
    if last - first <= size:
        yield first // size, src, quotas
        return
    if not len(src):
        return
    middle = first + -(-(last - first) // (2 * size)) * size
    rng = np.random.default_rng([seed, first, last])
    drawn = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * (middle - first) // (last - first), method="marginals")
    for part, a, b in ((drawn, first, middle), (quotas - drawn, middle, last)):
        yield from split(src[part > 0], part[part > 0], a, b, size, seed)


def quota_ranges(quotas: DataFrame, shards: int, size: int, seed: int) -> DataFrame:
    """(range, src, first, quota): blocks of a source in a range of shards, and its blocks in the ranges before.

    One task reads a row (src, quota) for each source and streams what it draws.
    """

    def run(frames):
        rows = pd.concat([pd.DataFrame({"src": [], "quota": []}), *frames]).sort_values("src", ignore_index=True)
        rows = rows[rows["quota"] > 0]
        names, total = rows["src"].to_numpy(object), rows["quota"].to_numpy(np.int64)
        taken = np.zeros(len(names), np.int64)
        for place, which, blocks in split(np.arange(len(names)), total, 0, shards, size, seed):
            yield pd.DataFrame({"range": np.full(len(which), place, np.int64), "src": names[which], "first": taken[which], "quota": blocks})
            taken[which] += blocks

    return quotas.select("src", "quota").coalesce(1).mapInPandas(run, "range long, src string, first long, quota long")


def shard_intervals(quotas: DataFrame, shards: int, seed: int, scratch: Scratch) -> DataFrame:
    """(src, shard, first, last): the stretch of a source's permuted blocks that a shard takes, where it takes any.

    The upper tree, down to ranges of shards, is drawn by one task, the tree below a range by a task for each range,
    which holds no more rows than its shards have blocks.
    """
    size = RANGE_SHARDS
    ranges = scratch.table(quota_ranges(quotas, shards, size, seed), "ranges")

    def below(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("src", ignore_index=True)
        start = int(frame["range"][0]) * size
        names, at, out = frame["src"].to_numpy(object), frame["first"].to_numpy(np.int64).copy(), []
        for shard, which, blocks in split(np.arange(len(names)), frame["quota"].to_numpy(np.int64), start, min(start + size, shards), 1, seed):
            out.append(pd.DataFrame({"src": names[which], "shard": np.full(len(which), shard, np.int32), "first": at[which], "last": at[which] + blocks}))
            at[which] += blocks
        return pd.concat(out)

    return scratch.table(ranges.groupBy("range").applyInPandas(below, "src string, shard int, first long, last long"), "intervals")


def block_plan(goals: DataFrame, block_words: int, seed: int) -> DataFrame:
    """For each source its quota of blocks, and the step and shift of its permutation."""
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    rest = F.col("target") - whole * F.col("source_size")
    quota = (F.ceil(F.col("source_size") / block_words) * whole + F.ceil(rest / block_words)).cast("long")

    def run(frames):
        for frame in frames:
            steps, shifts = [], []
            for src, quota in zip(frame["src"], frame["quota"].tolist(), strict=True):
                rng = np.random.default_rng([seed, *src.encode()])
                step = int(rng.integers(1, max(2, min(quota, 1 << 30))))
                while gcd(step, max(quota, 1)) > 1:
                    step += 1
                steps.append(step)
                shifts.append(int(rng.integers(0, max(1, quota))))
            yield frame.assign(step=steps, shift=shifts)

    return goals.withColumn("quota", quota).mapInPandas(run, "src string, source_size long, target double, quota long, step long, shift long")


def shards_for(rows: DataFrame, share: float, shard_words: int) -> int:
    words = rows.agg(F.sum("size")).first()[0] or 0
    return max(1, int(-(-share * words // shard_words)))


def mix(rows: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int | None = None, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """rows: a stored table (row, id, src, size).  Adds source_size, target, taken and ``draws``: a (shard, place) for each time the row is taken.

    shards: their number, if it is not to follow from ``shard_words``.
    """
    sizes = scratch.table(rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), "sources")
    n_sources, words = sizes.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    shards = shards or max(1, int(-(-share * words // shard_words)))
    block_words = max(block_words, int(-(-share * words // MOST_BLOCKS)))
    plan = scratch.table(block_plan(targets(sizes.drop("n_rows"), weights, share, cap), block_words, seed).join(sizes.select("src", "n_rows"), "src"), "plan")
    stretches = shard_intervals(plan, shards, seed, scratch)
    few = stretches.limit(BROADCAST_STRETCHES + 1).count() <= BROADCAST_STRETCHES
    if few:
        plan = plan.join(stretches.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("first", "last", "shard"))).alias("stretches")), "src", "left")
    if n_sources <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    key = F.xxhash64(F.lit(seed), "id", "size")
    laid = rows.join(plan, "src").withColumn("key", key).withColumn("bucket", F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("n_rows") / BUCKET_ROWS)))
    part = laid.groupBy("src", "bucket").agg(F.sum("size").alias("part")).withColumn("group", F.floor(F.col("bucket") / GROUP_BUCKETS))
    before = lambda by, order, n: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = part.groupBy("src", "group").agg(F.sum("part").alias("sum")).select("src", "group", before(["src"], "group", "sum").alias("first"))
    offsets = part.withColumn("inside", before(["src", "group"], "bucket", "part")).join(groups, ["src", "group"]).select("src", "bucket", (F.col("first") + F.col("inside")).alias("offset"))
    inside = Window.partitionBy("src", "bucket").orderBy("key", "id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = laid.withColumn("end", F.sum("size").over(inside)).join(offsets, ["src", "bucket"]).withColumn("start", F.col("offset") + F.col("end") - F.col("size"))
    total = F.greatest("source_size", F.lit(1))
    passes = F.floor(F.col("target") / total)
    rest = F.col("target") - passes * total
    block = F.floor(F.col("start") / block_words)
    per_pass = F.ceil(F.col("source_size") / block_words)
    copies = F.when(F.col("size") == 0, 0).otherwise(passes + F.when(F.col("start") + F.col("size") / 2 < rest, 1).otherwise(0)).cast("int")

    def draw(k: Column) -> Column:
        quota = F.greatest("quota", F.lit(1))
        placed = F.pmod(F.pmod(k * per_pass + block, quota) * F.col("step") + F.col("shift"), quota)
        place = F.xxhash64(F.lit(seed + 1), "id", "row", k).alias("place")
        if not few:
            return F.struct(placed.alias("placed"), place)
        return bound(placed, lambda at: F.struct(F.get(F.filter("stretches", lambda e: (e["first"] <= at) & (at < e["last"])), F.lit(0))["shard"].alias("shard"), place))

    none = F.array().cast(f"array<struct<{'shard:int' if few else 'placed:bigint'},place:bigint>>")
    draws = F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), draw)).otherwise(none)
    out = laid.select("row", "id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), draws.alias("draws"), "src", "quota")
    return (out if few else dealt(out, stretches, plan, shards)).drop("src", "quota")


def dealt(rows: DataFrame, stretches: DataFrame, plan: DataFrame, shards: int) -> DataFrame:
    """``rows`` with shards in place of places in their source's order, by a join on (source, bin of places).

    A bin is about as wide as a shard's stretch, so a bin meets a few stretches and no source is a hot key.
    """
    width = F.greatest(F.lit(1), F.ceil(F.col("quota") / shards)).cast("long")
    bins = F.sequence(F.floor(F.col("first") / width), F.floor((F.col("last") - 1) / width))
    known = stretches.join(plan.select("src", "quota"), "src").select("src", "shard", "first", "last", F.explode(bins).alias("bin"))
    drawn = rows.select("row", "src", "quota", F.explode("draws").alias("draw")).withColumn("bin", F.floor(F.col("draw.placed") / width))
    met = drawn.join(known, ["src", "bin"]).where("first <= draw.placed and draw.placed < last")
    again = met.groupBy("row").agg(F.collect_list(F.struct("shard", "draw.place")).alias("found"))
    empty = F.array().cast("array<struct<shard:int,place:bigint>>")
    return rows.join(again, "row", "left").withColumn("draws", F.coalesce("found", empty)).drop("found")


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scratch: Scratch | None = None, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (of each time it is taken) for each row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("src"), n_words(F.col(text_col)).alias("size"))
    return mix(scratch.table(rows, "sizes"), scratch, **how).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards"))


def mixture(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, share: float = SHARE, shard_words: int = SHARD_WORDS, slice_words: int = SLICE_WORDS, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, dealt out by shard and shuffled within it.

    A partition is a slice of one shard's random order, so shards lie one after the other.
    """
    stored = scratch.table(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"), n_words(F.col(text_col)).alias("size")), "docs-by-row")
    rows = stored.select("row", F.col(f"doc.{id_col}").alias("id"), source_key(F.col(f"doc.{source_col}")).alias("src"), "size")
    shards = shards or shards_for(rows, share, shard_words)
    many = max(1, -(-shards_for(rows, share, slice_words) // shards))
    drawn = mix(rows, scratch, shards=shards, share=share, **how).select("row", F.explode("draws").alias("draw"))
    slice_of = F.least(F.lit(many - 1), F.floor((F.col("draw.place") / F.lit(2.0**64) + 0.5) * many).cast("int"))
    return stored.select("doc", "row").join(drawn, "row").repartitionById(shards * many, (F.col("draw.shard") * many + slice_of).cast("int")).sortWithinPartitions("draw.shard", "draw.place").select("doc.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))
