"""Centroid clustering by delta Lloyd: exact integer k-means that reworks only what changed.

Vectors are written once, bucketed by a row number.  Each round writes who owns
which vector, bucketed alike, so that the two tables meet without a shuffle.  A
vector whose owner kept its centroid is compared with the changed centroids only,
for its stored distance stands against all others; a vector whose owner's centroid
moved is compared with all.  Tasks hand back signed sums of the vectors that
changed hands, which are added to the global sums; no round sums vectors that
stayed.  When no centroid changes, all later rounds would repeat the same state,
so the work ends there with the result of the full number of rounds.

What reaches the driver is k centroids and k sums a round.

Defined results: a vector with another number of components, or with a null or
non-finite one, is left out; ids may be null or repeated, each row counts; among
equal starting hashes the smaller components go first; fewer vectors than centroids
start as many centroids as there are; an empty table gives an empty table.
Components are kept between -2^26 and 2^26, since a squared distance beyond that
does not fit the 64-bit result; sums of distances beyond 2^63-1 stay there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.shared import Scratch, table

WIDTH, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Largest size of a component: 64 squared differences of twice this still fit 63 bits.
LARGEST = 1 << 26
#: Below this size products of 64 components are exact in double precision.
EXACT = 1 << 22
#: Vectors of one bucket, on average.
BUCKET_ROWS = 250_000
OWNED = "row long, cluster int, distance long, given array<struct<cluster: int, n: long, total: array<long>>>"


def whole_components(vector: Column, width: int, scale: int) -> Column:
    """floor(scale * x) of each component as integers; null where a component is null or non-finite, or their number is another."""
    fits = (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = float(LARGEST)
    whole = F.transform(vector, lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-top)), F.lit(top))), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    return F.when(F.coalesce(fits, F.lit(False)), whole)


def starting(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the k smallest hashes of ``seed:id``, in order."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    first = vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return np.array([r.x for r in first], np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT else np.int64
    a, b = x.astype(kind), centroids.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def owners(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) after some centroids changed; a cluster of -1 has no owner yet.  Ties go to the smaller number."""
    cluster, distance = cluster.copy(), distance.copy()
    lost = (cluster < 0) | np.isin(cluster, changed)
    if lost.any():
        all_of = squared(x[lost], centroids)
        cluster[lost] = all_of.argmin(1)
        distance[lost] = all_of.min(1)
    stay = np.flatnonzero(~lost)
    if stay.size and changed.size:
        near = squared(x[stay], centroids[changed])
        best = near.argmin(1)
        d, c = near[np.arange(stay.size), best], changed[best]
        moves = (d < distance[stay]) | ((d == distance[stay]) & (c < cluster[stay]))
        cluster[stay[moves]], distance[stay[moves]] = c[moves], d[moves]
    return cluster, distance


def transfers(x: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> list[dict]:
    """Signed counts and sums for the clusters between which vectors went over."""
    moved = before != after
    x, before, after = x[moved].astype(np.int64), before[moved], after[moved]
    out = []
    for c in range(k):
        lost, won = x[before == c], x[after == c]
        if len(lost) or len(won):
            out.append({"cluster": c, "n": len(won) - len(lost), "total": (won.sum(0) - lost.sum(0)).tolist()})
    return out


def reassigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, changed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Owners of the vectors in ``batches``; the first row of a batch carries the batch's transfers."""
    schema = pa.schema([("row", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("given", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])))])
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        before = batch.column("cluster").to_numpy(zero_copy_only=False)
        after, distance = owners(x, before, batch.column("distance").to_numpy(zero_copy_only=False), centroids, changed)
        given = transfers(x, before, after, len(centroids)) or None
        columns = [batch.column("row"), pa.array(after, pa.int32()), pa.array(distance, pa.int64()), pa.array([given] + [None] * (batch.num_rows - 1), schema.field("given").type)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


class Bucketed:
    """Tables of one set of vectors, bucketed by ``row`` in the shared folder."""

    def __init__(self, scratch: Scratch, buckets: int):
        self.scratch, self.buckets = scratch, buckets
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, label: str) -> str:
        name = f"{label}_{uuid.uuid4().hex}"
        self.paths[name] = self.scratch.path(label)
        df.write.bucketBy(self.buckets, "row").sortBy("row").option("path", self.paths[name]).format("parquet").saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        self.scratch.spark.sql(f"DROP TABLE {name}")
        self.scratch.remove(self.paths.pop(name))


def delta_lloyd(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3, scratch: Scratch | None = None) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), centroids) of vectors (id, x): ``rounds`` rounds of assignment and update, then one more assignment."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    stored = scratch.table(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = stored.count()
    centroids = starting(stored, k, seed)
    if not n:
        return stored.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    buckets = max(spark.sparkContext.defaultParallelism, -(-n // BUCKET_ROWS))
    tables = Bucketed(scratch, buckets)
    base = spark.table(tables.write(stored.repartition(buckets, "row"), "vectors_by_row"))
    owned, name, k = None, "", len(centroids)
    counts, sums = np.zeros(k, object), np.zeros((k, centroids.shape[1]), object)
    changed = np.arange(k)
    for step in range(rounds + 1):
        if owned is None:
            state = base.select("row", "x", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        else:
            state = base.select("row", "x").hint("merge").join(owned.select("row", "cluster", "distance"), "row").select("row", "x", "cluster", "distance")
        last, name = name, tables.write(state.mapInArrow(lambda b, c=centroids, m=changed: reassigned(b, c, m), OWNED), "owners")
        owned = spark.table(name)
        if last:
            tables.drop(last)
        if step == rounds:
            break
        given = owned.where("given is not null").select(F.inline("given")).select("cluster", "n", F.posexplode("total").alias("i", "v"))
        totals = given.groupBy("cluster", "i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        for r in totals.collect():
            sums[r.cluster][r.i] += int(r.v)
            counts[r.cluster] += int(r.n) if r.i == 0 else 0
        new = np.array([[int(v) // int(m) for v in s] if m else old.tolist() for s, m, old in zip(sums, counts, centroids, strict=True)], np.int64)
        changed = np.flatnonzero((new != centroids).any(1))
        centroids = new
        if not changed.size:
            break
    return base.select("row", "id").hint("merge").join(owned.select("row", "cluster", "distance"), "row").drop("row"), centroids


def clusters(records: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that is kept."""
    vectors = records.select(F.col(id_col).cast("long").alias("id"), whole_components(F.col(vector_col), width, scale).alias("x")).where("x is not null")
    owned, centroids = delta_lloyd(vectors, k, rounds, seed, scratch)
    digests = [(c, hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(centroids)]
    named = records.sparkSession.createDataFrame(digests, T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("centroid_sha256", T.StringType())]))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    fitted = lambda c: F.least(F.col(c), most).cast("long").alias(c)
    each = owned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia"))
    total = each.agg(F.sum("cluster_inertia").alias("inertia"))
    sums = each.join(named, "cluster").join(F.broadcast(total)).select("cluster", fitted("cluster_inertia"), fitted("inertia"), "centroid_sha256")
    return owned.join(F.broadcast(sums), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """One pair of expressions a round, written out: SQL has no loop over aggregates."""
    d = "list_sum(list_transform(generate_series(1, 64), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    near = "SELECT v.id, v.x, arg_min(c.k, {{'d': {d}, 'k': c.k}}) AS k, min({d}) AS distance FROM v, c{r} c GROUP BY v.id, v.x"
    out = ["""v AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || id)) - 1 AS k, x FROM v QUALIFY k < 8)"""]
    for r in range(ROUNDS):
        out.append(f"a{r} AS MATERIALIZED ({near.format(d=d, r=r)})")
        out.append(f"""s{r} AS MATERIALIZED (SELECT k, list(floor_mean ORDER BY i) AS x FROM (SELECT k, i, CASE WHEN t >= 0 THEN t // n ELSE -((n - 1 - t) // n) END AS floor_mean
  FROM (SELECT k, i, sum(x[i])::BIGINT AS t, count(*) AS n FROM a{r}, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY k, i)) GROUP BY k)""")
        out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN s{r} s USING (k))")
    out.append(f"a AS MATERIALIZED ({near.format(d=d, r=ROUNDS)})")
    return f"""WITH {', '.join(out)}
SELECT a.id AS vec_id, a.k::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a JOIN c{ROUNDS} c USING (k)"""


OP12_SQL = _sql()
