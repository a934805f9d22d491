"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors are turned to integers, so that distances, sums and means are exact and no
order of rows or tasks can change them.

* *Start.* The ``k`` vectors with the smallest hashes of ``seed:id``, a top-k that
  each task cuts down before the merge.
* *Round.* A task reads its vectors in Arrow batches.  For each dimension it lists
  the integer values that occur in the batch, tabulates the squared difference of
  each of them to each centroid, and adds up the table's rows for all vectors by
  NumPy gathers; no vector is ever subtracted from a centroid.  A batch's table is
  bounded by the batch.  A task returns a count and a sum per centroid (``k`` rows),
  which Spark adds up; the driver sees ``k`` rows a round.
* *End.* Vectors are assigned once more and written; the inertias are sums over the
  written rows, joined back as a table of ``k`` rows.

Defined cases: vectors that are null, of another length, or hold null or non-finite
numbers take no part and are not returned; repeated rows are vectors each; a null id
is returned and comes last in the start; with fewer than ``k`` vectors there are as
many centroids; an empty table gives no rows.  A component beyond +-2^27 after
scaling raises, as its distances would leave 64 bits; no row is left out for it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.llm.common import pick, write_table

DIMS, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
_LIMIT = 1 << 27
_CELLS = 1 << 21  # distances held at once: rows of a chunk times centroids


def integer_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", dims: int = DIMS,
                    scale: int = SCALE) -> DataFrame:
    """id and v (array of integers floor(scale * x)) of the vectors that take part."""
    v = pick(df, id=id, v=vector)
    inf = F.lit(float("inf"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    x = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    v = v.where((F.size("v") == dims) & whole).select("id", x.alias("v"))
    wide = F.exists("v", lambda x: (x > _LIMIT) | (x < -_LIMIT))
    return v.select("id", F.when(wide, F.raise_error(F.lit(f"a component is beyond {_LIMIT} after scaling")).cast("array<int>"))
                    .otherwise(F.col("v").cast("array<int>")).alias("v"))


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur, ascending, and the number of each row's value."""
    low = int(values.min())
    span = int(values.max()) - low + 1
    if span > max(4 * len(values), 1 << 16):
        return np.unique(values, return_inverse=True)
    seen = np.zeros(span, bool)
    seen[values - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[values - low]


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centroids) from a table per dimension."""
    out = np.zeros((len(vectors), len(centroids)), np.int64)
    for d in range(vectors.shape[1]):
        occurring, code = _codes(vectors[:, d])
        table = (occurring[:, None] - centroids[None, :, d]) ** 2
        out += table[code]
    return out


def _nearest(batch: pa.RecordBatch, centroids: np.ndarray):
    """Chunks of a batch: vectors, number of the nearest centroid (the smaller one
    of equals) and distance."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    vectors = flat.reshape(len(batch), centroids.shape[1])
    rows = max(1, _CELLS // len(centroids))
    for a in range(0, len(vectors), rows):
        part = vectors[a:a + rows]
        dist = distances(part, centroids)
        best = dist.argmin(axis=1)
        yield part, best, dist[np.arange(len(part)), best]


def _sums(centroids: np.ndarray):
    def run(batches):
        n = np.zeros(len(centroids), np.int64)
        total = np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for part, best, _ in _nearest(batch, centroids):
                order = np.argsort(best, kind="stable")
                used, first = np.unique(best[order], return_index=True)
                n += np.bincount(best, minlength=len(centroids))
                total[used] += np.add.reduceat(part[order], first, axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64()),
                                          pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def _assignments(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            found = list(_nearest(batch, centroids))
            best = np.concatenate([b for _, b, _ in found]) if found else np.zeros(0, np.int64)
            dist = np.concatenate([d for _, _, d in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best, pa.int32()), pa.array(dist, pa.int64())],
                                             names=["id", "cluster", "distance"])

    return run


def start_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: componentwise floor of the mean; an empty centroid stays."""
    dims = centroids.shape[1]
    parts = vectors.select("v").mapInArrow(_sums(centroids), "cluster int, n long, total array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[
        F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"t{d}") for d in range(dims)]).collect()
    out = centroids.copy()
    for r in sums:
        out[r.cluster] = [int(r[f"t{d}"]) // r.n for d in range(dims)]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """id, cluster and distance of each of the integer vectors, and the centroids."""
    vectors = write_table(vectors, "centroid-vectors")
    centroids = start_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long"
    return write_table(vectors.mapInArrow(_assignments(centroids), schema), "centroid-assigned"), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    few = spark.createDataFrame([(c, s, total, digest[c]) for c, s in sums.items()],
                                "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(few), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance",
                                                         "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> str:
    ctes = [f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rn,
  list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
            f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS c, v
  FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept) ORDER BY h NULLS LAST, v LIMIT {k})"""]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT rn, min(struct_pack(d := d, c := c)) AS best FROM (
  SELECT rn, c, list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
  FROM kept k CROSS JOIN c{r} m) GROUP BY rn)""")
        if r < rounds:
            ctes.append(f"""c{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(f.v, m.v) AS v FROM c{r} m LEFT JOIN (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
    SELECT best.c AS c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN (
      SELECT rn, unnest(v) AS x, unnest(range({DIMS})) AS i FROM kept) USING (rn) GROUP BY best.c, i)
  GROUP BY c) f ON f.c = m.c)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, best.c AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (rn) JOIN c{rounds} m ON m.c = best.c"""
