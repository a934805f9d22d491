"""Approximate nearest neighbours by inner product: robust-pruned directed
graphs, one per shard, searched by beams.

* *Classes.* Equal vectors are one point of the index; of each class only the
  ``k + 1`` smallest ids can be in an answer, and a ranked window with a map-side
  limit keeps just those, so a vector that a third of the rows hold is cheap.
  Every row is thus indexed.
* *Shards.* Points are dealt by hash to shards of at most about ``shard_bytes`` of
  doubles, which bounds a task's memory.  A table with fewer such shards than
  cores gets as many as there are cores, but of no fewer than ``shard_rows``.
* *Graph.* With one more coordinate all vectors of a shard get the same norm;
  then the nearest vector is the one of largest inner product.  Points enter
  in random order and in batches: a greedy beam search proposes neighbours, and
  relaxed pruning keeps an edge only if no kept neighbour is ``alpha`` times
  nearer to its end, which leaves diverse directions.  Edges are added both
  ways and full lists are pruned again.
* *Search.* The queries, the small side, travel to every shard.  A shard's task
  gets its index, which is sent once and to no other task, and after it the
  blocks of queries one by one; a beam walks the graph for all queries of a
  block at once, and the shards' answers are merged by rank.

All steps of a batch are numpy operations over the whole batch.  The index is
written to the shared checkpoint folder before it is searched.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite
numbers take no part; vectors of different lengths are in different shards and
never compared; rows of one id each count; a query gets all candidates if they
are fewer than ``k``; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotspark.llm.common import pick, write_table

DEGREE, BEAM, BUILD_BEAM, WIDTH, ALPHA = 32, 200, 64, 4, 1.2
_BATCH = 256


def _distance(x: np.ndarray, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances from each row of x to its own list of point ids."""
    d = points[ids]
    d -= x[:, None, :]
    return np.einsum("bkd,bkd->bk", d, d)


def beam_search(points: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int = BEAM):
    """For each query the ``beam`` nearest points that a greedy walk finds, by
    distance, and their squared distances; -1 and infinity where there are fewer."""
    n, b = len(points), len(queries)
    rows = np.arange(b)[:, None]
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf)
    done = np.zeros((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)
    start = np.broadcast_to(entry[:beam], (b, min(len(entry), beam)))
    d0 = _distance(queries, points, start)
    order = np.argsort(d0, axis=1, kind="stable")
    ids[:, :start.shape[1]] = np.take_along_axis(start, order, 1)
    dist[:, :start.shape[1]] = np.take_along_axis(d0, order, 1)
    seen[rows, start] = True
    live = np.arange(b)
    while len(live):
        # The nearest points of each beam that were not expanded yet.
        todo = ~done[live] & (ids[live] >= 0)
        first = np.argsort(~todo, axis=1, kind="stable")[:, :WIDTH]
        use = np.take_along_axis(todo, first, 1)
        some = use.any(axis=1)
        live, first, use = live[some], first[some], use[some]
        if not len(live):
            break
        at = live[:, None]
        done[at, first] |= use
        origin = np.where(use, ids[at, first], -1)
        new = np.where(origin[:, :, None] >= 0, edges[np.maximum(origin, 0)], -1).reshape(len(live), -1)
        new = np.sort(new, axis=1)
        twice = np.zeros(new.shape, bool)
        twice[:, 1:] = new[:, 1:] == new[:, :-1]
        new[twice | seen[at, new]] = -1
        seen[at, np.where(new >= 0, new, n)] = True
        seen[:, n] = False
        d = np.where(new >= 0, _distance(queries[live], points, np.maximum(new, 0)), np.inf)
        all_ids = np.concatenate([ids[live], new], axis=1)
        all_d = np.concatenate([dist[live], d], axis=1)
        all_done = np.concatenate([done[live], np.zeros(new.shape, bool)], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_d, best, 1)
        done[live] = np.take_along_axis(all_done, best, 1)
    ids[np.isinf(dist)] = -1
    return ids, dist


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """At most ``degree`` diverse neighbours for each point of ``of``, from its
    row of candidates (-1: none)."""
    candidates = np.sort(candidates, axis=1)
    bad = (candidates < 0) | (candidates == of[:, None])
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    d = np.where(bad, np.inf, _distance(points[of], points, np.maximum(candidates, 0)))
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    alive = np.isfinite(d)
    out = np.full((len(of), degree), -1, np.int64)
    rows = np.arange(len(of))
    for k in range(degree):
        nearest = alive.argmax(axis=1)
        has = alive[rows, nearest]
        if not has.any():
            break
        pick_ = np.where(has, candidates[rows, nearest], -1)
        out[:, k] = pick_
        between = _distance(points[np.maximum(pick_, 0)], points, np.maximum(candidates, 0))
        alive &= ~(has[:, None] & (alpha * alpha * between <= d))
        alive[rows, nearest] = False
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 11):
    """The graph over ``points``: edges (n, degree), -1 for none, and entry points."""
    n = len(points)
    rng = np.random.default_rng(seed)
    room = 2 * degree  # lists may grow before they are pruned again
    edges = np.full((n, room), -1, np.int64)
    if n > 1:
        some = rng.integers(0, n - 1, (n, min(degree, n - 1)))
        edges[:, :some.shape[1]] = some + (some >= np.arange(n)[:, None])
    center = ((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin()
    entry = np.unique(np.concatenate([[center], rng.integers(0, n, min(n, 7))]))
    for relaxed in (1.0, alpha):
        order = rng.permutation(n)
        for a in range(0, n, _BATCH):
            own = order[a:a + _BATCH]
            found, _ = beam_search(points, edges, entry, points[own], beam)
            chosen = robust_prune(points, own, np.concatenate([found, edges[own]], axis=1), relaxed, degree)
            edges[own, :degree], edges[own, degree:] = chosen, -1
            # The same edges backwards, grouped by the point that gets them.
            to, back = chosen.ravel(), np.repeat(own, degree)
            to, back = to[chosen.ravel() >= 0], back[chosen.ravel() >= 0]
            order2 = np.argsort(to, kind="stable")
            to, back = to[order2], back[order2]
            target, first, size = np.unique(to, return_index=True, return_counts=True)
            used = (edges[target] >= 0).sum(axis=1)
            fits = used + size <= room
            place = np.arange(len(to)) - np.repeat(first, size) + np.repeat(used, size)
            ok = np.repeat(fits, size)
            edges[to[ok], place[ok]] = back[ok]
            full = np.flatnonzero(~fits)
            if len(full):
                wide = np.full((len(full), int(size[full].max())), -1, np.int64)
                for r, k in enumerate(full):
                    wide[r, :size[k]] = back[first[k]:first[k] + size[k]]
                kept = robust_prune(points, target[full], np.concatenate([edges[target[full]], wide], axis=1), relaxed, degree)
                edges[target[full], :degree], edges[target[full], degree:] = kept, -1
    out = np.full((n, degree), -1, np.int64)
    for a in range(0, n, 1024):
        own = np.arange(a, min(a + 1024, n))
        out[own] = robust_prune(points, own, edges[own], alpha, degree)
    return out, entry


def _lift(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate, so that all norms are that of the longest vector."""
    norms = (vectors ** 2).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


_INDEX = "dim int, shard int, points binary, edges binary, entry binary, members binary, sizes binary"


def _build_shard(table: pa.Table) -> pa.Table:
    x = _matrix(table.column("vector"))
    edges, entry = build(_lift(x).astype(np.float32))  # proposals need no more; scores are double
    ids = table.column("ids").combine_chunks()
    narrow = x.astype(np.float32)
    return pa.table({
        "dim": pa.array([x.shape[1]], pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
        # Vectors that came as floats are kept as floats, without loss.
        "points": pa.array([(narrow if (narrow == x).all() else x).tobytes()], pa.binary()),
        "edges": pa.array([edges.astype(np.int32).tobytes()], pa.binary()),
        "entry": pa.array([entry.astype(np.int32).tobytes()], pa.binary()),
        "members": pa.array([ids.flatten().to_numpy().astype(np.int64).tobytes()], pa.binary()),
        "sizes": pa.array([ids.value_lengths().to_numpy().astype(np.int64).tobytes()], pa.binary())})


def build_index(rows: DataFrame, k: int, shard_bytes: int = 1 << 25, shard_rows: int = 8192) -> tuple[DataFrame, int]:
    """One row per shard (and length of vectors), and the number of shards;
    ``rows`` has vec_id and vector, valid ones only."""
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    points = (rows.withColumn("r", nth).where(F.col("r") <= k + 1)  # pruned before the shuffle
              .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
              .withColumn("dim", F.size("vector")))
    points = write_table(points, "ann-points")
    seen = points.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("dim") * F.lit(8).cast("long")), F.lit(0)).alias("bytes")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(seen["bytes"] / shard_bytes), min(cores, math.ceil(seen["n"] / shard_rows)))
    points = points.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    return write_table(points.groupBy("dim", "shard").applyInArrow(_build_shard, _INDEX), "ann-index"), shards


class _Shard:
    """A shard's index as arrays."""

    def __init__(self, row: dict):
        self.members, self.sizes = (np.frombuffer(row[c], np.int64) for c in ("members", "sizes"))
        octets = len(row["points"]) // (len(self.sizes) * row["dim"])
        self.x = np.frombuffer(row["points"], np.float32 if octets == 4 else np.float64).reshape(-1, row["dim"]).astype(np.float64)
        self.edges = np.frombuffer(row["edges"], np.int32).reshape(len(self.x), -1).astype(np.int64)
        self.entry = np.frombuffer(row["entry"], np.int32).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.lifted = _lift(self.x)

    def best(self, own: np.ndarray, q: np.ndarray, k: int, beam: int):
        """For each query its id, and ids and scores of its best in the shard."""
        for a in range(0, len(own), _BATCH):
            part = q[a:a + _BATCH]
            found, _ = beam_search(self.lifted, self.edges, self.entry,
                                   np.concatenate([part, np.zeros((len(part), 1))], axis=1), beam)
            score = np.einsum("bd,bkd->bk", part, self.x[np.maximum(found, 0)])
            for j in range(len(part)):
                at = found[j][found[j] >= 0]
                ids = np.concatenate([self.members[self.first[p]:self.first[p] + self.sizes[p]] for p in at])
                s = np.repeat(score[j][found[j] >= 0], self.sizes[at])
                keep = ids != own[a + j]
                ids, s = ids[keep], s[keep]
                best = np.lexsort((ids, -s))[:k]
                yield int(own[a + j]), ids[best], s[best]


def _search_shards(k: int, beam: int):
    """Rows of a shard: first its index, then blocks of queries."""

    def run(batches):
        at, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                key = row.column("dim")[0].as_py(), row.column("shard")[0].as_py()
                if row.column("query_ids")[0].as_py() is None:
                    at, shard = key, _Shard(row.to_pylist()[0])
                elif key == at:  # else no vector of this length is in the shard
                    own = row.column("query_ids").flatten().to_numpy()
                    q = row.column("queries").flatten().to_numpy().reshape(len(own), key[0])
                    out = list(shard.best(own, q, k, beam))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64())),
                         pa.array([o[2] for o in out], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

    return run


def valid_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = pick(df, vec_id=id, vector=vector).where("vec_id is not null and vector is not null and size(vector) > 0")
    return v.where("""forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))
                      and exists(vector, x -> x <> 0)""")


def nearest(df: DataFrame, is_query, k: int = 20, id: str = "vec_id", vector: str = "embedding", beam: int = BEAM,
            shard_bytes: int = 1 << 25, shard_rows: int = 8192, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score for each row where ``is_query`` (a Column
    over vec_id) holds: its k nearest other rows found."""
    rows = valid_vectors(df, id, vector)
    index, shards = build_index(rows, k, shard_bytes, shard_rows)
    asked = write_table(rows.where(is_query), "ann-queries")
    blocks = max(1, math.ceil(asked.count() / block))
    asked = (asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
             .withColumn("dim", F.size("vector"))
             .groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "vector"))).alias("q"))
             .select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                     F.col("q.vec_id").alias("query_ids"),
                     F.flatten(F.col("q.vector").cast("array<array<double>>")).alias("queries")))
    meet = index.unionByName(asked, allowMissingColumns=True).repartitionById(shards, "shard")
    meet = meet.sortWithinPartitions("dim", "shard", F.col("query_ids").isNotNull())
    found = meet.mapInArrow(_search_shards(k, max(beam, 2 * k)), "query_id long, ids array<long>, scores array<double>")
    best = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
    best = best.select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose vec_id is divisible by 20, as the contract has it."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
