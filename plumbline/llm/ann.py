"""Approximate nearest neighbours on robust-pruned directed graphs.

Identical vectors are one node with the ids of its copies. Distinct vectors are
spread over shards of at most SHARD vectors and SHARD_BYTES by a hash of their
least id. A shard's graph is grown in batches: a greedy beam search from the
medoid on the graph so far, and the batch's own members, propose neighbours;
robust pruning keeps the nearest proposal and drops those that are ALPHA times
closer to a kept one than to the point, until DEGREE diverse edges are kept;
reverse edges are added, WIDTH a point at once, and overfull points pruned
again, so the memory of a step depends neither on a hub's edges nor on the
shard. Queries run a beam search in every shard of their dimension and the
shards' best K are merged; then nodes give way to their ids, and copies of the
query's own vector, which need no search, come first. All steps are numpy over
blocks of points. Distances are squared Euclidean.

Every row is indexed. Queries are the rows of the table that ``queries`` names
(op3: the ids divisible by QUERY_STEP), all rows without it; a row isn't its own
neighbour. Shards meet slices of at most SLICE queries, so no task holds all
queries or all vectors; building is linear in the vectors, searching is queries
times shards.

Defined cases: null and empty vectors, and those with a null or not finite
component, are neither found nor queries, nor are rows without vec_id. Vectors
of another length are searched among their like. Rows with one vec_id count once, with the
least vector. Equal distances are ordered by vec_id. With fewer than K others
there are fewer rows; an empty table, or one without queries, gives none.
Further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written

K = 10
DEGREE = 32
BEAM = 64
SEARCH_BEAM = 256
ALPHA = 1.2
#: Distinct vectors of a shard, and the bytes of its vectors.
SHARD, SHARD_BYTES = 50_000, 1 << 26
SLICE = 50_000
BLOCK = 512
#: Marks of seen points that a block of searches may hold.
SEEN = 1 << 26
#: New edges that join a point's list before it is pruned; points of a block whose pairs are measured.
WIDTH, PRUNED = 128, 128
#: op3's queries are the ids divisible by this.
QUERY_STEP = 100


def beam_search(vectors: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the beam's points for each query, nearest first; -1 and inf where there are fewer.

    Each round expands the wide nearest points that aren't expanded yet, for all
    queries of a block together, until every point of every beam is.
    """
    n, degree = graph.shape
    m = len(queries)
    qn = np.einsum("ij,ij->i", queries, queries)
    ids = np.full((m, beam), -1, np.int32)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    ids[:, 0] = start
    dist[:, 0] = norms[start] + qn - 2 * queries @ vectors[start]
    done[:, 0] = False
    seen = np.zeros((m, n + 1), bool)
    seen[:, start] = True
    seen[:, n] = True  # the place of "no neighbour"
    active = np.arange(m)
    while len(active):
        open_at = np.where(done[active], np.inf, dist[active])
        pick = np.argpartition(open_at, min(wide, beam) - 1, axis=1)[:, :wide] if beam > wide else np.argsort(open_at, axis=1)
        usable = np.take_along_axis(open_at, pick, 1) < np.inf
        done[active[:, None], pick] = True
        nodes = np.where(usable, ids[active[:, None], pick], n)
        padded = graph[np.minimum(nodes, n - 1)]
        near = np.where(usable[:, :, None], padded, -1).reshape(len(active), -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[active[:, None], near]] = n
        row, col = np.nonzero(near < n)
        if len(row):
            found = near[row, col]
            q = active[row]
            seen[q, found] = True
            d = norms[found] + qn[q] - 2 * np.einsum("ij,ij->i", vectors[found], queries[q])
            fresh = np.full(near.shape, np.inf, np.float32)
            fresh[row, col] = d
            width = int((near < n).sum(axis=1).max())
            if width < near.shape[1]:
                keep = np.argpartition(fresh, width - 1, axis=1)[:, :width]
                fresh, near = np.take_along_axis(fresh, keep, 1), np.take_along_axis(near, keep, 1)
            all_d = np.concatenate([dist[active], fresh], axis=1)
            all_i = np.concatenate([ids[active], np.where(fresh < np.inf, near, -1)], axis=1)
            all_done = np.concatenate([done[active], fresh == np.inf], axis=1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            dist[active], ids[active], done[active] = np.take_along_axis(all_d, best, 1), np.take_along_axis(all_i, best, 1), np.take_along_axis(all_done, best, 1)
        active = active[~done[active].all(axis=1)]
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(vectors: np.ndarray, norms: np.ndarray, points: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The kept neighbours of points among proposed ones (-1: none), nearest first."""
    m, width = proposed.shape
    cand = np.sort(proposed, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == points[:, None]] = -1
    held = vectors[np.maximum(cand, 0)]
    d = norms[np.maximum(cand, 0)] + norms[points][:, None] - 2 * np.einsum("mwd,md->mw", held, vectors[points])
    d = np.where(cand < 0, np.inf, np.maximum(d, 0)).astype(np.float32)
    inner = norms[np.maximum(cand, 0)]
    pair = np.maximum(inner[:, :, None] + inner[:, None, :] - 2 * held @ held.transpose(0, 2, 1), 0)
    out = np.full((m, degree), -1, np.int32)
    left = d.copy()
    rows = np.arange(m)
    for k in range(degree):
        best = left.argmin(axis=1)
        ok = left[rows, best] < np.inf
        if not ok.any():
            break
        out[ok, k] = cand[rows[ok], best[ok]]
        left[rows, best] = np.inf
        # alpha applies to distances; these are squared
        left[(alpha * alpha * pair[rows, best] <= d) & ok[:, None]] = np.inf
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(graph, start): out-neighbours of every vector, -1 where there are fewer."""
    n = len(vectors)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    start = int(np.argmin(norms - 2 * vectors @ vectors.mean(axis=0)))
    graph = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(5).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        batch = order[at : at + max(64, min(at, 1024))]
        proposed = []
        block = _block(n)
        for k in range(0, len(batch), block):
            part = batch[k : k + block]
            found, _ = beam_search(vectors, norms, graph, start, vectors[part], beam)
            mates = norms[batch][None, :] - 2 * vectors[part] @ vectors[batch].T
            close = batch[np.argpartition(mates, min(16, len(batch) - 1), axis=1)[:, :16]]
            proposed.append(np.concatenate([found, close.astype(np.int32)], axis=1))
        offers = np.concatenate(proposed)
        for k in range(0, len(batch), PRUNED):
            part = batch[k : k + PRUNED]
            graph[part] = robust_prune(vectors, norms, part, offers[k : k + PRUNED], degree, alpha)
        _add_reverse(vectors, norms, graph, batch, degree, alpha)
        at += len(batch)
    return graph, start


def _block(n: int) -> int:
    """Searches that run together in a graph of n points."""
    return max(16, min(BLOCK, SEEN // max(1, n)))


def _add_reverse(vectors: np.ndarray, norms: np.ndarray, graph: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Add the edges back from the neighbours of batch, WIDTH of a point at once."""
    source = np.repeat(batch, degree)
    target = graph[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    points, first, count = np.unique(target, return_index=True, return_counts=True)
    by_count = np.argsort(-count, kind="stable")
    points, first, count = points[by_count], first[by_count], count[by_count]
    done = 0
    while len(points) and count[0] > done:
        live = int(np.searchsorted(-count, -done, "left"))
        for k in range(0, live, PRUNED):
            p, f, c = points[k : min(live, k + PRUNED)], first[k : min(live, k + PRUNED)] + done, count[k : min(live, k + PRUNED)] - done
            step = np.arange(min(WIDTH, int(c.max())))[None, :]
            new = np.where(step < c[:, None], source[np.minimum(f[:, None] + step, len(source) - 1)], -1)
            both = np.sort(np.concatenate([graph[p], new.astype(np.int32)], axis=1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both = -np.sort(-both, axis=1)  # ids first, -1 last
            full = both[:, degree] >= 0 if both.shape[1] > degree else np.zeros(len(p), bool)
            graph[p[~full]] = both[~full][:, :degree]
            if full.any():
                graph[p[full]] = robust_prune(vectors, norms, p[full], both[full], degree, alpha)
        done += WIDTH


def search(vectors: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
    norms = np.einsum("ij,ij->i", vectors, vectors)
    ids, dist = [], []
    block = _block(len(vectors))
    for lo in range(0, len(queries), block):
        i, d = beam_search(vectors, norms, graph, start, queries[lo : lo + block], max(beam, k))
        ids.append(i[:, :k])
        dist.append(d[:, :k])
    return np.concatenate(ids), np.concatenate(dist)


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in col.chunks]) if col.num_chunks else pa.array([], pa.float32())
    return np.asarray(flat, np.float32).reshape(-1, dim)


def neighbours(table: DataFrame, k: int = K, shard: int = SHARD, slice_rows: int = SLICE, queries: str | None = None) -> DataFrame:
    """(vec_id, neighbor_id, rank, distance): the k nearest others of every query, rank from 1; queries: an SQL condition on vec_id."""
    sound = table.filter("vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    rows = sound.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col("embedding").cast("array<float>")).alias("embedding"))
    # -0.0 is 0.0, so equal vectors are equal bit by bit
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0).cast("float")))
    rows = written(rows.withColumn("key", F.xxhash64("embedding")).withColumn("asks", F.coalesce(F.expr(queries or "true"), F.lit(False))), "vectors")
    # k + 1 ids are enough of any node; WindowGroupLimit keeps no more of them a task
    lowest = F.row_number().over(W.partitionBy("key", "embedding").orderBy("vec_id"))
    same = rows.withColumn("_k", lowest).filter(F.col("_k") <= k + 1).groupBy("key", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = written(same.select("key", "embedding", "ids", F.col("ids")[0].alias("node"), F.size("embedding").alias("dim")), "nodes")
    asked = rows.filter("asks").join(nodes.select("key", "embedding", "node", "ids"), ["key", "embedding"])
    asked = written(asked.select("vec_id", "node", "ids", "embedding", F.size("embedding").alias("dim")), "queries")
    # a node of more than k ids has its neighbours among them
    seekers = asked.filter(F.size("ids") <= k).groupBy("node", "dim").agg(F.first("embedding").alias("embedding"))
    counts = {r[0]: r[1] for r in nodes.groupBy("dim").count().collect()}
    if not counts:
        return table.sparkSession.createDataFrame([], "vec_id long, neighbor_id long, rank int, distance double")

    shards = {d: -(-n // max(1, min(shard, SHARD_BYTES // (4 * d)))) for d, n in counts.items()}
    slices = {d: max(1, -(-n // slice_rows)) for d, n in seekers.groupBy("dim").count().collect()}

    def by_dim(of: dict[int, int]) -> F.Column:
        return F.coalesce(F.create_map(*[F.lit(x) for d in counts for x in (d, of.get(d, 1))])[F.col("dim")].cast("long"), F.lit(1).cast("long"))

    schema = "dim int, shard long, ids binary, vectors binary, graph binary, start long"

    def grow(key: tuple, t: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        order = np.argsort(np.asarray(t.column("node").combine_chunks()), kind="stable")
        t = t.take(pa.array(order))
        vectors = _matrix(t.column("embedding"), dim)
        graph, start = build(vectors)
        blobs = [np.asarray(t.column("node").combine_chunks()).astype("<i8"), vectors.astype("<f4"), graph.astype("<i4")]
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("ids", "vectors", "graph"), blobs)}, "start": pa.array([start], pa.int64())})

    sharded = nodes.select("node", "embedding", "dim", F.pmod(F.xxhash64("node"), by_dim(shards)).alias("shard"))
    # one partition a shard, which the size of the rows would otherwise merge
    graphs = written(sharded.repartition(sum(shards.values()), "dim", "shard").groupBy("dim", "shard").applyInArrow(grow, schema), "graphs")
    left = graphs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), by_dim(slices) - 1)))
    right = seekers.select("node", "embedding", "dim", F.pmod(F.xxhash64("node", F.lit(1)), by_dim(slices)).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), by_dim(shards) - 1)).alias("shard"))

    def look(key: tuple, g: pa.Table, q: pa.Table) -> pa.Table:
        empty = {"node": pa.array([], pa.int64()), "hit": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())}
        if not g.num_rows or not q.num_rows:
            return pa.table(empty)
        dim = key[0].as_py()
        ids = np.frombuffer(g.column("ids")[0].as_py(), "<i8")
        vectors = np.frombuffer(g.column("vectors")[0].as_py(), "<f4").reshape(-1, dim)
        graph = np.frombuffer(g.column("graph")[0].as_py(), "<i4").reshape(len(ids), -1)
        asking, own = _matrix(q.column("embedding"), dim), np.asarray(q.column("node").combine_chunks())
        found, _ = search(vectors, graph, g.column("start")[0].as_py(), asking, k + 1)
        row, col = np.nonzero(found >= 0)
        hit = found[row, col]
        row, hit = row[ids[hit] != own[row]], hit[ids[hit] != own[row]]
        apart = vectors[hit].astype(np.float64) - asking[row].astype(np.float64)
        return pa.table({"node": pa.array(own[row]), "hit": pa.array(ids[hit]), "distance": pa.array(np.einsum("ij,ij->i", apart, apart))})

    keys = ["dim", "shard", "part"]
    hits = right.groupBy(*keys).cogroup(left.groupBy(*keys)).applyInArrow(lambda key, q, g: look(key, g, q), "node long, hit long, distance double")
    nearest = F.row_number().over(W.partitionBy("node").orderBy("distance", "hit"))
    near = hits.withColumn("_k", nearest).filter(F.col("_k") <= k)
    near = near.join(nodes.filter(F.size("ids") > 1).select(F.col("node").alias("hit"), "ids"), "hit", "left")
    near = asked.select("vec_id", "node").join(near, "node").select("vec_id", F.explode(F.coalesce("ids", F.array("hit"))).alias("neighbor_id"), "distance")
    copies = asked.select("vec_id", F.explode("ids").alias("neighbor_id"), F.lit(0.0).alias("distance")).filter("vec_id <> neighbor_id")
    rank = F.row_number().over(W.partitionBy("vec_id").orderBy("distance", "neighbor_id"))
    return near.unionByName(copies).withColumn("rank", rank).filter(F.col("rank") <= k).select("vec_id", "neighbor_id", "rank", "distance")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=f"vec_id % {QUERY_STEP} = 0")
