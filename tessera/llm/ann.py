"""Approximate nearest neighbours by cosine, on robust-pruned directed graphs.

Equal vectors, and vectors that differ by a power of two (their cosines are the
same to the last bit), become one point that keeps its k + 1 least ids (no query
needs more of a point).  Points are dealt by hash into shards of bounded size, and
every shard gets a graph: points join in batches, a greedy beam search in the
graph so far proposes neighbours, and relaxed pruning keeps a neighbour only if
no kept one is closer to it by the factor ``ALPHA``; edges back are added and
pruned alike.  A query runs a beam search in each shard; the shards' best points
are scored with the original vectors in double precision and ranked; of points
that tie, those with the least ids count.

Queries are dealt in blocks, and a task holds one shard and one block.

Inputs: vectors that are null, zero, or hold nulls or non-finite components take
no part, and neither do rows without an id.  Repeated rows count once.  Vectors
of different lengths are never neighbours.  With no more than k candidates a
query gets them all (a shard returns at least k + 1 points, if it has them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SHARD_ROWS = 2_000
QUERY_BLOCK = 2_000
DEGREE = 32
BEAM = 64
ALPHA = 1.2


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entry: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the ``beam`` best points found for each query, nearest first; -1 pads."""
    b, n = len(queries), len(x)
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf)
    done = np.zeros((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)
    ids[:, 0], seen[:, entry] = entry, True
    dist[:, 0] = 2 - 2 * (queries @ x[entry])
    live = np.arange(b)
    while len(live):
        open_ = ~done[live] & (ids[live] >= 0)
        live = live[open_.any(1)]
        if not len(live):
            break
        at = (~done[live] & (ids[live] >= 0)).argmax(1)
        done[live, at] = True
        near = edges[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, n)] = True
        d = np.where(fresh, 2 - 2 * np.einsum("brd,bd->br", x[near], queries[live]), np.inf)
        all_d = np.concatenate([dist[live], d], 1)
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_done = np.concatenate([done[live], np.zeros_like(fresh)], 1)
        best = np.argsort(all_d, 1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, best, 1)
        ids[live] = np.where(np.isfinite(dist[live]), np.take_along_axis(all_ids, best, 1), -1)
        done[live] = np.take_along_axis(all_done, best, 1)
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-neighbours of ``nodes`` among their ``candidates`` (-1 pads): nearest first, dropping
    those to which a kept neighbour is closer by the factor alpha."""
    out = np.full((len(nodes), degree), -1, np.int64)
    step = max(1, 4_000_000 // max(1, candidates.shape[1] ** 2))
    for s in range(0, len(nodes), step):
        q, c = nodes[s:s + step], candidates[s:s + step]
        c = np.where(c == q[:, None], -1, c)
        c = np.sort(c, 1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        d = np.where(c >= 0, 2 - 2 * np.einsum("bcd,bd->bc", x[c], x[q]), np.inf)
        order = np.argsort(d, 1, kind="stable")
        c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
        between = 2 - 2 * np.einsum("bcd,bed->bce", x[c], x[c])
        alive, rows = np.isfinite(d), np.arange(len(q))
        for r in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            j = alive.argmax(1)
            out[s:s + step][some, r] = c[rows, j][some]
            alive &= ~((alpha * alpha * between[rows, j] <= d) & some[:, None])
            alive[rows, j] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (n x degree, -1 pads) over unit vectors, and the entry point."""
    n = len(x)
    edges = np.full((n, degree), -1, np.int64)
    start = min(n, 2 * degree)
    first = np.arange(start)
    edges[:start] = robust_prune(x, first, np.tile(first, (start, 1)), degree, alpha)
    entry, at = 0, start
    while at < n:
        batch = np.arange(at, min(n, 2 * at, at + 512))
        found, _ = beam_search(x[:at], edges[:at], x[batch], entry, beam)
        edges[batch] = robust_prune(x, batch, found, degree, alpha)
        at = int(batch[-1]) + 1
        source = np.repeat(batch, degree)
        target = edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first_, count = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(nodes), degree + int(count.max())), -1, np.int64)
        wide[:, :degree] = edges[nodes]
        wide[np.repeat(np.arange(len(nodes)), count), degree + np.arange(len(target)) - np.repeat(first_, count)] = source
        total = (wide >= 0).sum(1)
        few = total <= degree
        packed = -np.sort(-wide, 1)[:, :degree]  # pads last
        edges[nodes[few]] = packed[few]
        if (~few).any():
            edges[nodes[~few]] = robust_prune(x, nodes[~few], wide[~few], degree, alpha)
    return edges, entry


_INDEX = "dim int, shard int, ids array<array<long>>, vectors binary, edges binary, entry int"


def _build(group: pa.Table) -> pa.Table:
    group = group.sort_by([("h1", "ascending"), ("h2", "ascending")])
    dim = group["dim"][0].as_py()
    v = np.asarray(group["vec"].combine_chunks().flatten(), float).reshape(-1, dim)
    edges, entry = build_graph(_unit(v))
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "shard": pa.array([group["shard"][0].as_py()], pa.int32()),
        "ids": pa.array([group["ids"].to_pylist()], pa.list_(pa.list_(pa.int64()))),
        "vectors": pa.array([v.tobytes()], pa.binary()), "edges": pa.array([edges.astype(np.int32).tobytes()], pa.binary()),
        "entry": pa.array([entry], pa.int32())})


def _unit(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(1, keepdims=True)
    v = v / top  # keeps very large and very small vectors finite
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosine(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.einsum("nd,d->n", v, q) / (np.sqrt(np.einsum("nd,nd->n", v, v)) * np.sqrt(np.einsum("d,d->", q, q)))


def _search(k: int, beam: int):
    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "ids": [], "score": []}
        if shard.num_rows and queries.num_rows:
            dim = shard["dim"][0].as_py()
            v = np.frombuffer(shard["vectors"][0].as_py(), float).reshape(-1, dim)
            edges = np.frombuffer(shard["edges"][0].as_py(), np.int32).reshape(len(v), -1).astype(np.int64)
            names = shard["ids"][0].as_py()
            least = np.array([n[0] for n in names], np.int64)  # of points that tie, those with the least ids count
            q = np.asarray(queries["vec"].combine_chunks().flatten(), float).reshape(-1, dim)
            x, unit = _unit(v), _unit(q)
            for s in range(0, len(q), 512):
                found, _ = beam_search(x, edges, unit[s:s + 512], shard["entry"][0].as_py(), max(beam, k + 1))
                for i, row in enumerate(found):
                    row = row[row >= 0]
                    score = cosine(v[row], q[s + i])
                    for j in np.lexsort((least[row], -score))[:k + 1]:
                        out["query_id"].append(queries["query_id"][s + i].as_py())
                        out["ids"].append(names[row[j]])
                        out["score"].append(float(score[j]))
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()),
                         "ids": pa.array(out["ids"], pa.list_(pa.int64())), "score": pa.array(out["score"], pa.float64())})
    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim, h1, h2) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return (vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).where(ok)
            .select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
            .select("id", "vec", F.size("vec").alias("dim"), _direction(F.col("vec")).alias("way"))
            .select("id", "vec", "dim", F.xxhash64("way").alias("h1"), F.xxhash64(F.lit("second"), F.col("way")).alias("h2")))


def _direction(vec: Column) -> Column:
    """The vector scaled by a power of two to a size near 1: exact, so vectors that differ by such a factor have the
    same cosines to the last bit and are one point.  Very large and very small ones stay as they are."""
    power = F.floor(F.log2(F.array_max(F.transform(vec, F.abs))))
    scale = F.when(F.abs(power) < 200, F.pow(F.lit(2.0), power.cast("double"))).otherwise(F.lit(1.0))
    return F.transform(vec, lambda x: x / scale)


def build_index(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: its points (``ids`` of each, vectors) and its graph."""
    points = ["dim", "h1", "h2"]
    rows = usable(vectors, id_col, vec_col).dropDuplicates(["id", *points])
    least = rows.withColumn("at", F.row_number().over(Window.partitionBy(*points).orderBy("id"))).where(
        F.col("at") <= k + 1)
    found = saved(least.groupBy(*points).agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids")),
                  "points")
    shards = max(1, -(-found.count() // shard_rows))
    return saved(found.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
                 .groupBy("dim", "shard").applyInArrow(_build, _INDEX), "graphs")


def search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
           beam: int = BEAM, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k nearest rows found, the query's own id left out."""
    asked = usable(queries, id_col, vec_col).dropDuplicates(["id"]).select(
        F.col("id").alias("query_id"), "vec", "dim")
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    shards = index.groupBy("dim").agg(F.collect_set("shard").alias("shards"))  # one row a dimension
    # Every block of queries meets every shard of its dimension.
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.join(shards, "dim").select("query_id", "vec", "dim", "block", F.explode("shards").alias("shard"))
    met = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInArrow(
        _search(k, beam), "query_id long, ids array<long>, score double")
    found = met.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
