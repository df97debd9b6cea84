"""Exact maximum inner product search: a ball tree for each shard, searched by branch and bound.

Vectors are dealt into shards of bounded size; each shard builds a ball tree. Within a shard a query visits nodes in
descending order of their upper bound q.center + |q| * radius and stops below its current k-th score. A query visits
shards in the order of the same bound of their roots, one in the first round and twice as many in each round after it.
What all queries have found is put together between rounds, so that every search starts from the k-th score of all
shards before it, and a query is sent only to shards whose bound reaches that score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.common import cut, tidied

#: Vectors of a shard, and shards at most (their roots are broadcast; beyond that shards grow).
SHARD, SHARDS = 8192, 100_000
LEAF = 256
#: Queries that meet a copy of a shard in one task, and those searched at a time.
CELL, BLOCK = 65_536, 512
NONE = np.iinfo(np.int64).min


class BallTree:
    """Nodes as arrays; a node holds the points first..last of ``points``, which are reordered so."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        self.first, self.last, self.parent, self.leaf = [], [], [], []
        centers, radii = [], []
        stack = [(0, len(ids), -1)]
        real = points.astype(np.float64)
        while stack:
            a, b, up = stack.pop()
            x = real[order[a:b]]
            center = x.mean(axis=0)
            far = np.sqrt(((x - center) ** 2).sum(axis=1))
            centers.append(center)
            radii.append(float(far.max(initial=0)))
            self.first.append(a), self.last.append(b), self.parent.append(up)
            radius, me = radii[-1], len(radii) - 1
            self.leaf.append(b - a <= LEAF or radius == 0)
            if not self.leaf[-1]:
                one = x[far.argmax()]
                other = x[((x - one) ** 2).sum(axis=1).argmax()]
                along = x @ (other - one)
                order[a:b] = order[a:b][np.argsort(along, kind="stable")]
                half = (a + b) // 2
                stack += [(a, half, me), (half, b, me)]
        self.ids, self.points = ids[order], points[order]
        self.centers, self.radii = np.array(centers), np.array(radii)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, best: np.ndarray, who: np.ndarray, floor: np.ndarray) -> None:
        """Merges each query's best here that reach its floor into its k best so far (scores, ids); ties to smaller ids."""
        m, k, none = len(queries), best.shape[1], NONE
        width = max(queries.shape[1], self.points.shape[1])
        q = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        points = np.pad(self.points, ((0, 0), (0, width - self.points.shape[1])))
        centers = np.pad(self.centers, ((0, 0), (0, width - self.centers.shape[1])))
        real = q.astype(np.float64)
        exact = np.abs(real).max(initial=0) * float(np.abs(points).max(initial=0)) * width < 2**53
        bound = real @ centers.T + np.sqrt((real**2).sum(axis=1))[:, None] * self.radii[None, :]
        bound += 1e-9 * np.abs(bound) + 1e-6
        kth = np.maximum(floor, np.where(best[:, k - 1] == none, -np.inf, best[:, k - 1].astype(np.float64)))
        for node, up in enumerate(self.parent):  # parents stand before their children
            if up >= 0:
                bound[:, node] = np.minimum(bound[:, node], bound[:, up])
        leaves = np.flatnonzero(self.leaf)
        order = leaves[np.argsort(-bound[:, leaves], axis=1, kind="stable")]
        alive = np.arange(m)
        for turn in range(len(leaves)):
            node = order[alive, turn]
            open_ = bound[alive, node] >= kth[alive]  # the others' next nodes are bounded lower still
            alive, node = alive[open_], node[open_]
            if not len(alive):
                break
            for n in np.unique(node).tolist():
                rows = alive[node == n]
                a, b = self.first[n], self.last[n]
                score = np.rint(real[rows] @ points[a:b].T.astype(np.float64)).astype(np.int64) if exact else q[rows] @ points[a:b].T
                score[self.ids[a:b][None, :] == query_ids[rows][:, None]] = none
                hit = score.max(axis=1) >= kth[rows]
                rows, score = rows[hit], score[hit]
                if not len(rows):
                    continue
                both = np.concatenate([best[rows], score], axis=1)
                ids = np.concatenate([who[rows], np.broadcast_to(self.ids[a:b], score.shape)], axis=1)
                top = np.lexsort((ids, ~both), axis=1)[:, :k]
                best[rows], who[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)
                kth[rows] = np.maximum(kth[rows], np.where(best[rows, k - 1] == none, -np.inf, best[rows, k - 1].astype(np.float64)))


def _integers(column: pa.Array, scale: float) -> np.ndarray:
    lists = column.to_pylist()
    out = np.zeros((len(lists), max(map(len, lists), default=0)), np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = np.floor(scale * np.array(x, np.float64))
    return out


def _batch(arrays: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of highest integer inner product, its own id left out.

    Components become floor(scale * x). Rows with a null id, a null vector, or a null or non-finite component take no
    part; a shorter vector counts as filled up with zeros. Rows that share an id are candidates each, and as queries
    have a list of their own each; a query's own id never is a candidate. Ties go to the smaller id; fewer than k
    candidates: all of them. Empty table: no rows. Scores are exact while they fit 64 bits.
    """
    spark = vectors.sparkSession
    x = F.col("v")
    usable = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vector_col].cast("array<double>").alias("v"), is_query.alias("q"))
    usable = usable.where(F.col("id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    n = usable.count()
    size = max(SHARD, -(-n // SHARDS))
    shards = max(1, -(-n // size))
    # dealt by the whole row, so that neither an id nor a vector with many rows makes a shard larger
    shard = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    points = usable.select("id", "v", shard.alias("shard")).repartition(shards, "shard")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            keys, ids, v = np.asarray(batch.column(2)), np.asarray(batch.column(0)), _integers(batch.column(1), scale)
            for key in np.unique(keys).tolist():
                parts.setdefault(key, []).append((ids[keys == key], v[keys == key]))
        for key, found in parts.items():
            width = max(v.shape[1] for _, v in found)
            tree = BallTree(np.concatenate([i for i, _ in found]), np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, v in found]))
            yield _batch({"shard": pa.array([key], pa.int32()), "center": pa.array([tree.centers[0].tolist()], pa.list_(pa.float64())), "radius": pa.array([float(tree.radii[0])]), "tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary())})

    trees = cut(points.mapInArrow(tidied(build), "shard int, center array<double>, radius double, tree binary"))
    roots = trees.select("shard", "center", "radius").collect()  # SHARDS rows at most
    width = max((len(r.center) for r in roots), default=0)
    centers = np.zeros((len(roots), width))
    for i, r in enumerate(roots):
        centers[i, : len(r.center)] = r.center
    heads = spark.sparkContext.broadcast((np.array([r.shard for r in roots], np.int32), centers, np.array([r.radius for r in roots], np.float64)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _integers(batch.column(1), scale)
            yield _batch({"id": batch.column(0), "v": pa.array(v.tolist(), pa.list_(pa.int64()))})

    # a query row is told from others by a number of its own; written, so that the number stays
    asked = usable.where("q").select("id", "v").mapInArrow(tidied(ask), "id bigint, v array<bigint>")
    asked = cut(asked.select(F.monotonically_increasing_id().alias("q"), "id", "v"))
    cells = max(1, -(-asked.count() // CELL))
    tasks = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def choose(first: int, last: int):
        """Queries with the shards that stand at first..last in the order of their bounds, where those reach the k-th score."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, at, radii = heads.value
            for whole in batches:
                for o in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(o, BLOCK)
                    lists = batch.column(2).to_pylist()
                    real = np.zeros((len(lists), at.shape[1]))
                    for i, y in enumerate(lists):
                        real[i, : len(y)] = y[: at.shape[1]]
                    bound = real @ at.T + np.sqrt((real**2).sum(axis=1))[:, None] * radii[None, :]
                    bound += 1e-9 * np.abs(bound) + 1e-6
                    floor = np.array([-np.inf if y is None else float(y) for y in batch.column(3).to_pylist()])
                    order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                    row, column = np.nonzero(np.take_along_axis(bound, order, 1) >= floor[:, None])
                    taken = batch.take(pa.array(row))
                    yield _batch({"shard": pa.array(names[order[row, column]]), "q": taken.column(0), "id": taken.column(1), "v": taken.column(2), "floor": taken.column(3)})

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, rows = None, []

        def found() -> Iterator[pa.RecordBatch]:
            for o in range(0, len(rows), BLOCK):
                part = rows[o : o + BLOCK]
                v = np.zeros((len(part), max(len(r[2]) for r in part)), np.int64)
                for i, r in enumerate(part):
                    v[i, : len(r[2])] = r[2]
                start = np.array([-np.inf if r[3] is None else float(r[3]) for r in part])
                best, who = np.full((len(part), k), NONE, np.int64), np.zeros((len(part), k), np.int64)
                tree.search(np.array([r[1] for r in part], np.int64), v, best, who, start)
                row, column = np.nonzero((best != NONE) & (best >= start[:, None]))
                q = np.array([r[0] for r in part], np.int64)
                yield _batch({"q": pa.array(q[row]), "query_id": pa.array(np.array([r[1] for r in part], np.int64)[row]), "vec_id": pa.array(who[row, column]), "score": pa.array(best[row, column])})
            rows.clear()

        for batch in batches:
            for blob, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if blob is not None:  # a cell begins with its tree
                    if rows:
                        yield from found()
                    tree = pickle.loads(blob)
                else:
                    rows.append(row)
                    if len(rows) >= 8 * BLOCK:
                        yield from found()
        if rows:
            yield from found()

    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = spark.createDataFrame([], "q bigint, query_id bigint, vec_id bigint, score bigint")
    first, step = 0, 1
    while first < len(roots):
        floors = best.groupBy("q").agg(F.count("*").alias("m"), F.min("score").alias("floor")).where(F.col("m") >= k).select("q", "floor")
        pairs = asked.join(floors, "q", "left").select("q", "id", "v", "floor").mapInArrow(tidied(choose(first, first + step)), "shard int, q bigint, id bigint, v array<bigint>, floor bigint")
        pairs = pairs.withColumn("cell", F.pmod(F.xxhash64("q"), F.lit(cells)).cast("int")).withColumn("tree", F.lit(None).cast("binary"))
        if first:
            pairs = cut(pairs)
            if pairs.isEmpty():
                break
        copies = trees.select("shard", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "tree")
        met = copies.unionByName(pairs, allowMissingColumns=True).repartition(min(len(roots) * cells, tasks), "shard", "cell")
        ordered = met.sortWithinPartitions("shard", "cell", F.col("tree").isNull()).select("tree", "q", "id", "v", "floor")
        hits = ordered.mapInArrow(tidied(search), "q bigint, query_id bigint, vec_id bigint, score bigint")
        ranked = best.unionByName(hits).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        best = cut(ranked.select("q", "query_id", "vec_id", "score"))
        first, step = first + step, 2 * step
    return best.select("query_id", F.row_number().over(by_score).alias("rank"), "vec_id", "score")
