"""Exact top-k search by integer inner product with a KD-tree per shard.

Vectors become integers, floor(scale * x). Rows are dealt into shards by id; a task builds its shard's tree (median
splits of the widest dimension, tight bounding boxes) and answers a block of queries best-first: a box cannot
hold a higher score than the inner product with its best corner, and subtrees below the k-th score known so far are
left out. Searching runs in two rounds. In the first, every query searches one shard; its k-th score there goes along
as the bound of the second round, in which the query meets the other shards.

Queries travel in blocks to every shard, so a task holds one shard and one block, both bounded. Equal scores go to
the smaller id: a subtree whose best possible score equals the k-th one is searched if it holds a smaller id.

Defined results: null vectors and vectors with a null, NaN or infinite component take no part; shorter vectors
count as filled up with zeros; rows without an id take no part; fewer than k candidates give all; equal
rows (same id and vector) count as one, other rows of one id are candidates each, but not for their own id, and the smallest vector of an id
is its query; columns of other names are not read; scores beyond a 64-bit integer are set to its limit; no rows give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

ship(__name__)

LIMIT = (1 << 63) - 1
RESULT = "query_id long, vec_id long, score long"


def exact_dtype(*sets: np.ndarray) -> type:
    """float64 where every sum of products is a whole number below 2^53, else Python integers."""
    width = max([x.shape[1] for x in sets if x.size] or [1])
    most = [float(np.abs(x).max()) if x.size else 0.0 for x in sets]
    return np.float64 if most[0] * most[-1] * width < 2.0**53 else object


class KDTree:
    """Balanced tree over the rows of `points`; nodes are kept level by level in arrays."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 64):
        order = np.argsort(ids, kind="stable")
        self.low, self.high, self.least, self.span, self.kids = [], [], [], [], []
        todo = [(order, -1, 0)]
        runs, at = [], 0
        while todo:
            rows, parent, side = todo.pop()
            me = len(self.low)
            if parent >= 0:
                self.kids[parent][side] = me
            p = points[rows]
            lo, hi = p.min(axis=0), p.max(axis=0)
            self.low.append(lo)
            self.high.append(hi)
            self.least.append(int(ids[rows].min()))
            self.kids.append([-1, -1])
            if len(rows) <= leaf:
                self.span.append((at, at + len(rows)))
                runs.append(rows)
                at += len(rows)
                continue
            self.span.append((0, 0))
            d = int(np.argmax(hi - lo))
            half = len(rows) // 2
            cut = np.argsort(p[:, d], kind="stable")
            todo += [(rows[cut[half:]], me, 1), (rows[cut[:half]], me, 0)]
        rows = np.concatenate(runs)
        self.points, self.ids = points[rows], ids[rows]
        self.low, self.high = np.stack(self.low), np.stack(self.high)

    def bounds(self, q: np.ndarray, nodes: list[int]) -> list:
        """Highest inner product that any point in each node's box can have with q."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return list(self.high[nodes] @ up + self.low[nodes] @ down)

    def search(self, q: np.ndarray, k: int, skip: int | None, known: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) but for id `skip`; those below the score `known` may be missing."""
        best: list[tuple] = []  # heap of (score, -id), the worst first
        todo = [(-self.bounds(q, [0])[0], 0)]
        while todo:
            most, node = heapq.heappop(todo)
            most = -most
            if known is not None and most < known:
                break
            if len(best) == k and most < best[0][0]:
                break
            if len(best) == k and most == best[0][0] and self.least[node] > -best[0][1]:
                continue
            kids = self.kids[node]
            if kids[0] >= 0:
                for b, n in zip(self.bounds(q, kids), kids, strict=True):
                    heapq.heappush(todo, (-b, n))
                continue
            a, z = self.span[node]
            scores, ids = self.points[a:z] @ q, self.ids[a:z]
            if len(best) == k:
                keep = np.flatnonzero(scores >= best[0][0])
            else:
                keep = range(z - a)
            for i in keep:
                x = (scores[i], -int(ids[i]))
                if -x[1] == skip:
                    continue
                if len(best) < k:
                    heapq.heappush(best, x)
                elif x > best[0]:
                    heapq.heapreplace(best, x)
        return sorted(((max(-LIMIT - 1, min(LIMIT, int(s))), -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _matrix(column: pd.Series, width: int, dtype: type) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.float64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    if dtype is object:
        return np.array([[int(x) for x in row] for row in out], dtype=object)
    return out


def _searcher(k: int):
    def run(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(shard["v"].map(len).max(), queries["wanted"].map(len).max())
        points, asked = _matrix(shard["v"], width, np.float64), _matrix(queries["wanted"], width, np.float64)
        if exact_dtype(points, asked) is object:
            points, asked = _matrix(shard["v"], width, object), _matrix(queries["wanted"], width, object)
        tree = KDTree(points, shard["vec_id"].to_numpy())
        out = []
        for q, i, known in zip(asked, queries["query_id"], queries["known"], strict=True):
            out += [(i, vec, s) for s, vec in tree.search(q, k, int(i), None if pd.isna(known) else int(known))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as doubles; null unless all components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    # floor as a double: a component times the scale may not fit a long
    scaled = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    floor = F.transform(scaled, lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y))
    return F.when(vector.isNotNull() & ~bad, floor)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id: str = "vec_id", vector: str = "embedding",
          shard_rows: int = 8192, block_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for every row for which `queries` holds, against all rows but itself."""
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), whole_numbers(F.col(vector), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).groupBy("vec_id", "v").agg(F.max("asked").alias("asked"))
    rows = stored(rows, "vectors")
    n, asked = rows.select(F.count(F.lit(1)), F.count(F.when(F.col("asked"), 1))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))
    # dealt by different hashes, so that no block meets its own rows only
    shard = F.pmod(F.xxhash64(F.lit("shard"), "vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int")
    kept = rows.select("vec_id", "v", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    q = rows.filter("asked").groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), F.col("v").alias("wanted"), block.alias("block"))
    home = F.pmod(F.xxhash64(F.lit("home"), "query_id"), F.lit(shards)).cast("int")

    def searched(some: DataFrame) -> DataFrame:
        return kept.groupBy("shard", "block").cogroup(some.groupBy("shard", "block")).applyInPandas(_searcher(k), RESULT)

    first = stored(searched(q.withColumns({"shard": home, "known": F.lit(None).cast("long")})), "first")
    if shards > 1:
        bound = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("known"))
        others = q.join(bound, "query_id", "left").withColumn("shard", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home)))
        first = first.union(searched(others))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
