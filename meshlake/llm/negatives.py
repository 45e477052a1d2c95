"""Hard negatives by angular triangle filtering.

Vectors become integers, floor(scale * x). Each row stores its norm and its angles to a few reference directions. Two
rows with angles s and t to a reference differ in direction by no less than |s - t| and by no more than s + t and 2 pi - s - t; the
cosines of these, times both norms, bound the integer inner product from both sides, widened by more than the rounding.

Rows are dealt by range over (nearest reference, angle to it) into shards, so a shard spans a narrow interval
of angles; one small row per shard (intervals of angles and norms, at most `MOST_SHARDS` rows) tells which shards an anchor can skip. Within a
shard, the rows whose angle to a reference lies within reach of the anchor's are a window of that reference's order; the
narrowest window is taken, the bounds of its rows are compared with the scores asked for, and only rows whose
bounds overlap them are scored. Positives are found in the anchor's own shard first, whose k-th score bounds the search in
the others; negatives are looked for between the scores that the positives allow.

A task holds one shard and one block of anchors, both bounded; anchors of neighbouring shards share blocks.

Defined results: rows with a null id, label or vector, or a vector with a null, NaN or infinite component, take no
part; shorter vectors count as filled up with zeros; rows equal in id, label and vector count as one, other
rows of one id as candidates of their own, but never for their own id; the anchor of such an id is the row of smallest label, then
vector; equal scores go to the smaller id; scores beyond a 64-bit integer are set to its limit before they are compared;
an anchor without positives, or a positive without negatives, gives no rows; columns of other names are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, ship, stored
from .topk import LIMIT, _matrix, exact_dtype, whole_numbers

ship(__name__)

#: Shards grow beyond this number of them, so what tasks are told about all shards stays bounded.
MOST_SHARDS = 65536
#: Angles are exact to about 1e-7 where they are near 0 or pi.
SLACK = 1e-6
FOUND = "anchor_id long, vec_id long, score long"


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    rows = column.tolist()
    if rows and all(len(v) == width for v in rows):
        return np.stack(rows)
    return _matrix(column, width, np.float64)


def measured(points: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to unit vectors (0 for null vectors), without overflow on the way."""
    most = np.abs(points).max(axis=1, initial=0.0)
    unit = points / np.where(most > 0, most, 1.0)[:, None]
    length = np.sqrt((unit * unit).sum(axis=1))
    with np.errstate(over="ignore"):
        norms = most * length
    cosines = unit @ references.T / np.where(length > 0, length, 1.0)[:, None]
    return norms, np.where(length[:, None] > 0, np.arccos(np.clip(cosines, -1.0, 1.0)), 0.0)


def _product(norm, norms: np.ndarray, cosine: np.ndarray, up: int) -> np.ndarray:
    """Product of norms and cosine, beyond which (up: 1, down: -1) no score of the pair can lie."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = norm * norms
        out = size * cosine + up * (1.0 + 1e-9 * size)
    return np.clip(np.where(np.isfinite(out), out, up * np.inf), -LIMIT - 1, LIMIT)


def score_bounds(norm: float, angles: np.ndarray, norms: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest possible inner product with rows of the given norms and angles."""
    least = np.maximum(np.abs(others - angles).max(axis=1) - SLACK, 0.0)
    both = others + angles
    most = np.minimum(np.minimum(both.min(axis=1), 2 * np.pi - both.max(axis=1)) + SLACK, np.pi)
    return _product(norm, norms, np.cos(most), -1), _product(norm, norms, np.cos(least), 1)


class Shard:
    """Rows with their norms and angles, and their order by the angle to each reference."""

    def __init__(self, rows: pd.DataFrame, width: int):
        self.ids, self.labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        self.points = matrix(rows["v"], width)
        self.norms, self.angles = rows["norm"].to_numpy(), np.stack(rows["angles"].tolist())
        self.order = np.argsort(self.angles, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.angles, self.order, axis=0)
        self.longest = self.norms.max()
        self.scored = 0

    def window(self, norm: float, angles: np.ndarray, least: int | None) -> np.ndarray:
        """Rows that can reach the score `least`, by the reference that leaves the fewest."""
        if least is None or least <= 0:  # null vectors have no angle and score 0
            return np.arange(len(self.ids))
        with np.errstate(over="ignore"):
            size = norm * self.longest
        reach = np.arccos(min(1.0, least * (1 - 1e-9) / size)) + SLACK if size > 0 else 0.0
        a = [np.searchsorted(self.sorted[:, i], t - reach, "left") for i, t in enumerate(angles)]
        z = [np.searchsorted(self.sorted[:, i], t + reach, "right") for i, t in enumerate(angles)]
        i = int(np.argmin(np.subtract(z, a)))
        return self.order[a[i] : z[i], i]

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.scored += len(rows)
        s = self.points[rows] @ q
        return s.astype(np.int64) if s.dtype != object else np.array([max(-LIMIT - 1, min(LIMIT, int(x))) for x in s], dtype=np.int64)

    def best(self, q, norm, angles, skip: int, label, k: int, known: int | None) -> list[tuple[int, int]]:
        """The k best rows (id, score) of a label, highest bounds first; those below the score `known` may be missing."""
        rows = self.window(norm, angles, known)
        rows = rows[(self.labels[rows] == label) & (self.ids[rows] != skip)]
        _, high = score_bounds(norm, angles, self.norms[rows], self.angles[rows])
        if known is not None:
            rows, high = rows[high >= known], high[high >= known]
        turn = np.argsort(-high, kind="stable")
        rows, high = rows[turn], high[turn]
        ids, scores, at = np.empty(0, np.int64), np.empty(0, np.int64), 0
        while at < len(rows) and not (len(ids) == k and high[at] < scores[-1]):
            some = rows[at : at + 64]
            at += 64
            ids, scores = np.concatenate([ids, self.ids[some]]), np.concatenate([scores, self.scores(some, q)])
            top = _first(scores, ids, k)
            ids, scores = ids[top], scores[top]
        return list(zip(ids.tolist(), scores.tolist(), strict=True))

    def between(self, q, norm, angles, skip: int, label, spans: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each span of scores the k best rows (id, score) of other labels."""
        low, high = min(s[0] for s in spans), max(s[1] for s in spans)
        rows = self.window(norm, angles, low)
        rows = rows[(self.labels[rows] != label) & (self.ids[rows] != skip)]
        least, most = score_bounds(norm, angles, self.norms[rows], self.angles[rows])
        rows = rows[(most >= low) & (least <= high)]
        scores, ids = self.scores(rows, q), self.ids[rows]
        out = []
        for a, z in spans:
            fit = np.flatnonzero((scores >= a) & (scores <= z))
            fit = fit[_first(scores[fit], ids[fit], k)]
            out.append(list(zip(ids[fit].tolist(), scores[fit].tolist(), strict=True)))
        return out


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by id."""
    return np.lexsort((ids, ~scores))[:k]  # ~x falls as x rises, without overflow


def _opened(rows: pd.DataFrame, anchors: pd.DataFrame) -> tuple[Shard, np.ndarray]:
    width = max(rows["v"].map(len).max(), anchors["v"].map(len).max())
    shard, asked = Shard(rows, width), matrix(anchors["v"], width)
    if exact_dtype(shard.points, asked) is object:
        shard.points, asked = _matrix(rows["v"], width, object), _matrix(anchors["v"], width, object)
    return shard, asked


def _positives(k: int):
    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            shard, asked = _opened(rows, anchors)
            for q, a in zip(asked, anchors.itertuples(), strict=True):
                known = None if pd.isna(a.known) else int(a.known)
                out += [(a.vec_id, *x) for x in shard.best(q, a.norm, a.angles, a.vec_id, a.label, k, known)]
        return pd.DataFrame(out, columns=["anchor_id", "vec_id", "score"]).astype("int64")

    return run


def _negatives(k: int, low: int, high: int):
    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            shard, asked = _opened(rows, anchors)
            for q, a in zip(asked, anchors.itertuples(), strict=True):
                spans = [allowed(int(s), low, high) for s in a.scores]
                for i, s, found in zip(a.positives, a.scores, shard.between(q, a.norm, a.angles, a.vec_id, a.label, spans, k), strict=True):
                    out += [(a.vec_id, int(i), int(s), *x) for x in found]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]).astype("int64")

    return run


def allowed(score: int, low: int, high: int) -> tuple[int, int]:
    """Scores between `low` and `high` hundredths of a positive's."""
    return -(-low * score // 100), high * score // 100


class Spread(NamedTuple):
    """Of every shard: its number, its block of anchors, intervals of norms and angles."""

    shard: np.ndarray
    block: np.ndarray
    norms: np.ndarray
    low: np.ndarray
    high: np.ndarray


def spread_of(rows: DataFrame, n_references: int, block_rows: int) -> Spread:
    angle = [F.col("angles")[i] for i in range(n_references)]
    found = rows.groupBy("shard").agg(F.count(F.when(F.col("asked"), 1)), F.min("norm"), F.max("norm"), F.array(*map(F.min, angle)), F.array(*map(F.max, angle))).collect()
    found.sort(key=lambda r: r[0])
    block = np.cumsum([0, *(r[1] for r in found)])[:-1] // block_rows if found else np.empty(0)
    return Spread(np.array([r[0] for r in found]), block, np.array([[r[2], r[3]] for r in found]), np.array([r[4] for r in found]), np.array([r[5] for r in found]))


def _visits(spread: Spread, low: int, high: int, home: bool | None):
    """Each anchor once for every shard that may hold rows with the scores it looks for; home: the own shard only, or all others."""

    def run(batches):
        for b in batches:
            which, shards = [], []
            for i, a in enumerate(b.itertuples()):
                own = spread.shard == a.shard
                if home:
                    fits = own
                else:
                    gap = np.maximum(np.maximum(spread.low - a.angles, a.angles - spread.high).max(axis=1) - SLACK, 0.0)
                    most = np.maximum(*(_product(a.norm, spread.norms[:, j], np.cos(gap), 1) for j in (0, 1)))
                    least = None if home is False else min(allowed(int(s), low, high)[0] for s in a.scores)
                    if home is False:
                        least = None if pd.isna(a.known) else int(a.known)
                    fits = np.ones(len(own), bool) if least is None else most >= least
                    if home is False:
                        fits = fits & ~own
                shards.append(spread.shard[fits])
                which.append(np.full(len(shards[-1]), i))
            out = b.iloc[np.concatenate(which)].copy() if which else b
            block = dict(zip(spread.shard.tolist(), spread.block.tolist(), strict=True))
            out["block"] = out["shard"].map(block).astype("int64")
            out["shard"] = np.concatenate(shards) if shards else out["shard"]
            yield out

    return run


def hard_negatives(vectors: DataFrame, anchors: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100, scale: int = 256, references: int = 16, shard_rows: int = 4096, block_rows: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows for which `anchors` holds.

    A positive is one of an anchor's `positives` best rows of its label; its negatives are the `negatives` best rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score. Reference directions are `references` rows, chosen by a
    hash of their ids; any choice gives the same result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), whole_numbers(F.col(vector), scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asked"))
    rows = stored(rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").groupBy("vec_id", "label", "v").agg(F.max("asked").alias("asked")), "vectors")
    n, width = rows.select(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    some = rows.filter(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").select("v").limit(references).toPandas()
    axes = matrix(some["v"], width) if len(some) else np.ones((1, width))
    axes = axes / np.abs(axes).max(axis=1, keepdims=True) if width else axes
    axes = axes / np.sqrt((axes * axes).sum(axis=1, keepdims=True)) if width else axes

    def angles(batches):
        for b in batches:
            norms, found = measured(matrix(b["v"], width), axes)
            home = found.argmin(axis=1) if len(b) else np.empty(0, int)
            yield b.assign(norm=norms, angles=list(found), home=home.astype("int32"), at=found[np.arange(len(b)), home])

    kinds = "vec_id long, label string, v array<double>, asked boolean, norm double, angles array<double>"
    shards = max(1, min(MOST_SHARDS, -(-n // shard_rows)))
    dealt = rows.mapInPandas(angles, f"{kinds}, home int, at double").repartitionByRange(shards, "home", "at", "vec_id").withColumn("shard", F.spark_partition_id()).drop("home", "at")
    dealt = stored(dealt, "shards")
    spread = spread_of(dealt, len(axes), block_rows)
    one = dealt.filter("asked").groupBy("vec_id").agg(F.min(F.struct("label", "v", "norm", "angles", "shard")).alias("x")).select("vec_id", "x.*")
    asking = stored(one, "anchors")
    meant = "vec_id long, label string, v array<double>, norm double, angles array<double>, shard int"

    def searched(some: DataFrame, extra: str, home: bool | None, task, result: str) -> DataFrame:
        visits = some.mapInPandas(_visits(spread, low, high, home), f"{meant}, {extra}, block long")
        visits = stored(visits, "visits")
        made.append(visits)
        shard = dealt.drop("asked").join(visits.select("shard", F.col("block").alias("of")).distinct(), "shard")
        return shard.groupBy("shard", "of").cogroup(visits.groupBy("shard", "block")).applyInPandas(task, result)

    made = [rows, asking]
    near = stored(searched(asking.withColumn("known", F.lit(None).cast("long")), "known long", True, _positives(positives), FOUND), "positives")
    bound = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= positives, F.min("score")).alias("known"))
    far = searched(asking.join(bound, "vec_id", "left"), "known long", False, _positives(positives), FOUND)
    best = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    chosen = near.unionByName(far).withColumn("r", best).filter(F.col("r") <= positives)
    chosen = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("p"))
    with_positives = stored(asking.join(chosen, "vec_id").withColumns({"positives": F.col("p.vec_id"), "scores": F.col("p.score")}).drop("p"), "asking")
    made += [near, with_positives]
    found = searched(with_positives, "positives array<long>, scores array<long>", None, _negatives(negatives, low, high),
                     "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    out = stored(found.withColumn("rank", rank).filter(F.col("rank") <= negatives), "negatives")
    forget(*made, dealt)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
