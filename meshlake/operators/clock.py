"""Clock skew of nodes, corrected for the clocks of the stations that heard them."""

from __future__ import annotations

from array import array
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from meshlake.functions import names
from meshlake.functions.numeric import true_median, trunc_round
from meshlake.functions.ranks import top_per_group

# fixed values: accepted advert times, severity limits and drift rules, in seconds
FIRST_VALID, LAST_VALID = 1577836800, 4102444800
WARNING, CRITICAL, ABSURD, NO_CLOCK = 300, 3600, 30 * 86400, 365 * 86400
RECENT_COUNT, RECENT_SECS, GOOD_SECS = 5, 3600, 3600
MIN_DRIFT_SAMPLES, MAX_JUMP, MAX_DRIFT = 5, 60.0, 86400.0


def classify_skew(skew: Column) -> Column:
    a = F.abs(skew)
    return (F.when(a >= NO_CLOCK, "no_clock").when(a >= ABSURD, "absurd").when(a >= CRITICAL, "critical").when(a >= WARNING, "warning").otherwise("ok"))


def skew_samples(tx: DataFrame, obs: DataFrame) -> DataFrame:
    """(hash, observer, advert time, observed time) of adverts with a believable time."""
    nested = F.col("decoded.payload.timestamp")
    t = F.when(nested > 0, nested).otherwise(F.col("decoded.timestamp"))
    head = tx.filter(F.col("payload_type") == names.ADVERT).select(
        F.col("id").alias("transmission_id"), "hash", F.col("decoded.pubKey").alias("public_key"), t.alias("advert_ts"))
    return obs.select("transmission_id", "observer_id", F.col("id").alias("obs_id"), F.unix_seconds("timestamp").alias("observed_ts")).join(
        head.filter(F.col("advert_ts").between(FIRST_VALID, LAST_VALID)), "transmission_id").filter(F.col("observed_ts") > 0)


def observer_calibration(samples: DataFrame) -> DataFrame:
    """Median deviation of each station from the packets' median hearing time."""
    med = samples.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), true_median("observed_ts").alias("m")).filter(F.col("n") >= 2)
    dev = samples.join(med, "hash").select("observer_id", (F.col("observed_ts") - F.col("m")).alias("dev"))
    return dev.groupBy("observer_id").agg(true_median("dev").alias("offset"), F.count(F.lit(1)).alias("samples"))


def corrected_samples(samples: DataFrame, offsets: DataFrame) -> DataFrame:
    raw = (F.col("advert_ts") - F.col("observed_ts")).cast("double")
    return samples.join(offsets.select("observer_id", "offset"), "observer_id", "left").withColumns({
        "raw": raw, "corrected": raw + F.coalesce("offset", F.lit(0.0)), "calibrated": F.col("offset").isNotNull()})


def hash_skew(corrected: DataFrame) -> DataFrame:
    """Per advert: mean, median and last corrected skew over its stations."""
    med = true_median("corrected")
    return corrected.groupBy("hash", "public_key", "advert_ts").agg(
        trunc_round(F.avg("corrected"), 1).alias("mean_skew"), trunc_round(med, 1).alias("median_skew"),
        trunc_round(F.min_by("corrected", F.struct("observed_ts", -F.col("obs_id"))), 1).alias("last_skew"),
        classify_skew(med).alias("severity"), F.count(F.lit(1)).alias("samples"), F.bool_or("calibrated").alias("calibrated"),
        F.max("observed_ts").alias("last_observed_ts"))


def mean_tenths(col: str, digits: int) -> Column:
    """Mean of values kept in tenths, summed as integers so that row order cannot matter."""
    total = F.sum(F.round(F.col(col) * 10).cast("bigint")) * (10 ** (digits - 1))
    return (total / F.count(col) + 0.5).cast("bigint") / float(10 ** digits)


def node_skew(hashes: DataFrame) -> DataFrame:
    """Skew and severity of every node from its adverts."""
    order = [F.col("last_observed_ts").desc(), F.col("hash").desc()]
    last = top_per_group(hashes.select("public_key", "hash", "last_observed_ts", "median_skew"), ["public_key"], order, RECENT_COUNT, "r")
    newest = F.max("last_observed_ts").over(W.partitionBy("public_key"))
    near = last.withColumn("newest", newest).filter(F.col("newest") - F.col("last_observed_ts") <= RECENT_SECS)
    good = F.abs("median_skew") <= GOOD_SECS
    rec = near.groupBy("public_key").agg(
        F.count(F.lit(1)).alias("recent_samples"), F.count_if(good).alias("good"), true_median("median_skew").alias("m"),
        true_median(F.when(good, F.col("median_skew"))).alias("gm"))
    newest_row = F.struct("last_observed_ts", "hash")
    all_ = hashes.groupBy("public_key").agg(
        mean_tenths("median_skew", 1).alias("mean_skew"), trunc_round(true_median("median_skew"), 1).alias("median_skew"),
        F.max_by(F.struct("last_skew", "advert_ts"), newest_row).alias("l"), F.sum("samples").alias("sample_count"),
        F.bool_or("calibrated").alias("calibrated"), F.max("last_observed_ts").alias("last_observed_ts"))
    frac = F.col("good") / F.col("recent_samples")
    bad = F.col("recent_samples") - F.col("good")
    value = F.when((frac >= 0.10) & (bad > 0) & (F.col("good") > 0), F.col("gm")).otherwise(F.col("m"))
    sev = F.when(frac < 0.10, "no_clock").when((frac < 0.80) & (bad > 0), "bimodal_clock").otherwise(classify_skew(value))
    return all_.join(rec, "public_key").select(
        "public_key", "mean_skew", "median_skew", F.col("l.last_skew").alias("last_skew"), trunc_round(value, 1).alias("recent_median_skew"),
        sev.alias("severity"), "sample_count", "calibrated", F.col("l.advert_ts").alias("last_advert_ts"), "last_observed_ts",
        trunc_round(frac, 2).alias("good_fraction"), bad.alias("recent_bad_samples"), "recent_samples")


def _slopes(t: np.ndarray, v: np.ndarray, cells: int = 1 << 22):
    """All pairwise slopes of points in the order of time, in pieces of bounded size."""
    rows = max(1, cells // len(t))
    for i in range(0, len(t) - 1, rows):
        dt = t[None, i + 1:] - t[i:i + rows, None]
        later = dt > 0
        yield (v[None, i + 1:] - v[i:i + rows, None])[later] / dt[later]


def _theil_sen_listed(t: np.ndarray, v: np.ndarray) -> float:
    """The same by going through all slopes: those between two guesses that a sample of pairs gives are kept, the others
    counted; guesses that miss the middle are widened."""
    rng = np.random.default_rng(0)
    i, j = np.sort(rng.integers(0, len(t), (2, 1_000_000)), axis=0)
    i, j = i[t[j] > t[i]], j[t[j] > t[i]]
    sample = (v[j] - v[i]) / (t[j] - t[i])
    width = 0.002
    while True:
        lo, hi = np.quantile(sample, [0.5 - width, 0.5 + width], method="nearest") if len(sample) and width < 0.5 else (-np.inf, np.inf)
        below = at_lo = at_hi = n = 0
        inner = []
        for s in _slopes(t, v):
            n += len(s)
            below += int((s < lo).sum())
            at_lo += int((s == lo).sum())
            at_hi += int((s == hi).sum()) if hi > lo else 0
            inner.append(s[(s > lo) & (s < hi)])
        if not n:
            return 0.0
        inner = np.sort(np.concatenate(inner))
        ranks = [(n - 1) // 2, n // 2]
        if below <= ranks[0] and ranks[1] < below + at_lo + len(inner) + at_hi:
            of = lambda r: lo if r < below + at_lo else inner[r - below - at_lo] if r < below + at_lo + len(inner) else hi
            return float((of(ranks[0]) + of(ranks[1])) / 2)
        width *= 8


def _inversions(x: np.ndarray, picks: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Pairs p < q with x[q] < x[p]: their number, and places (p, q) of the asked ones, by their number in the order met.

    A merge sort from the bottom up, all blocks of a round at once.
    """
    n = len(x)
    size = 1 << max(n - 1, 1).bit_length()
    val = np.concatenate([np.unique(x, return_inverse=True)[1].astype("int64"), n + np.arange(size - n)])
    place = np.arange(size)
    total, p, q, w = 0, [], [], 1
    while w < size:
        v, o = val.reshape(-1, 2 * w), place.reshape(-1, 2 * w)
        shift = np.arange(len(v))[:, None] * (2 * size)
        left, right = (v[:, :w] + shift).ravel(), (v[:, w:] + shift).ravel()
        pos = np.searchsorted(left, right, side="right")
        ends = np.cumsum(np.repeat(np.arange(1, len(v) + 1), w) * w - pos)
        if picks is not None:
            mine = picks[(picks >= total) & (picks < total + ends[-1])] - total
            r = np.searchsorted(ends, mine, side="right")
            p.append(o[:, :w].ravel()[pos[r] + mine - np.where(r > 0, ends[r - 1], 0)])
            q.append(o[:, w:].ravel()[r])
        total += int(ends[-1])
        s = np.argsort(v, axis=1, kind="stable")
        val, place = np.take_along_axis(v, s, 1).ravel(), np.take_along_axis(o, s, 1).ravel()
        w *= 2
    none = np.zeros(0, dtype="int64")
    return total, np.concatenate(p or [none]), np.concatenate(q or [none])


def _alike(*keys: np.ndarray) -> int:
    """Pairs that agree in all keys."""
    order = np.lexsort(keys)
    new = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
    m = np.diff(np.concatenate([[0], np.flatnonzero(new) + 1, [len(order)]]))
    return int((m * (m - 1) // 2).sum())


def _theil_sen(t: np.ndarray, v: np.ndarray, small: int = 2000) -> float:
    """Median of the slopes of all pairs of points at different times, in time n log n.

    Short series list their slopes. In longer ones the middle slope is closed in between two slopes of pairs: a slope p/q orders the
    points by v - t p/q, in which pairs of a smaller slope are those out of the order of time, so slopes are counted by sorting;
    a sample of the slopes in between narrows them until few remain, which are listed. Counting is exact: skews are whole tenths of
    a second and times whole seconds. Series that are not, or so long and wide that products leave 62 bits, list theirs in pieces.
    """
    if len(t) <= small:
        s = np.concatenate(list(_slopes(t, v)) or [np.zeros(0)])
        return float(np.median(s)) if len(s) else 0.0
    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    ti, vi = np.rint(t - t[0]).astype("int64"), np.rint((v - v[0]) * 10).astype("int64")
    wide = float(np.ptp(vi)) * float(ti[-1])
    if wide >= 2.0 ** 60 or np.abs(t - t[0] - ti).max() > 1e-6 or np.abs((v - v[0]) * 10 - vi).max() > 1e-3:
        return _theil_sen_listed(t, v)
    n = len(t) * (len(t) - 1) // 2 - _alike(ti)
    if not n:
        return 0.0
    a, b = ((n - 1) // 2, n // 2)
    if a != b:
        return (_slope_at(t, v, ti, vi, n, a) + _slope_at(t, v, ti, vi, n, b)) / 2
    return _slope_at(t, v, ti, vi, n, a)


def _slope_at(t: np.ndarray, v: np.ndarray, ti: np.ndarray, vi: np.ndarray, n: int, rank: int, few: int = 2_000_000, sample: int = 200_000) -> float:
    """The slope of a rank among the n slopes of points in the order of (t, v)."""
    rng = np.random.default_rng(0)
    key = lambda s: vi * (ti[s[1]] - ti[s[0]]) - ti * (vi[s[1]] - vi[s[0]])
    of = lambda s: float((v[s[1]] - v[s[0]]) / (t[s[1]] - t[s[0]]))
    lo = hi = None  # pairs of points; the slope looked for lies between theirs, neither included
    below = 0
    i, j = np.sort(rng.integers(0, len(t), (2, 5 * sample)), axis=0)
    inside = n
    while True:
        keep = ti[j] > ti[i]
        i, j = i[keep], j[keep]
        s = np.argsort((v[j] - v[i]) / (t[j] - t[i]), kind="stable")
        at = (rank - below) / inside * len(s)
        slack = 4 * np.sqrt(len(s)) + 2
        for r in (int(at - slack), int(at + slack)):
            if not 0 <= r < len(s):
                continue
            cand = (i[s[r]], j[s[r]])
            k = key(cand)
            under = _inversions(k)[0]
            same = _alike(k) - _alike(k, ti)
            if under <= rank < under + same:
                return of(cand)
            if under > rank:
                hi = cand if under - below < inside else hi
            else:
                lo, below = cand, under + same
        # slopes strictly between lo and hi: pairs that the two orders put differently
        first = np.lexsort((key(hi) if hi else -ti, key(lo) if lo else ti))
        second = (key(hi) if hi else -ti)[first]
        inside = _inversions(second)[0]
        picks = np.arange(inside) if inside <= few else np.unique(rng.integers(0, inside, sample))
        _, p, q = _inversions(second, picks)
        i, j = first[p], first[q]
        if inside <= few:
            s = np.sort((v[j] - v[i]) / (t[j] - t[i]))
            return float(s[rank - below])


class _Series:
    """What the drift rule needs of one node's series; with ``points`` the slope is that of the last ones only."""

    def __init__(self, key: str, points: int | None):
        self.key, self.n = key, 0
        self.first = self.last = None
        self.kept_first = self.kept_last = None
        self.kept_n = 0
        self.points = points
        self.raw, self.kept = (array("q"), array("d")), (array("q"), array("d"))

    def put(self, series: tuple[array, array], t: int, v: float) -> None:
        series[0].append(t)
        series[1].append(v)
        if self.points is not None and len(series[0]) >= 2 * self.points + 1024:
            for s in series:
                del s[:len(s) - self.points]

    def add(self, t: int, v: float) -> None:
        self.n += 1
        self.first = t if self.first is None else self.first
        self.last = t
        self.put(self.raw, t, v)
        if self.kept_last is None or abs(v - self.kept_last) <= MAX_JUMP:
            self.kept_first = t if self.kept_first is None else self.kept_first
            self.kept_last = v
            self.kept_n += 1
            self.put(self.kept, t, v)

    def drift(self) -> float:
        if self.last - self.first < 3600:
            return 0.0
        use = self.kept if self.kept_n >= 2 and self.kept[0][-1] - self.kept_first >= 3600 else self.raw
        t, v = (np.array(s, dtype="float64")[-self.points if self.points else 0:] for s in use)
        d = _theil_sen(t, v) * 86400
        return 0.0 if abs(d) > MAX_DRIFT else d


def _fold_series(batches, points: int | None = None):
    cur = None
    out = []
    for pdf in batches:
        for k, t, v in zip(pdf["public_key"].to_numpy(), pdf["t"].to_numpy(), pdf["v"].to_numpy()):
            if cur is None or cur.key != k:
                if cur is not None and cur.n >= MIN_DRIFT_SAMPLES:
                    out.append((cur.key, cur.n, cur.drift()))
                cur = _Series(k, points)
            cur.add(int(t), float(v))
        if len(out) >= 10_000:
            yield pd.DataFrame(out, columns=["public_key", "points", "drift"])
            out = []
    if cur is not None and cur.n >= MIN_DRIFT_SAMPLES:
        out.append((cur.key, cur.n, cur.drift()))
    if out:
        yield pd.DataFrame(out, columns=["public_key", "points", "drift"])


def node_drift(hashes: DataFrame, skew: DataFrame, points: int | None = None) -> DataFrame:
    """Seconds per day a node's clock gains, by the median of pairwise slopes of the last ``points`` (None: all).

    Clock corrections are removed by comparing with the last kept point, a fold no window
    expresses. Spark sorts the series (spilling if need be) and the fold reads it as a stream, keeping
    32 bytes a point.
    """
    if points is not None and points < 2:
        raise ValueError("a slope takes two points")
    use = skew.filter(~F.col("severity").isin("no_clock", "bimodal_clock")).select("public_key")
    s = hashes.join(use, "public_key", "left_semi").select(
        "public_key", F.col("last_observed_ts").alias("t"), "hash", F.col("median_skew").alias("v"))
    s = s.repartition("public_key").sortWithinPartitions("public_key", "t", "hash").select("public_key", "t", "v")
    d = s.mapInPandas(partial(_fold_series, points=points), "public_key string, points bigint, drift double")
    return d.select("public_key", "points", trunc_round(F.col("drift"), 2).alias("drift_per_day"))


def hash_evidence(corrected: DataFrame, observers: DataFrame, limit: int = 10) -> DataFrame:
    """Newest adverts of each node with every station's raw and corrected skew."""
    h = corrected.groupBy("public_key", "hash").agg(F.max("observed_ts").alias("ts"), trunc_round(true_median(trunc_round(F.col("corrected"), 1)), 1).alias("median_corrected"))
    top = top_per_group(h, ["public_key"], [F.col("ts").desc(), F.col("hash")], limit)
    who = observers.select(F.col("id").alias("observer_id"), F.col("name").alias("_n"))
    return corrected.select("hash", "observer_id", "obs_id", "raw", "corrected", "offset", "calibrated").join(top, "hash").join(who, "observer_id", "left").select(
        "public_key", "hash", "ts", "median_corrected", "observer_id", "obs_id",
        F.coalesce(F.when(F.col("_n") != "", F.col("_n")), F.col("observer_id")).alias("observer_name"), trunc_round(F.col("raw"), 1).alias("raw_skew"),
        trunc_round(F.col("corrected"), 1).alias("corrected_skew"), trunc_round(F.coalesce("offset", F.lit(0.0)), 1).alias("offset"), "calibrated")


def fleet_skew(skew: DataFrame, drift: DataFrame, nodes: DataFrame) -> DataFrame:
    return skew.join(drift.select("public_key", "drift_per_day"), "public_key", "left").join(nodes.select("public_key", "name", "role"), "public_key", "left").withColumn(
        "drift_per_day", F.coalesce("drift_per_day", F.lit(0.0)))
