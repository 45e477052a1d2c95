"""Distributed ranks and previous-row lookups that never sort one hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SLOTS = 64  # sub-buckets of one second


def time_cells(df: DataFrame, time: str, ident: str) -> DataFrame:
    """Row counts and start offsets of (second, slot) cells in the order time, id % 64, id.

    Offsets are summed hour by hour; only the list of hours itself is ordered in one place,
    and a decade has fewer than 90,000 of them.
    """
    cells = df.groupBy(F.unix_seconds(time).alias("_sec"), F.pmod(F.col(ident), F.lit(SLOTS)).alias("_slot")).agg(
        F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("_hour", F.floor(F.col("_sec") / 3600))
    hours = cells.groupBy("_hour").agg(F.sum("_n").alias("_hn"))
    hours = hours.select("_hour", (F.sum("_hn").over(W.orderBy("_hour")) - F.col("_hn")).alias("_hoff"))
    within = W.partitionBy("_hour").orderBy("_sec", "_slot")
    return (cells.withColumn("_coff", F.sum("_n").over(within) - F.col("_n"))
            .join(hours, "_hour")
            .select("_sec", "_slot", "_n", (F.col("_coff") + F.col("_hoff")).alias("_off")))


def every_kth(df: DataFrame, time: str, ident: str, points: int) -> DataFrame:
    """Systematic sample: rows 0, k, 2k, ... with ``k = max(1, n div points)``."""
    cells = time_cells(df, time, ident)
    step = F.greatest(F.floor(cells.agg((F.sum("_n") / points)).scalar()), F.lit(1))
    hit = cells.withColumn("_step", step).filter(
        F.floor((F.col("_off") + F.col("_n") - 1) / F.col("_step")) * F.col("_step") >= F.col("_off"))
    keyed = df.withColumn("_sec", F.unix_seconds(time)).withColumn("_slot", F.pmod(F.col(ident), F.lit(SLOTS)))
    w = W.partitionBy("_sec", "_slot").orderBy(ident)
    return (keyed.join(hit, ["_sec", "_slot"])
            .withColumn("_i", F.col("_off") + F.row_number().over(w) - 1)
            .filter(F.col("_i") % F.col("_step") == 0)
            .drop("_sec", "_slot", "_n", "_off", "_step", "_i"))


def with_previous(df: DataFrame, keys: list[str], order: list[str], chunk: Column, carry: list[str],
                  prefix: str = "prev_") -> DataFrame:
    """Values of the preceding row per key, found inside (key, chunk) pieces.

    ``chunk`` must grow with the order (an hour or day number). A key that holds a large share
    of all rows is spread over its chunks; the first row of a chunk takes the last row of the
    key's previous non-empty chunk from a table with one row per (key, chunk).
    """
    base = df.withColumn("_chunk", chunk)
    last = base.groupBy(*keys, "_chunk").agg(
        F.max_by(F.struct(*carry), F.struct(*order)).alias("_last"))
    shifted = last.select(
        *keys, "_chunk", F.lag("_last").over(W.partitionBy(*keys).orderBy("_chunk")).alias("_before"))
    w = W.partitionBy(*keys, "_chunk").orderBy(*order)
    inner = base.withColumn("_prev", F.lag(F.struct(*carry)).over(w))
    out = inner.join(shifted, [*keys, "_chunk"])
    prev = F.coalesce(F.col("_prev"), F.col("_before"))
    return out.select(*df.columns, *[prev[c].alias(prefix + c) for c in carry])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark trims each map task to ``k`` rows per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
