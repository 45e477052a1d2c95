"""Keeping the hourly rollups current.

Changes come from three sides: observations with ids above the watermark, rows that were removed, and packets that were
merged. Each names the hours it touches, by time of hearing and by time of the packet, and exactly these hours are
rebuilt from both facts, which are read from the first touched hour on (by day folders): no observation is older than its
packet. New hours are built aside and put in the place of the old; an hour without rows any more is
removed. The watermark lies with the rollups and moves last, so a run that failed is repeated for the same hours.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshlake.functions.time import hour_of
from meshlake.session import cut_lineage, delete, exists, folders, move

from . import rollups as U


class Touched(NamedTuple):
    """Hours to rebuild, by time of hearing and by first receive time of the packet; at most one entry per stored hour."""

    heard: list[datetime]
    seen: list[datetime]

    def whole_days(self) -> Touched:
        """All hours of the touched days."""
        return Touched(*([datetime(d.year, d.month, d.day, h, tzinfo=timezone.utc) for d in sorted({x.date() for x in hours}) for h in range(24)] for hours in self))

    def __or__(self, other: Touched) -> Touched:
        return Touched(sorted({*self.heard, *other.heard}), sorted({*self.seen, *other.seen}))


def _listed(times: DataFrame) -> list[datetime]:
    return sorted(U.at_utc(r[0]) for r in times.select(F.unix_seconds(hour_of(F.col(times.columns[0])))).distinct().collect() if r[0] is not None)


def touched_by(tx: DataFrame, obs: DataFrame) -> Touched:
    """Hours of packets that go or change, and of their observations."""
    return Touched(_listed(obs.select("timestamp")), _listed(tx.select("first_seen")))


def touched_by_new(tx: DataFrame, obs: DataFrame, watermark: int) -> Touched:
    """Hours of observations above the watermark and of the packets they belong to."""
    new = obs.filter(F.col("id") > watermark)
    ids = new.select(F.col("transmission_id").alias("id")).distinct()
    return Touched(_listed(new.select("timestamp")), _listed(tx.select("id", "first_seen").join(ids, "id", "left_semi").select("first_seen")))


def touched_by_prune(tx: DataFrame, obs: DataFrame, kept: DataFrame) -> Touched:
    """Hours that lose packets when only ``kept`` (ids) stay."""
    gone = tx.join(kept.select("id"), "id", "left_anti")
    return touched_by(gone, obs.join(gone.select(F.col("id").alias("transmission_id")), "transmission_id", "left_semi"))


def touched_by_rehash(tx: DataFrame, obs: DataFrame, kept: DataFrame, moved: DataFrame) -> Touched:
    """Hours of packets that a rehash merges, renames or moves to an earlier time, from the tables before and after it."""
    same = tx.join(kept.select("id", F.col("hash").alias("_h"), F.col("first_seen").alias("_f")), "id").filter(
        F.col("hash").eqNullSafe(F.col("_h")) & F.col("first_seen").eqNullSafe(F.col("_f"))).select("id")
    to = moved.select("id", F.col("transmission_id").alias("_to")).join(obs.select("id", "transmission_id"), "id").filter("_to <> transmission_id")
    ids = cut_lineage(tx.select("id").join(same, "id", "left_anti").union(to.select("_to")).union(to.select("transmission_id")).distinct())
    seen = tx.select("id", "first_seen").union(kept.select("id", "first_seen")).join(ids, "id", "left_semi")
    heard = obs.join(ids.select(F.col("id").alias("transmission_id")), "transmission_id", "left_semi")
    return Touched(_listed(heard.select("timestamp")), _listed(seen.select("first_seen")))


def builders(tx: DataFrame, obs: DataFrame, nodes: DataFrame, touched: Touched, max_km: float | None = None,
             hops_at: str | None = None) -> dict[str, tuple[list[datetime], Callable[[], DataFrame]]]:
    """Name, touched hours and new rows of every rollup. The hop table, if one asks for it, is written to ``hops_at``, which the caller deletes."""
    heard, seen = touched
    # packets of the touched hours were not heard before the first of them
    after = U.since_hour(obs, "timestamp", min(seen)) if seen else obs.limit(0)
    hops: list[DataFrame] = []

    def hop_table() -> DataFrame:
        if not hops:
            rows = U.stored_hops(tx, after, nodes, seen, max_km)
            if hops_at is None:
                hops.append(cut_lineage(rows))
            else:
                rows.write.mode("overwrite").option("compression", "zstd").parquet(hops_at)
                hops.append(tx.sparkSession.read.parquet(hops_at))
        return hops[0]

    return {
        "best_observation": (seen, lambda: U.best_rows(tx, after, seen)),
        "rf_rollup": (heard, lambda: U.rf_rollup_hour(tx, obs, heard)), "rf_rollup_bins": (heard, lambda: U.rf_rollup_bins(tx, obs, heard)),
        "rf_rollup_tx": (heard, lambda: U.rf_rollup_tx(tx, obs, heard)), "rf_rollup_scatter": (heard, lambda: U.rf_rollup_scatter(tx, obs, heard)),
        "channel_rollup": (seen, lambda: U.channel_rollup_hour(tx, after, seen)), "channel_rollup_bins": (seen, lambda: U.channel_rollup_bins(tx, after, seen)),
        "channel_sender_rollup": (seen, lambda: U.channel_sender_rollup(tx, after, seen)), "channel_rollup_tx": (seen, lambda: U.channel_rollup_tx(tx, after, seen)),
        "node_rollup": (seen, lambda: U.node_rollup_hour(tx, after, seen)), "node_rollup_total": (seen, lambda: U.node_rollup_total(tx, seen)),
        "distance_hourly": (seen, lambda: U.distance_hourly(hop_table(), after)), "distance_bins": (seen, lambda: U.distance_bins_hourly(hop_table(), after)),
        "distance_pair_hourly": (seen, lambda: U.distance_pair_hourly(hop_table(), after)), "distance_paths": (seen, lambda: U.distance_paths_rollup(hop_table())),
        "distance_path_observers": (seen, lambda: U.distance_path_observers(hop_table(), after)),
    }


#: Partitions of a grain, as Spark and as Python write them.
GRAINS = {"hour": ("yyyy-MM-dd-HH", "%Y-%m-%d-%H"), "day": ("yyyy-MM-dd", "%Y-%m-%d")}


def swap_hours(spark: SparkSession, df: DataFrame, root: str, name: str, hours: list[datetime], grain: str = "hour") -> None:
    """Put new rows in the place of the given hours; hours without rows are removed, others stay."""
    aside = f"{root}/_aside/{name}"
    U.write_rollup(df, aside, GRAINS[grain][0])
    new = {p.rsplit("/", 1)[1]: p for p in folders(spark, aside)}
    for part in sorted({f"hour_key={h.strftime(GRAINS[grain][1])}" for h in hours}):
        delete(spark, f"{root}/{name}/{part}")
        if part in new:
            move(spark, new[part], f"{root}/{name}/{part}")
    schema = f"{root}/_columns/{name}"
    if not exists(spark, schema):  # a rollup without rows keeps its columns
        df.limit(0).write.mode("overwrite").parquet(schema)
    delete(spark, aside)


def watermark(spark: SparkSession, root: str) -> int:
    """Highest observation id that the rollups hold; -1 before the first run."""
    at = f"{root}/_watermark"
    return spark.read.schema("id long").json(at).first()[0] if exists(spark, at) else -1


def refresh(spark: SparkSession, tx: DataFrame, obs: DataFrame, nodes: DataFrame, root: str, changed: Touched | None = None, max_km: float | None = None,
            grain: str = "hour", only: tuple[str, ...] | None = None) -> Touched:
    """Rebuild the hours touched since the last run and those in ``changed``; returns them. With days as grain, their whole days.
    A root that keeps ``only`` some rollups keeps these alone from its first run on.

    Call it with ``changed`` (of `touched_by_prune`, `touched_by_rehash`) once rows were removed or merged.
    """
    old = watermark(spark, root)
    top = obs.agg(F.max("id")).first()[0]
    touched = touched_by_new(tx, obs, old) if top is not None and top > old else Touched([], [])
    touched = touched | (changed or Touched([], []))
    touched = touched.whole_days() if grain == "day" else touched
    hops_at = f"{root}/_aside/hops"
    for name, (hours, build) in builders(tx, obs, nodes, touched, max_km, hops_at).items():
        if hours and (only is None or name in only):
            swap_hours(spark, build(), root, name, hours, grain)
    delete(spark, hops_at)
    if top is not None and top > old:
        spark.createDataFrame([(top,)], "id long").coalesce(1).write.mode("overwrite").json(f"{root}/_aside/watermark")
        delete(spark, f"{root}/_watermark")
        move(spark, f"{root}/_aside/watermark", f"{root}/_watermark")
    return touched


def kept(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A rollup as it is kept."""
    df = spark.read.parquet(f"{root}/_columns/{name}")
    return spark.read.schema(df.schema).parquet(f"{root}/{name}") if exists(spark, f"{root}/{name}") else df
