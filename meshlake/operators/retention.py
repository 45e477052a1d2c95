"""Ageing out of rows. Each function returns the table that remains."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshlake.functions.time import ts_lit

from .nodes import hours_before


def prune_packets(tx: DataFrame, obs: DataFrame, now, days: int) -> tuple[DataFrame, DataFrame]:
    """Packets of the last days, and the observations that belong to them."""
    keep = tx.filter(F.col("first_seen") >= hours_before(now, 24 * days))
    return keep, obs.join(keep.select(F.col("id").alias("transmission_id")), "transmission_id", "left_semi")


def prune_metrics(metrics: DataFrame, now, days: int) -> DataFrame:
    return metrics.filter(F.col("timestamp") >= hours_before(now, 24 * days))


def prune_dropped(dropped: DataFrame, now, days: int) -> DataFrame:
    return dropped.filter(F.col("dropped_at") >= hours_before(now, 24 * days))


def move_stale_nodes(nodes: DataFrame, inactive: DataFrame, now, days: int) -> tuple[DataFrame, DataFrame]:
    """Nodes not seen for days go to the inactive table, replacing older entries of their key."""
    stale = F.col("last_seen") < hours_before(now, 24 * days)
    gone = nodes.filter(stale)
    rest = inactive.join(gone.select("public_key"), "public_key", "left_anti")
    return nodes.filter(~F.coalesce(stale, F.lit(False))), rest.unionByName(gone)


def mark_stale_observers(observers: DataFrame, metrics: DataFrame, now, days: int) -> tuple[DataFrame, DataFrame]:
    """Silent stations become inactive and lose their telemetry; -1 days means never."""
    if days < 0:
        return observers, metrics
    stale = F.coalesce(F.col("last_seen") < hours_before(now, 24 * days), F.lit(False))
    fresh = observers.filter(stale & ~F.coalesce("inactive", F.lit(False))).select(F.col("id").alias("observer_id"))
    return observers.withColumn("inactive", F.coalesce("inactive", F.lit(False)) | stale), metrics.join(fresh, "observer_id", "left_anti")


def prune_edges(edges: DataFrame, now, days: int) -> DataFrame:
    return edges.filter(F.col("last_seen") >= hours_before(now, 24 * days))


def shift_timestamps(df: DataFrame, column: str, now) -> DataFrame:
    """All times moved alike so that the newest equals ``now``."""
    newest = df.agg(F.unix_micros(F.max(column))).scalar()
    return df.withColumn(column, F.timestamp_micros(F.unix_micros(column) + F.unix_micros(ts_lit(now)) - newest))
