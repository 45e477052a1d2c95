"""Reading and writing the packet tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshlake import schemas
from meshlake.functions import geo
from meshlake.functions.time import TimeWindow, ts_lit, utc
from meshlake.operators.packets import heard_in, seen_in

TABLES = {
    "transmissions": schemas.TRANSMISSIONS, "observations": schemas.OBSERVATIONS, "nodes": schemas.NODES,
    "inactive_nodes": schemas.NODES, "observers": schemas.OBSERVERS, "observer_metrics": schemas.OBSERVER_METRICS,
    "dropped_packets": schemas.DROPPED_PACKETS, "neighbor_edges": schemas.EDGES,
}
PARTITION_TIME = {"transmissions": "first_seen", "observations": "timestamp", "observer_metrics": "timestamp",
                  "dropped_packets": "dropped_at"}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Typed read; columns that older files lack come back as null."""
    return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Facts are laid out by day so that time filters and retention touch whole folders.

    A day that holds most of the rows is split over tasks by AQE's rebalance.
    """
    path = f"{root.rstrip('/')}/{name}"
    time = PARTITION_TIME.get(name)
    if time is None:
        df.write.mode(mode).parquet(path)
        return
    out = df.withColumn("day", F.to_date(time)).hint("rebalance", "day")
    out.write.mode(mode).partitionBy("day").parquet(path)


def _joined(tx: DataFrame, obs: DataFrame, observers: DataFrame) -> DataFrame:
    o = obs.select(F.col("id").alias("obs_id"), "transmission_id", "observer_id", "direction", "snr", "rssi", "score",
                   "path", "resolved_path", "timestamp", F.col("raw_hex").alias("obs_raw_hex"))
    who = observers.select(F.col("id").alias("observer_id"), F.col("name").alias("observer_name"))
    return (tx.withColumnRenamed("id", "tx_id").join(o, F.col("tx_id") == o.transmission_id, "left")
            .join(who, "observer_id", "left").drop("transmission_id"))


def _from(tx: DataFrame, obs: DataFrame, window: TimeWindow) -> tuple[DataFrame, DataFrame]:
    """Packets with a time in the window and the observations they can have, by day folders where there are."""
    return seen_in(tx, window).filter(F.col("first_seen").isNotNull()), heard_in(obs, window)


def load_packets(tx: DataFrame, obs: DataFrame, observers: DataFrame, since: datetime | str | None = None,
                 ordered: bool = False) -> DataFrame:
    """Packets with their observations and observers, optionally from a cutoff on."""
    out = _joined(tx, obs, observers) if since is None else _joined(*_from(tx, obs, TimeWindow(utc(since), None)), observers)
    return out.orderBy("first_seen", F.col("timestamp").desc()) if ordered else out


def load_packets_chunk(tx: DataFrame, obs: DataFrame, observers: DataFrame, since: datetime | str,
                       until: datetime | str) -> DataFrame:
    """Same for a half-open time range, for back-filling in pieces."""
    head, heard = _from(tx, obs, TimeWindow(utc(since), utc(until)))
    return _joined(head.filter(F.col("first_seen") < ts_lit(until)), heard, observers)


def packets_view(tx: DataFrame, obs: DataFrame, observers: DataFrame) -> DataFrame:
    """One row per observation with packet columns; inactive observers are blanked."""
    o = obs.select("id", "transmission_id", F.col("observer_id").alias("_oid"), "direction", "snr", "rssi", "score",
                   "path", "timestamp", F.col("raw_hex").alias("_raw"))
    who = observers.filter(~F.coalesce("inactive", F.lit(False))).select(
        F.col("id").alias("observer_id"), F.col("name").alias("observer_name"))
    head = tx.select(F.col("id").alias("transmission_id"), "raw_hex", "hash", "route_type", "payload_type",
                     "payload_version", "decoded")
    joined = o.join(head, "transmission_id").join(who, F.col("_oid") == F.col("observer_id"), "left")
    return joined.select("id", F.coalesce("_raw", "raw_hex").alias("raw_hex"), "timestamp", "observer_id",
                         "observer_name", "direction", "snr", "rssi", "score", "path", "hash", "route_type",
                         "payload_type", "payload_version", "decoded")


def incremental_since(df: DataFrame, last_id: int, limit: int) -> DataFrame:
    """Next rows after a watermark id."""
    return df.filter(F.col("id") > last_id).orderBy("id").limit(limit)


def node_dim(nodes: DataFrame) -> DataFrame:
    return nodes.select("public_key", "name", "role", "lat", "lon", "last_seen",
                        F.coalesce("advert_count", F.lit(0)).alias("advert_count"),
                        geo.has_gps(F.col("lat"), F.col("lon")).alias("has_gps"))
