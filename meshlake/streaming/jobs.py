"""Continuous jobs. Each builds on the batch operators, so a stream and a batch give the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from meshlake.functions.time import snap
from meshlake.operators import ingest as I
from meshlake.session import cut_lineage



def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Drain what the source holds now through ``foreachBatch`` and stop."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# ---- ingest ----------------------------------------------------------------------------

def ingest_batch(messages: DataFrame, root: str, batch_id: int) -> None:
    """One micro-batch: packets and status rows land in folders named by the batch.

    A retried batch overwrites its own folder, so nothing is counted twice.
    """
    packets = I.packet_messages(messages).select("hash", "raw_hex", "observer_id", "snr", "rssi", "score", "rx_time")
    status = I.observer_meta(I.route_messages(messages).filter(F.col("kind") == "status"))
    packets.write.mode("overwrite").parquet(f"{root}/packets/batch={batch_id}")
    status.write.mode("overwrite").parquet(f"{root}/status/batch={batch_id}")


def ingest_stream(messages: DataFrame, root: str, checkpoint: str) -> None:
    run_available(messages, lambda df, i: ingest_batch(df, root, i), checkpoint)


def ingested_packets(spark, root: str) -> DataFrame:
    """Packet table over everything ingested: one row per hash, first receive time, hearings."""
    p = spark.read.parquet(f"{root}/packets")
    return p.groupBy("hash").agg(F.min("rx_time").alias("first_seen"), F.count(F.lit(1)).alias("hearings"), F.count_distinct("observer_id").alias("observers"))


def stream_dedup(packets: DataFrame, horizon: str = "12 hours") -> DataFrame:
    """First copy of each hash inside a horizon; state is dropped once the watermark passes it."""
    return packets.withWatermark("rx_time", horizon).dropDuplicatesWithinWatermark(["hash"])


def hourly_tumbling(packets: DataFrame, late: str = "12 hours") -> DataFrame:
    """Packets and mean signal per hour, final once the watermark has passed the hour."""
    return packets.withWatermark("rx_time", late).groupBy(F.window("rx_time", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("packets"), F.count("snr").alias("n_snr"), F.avg("snr").alias("avg_snr")).select(
        F.col("w.start").alias("hour"), "packets", "n_snr", "avg_snr")


# ---- rollups ---------------------------------------------------------------------------

def rollup_stream(new_rows: DataFrame, rebuild: Callable[[DataFrame], None], time: str, checkpoint: str) -> None:
    """Rebuild every hour that received rows, however late they are."""
    def sink(df: DataFrame, _: int) -> None:
        rebuild(df.select(F.date_trunc("hour", time).alias("hour")).distinct())
    run_available(new_rows, sink, checkpoint)


# ---- telemetry -------------------------------------------------------------------------

def metrics_stream(samples: DataFrame, root: str, checkpoint: str, bucket: int = 300) -> None:
    """Keep the last sample of every station and bucket in a table stored by day.

    A micro-batch rewrites the days that it touches, from what they hold and what is new, so neither the size of
    batches nor the order of samples changes the table. Rates follow from it by ``observers.metrics_deltas``,
    over all of it or the days asked for; counters may be null.
    """
    spark, schema = samples.sparkSession, _sample_schema(samples)
    spark.createDataFrame([], schema).write.mode("append").partitionBy("day").parquet(root)

    def sink(df: DataFrame, _: int) -> None:
        at = F.timestamp_seconds(snap(F.unix_seconds("timestamp"), bucket))
        new = df.withColumn("timestamp", at).withColumn("day", F.to_date(at)).select(*schema.fieldNames())
        old = df.sparkSession.read.schema(schema).parquet(root).join(new.select("day").distinct(), "day", "left_semi").select(*schema.fieldNames())
        cols = [c for c in schema.fieldNames() if c not in ("observer_id", "timestamp", "day")]
        last = old.union(new).groupBy("observer_id", "timestamp", "day").agg(F.max_by(F.struct(*cols), "seq").alias("l"))
        # written aside first: the days are read while they are replaced
        kept = cut_lineage(last.select("observer_id", "timestamp", *[F.col("l")[c].alias(c) for c in cols], "day"))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(root)

    run_available(samples, sink, checkpoint)


def _sample_schema(samples: DataFrame) -> T.StructType:
    return T.StructType([*(f for f in samples.schema if f.name != "day"), T.StructField("day", T.DateType())])


def stored_samples(samples: DataFrame, root: str) -> DataFrame:
    """What `metrics_stream` has kept, with the columns of its source."""
    return samples.sparkSession.read.schema(_sample_schema(samples)).parquet(root).select(*samples.columns)
