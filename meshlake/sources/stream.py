"""Streaming sources: broker messages from files or from a message bus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshlake import schemas


def read_message_stream(spark: SparkSession, paths: dict[str, str], max_files: int = 1000) -> DataFrame:
    """One stream over several named folders of JSON lines (topic, value, ingest_time)."""
    schema = "topic string, value string, ingest_time timestamp"
    out = None
    for name, path in paths.items():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path).withColumn("source", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out.select(*schemas.MESSAGE.fieldNames())


def read_bus_stream(spark: SparkSession, name: str, servers: str, topics: str, per_trigger: int = 1_000_000) -> DataFrame:
    """Same from a Kafka-compatible bus; the record key holds the original topic."""
    k = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribePattern", topics)
         .option("maxOffsetsPerTrigger", per_trigger).load())
    return k.select(F.coalesce(F.col("key").cast("string"), F.col("topic")).alias("topic"), F.col("value").cast("string").alias("value"),
                    F.lit(name).alias("source"), F.col("timestamp").alias("ingest_time"))
