"""Watching sources for silence: alerts on change, reminders while it lasts.

A watch looks at every source at ticks, the multiples of ``tick`` seconds. At a tick a source is silent if its newest
message, or its registration where there was none, is ``threshold`` seconds old or older. The first such tick gives
``stalled`` or ``never_received``; each further ``heartbeat`` seconds of the same silence give ``heartbeat``; the first
tick after a message gives ``recovered``. ``first_message`` marks a source's first message of all.

Messages are counted down to one row per source and tick before anything is sorted, so neither the state nor a
group grows with the messages of a busy source, and everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

ALERTS = "source string, event string, at timestamp, idle_secs double"
#: per source: registration, newest message, newest alert of the present silence, and how far the watch has looked
STATE = "source string, since bigint, last bigint, alert bigint, watched bigint"


def _tick_from(secs: Column, tick: int) -> Column:
    """The first tick at or after a time."""
    return F.ceil(secs / tick).cast("bigint") * tick


def registered(sources: DataFrame) -> DataFrame:
    """State of sources (source, since timestamp) that no message was heard from yet; the watch begins with the first of them."""
    since = F.unix_seconds("since")
    none = F.lit(None).cast("bigint")
    return sources.filter("source IS NOT NULL").groupBy("source").agg(F.min(since).alias("since")).select(
        "source", "since", none.alias("last"), none.alias("alert"), none.alias("watched"))


def look(messages: DataFrame, state: DataFrame, now: int, threshold: int = 300, tick: int = 60, heartbeat: int = 3600) -> tuple[DataFrame, DataFrame]:
    """Alerts of all ticks before ``now`` (seconds) that the state has not seen, and the state then.

    ``messages`` has source and ingest_time; rows without either are left out. A message older than the time the watch has
    reached counts from that time on: alerts once given are not taken back. Later than ``now`` counts as its own time.
    """
    if not 0 < tick <= threshold or heartbeat <= 0:
        raise ValueError("a watch needs 0 < tick <= threshold and a positive heartbeat")
    again = -(-heartbeat // tick) * tick
    reached = state.agg(F.max("watched")).first()[0]
    t = F.unix_seconds("ingest_time")
    t = t if reached is None else F.greatest(t, F.lit(reached))
    cells = messages.filter("source IS NOT NULL AND ingest_time IS NOT NULL").select("source", t.alias("t")).groupBy(
        "source", _tick_from(F.col("t"), tick).alias("cell")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    none = F.lit(None).cast("bigint")
    rows = cells.select("source", "first", "last", none.alias("since"), none.alias("alert"), F.lit(False).alias("old")).unionByName(
        state.select("source", F.lit(None).cast("bigint").alias("first"), "last", "since", "alert", F.lit(True).alias("old")))
    order = W.partitionBy("source").orderBy(F.col("old").desc(), "first")
    c = F.col
    # each row begins a silence that the next row ends
    quiet = rows.withColumns({
        "next": F.lead("first").over(order), "prior": F.lag("last").over(order), "base": F.coalesce("last", "since")})
    end = F.least(F.coalesce("next", F.lit(now)), F.lit(now))
    quiet = quiet.withColumn("end", end).withColumn("start", F.coalesce("alert", _tick_from(c("base") + threshold, tick)))
    quiet = quiet.withColumn("silent", c("alert").isNotNull() | (c("start") < c("end"))).withColumn(
        "reminders", F.when(c("silent"), F.greatest(F.floor((c("end") - 1 - c("start")) / again), F.lit(0))).otherwise(0))
    event = lambda name, at, idle: F.struct(F.lit(name).alias("event"), at.alias("at"), idle.cast("double").alias("idle_secs"))
    kind = lambda name, missing: c("silent") & c("alert").isNull() & (c("last").isNull() if missing else c("last").isNotNull())
    beats = F.transform(F.when(c("reminders") > 0, F.sequence(F.lit(1), c("reminders"))).otherwise(F.array().cast("array<bigint>")),
                        lambda i: event("heartbeat", c("start") + i * again, c("start") + i * again - c("base")))
    one = lambda cond, e: F.when(cond, e)
    found = F.array_compact(F.concat(F.array(
        one(~c("old") & c("prior").isNull(), event("first_message", c("first"), F.lit(0))),
        one(kind("stalled", False), event("stalled", c("start"), c("start") - c("base"))),
        one(kind("never", True), event("never_received", c("start"), c("start") - c("base"))),
        one(c("silent") & c("next").isNotNull(), event("recovered", _tick_from(c("next"), tick), c("next") - c("base")))), beats))
    alerts = quiet.select("source", F.explode(found).alias("e")).select(
        "source", "e.event", F.timestamp_seconds("e.at").alias("at"), "e.idle_secs")
    tail = quiet.groupBy("source").agg(
        F.min("since").alias("since"), F.max("last").alias("last"),
        F.max(F.when(c("next").isNull() & c("silent"), c("start") + c("reminders") * again)).alias("alert"))
    return alerts, tail.select("source", "since", "last", "alert", F.lit(now).cast("bigint").alias("watched"))


def _state_path(root: str, batch_id: int) -> str:
    return f"{root}/state/batch={batch_id}"


def watch_batch(messages: DataFrame, root: str, batch_id: int, clock: str = "event", **limits) -> None:
    """One micro-batch: reads the state that the batch before it left and writes alerts and state under its own number.

    A batch repeated after a failure starts from the same state and overwrites what it had written, so alerts come once.
    Rows without a source only move the clock.
    """
    spark = messages.sparkSession
    state = spark.read.schema(STATE).parquet(_state_path(root, batch_id - 1))
    newest = F.max(F.unix_seconds("ingest_time"))
    wall = F.unix_seconds(F.current_timestamp())
    at = messages.agg(newest.alias("t"), F.any_value(wall).alias("w")).first()
    reached = state.agg(F.max("watched")).first()[0]
    times = [x for x in (at.t, reached, at.w if clock == "processing" else None) if x is not None]
    if not times:  # nothing heard or seen yet
        state.write.mode("overwrite").parquet(_state_path(root, batch_id))
        return
    alerts, after = look(messages, state, max(times), **limits)
    alerts.write.mode("overwrite").parquet(f"{root}/alerts/batch={batch_id}")
    after.write.mode("overwrite").parquet(_state_path(root, batch_id))


def with_clock(messages: DataFrame) -> DataFrame:
    """The messages (source, ingest_time) and one row a second without a source, so that silence of all sources is noticed."""
    rows = messages.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    return messages.select("source", "ingest_time").unionByName(rows.select(
        F.lit(None).cast("string").alias("source"), F.col("timestamp").alias("ingest_time")))


def watch_sources(messages: DataFrame, root: str, checkpoint: str, sources: DataFrame | None = None, every: str | None = None, clock: str = "event",
                  threshold: int = 300, tick: int = 60, heartbeat: int = 3600) -> StreamingQuery:
    """Watch a stream of messages; ``sources`` (source, since) are the ones expected, others are taken up when they speak.

    ``clock="event"`` goes by the newest message time of any source, ``"processing"`` by the wall clock. Without ``every`` what is
    there is read and the job ends; with it the job goes on at that interval, with a clock of its own.
    """
    if clock not in ("event", "processing"):
        raise ValueError(f"unknown clock {clock}")
    spark = messages.sparkSession
    begin = registered(sources) if sources is not None else spark.createDataFrame([], STATE)
    begin.write.mode("ignore").parquet(_state_path(root, -1))
    src = with_clock(messages) if every else messages.select("source", "ingest_time")
    w = src.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, i: watch_batch(df, root, i, clock, threshold=threshold, tick=tick, heartbeat=heartbeat))
    q = (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
    if not every:
        q.awaitTermination()
    return q


def alerts(spark: SparkSession, root: str) -> DataFrame:
    """All alerts of a watch."""
    return spark.read.schema(ALERTS + ", batch bigint").parquet(f"{root}/alerts").select("source", "event", "at", "idle_secs")
