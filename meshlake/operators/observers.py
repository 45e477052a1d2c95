"""Station reports and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshlake.functions.numeric import half_away
from meshlake.functions.ranks import top_per_group, with_previous
from meshlake.functions.time import ts_lit

from .nodes import hours_before
from .packets import by_id

COUNTERS = ("tx_air_secs", "rx_air_secs", "recv_errors", "packets_sent", "packets_recv")


def observers_list(obs: DataFrame, observers: DataFrame, nodes: DataFrame, now) -> DataFrame:
    """Active stations with last-hour traffic and the position of the node of the same key."""
    last = obs.filter(F.col("timestamp") > hours_before(now, 1)).groupBy(F.col("observer_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    loc = nodes.select(F.lower("public_key").alias("_k"), "lat", "lon", F.col("role").alias("node_role"))
    a = observers.filter(~F.coalesce("inactive", F.lit(False)))
    return a.join(last, "id", "left").join(loc, F.lower("id") == F.col("_k"), "left").drop("_k").withColumn(
        "packets_last_hour", F.coalesce("n", F.lit(0))).drop("n")


def observer_counts(observers: DataFrame, now) -> DataFrame:
    on, st = F.col("last_seen") >= hours_before(now, 1 / 6), F.col("last_seen") >= hours_before(now, 1)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return observers.filter(~F.coalesce("inactive", F.lit(False))).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(yes(on)).alias("online"), F.count_if(yes(st & ~on)).alias("stale"), F.count_if(~yes(st)).alias("offline"))


def _recent(obs: DataFrame, now, days: int, observer: str | None = None) -> DataFrame:
    if days < 1:
        raise ValueError("days must be positive")
    out = obs.filter(F.col("timestamp") >= hours_before(now, 24 * days))
    return out if observer is None else out.filter(F.col("observer_id") == observer)


def bucket(col: Column, days: int) -> Column:
    step = 3600 if days <= 1 else 14400 if days <= 7 else 86400
    return F.timestamp_seconds(F.floor(F.unix_seconds(col) / step) * step)


def observer_timeline(obs, now, days: int = 7, observer: str | None = None) -> DataFrame:
    return _recent(obs, now, days, observer).groupBy("observer_id", bucket(F.col("timestamp"), days).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def observer_packet_types(tx, obs, now, days: int = 7, observer: str | None = None) -> DataFrame:
    t = tx.select(F.col("id").alias("transmission_id"), "payload_type").filter(F.col("payload_type").isNotNull())
    return _recent(obs, now, days, observer).join(t, "transmission_id").groupBy("observer_id", "payload_type").agg(F.count(F.lit(1)).alias("count"))


def observer_nodes_timeline(tx, obs, now, days: int = 7, observer: str | None = None) -> DataFrame:
    """Distinct identifiers (keys, address bytes, hops) a station heard per bucket."""
    t = tx.select(F.col("id").alias("transmission_id"), F.array_compact(F.array("decoded.pubKey", "decoded.srcHash", "decoded.destHash")).alias("ids"))
    r = _recent(obs, now, days, observer).join(t, "transmission_id")
    every = F.array_union("ids", F.coalesce("path", F.array().cast("array<string>")))
    return r.select("observer_id", bucket(F.col("timestamp"), days).alias("bucket"), F.explode(every).alias("i")).filter(F.col("i") != "").groupBy(
        "observer_id", "bucket").agg(F.count_distinct("i").alias("count"))


def observer_snr_distribution(obs, now, days: int = 7, observer: str | None = None) -> DataFrame:
    """2-dB bins with the truncating arithmetic of the displayed labels."""
    whole = F.col("snr").cast("int")
    b = F.expr("cast(snr as int) div 2 * 2").cast("int")
    low = F.when((F.col("snr") < 0) & (whole != b), b - 2).otherwise(b)
    return _recent(obs, now, days, observer).filter(F.col("snr").isNotNull()).groupBy("observer_id", low.alias("low")).agg(
        F.count(F.lit(1)).alias("count")).withColumn("range", F.concat(F.col("low").cast("string"), F.lit(" to "), (F.col("low") + 2).cast("string")))


def observer_rssi_timeline(obs, now, days: int = 7, observer: str | None = None) -> DataFrame:
    return _recent(obs, now, days, observer).filter(F.col("rssi").isNotNull()).groupBy(
        "observer_id", bucket(F.col("timestamp"), days).alias("bucket")).agg(half_away(F.avg("rssi"), 1).alias("avg"))


def observer_recent(tx, obs, now, days: int = 7, observer: str | None = None, limit: int = 20) -> DataFrame:
    r = _recent(obs, now, days, observer).select("observer_id", "id", "transmission_id", "timestamp", "snr", "rssi", "path")
    top = top_per_group(r, ["observer_id"], [F.col("timestamp").desc(), F.col("id").desc()], limit)
    return top.join(tx.select(F.col("id").alias("transmission_id"), "hash", "payload_type", "route_type"), "transmission_id")


# ---- telemetry -------------------------------------------------------------------------

def observer_metrics(metrics: DataFrame, since=None, until=None, resolution: str = "5m", observer: str | None = None) -> DataFrame:
    """Samples as they are, or the last one of each hour or day under the bucket's time."""
    m = metrics
    if observer is not None:
        m = m.filter(F.col("observer_id") == observer)
    if since is not None:
        m = m.filter(F.col("timestamp") >= ts_lit(since))
    if until is not None:
        m = m.filter(F.col("timestamp") <= ts_lit(until))
    unit = {"1h": "hour", "1d": "day"}.get(resolution)
    cols = [c for c in metrics.columns if c not in ("observer_id", "timestamp")]
    tie = ["seq"] if "seq" in cols else []
    if unit is None:
        return m
    g = m.groupBy("observer_id", F.date_trunc(unit, "timestamp").alias("b")).agg(F.max_by(F.struct(*cols), F.struct("timestamp", *tie)).alias("l"))
    return g.select("observer_id", F.col("b").alias("timestamp"), *[F.col("l")[c].alias(c) for c in cols])


def metrics_deltas(samples: DataFrame, bucket_secs: int = 300) -> DataFrame:
    """Airtime and error rates between consecutive samples of a station.

    No rate on a station's first sample, after a gap of more than two buckets, or at a reboot
    (some counter went down).
    """
    tie = ["seq"] if "seq" in samples.columns else []
    p = with_previous(samples, ["observer_id"], ["timestamp", *tie], F.to_date("timestamp"), ["timestamp", *COUNTERS])
    gap = F.unix_seconds("timestamp") - F.unix_seconds("prev_timestamp")
    usable = F.coalesce((gap > 0) & (gap <= 2 * bucket_secs), F.lit(False))
    fell = F.lit(False)
    for c in COUNTERS:
        fell = fell | F.coalesce(F.col(c) < F.col("prev_" + c), F.lit(False))
    ok = usable & ~fell
    pct = lambda c: F.when(ok, half_away(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col(c) - F.col("prev_" + c)) / gap * 100.0)), 2))
    de, dr = F.col("recv_errors") - F.col("prev_recv_errors"), F.col("packets_recv") - F.col("prev_packets_recv")
    return p.select("observer_id", "timestamp", *tie, "noise_floor", "battery_mv", "uptime_secs", "queue_len",
                    pct("tx_air_secs").alias("tx_airtime_pct"), pct("rx_air_secs").alias("rx_airtime_pct"),
                    F.when(ok & (de + dr > 0), half_away(F.try_divide(de * 1.0, de + dr) * 100.0, 2)).alias("recv_error_rate"),
                    (usable & fell).alias("is_reboot"))


def metrics_summary(metrics: DataFrame, observers: DataFrame, since=None) -> DataFrame:
    m = metrics if since is None else metrics.filter(F.col("timestamp") >= ts_lit(since))
    order = F.struct("timestamp", *(["seq"] if "seq" in metrics.columns else []))
    g = m.groupBy(F.col("observer_id").alias("id")).agg(
        F.max_by(F.struct("noise_floor", "battery_mv"), order).alias("l"), F.avg("noise_floor").alias("avg_noise_floor"),
        F.max("noise_floor").alias("max_noise_floor"), F.count(F.lit(1)).alias("sample_count"))
    return g.join(observers.select("id", "name", "iata"), "id", "left").select(
        F.col("id").alias("observer_id"), F.col("name").alias("observer_name"), F.coalesce("iata", F.lit("")).alias("iata"),
        F.col("l.noise_floor").alias("current_noise_floor"), "avg_noise_floor", "max_noise_floor", F.col("l.battery_mv").alias("battery_mv"), "sample_count")


def metrics_sparkline(metrics: DataFrame, since=None) -> DataFrame:
    """Noise-floor series in time order per station and hour.

    One array per hour keeps a busy station's series in pieces; the pieces are ordered by hour.
    """
    m = metrics if since is None else metrics.filter(F.col("timestamp") >= ts_lit(since))
    return m.groupBy("observer_id", F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "noise_floor"))), lambda e: e["noise_floor"]).alias("noise_floor"))


# ---- comparisons -----------------------------------------------------------------------

def observer_compare(tx, obs, a: str, b: str, mode: str = "all") -> DataFrame:
    """Shared and exclusive packets of two stations, and how much of the other each one heard."""
    routes = {"flood": (0, 1), "direct": (2, 3)}.get(mode)
    head = tx if routes is None else tx.filter(F.col("route_type").isin(*routes))
    h = obs.filter(F.col("observer_id").isin(a, b)).select("transmission_id", "observer_id").join(
        head.select(F.col("id").alias("transmission_id"), "hash"), "transmission_id")
    per = h.groupBy("hash").agg(F.bool_or(F.col("observer_id") == a).alias("a"), F.bool_or(F.col("observer_id") == b).alias("b"))
    n = per.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"), F.count_if(F.col("a") & F.col("b")).alias("shared"))
    pct = lambda d: F.coalesce(half_away(F.try_divide(F.col("shared") * 100.0, d), 1), F.lit(0.0))
    return n.select((F.col("only_a") + F.col("shared")).alias("total_a"), (F.col("only_b") + F.col("shared")).alias("total_b"), "shared", "only_a", "only_b",
                    pct(F.col("only_b") + F.col("shared")).alias("a_sees_of_b"), pct(F.col("only_a") + F.col("shared")).alias("b_sees_of_a"))


def compare_packet_sets(tx, obs, a: str, b: str) -> DataFrame:
    """hash -> heard by ``a`` only, ``b`` only, or both."""
    h = obs.filter(F.col("observer_id").isin(a, b)).join(tx.select(F.col("id").alias("transmission_id"), "hash"), "transmission_id")
    per = h.groupBy("hash").agg(F.bool_or(F.col("observer_id") == a).alias("a"), F.bool_or(F.col("observer_id") == b).alias("b"))
    return per.select("hash", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_a").otherwise("only_b").alias("side"))


def source_liveness(messages: DataFrame, now, threshold_secs: int = 300, sources: DataFrame | None = None) -> DataFrame:
    """Per broker: ok, stalled (silent for the threshold or longer) or never received."""
    g = messages.groupBy("source").agg(F.max("ingest_time").alias("last_message"), F.count(F.lit(1)).alias("messages"))
    if sources is not None:
        g = sources.select("source").join(g, "source", "left")
    idle = F.unix_seconds(ts_lit(now)) - F.unix_seconds("last_message")
    return g.select("source", "last_message", F.coalesce("messages", F.lit(0)).alias("messages"),
                    F.when(F.col("last_message").isNull(), "never_received").when(idle >= threshold_secs, "stalled").otherwise("ok").alias("state"))


def distinct_regions(observers: DataFrame, coordinates: DataFrame | None = None) -> DataFrame:
    """Region codes in use, with their coordinates where a table of them is given."""
    r = observers.filter(F.col("iata") != "").select(F.upper(F.trim("iata")).alias("iata")).distinct()
    return r if coordinates is None else r.join(coordinates, "iata", "left")
