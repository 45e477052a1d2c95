"""Radio signal analytics over observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshlake.functions import names
from meshlake.functions.numeric import upper_median
from meshlake.functions.ranks import every_kth
from meshlake.functions.time import TimeWindow, epoch_f, hour_of, in_window

from .packets import heard_ids, heard_in, obs_in_region, region_codes, seen_in


def signal_rows(tx: DataFrame, obs: DataFrame, observers: DataFrame, region: str | None = None,
                window: TimeWindow | None = None, tx_cols: tuple[str, ...] = ()) -> DataFrame:
    """Observations in scope.

    Without a region the window applies to the packet's first hearing, with one to each
    observation. The packet table is joined only when its columns or its time are needed.
    """
    if region_codes(region) is not None:
        rows = obs_in_region(obs, observers, region).filter(in_window(window, F.col("timestamp")))
        need = set(tx_cols)
    else:
        rows = heard_in(obs, window)
        need = set(tx_cols) | (set() if window is None or window.unbounded else {"first_seen"})
    if not need:
        return rows
    head = tx
    if region_codes(region) is None:
        head = seen_in(tx, window)
    head = head.select(F.col("id").alias("transmission_id"), *sorted(need))
    return rows.join(head, "transmission_id")


def packets_in_scope(tx: DataFrame, obs: DataFrame, observers: DataFrame, region: str | None = None,
                     window: TimeWindow | None = None) -> DataFrame:
    """Packets in scope, each once."""
    if region_codes(region) is None:
        return seen_in(tx, window)
    ids = heard_ids(obs_in_region(obs, observers, region).filter(in_window(window, F.col("timestamp"))))
    return tx.join(ids, tx.id == ids.transmission_id, "left_semi")


def rf_summary(tx: DataFrame, obs: DataFrame, observers: DataFrame, region: str | None = None,
               window: TimeWindow | None = None) -> DataFrame:
    """Observation, packet and time-span totals."""
    rows = signal_rows(tx, obs, observers, region, window)
    seen = rows.agg(F.count("snr").alias("with_snr"), F.count(F.lit(1)).alias("observations"),
                    F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))
    scope = packets_in_scope(tx, obs, observers, region, window)
    heads = scope.agg(F.count_distinct("hash").alias("transmissions"))
    if region_codes(region) is None:
        # packets nobody reported count once, at their own time
        silent = scope.join(heard_ids(heard_in(obs, window)), scope.id == F.col("transmission_id"), "left_anti")
        lone = silent.agg(F.lit(0).cast("bigint").alias("with_snr"), F.count(F.lit(1)).alias("observations"),
                          F.min("first_seen").alias("t0"), F.max("first_seen").alias("t1"))
        seen = seen.unionByName(lone).agg(F.sum("with_snr").alias("with_snr"), F.sum("observations").alias("observations"),
                                          F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    return seen.select(
        F.col("with_snr").alias("total_packets"), F.col("observations").alias("total_all_packets"),
        heads.scalar().alias("total_transmissions"),
        F.coalesce((epoch_f(F.col("t1")) - epoch_f(F.col("t0"))) / 3600.0, F.lit(0.0)).alias("time_span_hours"))


def value_stats(rows: DataFrame, col: str) -> DataFrame:
    """min, max, mean, upper median, population stddev; zeros when there is nothing."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.agg(F.count(col).alias("count"), z(F.min(col)).alias("min"), z(F.max(col)).alias("max"),
                    z(F.avg(col)).alias("avg"), z(upper_median(col)).alias("median"),
                    z(F.stddev_pop(col)).alias("stddev"))


def rf_snr_stats(tx, obs, observers, region=None, window=None) -> DataFrame:
    return value_stats(signal_rows(tx, obs, observers, region, window), "snr")


def rf_rssi_stats(tx, obs, observers, region=None, window=None) -> DataFrame:
    return value_stats(signal_rows(tx, obs, observers, region, window), "rssi")


def histogram(rows: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins between min and max, the last one closed.

    Values are counted first; bounds and bins are then read from the counts, so the source is
    scanned once and the counting shuffle is shared.
    """
    counts = rows.select(value.cast("double").alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(
        F.count(F.lit(1)).alias("n"))
    lo, hi = counts.agg(F.min("v")).scalar(), counts.agg(F.max("v")).scalar()
    span = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
    width = span / float(bins)
    hit = counts.groupBy(F.least(((F.col("v") - lo) / width).cast("bigint"), F.lit(bins - 1)).alias("bin")).agg(
        F.sum("n").alias("count"))
    grid = rows.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return (grid.join(hit, "bin", "left").filter(lo.isNotNull())
            .select("bin", (lo + F.col("bin") * width).alias("x"), width.alias("w"), F.coalesce("count", F.lit(0)).alias("count")))


def rf_histogram(tx, obs, observers, region=None, window=None, measure: str = "snr", bins: int = 20) -> DataFrame:
    if measure == "size":
        scope = packets_in_scope(tx, obs, observers, region, window)
        rows = _sizes(scope)
        return histogram(rows, F.col("size"), bins)
    return histogram(signal_rows(tx, obs, observers, region, window), F.col(measure), bins)


def _sizes(scope: DataFrame) -> DataFrame:
    return (scope.filter((F.col("hash") != "") & (F.col("raw_hex") != "")).groupBy("hash")
            .agg(F.min(F.floor(F.length("raw_hex") / 2)).alias("size")))


def rf_packet_sizes(tx, obs, observers, region=None, window=None) -> DataFrame:
    """Frame length in bytes, once per packet; the mean is cut to an integer."""
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return _sizes(packets_in_scope(tx, obs, observers, region, window)).agg(
        F.count(F.lit(1)).alias("count"), z(F.min("size")).alias("min"), z(F.max("size")).alias("max"),
        z(F.floor(F.sum("size") / F.count(F.lit(1)))).alias("avg"))


def rf_packets_per_hour(tx, obs, observers, region=None, window=None) -> DataFrame:
    rows = signal_rows(tx, obs, observers, region, window, ("hash",))
    heard = rows.select(hour_of(F.col("timestamp")).alias("hour"), "hash")
    if region_codes(region) is None:
        scope = packets_in_scope(tx, obs, observers, region, window)
        silent = scope.join(heard_ids(obs), scope.id == F.col("transmission_id"), "left_anti")
        heard = heard.unionByName(silent.select(hour_of(F.col("first_seen")).alias("hour"), "hash"))
    return heard.groupBy("hour").agg(F.count_distinct("hash").alias("count"))


def rf_payload_types(tx, obs, observers, region=None, window=None) -> DataFrame:
    return (packets_in_scope(tx, obs, observers, region, window).filter(F.col("payload_type").isNotNull())
            .groupBy(F.col("payload_type").alias("type")).agg(F.count_distinct("hash").alias("count"))
            .select("type", names.payload_name(F.col("type")).alias("name"), "count").orderBy(F.col("count").desc(), "type"))


def rf_snr_by_type(tx, obs, observers, region=None, window=None) -> DataFrame:
    rows = signal_rows(tx, obs, observers, region, window, ("payload_type",)).filter(F.col("snr").isNotNull())
    return (rows.groupBy("payload_type").agg(F.count("snr").alias("count"), F.avg("snr").alias("avg"),
                                             F.min("snr").alias("min"), F.max("snr").alias("max"))
            .select(names.payload_name(F.col("payload_type")).alias("name"), "count", "avg", "min", "max")
            .orderBy(F.col("count").desc(), "name"))


def rf_signal_over_time(tx, obs, observers, region=None, window=None) -> DataFrame:
    rows = signal_rows(tx, obs, observers, region, window).filter(F.col("snr").isNotNull())
    return rows.groupBy(hour_of(F.col("timestamp")).alias("hour")).agg(
        F.count("snr").alias("count"), F.avg("snr").alias("avg_snr"))


def rf_scatter(tx, obs, observers, region=None, window=None, points: int = 500) -> DataFrame:
    """Every k-th (snr, rssi) pair in time order, about ``points`` of them."""
    rows = signal_rows(tx, obs, observers, region, window).filter(F.col("snr").isNotNull() & F.col("rssi").isNotNull())
    return every_kth(rows.select("id", "timestamp", "snr", "rssi"), "timestamp", "id", points)
