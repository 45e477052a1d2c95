"""Hourly pre-aggregates: build for all or for given hours, keep current, and answer windows from them.

Histograms are kept as rows (cell, bin, count), so merging any set of hours is one sum. Station
``*`` marks rows that count a packet once, whoever heard it.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from meshlake.functions import geo, names
from meshlake.functions.keys import grouped, packed, unpacked
from meshlake.functions.numeric import half_away
from meshlake.functions.ranks import top_per_group
from meshlake.functions.time import TimeWindow, hour_of
from meshlake.operators import channels as C, distance as D, resolve as R
from meshlake.operators.nodes import hop_keys, hours_before
from meshlake.operators.packets import best_table, region_codes, region_observers

# fixed values: first bin, width and number of bins per measure
BINS = {"snr": (-30, 1, 50), "rssi": (-130, 1, 110), "size": (0, 4, 64), "length": (0, 16, 32), "dist": (0, 12, 25)}
ALL = "*"


def bin_of(value: Column, measure: str) -> Column:
    """Clamped bin number; values are cut to whole numbers and divided toward zero."""
    lo, width, count = BINS[measure]
    v = value.cast("bigint") - lo
    q = F.when(v < 0, -F.floor(-v / width)).otherwise(F.floor(v / width))
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(count - 1), q))).cast("int")


def at_utc(seconds: int) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


def since_hour(df: DataFrame, time: str, first: datetime) -> DataFrame:
    """Rows from an hour on, by day folders where the table has them."""
    df = df.filter(F.col(time) >= F.lit(first))
    return df.filter(F.col("day") >= F.lit(first.date())) if "day" in df.columns else df


def _hours(df: DataFrame, time: str, hours: DataFrame | list[datetime] | None) -> DataFrame:
    """Restrict to given hours: exactly, plus bounds that prune folders and files. A list of hours needs no join."""
    if hours is None:
        return df.withColumn("hour", hour_of(F.col(time)))
    listed = hours if isinstance(hours, list) else None
    lo, hi = (min(listed, default=None), max(listed, default=None)) if listed is not None else (
        None if s is None else at_utc(s) for s in hours.agg(F.min(F.unix_seconds("hour")), F.max(F.unix_seconds("hour"))).first())
    if lo is None:
        return df.withColumn("hour", hour_of(F.col(time))).filter(F.lit(False))
    near = since_hour(df, time, lo).filter(F.col(time) < F.lit(hi + timedelta(hours=1)))
    if "day" in df.columns:
        near = near.filter(F.col("day") <= F.lit(hi.date()))
    near = near.withColumn("hour", hour_of(F.col(time)))
    return near.filter(F.col("hour").isin(listed)) if listed is not None else near.join(hours.select("hour"), "hour", "left_semi")


# ---- packets ---------------------------------------------------------------------------

def best_rows(tx: DataFrame, obs: DataFrame, hours=None) -> DataFrame:
    """Best observation of each packet of the hours, under the packet's hour."""
    head = _hours(tx, "first_seen", hours).select(F.col("id").alias("transmission_id"), "hour")
    return best_table(obs.join(head, "transmission_id", "left_semi")).join(head, "transmission_id")


# ---- radio -----------------------------------------------------------------------------

def _rf_rows(tx, obs, hours=None) -> DataFrame:
    o = _hours(obs, "timestamp", hours).select("hour", "id", "transmission_id", "observer_id", "snr", "rssi", "timestamp")
    head = tx.select(F.col("id").alias("transmission_id"), F.coalesce("payload_type", F.lit(-1)).alias("payload_type"),
                     F.floor(F.length("raw_hex") / 2).alias("size"))
    return o.join(head, "transmission_id")


def rf_rollup_hour(tx, obs, hours=None) -> DataFrame:
    """(hour, type, station): counts, sums, squares, extremes of signal and of frame size per packet."""
    r = _rf_rows(tx, obs, hours)
    k = ["hour", "payload_type", "observer_id"]
    # one row per packet first, so that size counts once and the cell sums stay additive
    per = r.groupBy(*k, "transmission_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("snr").alias("ns"), F.sum("snr").alias("s"), F.sum(F.col("snr") * F.col("snr")).alias("s2"),
        F.min("snr").alias("s0"), F.max("snr").alias("s1"), F.count("rssi").alias("nr"), F.sum("rssi").alias("r"),
        F.sum(F.col("rssi") * F.col("rssi")).alias("r2"), F.min("rssi").alias("r0"), F.max("rssi").alias("r1"), F.min("size").alias("size"))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return grouped(
        per, k, ["observer_id"], F.sum("n").alias("n_obs"), F.count(F.lit(1)).alias("n_tx"), F.sum("ns").alias("n_snr"), z("s").alias("snr_sum"), z("s2").alias("snr_sumsq"),
        F.min("s0").alias("snr_min"), F.max("s1").alias("snr_max"), F.sum("nr").alias("n_rssi"), z("r").alias("rssi_sum"), z("r2").alias("rssi_sumsq"),
        F.min("r0").alias("rssi_min"), F.max("r1").alias("rssi_max"), F.sum("size").alias("pkt_sum"), F.min("size").alias("pkt_min"), F.max("size").alias("pkt_max"))


def rf_rollup_bins(tx, obs, hours=None) -> DataFrame:
    """(hour, type, station, measure, bin): observations per signal bin, packets per size bin."""
    r = _rf_rows(tx, obs, hours)
    k = ["hour", "payload_type", "observer_id"]
    # a packet's rows lie together: its bins are one row, and only that row is brought to the cell and taken apart there
    bins = r.groupBy(*k, "transmission_id", "size", bin_of(F.col("snr"), "snr").alias("snr"), bin_of(F.col("rssi"), "rssi").alias("rssi")).agg(
        F.count(F.lit(1)).alias("n"))
    per = bins.groupBy(*k, "transmission_id", "size").agg(F.collect_list(F.struct("snr", "rssi", "n")).alias("e"))
    cell = per.select(*k, bin_of(F.col("size"), "size").alias("size"), "e").repartition(*k)
    one = lambda measure, b, n: F.struct(F.lit(measure).alias("measure"), b.alias("bin"), n.alias("n"))
    e = F.concat(F.array(one("size", F.col("size"), F.lit(1).cast("bigint"))), F.flatten(F.transform("e", lambda x: F.array(
        one("snr", x["snr"], x["n"]), one("rssi", x["rssi"], x["n"])))))
    rows = cell.select(*k, F.explode(e).alias("e")).select(*k, "e.*").filter((F.col("measure") == "size") | F.col("bin").isNotNull())
    return rows.groupBy(*k, "measure", "bin").agg(F.sum("n").alias("n"))


def rf_rollup_scatter(tx, obs, hours=None, points: int | None = None) -> DataFrame:
    """(snr, rssi) pairs of each cell by time; with ``points`` only its first ones."""
    r = _rf_rows(tx, obs, hours).filter(F.col("snr").isNotNull() & F.col("rssi").isNotNull())
    r = r.select("hour", "payload_type", "observer_id", "timestamp", "id", "snr", "rssi")
    cell, order = ["hour", "payload_type", "observer_id"], [F.col("timestamp"), F.col("id")]
    if points is None:
        return r.withColumn("rank", F.row_number().over(W.partitionBy(*cell).orderBy(*order)))
    return top_per_group(r, cell, order, points)


def rf_rollup_tx(tx, obs, hours=None) -> DataFrame:
    return _rf_rows(tx, obs, hours).groupBy("hour", "payload_type").agg(F.count_distinct("transmission_id").alias("distinct_tx"))


def in_hours(window: TimeWindow | None) -> Column:
    if window is None or window.unbounded:
        return F.lit(True)
    cut = lambda t: t.replace(minute=0, second=0, microsecond=0) if t else None
    return TimeWindow(cut(window.since), window.until).holds(F.col("hour"))


def _scope(cells: DataFrame, observers, region, window) -> DataFrame:
    c = cells.filter(in_hours(window))
    return c if region_codes(region) is None else c.join(region_observers(observers, region), "observer_id", "left_semi")


def bin_median(bins: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Lower edge of the bin where more than half of the counts are reached; at most 110 bins per key."""
    lo, width, _ = BINS[measure]
    arr = bins.groupBy(*keys, "bin").agg(F.sum("n").alias("n")).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("b"), F.sum("n").alias("t"))
    walk = F.aggregate("b", F.struct(F.lit(0).cast("bigint").alias("c"), F.lit(None).cast("int").alias("x")), lambda a, e: F.struct(
        (a["c"] + e["n"]).alias("c"), F.when(a["x"].isNull() & (a["c"] + e["n"] > F.floor(F.col("t") / 2)), e["bin"]).otherwise(a["x"]).alias("x")))
    return arr.select(*keys, (F.lit(lo) + walk["x"] * width).alias("median"))


def rf_from_rollup(cells: DataFrame, bins: DataFrame, observers=None, region=None, window=None) -> DataFrame:
    """Signal statistics of a window from hourly cells: one row per measure."""
    c = _scope(cells, observers, region, window)
    b = _scope(bins, observers, region, window)
    out = None
    for m in ("snr", "rssi"):
        s = c.agg(F.sum(f"n_{m}").alias("count"), F.min(f"{m}_min").alias("min"), F.max(f"{m}_max").alias("max"),
                  F.sum(f"{m}_sum").alias("s"), F.sum(f"{m}_sumsq").alias("q"))
        mean = F.try_divide("s", "count")
        row = s.select(F.lit(m).alias("measure"), "count", "min", "max", mean.alias("avg"),
                       F.sqrt(F.greatest(F.try_divide("q", "count") - mean * mean, F.lit(0.0))).alias("stddev"))
        med = bin_median(b.filter(F.col("measure") == m), ["measure"], m)
        row = row.join(med, "measure", "left")
        out = row if out is None else out.unionByName(row)
    return out


def rf_bins_from_rollup(bins: DataFrame, observers=None, region=None, window=None) -> DataFrame:
    return _scope(bins, observers, region, window).groupBy("measure", "bin").agg(F.sum("n").alias("n"))


def rf_hours_from_rollup(cells: DataFrame, per_tx: DataFrame, observers=None, region=None, window=None) -> DataFrame:
    """Signal per hour, with distinct packets per hour where no region is asked for."""
    c = _scope(cells, observers, region, window).groupBy("hour").agg(
        F.sum("n_snr").alias("n_snr"), F.try_divide(F.sum("snr_sum"), F.sum("n_snr")).alias("avg_snr"), F.sum("n_tx").alias("heard"))
    if region_codes(region) is not None:
        return c.withColumnRenamed("heard", "packets")
    p = per_tx.filter(in_hours(window)).groupBy("hour").agg(F.sum("distinct_tx").alias("packets"))
    return c.drop("heard").join(p, "hour")


def rf_types_from_rollup(cells: DataFrame, observers=None, region=None, window=None) -> DataFrame:
    """Signal and frame sizes per payload type; sizes weigh a packet once per hour and station that heard it."""
    return _scope(cells, observers, region, window).groupBy("payload_type").agg(
        F.sum("n_obs").alias("count"), F.sum("n_snr").alias("n_snr"), F.try_divide(F.sum("snr_sum"), F.sum("n_snr")).alias("avg_snr"),
        F.min("snr_min").alias("min_snr"), F.max("snr_max").alias("max_snr"), F.sum("n_tx").alias("sizes"),
        F.try_divide(F.sum("pkt_sum") * 1.0, F.sum("n_tx")).alias("avg_size"), F.min("pkt_min").alias("min_size"), F.max("pkt_max").alias("max_size"))


# ---- channels --------------------------------------------------------------------------

def _channel_rows(tx, obs, hours=None) -> DataFrame:
    head = _hours(tx.filter(F.col("payload_type") == names.GRP_TXT), "first_seen", hours).drop("hour")
    rows = C.channel_rows(head, obs, None).withColumn("hour", hour_of(F.col("first_seen")))
    o = obs.select(F.col("transmission_id").alias("id"), "observer_id")
    return rows.join(o, "id", "left").withColumn("observer_id", F.coalesce("observer_id", F.lit("")))


def channel_rollup_hour(tx, obs, hours=None) -> DataFrame:
    r = _channel_rows(tx, obs, hours)
    order = F.struct("first_seen", "id")
    real = ~C.placeholder(F.col("name"))
    n = F.when(F.col("text") != "", F.octet_length("text"))
    return grouped(
        r, ["hour", "ch", "observer_id"], ["observer_id"], F.count(F.lit(1)).alias("msg_count"), F.count_if(~F.col("encrypted")).alias("decrypted_count"),
        F.coalesce(F.min_by(F.when(real, F.col("name")), F.when(real, order)), F.min_by("name", order)).alias("name"), F.max("first_seen").alias("last_activity"),
        F.coalesce(F.sum(n), F.lit(0)).alias("len_sum"), F.count(n).alias("len_count"), F.min(n).alias("len_min"), F.max(n).alias("len_max"))


def channel_rollup_bins(tx, obs, hours=None) -> DataFrame:
    r = _channel_rows(tx, obs, hours).filter(F.col("text") != "")
    return r.groupBy("hour", "ch", "observer_id", bin_of(F.octet_length("text"), "length").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def channel_sender_rollup(tx, obs, hours=None) -> DataFrame:
    return _channel_rows(tx, obs, hours).filter(F.col("sender") != "").groupBy("hour", "ch", "observer_id", "sender").agg(F.count(F.lit(1)).alias("msg_count"))


def channel_rollup_tx(tx, obs, hours=None) -> DataFrame:
    return _channel_rows(tx, obs, hours).groupBy("hour", "ch").agg(F.count_distinct("id").alias("distinct_tx"))


def channels_from_rollup(cells: DataFrame, senders: DataFrame, per_tx: DataFrame, observers=None, region=None, window=None) -> DataFrame:
    """Channels of a window: messages (distinct packets without a region), senders, encrypted flag."""
    c = _scope(cells, observers, region, window)
    real = ~C.placeholder(F.col("name"))
    g = c.groupBy("ch").agg(
        F.sum("msg_count").alias("heard"), F.sum("decrypted_count").alias("d"), F.max("last_activity").alias("last_activity"),
        F.coalesce(F.min_by(F.when(real, F.col("name")), F.when(real, F.struct("hour", "name"))), F.min_by("name", F.struct("hour", "name"))).alias("name"))
    s = _scope(senders, observers, region, window).groupBy("ch").agg(F.count_distinct("sender").alias("senders"))
    g = g.join(s, "ch", "left")
    if region_codes(region) is None:
        g = g.join(per_tx.filter(in_hours(window)).groupBy("ch").agg(F.sum("distinct_tx").alias("messages")), "ch")
    else:
        g = g.withColumn("messages", F.col("heard"))
    return g.select("ch", "name", "messages", F.coalesce("senders", F.lit(0)).alias("senders"), "last_activity", (F.col("d") == 0).alias("encrypted"))


def channel_timeline_from_rollup(cells: DataFrame, per_tx: DataFrame, observers=None, region=None, window=None) -> DataFrame:
    """Messages per hour and channel: distinct packets, or hearings by a region's stations."""
    if region_codes(region) is None:
        return per_tx.filter(in_hours(window)).groupBy("hour", "ch").agg(F.sum("distinct_tx").alias("messages"))
    return _scope(cells, observers, region, window).groupBy("hour", "ch").agg(F.sum("msg_count").alias("messages"))


def channel_lengths_from_rollup(cells: DataFrame, bins: DataFrame, observers=None, region=None, window=None) -> DataFrame:
    """Text lengths (bytes) per channel: how many, mean, extremes and the counts of the bins that have any (at most 32)."""
    c = _scope(cells, observers, region, window).groupBy("ch").agg(
        F.sum("len_count").alias("count"), F.try_divide(F.sum("len_sum") * 1.0, F.sum("len_count")).alias("avg"), F.min("len_min").alias("min"), F.max("len_max").alias("max"))
    b = _scope(bins, observers, region, window).groupBy("ch", "bin").agg(F.sum("n").alias("n")).groupBy("ch").agg(
        F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    return c.filter("count > 0").join(b, "ch", "left")


def senders_from_rollup(senders: DataFrame, observers=None, region=None, window=None, limit: int = 15) -> DataFrame:
    return _scope(senders, observers, region, window).groupBy("sender").agg(F.sum("msg_count").alias("count")).orderBy(F.col("count").desc(), "sender").limit(limit)


# ---- relays ----------------------------------------------------------------------------

def node_rollup_hour(tx, obs, hours=None) -> DataFrame:
    """(hour, relay key): distinct non-advert packets and the last one."""
    head = _hours(tx.filter(F.coalesce("payload_type", F.lit(-1)) != names.ADVERT), "first_seen", hours).select(F.col("id").alias("transmission_id"), "hour", "first_seen")
    keys = obs.filter(F.size("path") > 0).select("transmission_id", F.explode(hop_keys()).alias("hop_key")).distinct()
    return grouped(keys.join(head, "transmission_id"), ["hour", "hop_key"], ["hop_key"],
                   F.count(F.lit(1)).alias("relay_count"), F.max("first_seen").alias("last_relayed"))


def node_rollup_total(tx, hours=None) -> DataFrame:
    return _hours(tx.filter(F.coalesce("payload_type", F.lit(-1)) != names.ADVERT), "first_seen", hours).groupBy("hour").agg(F.count(F.lit(1)).alias("n_nonadvert"))


def relay_from_rollup(cells: DataFrame, totals: DataFrame, nodes: DataFrame, now, window_hours: float = 24) -> DataFrame:
    """Relay activity over 1 hour, 24 hours and 7 days, summed over the node's key and one-byte prefix."""
    h = lambda n: F.date_trunc("hour", hours_before(now, n))
    c = cells.filter(F.col("hour") >= h(168)).groupBy("hop_key").agg(
        F.sum("relay_count").alias("c7"), F.sum(F.when(F.col("hour") >= h(24), F.col("relay_count"))).alias("c24"),
        F.sum(F.when(F.col("hour") >= h(1), F.col("relay_count"))).alias("c1"), F.max("last_relayed").alias("last"))
    total = totals.filter(F.col("hour") >= h(168)).agg(F.coalesce(F.sum("n_nonadvert"), F.lit(0))).scalar()
    mine = R.relays(nodes).select("key", F.explode(F.array("key", F.substring("key", 1, 2))).alias("hop_key"))
    g = mine.join(c, "hop_key", "left").groupBy("key").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("c1", "c24", "c7")], F.max("last").alias("last"))
    return g.select(F.col("key").alias("public_key"), F.col("c1").alias("relay_count_1h"), F.col("c24").alias("relay_count_24h"), F.col("last").alias("last_relayed"),
                    F.coalesce(F.col("last") > hours_before(now, window_hours), F.lit(False)).alias("relay_active"),
                    F.least(F.coalesce(F.try_divide(F.col("c7") * 1.0, total), F.lit(0.0)), F.lit(1.0)).alias("usefulness"))


# ---- distance --------------------------------------------------------------------------

def stored_hops(tx, obs, nodes, hours=None, max_km: float | None = None) -> DataFrame:
    """Hops of each packet's first non-empty path, resolved only by the stored keys; signal is the best one.

    With ``max_km`` only hops up to it; `distance.distance_rejected` counts the others.
    """
    head = _hours(tx, "first_seen", hours).select("id", "hash", "first_seen", "hour", F.lower("decoded.pubKey").alias("sender"))
    first = F.min(F.when(F.size("path") > 0, F.struct("id", "path", "resolved_path")))
    o = obs.groupBy("transmission_id").agg(first.alias("f"), F.max("snr").alias("snr")).filter(F.col("f").isNotNull()).select(
        F.col("transmission_id").alias("id"), "snr", "f.path", "f.resolved_path")
    rep = lambda: F.contains(F.lower(F.coalesce("role", F.lit(""))), F.lit("repeater"))
    pos = nodes.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        F.col("public_key").alias("k"), names.is_relay(F.col("role")).alias("relay"), F.struct(F.col("public_key").alias("pk"), "name", "lat", "lon", rep().alias("rep")).alias("stop"))
    keys = F.zip_with("path", F.coalesce("resolved_path", F.array().cast("array<string>")), lambda h, r: F.when(h.isNotNull(), F.lower(F.coalesce(F.when(r != "", r), h))))
    hop = o.select("id", F.posexplode(keys).alias("pos", "k")).join(pos.filter("relay"), "k").select("id", "pos", "stop")
    start = head.join(o.select("id"), "id", "left_semi").join(pos, F.col("sender") == F.col("k")).select("id", F.lit(-1).alias("pos"), "stop")
    c = hop.unionByName(start).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "stop"))).alias("s")).filter(F.size("s") >= 2)
    c = c.select("id", F.posexplode(D.chain_hops(F.transform("s", lambda e: e["stop"]), max_km)).alias("pos", "e"))
    return c.join(head, "id").join(o.select("id", "snr"), "id").select(
        "id", "hash", "first_seen", "hour", "snr", "pos", F.col("e.a.pk").alias("from_pk"), F.col("e.b.pk").alias("to_pk"), F.col("e.km").alias("km"),
        half_away(F.col("e.km"), 2).alias("dist"), D.hop_type(F.col("e.a.rep"), F.col("e.b.rep")).alias("type"))


def _per_station(hops: DataFrame, obs: DataFrame) -> DataFrame:
    """Each hop once under ``*`` and once per station that heard the packet."""
    st = obs.select(F.col("transmission_id").alias("id"), "observer_id").distinct()
    return hops.withColumn("observer_id", F.lit(ALL)).unionByName(hops.join(st, "id").select(*hops.columns, "observer_id"))


def distance_hourly(hops: DataFrame, obs: DataFrame) -> DataFrame:
    r = _per_station(hops, obs).withColumn("d100", F.round(F.col("dist") * 100).cast("bigint"))
    return grouped(r, ["hour", "type", "observer_id"], ["observer_id"], F.count(F.lit(1)).alias("count"), F.sum("d100").alias("dist_sum_100"), F.min("dist").alias("dist_min"), F.max("dist").alias("dist_max"))


def distance_bins_hourly(hops: DataFrame, obs: DataFrame) -> DataFrame:
    return _per_station(hops, obs).groupBy("hour", "type", "observer_id", bin_of(F.col("dist"), "dist").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def distance_pair_hourly(hops: DataFrame, obs: DataFrame) -> DataFrame:
    r = _per_station(hops, obs).withColumns({"pk_a": F.least("from_pk", "to_pk"), "pk_b": F.greatest("from_pk", "to_pk"), "hash": packed(F.col("hash"))})
    best = F.struct(-F.col("dist"), F.col("first_seen"), F.col("id"), F.col("pos"))
    g = grouped(r, ["hour", "pk_a", "pk_b", "type", "observer_id"], ["pk_a", "pk_b", "observer_id"],
                F.count(F.lit(1)).alias("count"), F.max("dist").alias("best_dist"), F.min_by("hash", best).alias("best_hash"), F.max("snr").alias("snr_max"))
    return g.withColumn("best_hash", unpacked(F.col("best_hash")))


def distance_paths_rollup(hops: DataFrame) -> DataFrame:
    return hops.groupBy("hour", "id", "hash").agg(half_away(F.round(F.sum("km"), 9), 2).alias("total_dist"), F.count(F.lit(1)).alias("hop_count"))


def distance_path_observers(hops: DataFrame, obs: DataFrame) -> DataFrame:
    """(hour, packet, station): who heard the packets of the stored paths, for a region's paths."""
    return obs.select(F.col("transmission_id").alias("id"), "observer_id").distinct().join(hops.select("hour", "id").distinct(), "id").select("hour", "id", "observer_id")


def _stations(t: DataFrame, observers, region, window) -> DataFrame:
    """Rows of all stations together, or those of a region's stations one by one."""
    t = t.filter(in_hours(window))
    return t.filter(F.col("observer_id") == ALL) if region_codes(region) is None else t.join(region_observers(observers, region), "observer_id", "left_semi")


def _mean_dist() -> Column:
    return F.floor(F.sum("dist_sum_100") / F.sum("count") + 0.5) / 100.0


def distance_from_rollup(hourly: DataFrame, bins: DataFrame, observers=None, region=None, window=None) -> DataFrame:
    """Statistics per hop type of a window."""
    g = _stations(hourly, observers, region, window).groupBy("type").agg(
        F.sum("count").alias("count"), _mean_dist().alias("avg"), F.min("dist_min").alias("min"), F.max("dist_max").alias("max"))
    return g.join(bin_median(_stations(bins, observers, region, window), ["type"], "dist"), "type", "left")


def distance_histogram_from_rollup(bins: DataFrame, observers=None, region=None, window=None) -> DataFrame:
    """Hops per bin, with the bin's lower edge."""
    lo, width, _ = BINS["dist"]
    return _stations(bins, observers, region, window).groupBy("bin").agg(F.sum("n").alias("count")).withColumn("x", F.col("bin") * width + lo)


def distance_hours_from_rollup(hourly: DataFrame, window=None, observers=None, region=None) -> DataFrame:
    return _stations(hourly, observers, region, window).groupBy("hour").agg(_mean_dist().alias("avg"), F.sum("count").alias("count"))


def distance_pairs_from_rollup(pairs: DataFrame, window=None, limit: int = 20, observers=None, region=None) -> DataFrame:
    p = _stations(pairs, observers, region, window).groupBy("pk_a", "pk_b", "type").agg(
        F.sum("count").alias("count"), F.max("best_dist").alias("best_dist"), F.min_by("best_hash", F.struct(-F.col("best_dist"), F.col("hour"), F.col("best_hash"))).alias("best_hash"),
        F.max("snr_max").alias("snr_max"))
    return p.orderBy(F.col("best_dist").desc(), "pk_a", "pk_b", "type").limit(limit)


def distance_paths_from_rollup(paths: DataFrame, path_observers: DataFrame | None = None, observers=None, region=None, window=None, limit: int = 20) -> DataFrame:
    """Longest paths, each once; with a region those that one of its stations heard."""
    p = paths.filter(in_hours(window))
    if region_codes(region) is not None:
        heard = path_observers.filter(in_hours(window)).join(region_observers(observers, region), "observer_id", "left_semi").select("hour", "id").distinct()
        p = p.join(heard, ["hour", "id"], "left_semi")
    return p.orderBy(F.col("total_dist").desc(), "id").limit(limit)


# ---- upkeep ----------------------------------------------------------------------------

def touched_hours(tx: DataFrame, obs: DataFrame, watermark: int, by: str = "timestamp") -> DataFrame:
    """Hours that got observations after the watermark id; these are rebuilt whole."""
    new = obs.filter(F.col("id") > watermark)
    if by == "first_seen":
        new = new.select(F.col("transmission_id").alias("id")).distinct().join(tx.select("id", "first_seen"), "id")
    return new.select(hour_of(F.col(by)).alias("hour")).distinct()


def write_rollup(df: DataFrame, path: str, key: str = "yyyy-MM-dd-HH") -> None:
    """Replace exactly the hours (or, with a shorter key, days) present in ``df``; other partitions stay.

    Rows are rebalanced by partition so that one is one file, or several when it is large; their texts move packed.
    """
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    day = df.withColumns({c: packed(F.col(c)) for c in text}).withColumn("hour_key", F.date_format("hour", key)).hint("rebalance", "hour_key")
    day = day.withColumns({c: unpacked(F.col(c)) for c in text})
    # keys are most of a row, and no dictionary holds them on large tables
    day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("hour_key").parquet(path)
