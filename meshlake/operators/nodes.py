"""Node and fleet health. Per-node reports are computed for all nodes at once; pass ``pubkeys`` to narrow them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from meshlake.functions import names
from meshlake.functions.keys import grouped, packed, unpacked
from meshlake.functions.numeric import half_away, spread, true_median, trunc_round
from meshlake.functions.ranks import top_per_group, with_previous
from meshlake.functions.time import TimeWindow, hour_of, ts_lit, utc

from . import resolve as R
from .clock import mean_tenths
from .packets import best_observation, heard_ids, heard_in, node_links, obs_in_region, region_codes, seen_in

# fixed values: hours until degraded and until silent
INFRA_HOURS, OTHER_HOURS = (24, 72), (1, 24)
COUNTED_ROLES = ("repeater", "room", "companion", "sensor")
LOW_MV, CRITICAL_MV = 3300, 3000


def hours_before(now: datetime | str, hours: float) -> Column:
    return F.timestamp_micros(F.unix_micros(ts_lit(now)) - F.lit(int(hours * 3_600_000_000)))


def node_rows(tx: DataFrame, obs: DataFrame, now=None, days: int | None = None, pubkeys: DataFrame | None = None,
              best: DataFrame | None = None) -> DataFrame:
    """(public_key, packet) rows with the packet's representative observation, from the kept table where there is one."""
    head = tx
    if days is not None:
        window = TimeWindow(utc(now) - timedelta(days=days), None)
        head = seen_in(tx, window).filter(F.col("first_seen") > ts_lit(window.since))
        obs = heard_in(obs, window)
    links = node_links(head, obs)
    if pubkeys is not None:
        links = links.join(pubkeys.select("public_key"), "public_key", "left_semi")
        if best is None:  # the packets of some nodes only
            obs = obs.join(links.select(F.col("id").alias("transmission_id")).distinct(), "transmission_id", "left_semi")
    best = best_observation(obs if best is None else best, ("path", "snr", "rssi", "observer_id")).withColumnRenamed("transmission_id", "id")
    return links.join(head.select("id", "hash", "first_seen", "payload_type", "decoded"), "id").join(best, "id", "left").withColumn(
        "observation_count", F.coalesce("observation_count", F.lit(0)))


def _today(now) -> Column:
    return F.date_trunc("day", ts_lit(now))


def bulk_health(tx, obs, nodes, observers, now, limit: int | None = 50, region: str | None = None, best: DataFrame | None = None) -> DataFrame:
    """Most recently seen nodes (all without ``limit``) with their packet totals."""
    base = nodes.select("public_key", "name", "role", "lat", "lon", "last_seen")
    if region_codes(region) is not None:
        near = heard_ids(obs_in_region(obs, observers, region))
        keys = node_links(tx, obs).join(near, F.col("id") == near.transmission_id, "left_semi").select("public_key").distinct()
        base = base.join(keys, "public_key", "left_semi")
    top = base if limit is None else base.orderBy(F.col("last_seen").desc(), "public_key").limit(limit)
    rows = node_rows(tx, obs, pubkeys=None if limit is None and region_codes(region) is None else top, best=best)
    agg = grouped(
        rows, ["public_key"], ["public_key"], F.count(F.lit(1)).alias("packets"), F.sum("observation_count").alias("obs"),
        F.count_if(F.col("first_seen") > _today(now)).alias("today"), F.avg("snr").alias("avg_snr"), F.max("first_seen").alias("last_heard"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return top.join(agg, "public_key", "left").select(
        "public_key", "name", "role", z("packets").alias("total_transmissions"),
        F.when(F.col("packets") > 0, F.greatest("obs", F.lit(1))).otherwise(F.lit(0)).alias("total_observations"),
        z("today").alias("packets_today"), "avg_snr", "last_heard")


def node_observer_stats(tx, obs, observers, now=None, days: int | None = None, pubkeys=None) -> DataFrame:
    """Per node and representative station: packets, mean signal, first and last time."""
    r = node_rows(tx, obs, now, days, pubkeys).filter(F.col("observer_id") != "")
    who = observers.select(F.col("id").alias("observer_id"), F.col("name").alias("observer_name"))
    return grouped(
        r, ["public_key", "observer_id"], ["public_key", "observer_id"], F.count(F.lit(1)).alias("packet_count"), F.avg("snr").alias("avg_snr"), F.avg("rssi").alias("avg_rssi"),
        F.min("first_seen").alias("first_seen"), F.max("first_seen").alias("last_seen")).join(who, "observer_id", "left")


node_observer_coverage = node_observer_stats


def node_health(tx, obs, now, pubkeys=None, best=None) -> DataFrame:
    """Totals per node, with the rounded mean hop count of its relayed packets."""
    n = F.size("path")
    return grouped(
        node_rows(tx, obs, pubkeys=pubkeys, best=best), ["public_key"], ["public_key"], F.count(F.lit(1)).alias("total_transmissions"), F.sum("observation_count").alias("total_observations"),
        F.count_if(F.col("first_seen") > _today(now)).alias("packets_today"), F.avg("snr").alias("avg_snr"),
        F.coalesce(half_away(F.avg(F.when(n > 0, n)), 0), F.lit(0.0)).cast("int").alias("avg_hops"), F.max("first_seen").alias("last_heard"))


def node_recent_packets(tx, obs, limit: int = 20, pubkeys=None) -> DataFrame:
    r = node_rows(tx, obs, pubkeys=pubkeys).select("public_key", "id", "hash", "first_seen", "payload_type", "snr")
    text = ("public_key", "hash")
    r = r.withColumns({c: packed(F.col(c)) for c in text})
    top = top_per_group(r, ["public_key"], [F.col("first_seen").desc(), F.col("id").desc()], limit)
    return top.withColumns({c: unpacked(F.col(c)) for c in text})


def node_activity_timeline(tx, obs, now, days: int = 7, pubkeys=None) -> DataFrame:
    r = node_rows(tx, obs, now, days, pubkeys).withColumn("hour", hour_of(F.col("first_seen")))
    return grouped(r, ["public_key", "hour"], ["public_key"], F.count(F.lit(1)).alias("count"))


def node_snr_trend(tx, obs, now, days: int = 7, pubkeys=None) -> DataFrame:
    return node_rows(tx, obs, now, days, pubkeys).filter(F.col("snr").isNotNull()).select(
        "public_key", "id", "first_seen", "snr", "rssi", "observer_id")


def node_type_breakdown(tx, obs, now, days: int = 7, pubkeys=None) -> DataFrame:
    r = node_rows(tx, obs, now, days, pubkeys).filter(F.col("payload_type").isNotNull())
    return grouped(r, ["public_key", "payload_type"], ["public_key"], F.count(F.lit(1)).alias("count"))


def node_hop_distribution(tx, obs, now, days: int = 7, pubkeys=None) -> DataFrame:
    n = F.coalesce(F.size("path"), F.lit(0))
    label = F.when(n >= 4, "4+").otherwise(F.greatest(n, F.lit(0)).cast("string"))
    r = node_rows(tx, obs, now, days, pubkeys).withColumn("hops", label)
    return grouped(r, ["public_key", "hops"], ["public_key"], F.count(F.lit(1)).alias("count"))


def _field(name: str, tx: DataFrame) -> Column:
    """A decoded field, or null where the table's struct lacks it."""
    return F.col(f"decoded.{name}") if name in [f.name for f in tx.schema["decoded"].dataType.fields] else F.lit(None).cast("string")


def peer_rows(tx, obs, now, days: int, pubkeys=None, rows: DataFrame | None = None) -> DataFrame:
    r = node_rows(tx, obs, now, days, pubkeys) if rows is None else rows
    f = lambda n: _field(n, tx)
    full = lambda a, b: F.coalesce(F.when(f(a) != "", f(a)), f(b))
    peers = F.array(F.struct(f("sender_key").alias("k"), full("sender_name", "sender_short_name").alias("n")),
                    F.struct(f("recipient_key").alias("k"), full("recipient_name", "recipient_short_name").alias("n")),
                    F.struct(F.coalesce(f("pubkey"), f("peer_pubkey")).alias("k"), f("name").alias("n")))
    p = r.select("public_key", "id", "first_seen", F.explode(peers).alias("p")).filter(
        (F.col("p.k") != "") & (F.col("p.k") != F.col("public_key")))
    return p.groupBy("public_key", F.col("p.k").alias("peer_key")).agg(
        F.count(F.lit(1)).alias("message_count"), F.max("first_seen").alias("last_contact"),
        F.min_by("p.n", F.struct("first_seen", "id")).alias("_n")).select(
        "public_key", "peer_key", F.coalesce(F.when(F.col("_n") != "", F.col("_n")), F.substring("peer_key", 1, 12)).alias("peer_name"),
        "message_count", "last_contact")


def node_peers(tx, obs, now, days: int = 7, limit: int = 20, pubkeys=None) -> DataFrame:
    return top_per_group(peer_rows(tx, obs, now, days, pubkeys), ["public_key"], [F.col("message_count").desc(), F.col("peer_key")], limit)


def node_uptime_heatmap(tx, obs, now, days: int = 7, pubkeys=None) -> DataFrame:
    r = node_rows(tx, obs, now, days, pubkeys).withColumns({"day_of_week": F.dayofweek("first_seen") - 1, "hour": F.hour("first_seen")})
    return grouped(r, ["public_key", "day_of_week", "hour"], ["public_key"], F.count(F.lit(1)).alias("count"))


def node_computed_stats(tx, obs, now, days: int = 7, pubkeys=None, best=None) -> DataFrame:
    """Availability, longest silence, signal grade, relay share and daily mean per node."""
    r = node_rows(tx, obs, now, days, pubkeys, best)
    hours = r.select("public_key", hour_of(F.col("first_seen")).alias("hour")).distinct()
    gaps = with_previous(hours, ["public_key"], ["hour"], F.to_date("hour"), ["hour"])
    gap = (F.unix_seconds("hour") - F.unix_seconds("prev_hour")) * 1000
    silence = gaps.groupBy("public_key").agg(F.count(F.lit(1)).alias("hours"), F.max(F.struct(gap.alias("g"), (-F.unix_seconds("prev_hour")).alias("s"))).alias("m"))
    n = F.size("path")
    g = r.groupBy("public_key").agg(
        F.count(F.lit(1)).alias("total_packets"), F.avg("snr").alias("mean"), spread("snr").alias("dev"),
        F.count_if(n > 0).alias("with_path"), F.count_if(n > 1).alias("relayed"), F.count_distinct("observer_id").alias("unique_observers"))
    peers = peer_rows(tx, obs, now, days, rows=r).groupBy("public_key").agg(F.count(F.lit(1)).alias("unique_peers"))
    j = g.join(silence, "public_key").join(peers, "public_key", "left")
    mean, dev = F.coalesce("mean", F.lit(0.0)), F.col("dev")
    grade = (F.when((mean > 15) & (dev < 2), "A").when(mean > 15, "A-").when((mean > 12) & (dev < 3), "B+").when(mean > 8, "B")
             .when(mean > 3, "C").otherwise("D"))
    return j.select(
        "public_key", F.least(trunc_round(F.col("hours") * 100.0 / (24.0 * days), 1), F.lit(100.0)).alias("availability_pct"),
        F.coalesce(F.col("m.g"), F.lit(0)).alias("longest_silence_ms"),
        F.when(F.col("m.g") > 0, F.timestamp_seconds(-F.col("m.s"))).alias("longest_silence_start"), grade.alias("signal_grade"),
        trunc_round(mean, 1).alias("snr_mean"), trunc_round(dev, 1).alias("snr_stddev"),
        F.coalesce(trunc_round(F.try_divide(F.col("relayed") * 100.0, F.col("with_path")), 1), F.lit(0.0)).alias("relay_pct"),
        "total_packets", "unique_observers", F.coalesce("unique_peers", F.lit(0)).alias("unique_peers"),
        trunc_round(F.col("total_packets") / float(days), 1).alias("avg_packets_per_day"))


# ---- relays ----------------------------------------------------------------------------

def hop_keys(path: str = "path", resolved: str = "resolved_path") -> Column:
    """Distinct lower-case relay keys of an observation: the resolved key where known, else the raw hop."""
    z = F.zip_with(path, F.coalesce(resolved, F.array().cast("array<string>")), lambda h, r: F.when(
        h.isNotNull(), F.lower(F.coalesce(F.when(r != "", r), h))))
    return F.array_distinct(F.filter(z, lambda k: k != ""))


def relay_packets(tx, obs, full_keys_only: bool = False) -> DataFrame:
    """(hop, id, first_seen): non-advert packets by relay key, once per packet."""
    head = tx.filter(F.coalesce("payload_type", F.lit(-1)) != names.ADVERT).select(F.col("id").alias("transmission_id"), "first_seen")
    raw = F.transform("path", F.lower)
    keys = F.array_distinct(F.array_compact(F.transform("resolved_path", F.lower))) if full_keys_only else F.array_union(
        F.coalesce(raw, F.array().cast("array<string>")), F.coalesce(F.array_compact(F.transform("resolved_path", F.lower)), F.array().cast("array<string>")))
    h = obs.select("transmission_id", F.explode(keys).alias("hop")).distinct()
    return h.join(head, "transmission_id").withColumnRenamed("transmission_id", "id")


def repeater_liveness(tx, obs, nodes, now, window_hours: float = 24) -> DataFrame:
    """Relay activity of every relay, found by full key or by one-byte prefix.

    A packet found under both spellings of a node counts once: its short spellings are brought to its rows, which
    lie together by packet already, and each hop is then counted in one shuffle of what is left of it per task.
    """
    who = R.relays(nodes).select("key")
    rp = relay_packets(tx, obs)
    # neither of these can be a relay's spelling; the rest finds its relay after counting
    lens = who.agg(F.coalesce(F.min(F.length("key")), F.lit(2)).alias("lo"), F.coalesce(F.max(F.length("key")), F.lit(2)).alias("hi"))
    n = F.length("hop")
    rp = rp.filter((n == 2) | ((n >= lens.select("lo").scalar()) & (n <= lens.select("hi").scalar())))
    shorts = F.collect_set(F.when(n == 2, F.col("hop"))).over(W.partitionBy("id"))
    rp = rp.withColumn("both", F.array_contains(shorts, F.substring("hop", 1, 2)))
    day, hour = F.col("first_seen") > hours_before(now, 24), F.col("first_seen") > hours_before(now, 1)
    g = grouped(rp, ["hop"], ["hop"], F.max("first_seen").alias("last"), F.count_if(day).alias("d"), F.count_if(hour).alias("h"),
                              F.count_if(day & F.col("both")).alias("b_d"), F.count_if(hour & F.col("both")).alias("b_h"))
    k = g.select(F.col("hop").alias("key"), F.col("last").alias("k_last"), F.col("d").alias("k_d"), F.col("h").alias("k_h"), "b_d", "b_h")
    p = g.filter(n == 2).select("hop", F.col("last").alias("p_last"), F.col("d").alias("p_d"), F.col("h").alias("p_h"))
    j = who.withColumn("hop", F.substring("key", 1, 2)).join(k, "key", "left").join(p, "hop", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    last = F.greatest("k_last", "p_last")
    return j.select(F.col("key").alias("public_key"), last.alias("last_relayed"), (z("k_h") + z("p_h") - z("b_h")).alias("relay_count_1h"),
                    (z("k_d") + z("p_d") - z("b_d")).alias("relay_count_24h"),
                    F.coalesce(last > hours_before(now, window_hours), F.lit(False)).alias("relay_active"))


def repeater_usefulness(tx, obs, nodes) -> DataFrame:
    """Share of all non-advert packets that a relay carried."""
    total = tx.filter(F.coalesce("payload_type", F.lit(-1)) != names.ADVERT).agg(F.count(F.lit(1))).scalar()
    n = grouped(relay_packets(tx, obs, full_keys_only=True).select(F.col("hop").alias("key")), ["key"], ["key"], F.count(F.lit(1)).alias("relayed"))
    return R.relays(nodes).select("key").join(n, "key", "left").select(
        F.col("key").alias("public_key"), F.coalesce("relayed", F.lit(0)).alias("relayed"),
        F.least(F.coalesce(F.try_divide(F.coalesce("relayed", F.lit(0)) * 1.0, total), F.lit(0.0)), F.lit(1.0)).alias("usefulness"))


def node_paths(tx, obs, nodes, edges, now, pubkeys: DataFrame, limit: int = 50) -> DataFrame:
    """Packet paths through given nodes, grouped by the chain of resolved keys."""
    keys = pubkeys.select(F.lower("public_key").alias("key")).distinct()
    best = best_observation(obs, ("path",)).filter(F.size("path") > 0).select("transmission_id", "path")
    short = keys.select("key", F.explode(F.array(*[F.substring("key", 1, n) for n in (2, 4, 6, 8)])).alias("hop")).distinct()
    raw = best.select("transmission_id", F.explode(F.array_distinct(F.transform("path", F.lower))).alias("hop")).join(short, "hop").select("key", "transmission_id")
    sure = obs.select("transmission_id", F.explode(F.array_distinct(F.array_compact(F.transform("resolved_path", F.lower)))).alias("key")).join(
        keys, "key", "left_semi").distinct().withColumn("sure", F.lit(True))
    cand = raw.distinct().join(sure, ["key", "transmission_id"], "full").join(best, "transmission_id")
    hops = cand.select("key", "transmission_id", F.posexplode("path").alias("pos", "hop"), F.coalesce("sure", F.lit(False)).alias("sure"))
    pairs = hops.select("hop", F.col("key").alias("ctx")).distinct()
    ctx = keys.select(F.col("key").alias("ctx"), "key")
    got = R.resolve_hops(pairs, ctx, nodes, edges, now, with_node=False).select("hop", F.col("ctx").alias("key"), "pubkey")
    r = hops.join(got, ["hop", "key"])
    here = (F.col("pubkey") == F.col("key")) | (F.col("pubkey").isNull() & F.startswith("key", F.lower("hop")))
    t = r.groupBy("key", "transmission_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.coalesce("pubkey", "hop").alias("k")))).alias("s"),
        F.bool_or(F.col("sure") | F.coalesce(here, F.lit(False))).alias("ok")).filter("ok")
    sig = F.array_join(F.transform("s", lambda e: e["k"]), "→")
    info = tx.select(F.col("id").alias("transmission_id"), "hash", "first_seen")
    g = t.join(info, "transmission_id").groupBy(F.col("key").alias("public_key"), sig.alias("signature")).agg(
        F.count(F.lit(1)).alias("count"), F.max("first_seen").alias("last_seen"),
        F.max_by("hash", F.struct("first_seen", "transmission_id")).alias("sample_hash"))
    return top_per_group(g, ["public_key"], [F.col("count").desc(), F.col("last_seen").desc(), F.col("signature")], limit)


def relay_touch(nodes, obs, now, debounce_minutes: int = 5) -> DataFrame:
    """last_seen of nodes resolved as relays, raised to their newest hearing in 5-minute steps."""
    seen = grouped(obs.select(F.explode(F.array_distinct(F.array_compact("resolved_path"))).alias("public_key"), "timestamp"),
                   ["public_key"], ["public_key"], F.max("timestamp").alias("t"))
    due = F.col("last_seen").isNull() | (F.unix_seconds("t") - F.unix_seconds("last_seen") >= debounce_minutes * 60)
    return nodes.join(seen, "public_key", "left").withColumn(
        "last_seen", F.when(F.col("t").isNotNull() & due & (F.col("t") <= ts_lit(now)), F.col("t")).otherwise(F.col("last_seen"))).drop("t")


# ---- fleet -----------------------------------------------------------------------------

def node_battery(metrics: DataFrame, nodes: DataFrame, now, days: int = 7) -> DataFrame:
    """Latest battery reading and status of every node that reports telemetry under its key."""
    m = metrics.filter(F.col("battery_mv").isNotNull() & (F.col("timestamp") >= hours_before(now, 24 * days)))
    g = m.groupBy(F.lower("observer_id").alias("public_key")).agg(
        F.count(F.lit(1)).alias("samples"), F.max("timestamp").alias("latest_ts"),
        F.max_by("battery_mv", F.struct("timestamp", "battery_mv")).alias("latest_mv"))
    mv = F.col("latest_mv")
    return nodes.select(F.lower("public_key").alias("public_key")).join(g, "public_key", "left").select(
        "public_key", F.coalesce("samples", F.lit(0)).alias("samples"), "latest_ts", "latest_mv",
        F.when(mv.isNull(), "unknown").when(mv < CRITICAL_MV, "critical").when(mv < LOW_MV, "low").otherwise("ok").alias("status"))


def node_battery_series(metrics: DataFrame, key: str, now, days: int = 7) -> DataFrame:
    return metrics.filter((F.lower("observer_id") == key.lower()) & F.col("battery_mv").isNotNull()
                          & (F.col("timestamp") >= hours_before(now, 24 * days))).select("timestamp", "battery_mv").orderBy("timestamp")


def network_status(nodes: DataFrame, now) -> DataFrame:
    age = (F.unix_micros(ts_lit(now)) - F.unix_micros("last_seen")) / 3.6e9
    infra = F.coalesce(F.col("role").isin("repeater", "room"), F.lit(False))
    state = (F.when(age < F.when(infra, INFRA_HOURS[0]).otherwise(OTHER_HOURS[0]), "active")
             .when(age < F.when(infra, INFRA_HOURS[1]).otherwise(OTHER_HOURS[1]), "degraded").otherwise("silent"))
    return nodes.groupBy(F.coalesce("role", F.lit("unknown")).alias("role")).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(state == s).alias(s) for s in ("active", "degraded", "silent")])


def _role_counts(nodes: DataFrame) -> DataFrame:
    return nodes.agg(*[F.count_if(F.col("role") == r).alias(r + "s") for r in COUNTED_ROLES])


def role_counts(nodes: DataFrame, now) -> DataFrame:
    return _role_counts(nodes.filter(F.col("last_seen") > hours_before(now, 168)))


def role_counts_all(nodes: DataFrame) -> DataFrame:
    return _role_counts(nodes)


def stats(tx, obs, nodes, observers, now) -> DataFrame:
    n = tx.agg(F.count(F.lit(1))).scalar()
    who = nodes.agg(F.count_if(F.col("last_seen") > hours_before(now, 168)).alias("a"), F.count(F.lit(1)).alias("b"))
    return obs.agg(F.count(F.lit(1)).alias("total_observations"), F.count_if(F.col("timestamp") > hours_before(now, 1)).alias("packets_last_hour"),
                   F.count_if(F.col("timestamp") > hours_before(now, 24)).alias("packets_last_24h")).select(
        n.alias("total_transmissions"), "total_observations", who.select("a").scalar().alias("total_nodes"),
        who.select("b").scalar().alias("total_nodes_all_time"),
        observers.filter(~F.coalesce("inactive", F.lit(False))).agg(F.count(F.lit(1))).scalar().alias("total_observers"),
        "packets_last_hour", "packets_last_24h")


def role_analytics(nodes: DataFrame, skew: DataFrame) -> DataFrame:
    """Clock skew by role; ``skew`` is the table of clock.node_skew."""
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    j = nodes.select("public_key", F.when(role == "", "unknown").otherwise(role).alias("role")).join(
        skew.select("public_key", "recent_median_skew", "last_skew", "severity"), "public_key", "left")
    a = F.when(F.col("recent_median_skew") != 0, F.abs("recent_median_skew")).otherwise(F.abs("last_skew"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return j.withColumn("a", a).groupBy("role").agg(
        F.count(F.lit(1)).alias("node_count"), F.count("severity").alias("with_skew"), z(mean_tenths("a", 2)).alias("mean_abs_skew"),
        z(trunc_round(true_median("a"), 2)).alias("median_abs_skew"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("ok", "warning", "critical", "absurd", "no_clock")])


def enrich_nodes(nodes, hash_info, capability, liveness, usefulness) -> DataFrame:
    """Node list with prefix size, multi-byte and relay columns."""
    h = hash_info.select(F.col("pubkey").alias("public_key"), "hash_size", "inconsistent", "sizes_seen")
    c = capability.select("public_key", "status", "evidence", "max_hash_size")
    l = liveness.select("public_key", "last_relayed", "relay_count_1h", "relay_count_24h", "relay_active")
    u = usefulness.select("public_key", "usefulness")
    out = nodes
    for t in (h, c, l, u):
        out = out.join(t, "public_key", "left")
    return out


def node_rankings(health: DataFrame, coverage: DataFrame, limit: int = 10) -> DataFrame:
    """Top nodes by packets, mean signal, number of stations and recency."""
    obs = coverage.groupBy("public_key").agg(F.count(F.lit(1)).alias("stations"))
    h = health.join(obs, "public_key", "left")
    kinds = [("packets", F.col("total_transmissions").cast("double")), ("snr", F.col("avg_snr")), ("observers", F.col("stations").cast("double")),
             ("recent", F.unix_seconds("last_heard").cast("double"))]
    rows = h.select("public_key", F.explode(F.array(*[F.struct(F.lit(k).alias("ranking"), v.alias("value")) for k, v in kinds])).alias("e")).select(
        "public_key", "e.ranking", "e.value").filter(F.col("value").isNotNull())
    return top_per_group(rows, ["ranking"], [F.col("value").desc(), F.col("public_key")], limit)
