"""From broker messages to packet, node and station tables. All steps work on batches and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from meshlake.functions import geo, names
from meshlake.functions.ranks import top_per_group
from meshlake.functions.time import parse_ts, snap, ts_lit

from . import frames
from .channels import sender_from_text

MAX_NAME = 64
# fixed values: units that stations write behind numbers
UNITS = r"(?i)\s*(dbm|db|mw|km|mi|m)\s*$"


# ---- messages --------------------------------------------------------------------------

def field(*keys: str) -> Column:
    """First of several JSON spellings that is present, as text."""
    return F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in keys])


def route_messages(messages: DataFrame) -> DataFrame:
    """Adds region, observer and ``kind`` (status, packet, channel, direct); others are dropped.

    Topics read ``root/region/observer/what``; bridge messages ``root/message/channel|direct/id``.
    """
    t = F.split("topic", "/")
    part = lambda i: F.get(t, F.lit(i))
    bridge = part(1) == "message"
    raw = F.get_json_object("value", "$.raw")
    kind = (F.when(F.coalesce(part(2), F.lit("")).isin("status", "connection") & (F.size(t) == 3), None)
            .when(bridge & (part(2) == "channel"), "channel").when(bridge & (part(2) == "direct"), "direct")
            .when(part(3) == "status", "status").when(part(3) == "connection", None).when(raw != "", "packet"))
    out = messages.withColumns({"kind": kind, "region": F.when(~bridge, part(1)), "observer_id": F.when(~bridge, part(2)), "subject": F.when(bridge, part(3))})
    return out.filter(F.col("kind").isNotNull())


def ingest_filters(routed: DataFrame, blacklist: DataFrame | None = None, allowed_regions: list[str] | None = None,
                   source_regions: dict[str, list[str]] | None = None) -> DataFrame:
    """Observer blacklist and region allow-list for everything; per-source regions for packets only."""
    out = routed
    if blacklist is not None:
        out = out.join(blacklist.select(F.lower("observer_id").alias("_b")), F.lower("observer_id") == F.col("_b"), "left_anti")
    region = F.upper(F.trim("region"))
    if allowed_regions:
        ok = F.col("region").isNull() | region.isin(*[r.strip().upper() for r in allowed_regions])
        out = out.filter(ok)
    for src, regions in (source_regions or {}).items():
        ok = region.isin(*[r.strip().upper() for r in regions])
        out = out.filter((F.col("source") != src) | (F.col("kind") != "packet") | F.coalesce(ok, F.lit(False)))
    return out


def number(text: Column) -> Column:
    """Number from a number or from text with a unit suffix."""
    return F.trim(F.regexp_replace(F.trim(text), UNITS, "")).try_cast("double")


def coerce_numeric(packets: DataFrame) -> DataFrame:
    return packets.withColumns({"snr": number(field("SNR", "snr")), "rssi": number(field("RSSI", "rssi")),
                                "score": number(field("score", "Score")).cast("int"),
                                "direction": field("direction", "Direction")})


def rx_time(stamp: Column, ingest_time: Column) -> Column:
    """Receive time of the envelope; missing, unreadable and future values become the ingest time."""
    return F.least(F.coalesce(parse_ts(stamp), ingest_time), ingest_time)


def resolve_rx_time(messages: DataFrame) -> DataFrame:
    return messages.withColumn("rx_time", rx_time(F.get_json_object("value", "$.timestamp"), F.col("ingest_time")))


def observer_meta(status: DataFrame) -> DataFrame:
    """Station metadata and telemetry, from ``stats.*`` or the top level; later spellings win."""
    tele = lambda k: F.coalesce(number(F.get_json_object("value", f"$.stats.{k}")), number(F.get_json_object("value", f"$.{k}")))
    whole = lambda k, t: F.round(tele(k)).cast(t)
    return status.select(
        "observer_id", "region", "ingest_time", *(["seq"] if "seq" in status.columns else []), field("origin").alias("name"), field("model").alias("model"),
        field("firmware_version", "firmware").alias("firmware"), field("clientVersion", "client_version").alias("client_version"), field("radio").alias("radio"),
        whole("battery_mv", "int").alias("battery_mv"), whole("uptime_secs", "bigint").alias("uptime_secs"), tele("noise_floor").alias("noise_floor"),
        *[whole(k, "bigint").alias(k) for k in ("tx_air_secs", "rx_air_secs", "recv_errors", "packets_sent", "packets_recv")],
        whole("queue_len", "int").alias("queue_len"))


def packet_messages(messages: DataFrame) -> DataFrame:
    """Raw packets with signal, receive time and content hash."""
    p = resolve_rx_time(coerce_numeric(route_messages(messages).filter(F.col("kind") == "packet")))
    raw = F.get_json_object("value", "$.raw")
    return p.withColumn("raw_hex", raw).withColumn("hash", frames.content_hash(frames.clean_hex(F.col("raw_hex"))))


# ---- packet tables ---------------------------------------------------------------------

def dedup_transmissions(packets: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per hash with its first receive time; ``is_new`` tells new packets from repeats."""
    t = packets.groupBy("hash").agg(F.min("rx_time").alias("first_seen"), F.min_by("raw_hex", F.struct("rx_time", "raw_hex")).alias("raw_hex"), F.count(F.lit(1)).alias("copies"))
    if existing is None:
        return t.withColumn("is_new", F.lit(True))
    old = existing.select("hash", F.col("first_seen").alias("_old"))
    return t.join(old, "hash", "left").withColumns({"is_new": F.col("_old").isNull(), "first_seen": F.least("first_seen", F.coalesce("_old", "first_seen"))}).drop("_old")


def merge_observations(obs: DataFrame, seq: str = "id") -> DataFrame:
    """One row per (packet, station, path): newest non-null signal, score and frame win."""
    key = F.coalesce(F.array_join("path", ","), F.lit(""))
    newest = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c)
    return obs.groupBy("transmission_id", "observer_id", key.alias("path_key")).agg(
        F.min(seq).alias("id"), F.min("timestamp").alias("timestamp"), *[newest(c) for c in ("snr", "rssi", "score", "raw_hex")], F.count(F.lit(1)).alias("copies"))


def advert_rows(tx: DataFrame) -> DataFrame:
    d = F.col("decoded")
    return tx.filter((F.col("payload_type") == names.ADVERT) & (names.advert_key() != "")).select(
        names.advert_key().alias("public_key"), d["name"].alias("name"), d["lat"].alias("lat"), d["lon"].alias("lon"), F.col("first_seen").alias("rx"), "id")


NODE_FIELDS = {"name": "string", "role": "string", "lat": "double", "lon": "double", "battery_mv": "int", "temperature_c": "double", "foreign_advert": "boolean"}


def upsert_nodes(nodes: DataFrame, adverts: DataFrame, now: datetime | str) -> DataFrame:
    """Node table after adverts: newest non-null fields, last_seen never moves back or into the future.

    Fields that a table lacks (role and telemetry of undecoded adverts) count as null there.
    """
    lacking = lambda df: df.withColumns({c: F.lit(None).cast(t) for c, t in NODE_FIELDS.items() if c not in df.columns})
    nodes, adverts = lacking(nodes), lacking(adverts)
    order = F.struct("rx", "id")
    newest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias("n_" + c)
    a = adverts.groupBy("public_key").agg(*[newest(c) for c in NODE_FIELDS], F.max("rx").alias("rx"), F.min("rx").alias("rx0"), F.count_distinct("id").alias("n"))
    j = nodes.join(a, "public_key", "full")
    keep = lambda c: F.coalesce("n_" + c, c).alias(c)
    return j.select("public_key", *[keep(c) for c in NODE_FIELDS],
                    F.greatest(F.least("last_seen", ts_lit(now)), F.coalesce("rx", "last_seen")).alias("last_seen"), F.coalesce("first_seen", "rx0").alias("first_seen"),
                    (F.coalesce("advert_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("int").alias("advert_count"))


def node_key_rotation(nodes: DataFrame) -> DataFrame:
    """Adds ``superseded``: another key of the same non-empty name is newer.

    The newest key per name is found by aggregation, so a name that many keys share is not sorted.
    """
    order = F.struct("last_seen", "public_key")
    top = nodes.filter(F.col("name") != "").groupBy("name").agg(F.max_by("public_key", order).alias("_top"))
    return nodes.join(top, "name", "left").withColumn("superseded", F.col("_top").isNotNull() & (F.col("_top") != F.col("public_key"))).drop("_top")


def upsert_observers(observers: DataFrame, meta: DataFrame) -> DataFrame:
    """Station table after status messages: newest non-null metadata, counted messages, active again."""
    order = F.struct("ingest_time", *(["seq"] if "seq" in meta.columns else []))
    cols = ["name", "model", "firmware", "client_version", "radio", "battery_mv", "uptime_secs", "noise_floor"]
    g = meta.groupBy(F.col("observer_id").alias("id")).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias("n_" + c) for c in cols], F.max_by("region", order).alias("n_iata"),
        F.max("ingest_time").alias("seen"), F.min("ingest_time").alias("seen0"), F.count(F.lit(1)).alias("n"))
    j = observers.join(g, "id", "full")
    return j.select("id", *[F.coalesce("n_" + c, c).alias(c) for c in cols], F.coalesce("n_iata", "iata").alias("iata"),
                    F.greatest("last_seen", F.coalesce("seen", "last_seen")).alias("last_seen"), F.coalesce("first_seen", "seen0").alias("first_seen"),
                    (F.coalesce("packet_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("packet_count"),
                    F.when(F.col("n").isNotNull(), F.lit(False)).otherwise(F.coalesce("inactive", F.lit(False))).alias("inactive"))


def metrics_snap(metrics: DataFrame, seconds: int = 300) -> DataFrame:
    """Samples moved to the nearest bucket; the last write of a bucket wins."""
    b = F.timestamp_seconds(snap(F.unix_seconds("timestamp"), seconds))
    cols = [c for c in metrics.columns if c not in ("observer_id", "timestamp")]
    order = F.struct("timestamp", *(["seq"] if "seq" in cols else []))
    g = metrics.groupBy("observer_id", b.alias("bucket")).agg(F.max_by(F.struct(*cols), order).alias("l"))
    return g.select("observer_id", F.col("bucket").alias("timestamp"), *[F.col("l")[c].alias(c) for c in cols])


# ---- validation ------------------------------------------------------------------------

def advert_problem(key: Column, lat: Column, lon: Column, name: Column) -> Column:
    """Why an advert is refused, or null."""
    bad = lambda v, lim: v.isNotNull() & (F.isnan(v) | (F.abs(v) > lim))
    return (F.when(key.isNull() | (F.length(key) < 16), "pubkey too short").when(key.rlike("^0+$"), "pubkey is all zeros")
            .when(bad(lat, 90.0), "invalid lat").when(bad(lon, 180.0), "invalid lon")
            .when(name.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "name contains control characters")
            .when(F.octet_length(name) > MAX_NAME, "name too long"))


def validate_adverts(adverts: DataFrame) -> DataFrame:
    """Adds ``reason``; an explicit ``signature_valid`` of false also refuses."""
    out = adverts.withColumn("reason", advert_problem(F.col("public_key"), F.col("lat"), F.col("lon"), F.col("name")))
    if "signature_valid" in adverts.columns:
        out = out.withColumn("reason", F.coalesce("reason", F.when(~F.col("signature_valid"), "invalid signature")))
    return out


def quarantine(dropped: DataFrame, observer: str | None = None, node: str | None = None, limit: int = 100) -> DataFrame:
    """Refused packets, newest first."""
    out = dropped
    if observer:
        out = out.filter(F.col("observer_id") == observer)
    if node:
        out = out.filter(F.col("node_pubkey") == node)
    return out.orderBy(F.col("dropped_at").desc(), "hash").limit(limit)


def geo_filter(df: DataFrame, polygon=None, buffer_km: float = 0.0, box=None) -> DataFrame:
    return df.filter(geo.in_area(F.col("lat"), F.col("lon"), polygon, buffer_km, box))


def mark_foreign(df: DataFrame, polygon=None, buffer_km: float = 0.0, box=None) -> DataFrame:
    return df.withColumn("foreign_advert", ~geo.in_area(F.col("lat"), F.col("lon"), polygon, buffer_km, box))


def prune_outside_geo(nodes: DataFrame, polygon=None, buffer_km: float = 0.0, box=None) -> DataFrame:
    """Nodes to remove: positioned outside the area."""
    return nodes.filter(~geo.in_area(F.col("lat"), F.col("lon"), polygon, buffer_km, box))


# ---- migrations ------------------------------------------------------------------------

def rehash_backfill(tx: DataFrame, obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recomputed hashes; of packets that now coincide the smallest id stays and takes the observations."""
    h = tx.withColumn("hash", frames.content_hash(F.col("raw_hex")))
    to = h.groupBy("hash").agg(F.min("id").alias("keep"), F.min("first_seen").alias("first"))
    moves = h.select("id", "hash").join(to, "hash").select(F.col("id").alias("transmission_id"), "keep")
    kept = h.join(to, (h.hash == to.hash) & (h.id == to.keep), "left_semi").join(to.select("hash", "first"), "hash").withColumn("first_seen", F.col("first")).drop("first")
    moved = obs.join(moves, "transmission_id", "left").withColumn("transmission_id", F.coalesce("keep", "transmission_id")).drop("keep")
    return kept, moved


def from_pubkey_backfill(tx: DataFrame) -> DataFrame:
    return tx.withColumn("from_pubkey", F.coalesce("from_pubkey", F.when(F.col("payload_type") == names.ADVERT, names.advert_key())))


def split_packets_table(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old flat table (one row per hearing) into packet and observation rows."""
    tx = packets.groupBy("hash").agg(F.min("id").alias("id"), F.min("timestamp").alias("first_seen"),
                                     F.min_by("raw_hex", F.struct("timestamp", "id")).alias("raw_hex"), F.min_by("payload_type", F.struct("timestamp", "id")).alias("payload_type"))
    obs = packets.join(tx.select("hash", F.col("id").alias("transmission_id")), "hash")
    return tx, merge_observations(obs)


def channel_group_key(tx: DataFrame) -> Column:
    """Channel name of a readable group packet, ``enc_<HEX>`` of an unreadable one."""
    d = F.col("decoded")
    return F.when(F.col("payload_type") == names.GRP_TXT, F.when((d["type"] == "CHAN") & (d["channel"] != ""), d["channel"]).when(
        (d["type"] == "GRP_TXT") & (d["channelHashHex"] != ""), F.concat(F.lit("enc_"), d["channelHashHex"])))


def bridge_messages(messages: DataFrame) -> DataFrame:
    """Channel and direct messages of a bridge: group key, sender and text."""
    b = route_messages(messages).filter(F.col("kind").isin("channel", "direct"))
    text = F.get_json_object("value", "$.text")
    return b.select("kind", F.when(F.col("kind") == "channel", F.concat(F.lit("ch"), F.col("subject"))).alias("channel_hash"), "subject",
                    sender_from_text(text).alias("sender"), text.alias("text"), "ingest_time", *(["seq"] if "seq" in messages.columns else []))
