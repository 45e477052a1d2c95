"""Group channels: activity, messages, senders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshlake.functions import names
from meshlake.functions.time import TimeWindow, hour_of, in_window

from .packets import best_observation, beyond, tx_in_region

HASHTAG = r"(#[A-Za-z0-9_\-]+)"


def garbage(text: Column) -> Column:
    """More than two control or replacement characters."""
    bad = F.regexp_count(text, F.lit(r"[\x00-\x08\x0b-\x1f\x{FFFD}]"))
    return F.coalesce((text != "") & (bad > 2), F.lit(False))


def _group_packets(tx, obs, observers, region=None, window: TimeWindow | None = None) -> DataFrame:
    g = tx.filter((F.col("payload_type") == names.GRP_TXT) & in_window(window, F.col("first_seen")))
    return tx_in_region(g, obs, observers, region)


def _decoded(tx, obs, observers, region=None) -> DataFrame:
    d = F.col("decoded")
    g = _group_packets(tx, obs, observers, region).filter(d["type"] == "CHAN")
    return g.select("id", "hash", "first_seen", F.coalesce(d["channel"], F.lit("")).alias("channel"),
                    F.coalesce(d["text"], F.lit("")).alias("text"), F.coalesce(d["sender"], F.lit("")).alias("sender"),
                    d["sender_timestamp"].alias("sender_timestamp"))


def _named(c: Column) -> Column:
    return F.when(c != "", c).otherwise(F.lit("unknown"))


def after_sender(text: Column, limit: int | None = None) -> tuple[Column, Column]:
    """Sender and message of ``"Name: message"``; sender is null without a separator.

    Offsets are in bytes in the data, but a separator that exists is the same separator.
    """
    at = F.locate(": ", text) - 1
    ok = at > 0
    if limit is not None:
        ok = ok & (F.octet_length(F.substr(text, F.lit(1), at)) < limit)
    return (F.when(ok, F.substr(text, F.lit(1), at)),
            F.when(ok, F.substr(text, at + 3, F.length(text))).otherwise(text))


def sender_from_text(text: Column) -> Column:
    return after_sender(text, 50)[0]


def channels(tx, obs, observers, region=None) -> DataFrame:
    """Decoded channels with their count and last message."""
    m = _decoded(tx, obs, observers, region).filter(~garbage(F.col("channel")) & ~garbage(F.col("text")))
    order = F.struct("first_seen", "id")
    msg = after_sender(F.col("text"))[1]
    has = F.col("text") != ""
    signed = has & (F.col("sender") != "")
    return m.groupBy(_named(F.col("channel")).alias("name")).agg(
        F.count(F.lit(1)).alias("message_count"), F.max("first_seen").alias("last_activity"),
        F.max_by(F.when(has, msg), F.when(has, order)).alias("last_message"),
        F.max_by(F.when(signed, F.col("sender")), F.when(signed, order)).alias("last_sender"))


def discovered_channels(tx, obs, observers, region=None) -> DataFrame:
    """Hashtags mentioned in messages that are no known channel yet."""
    m = _decoded(tx, obs, observers, region)
    clean = m.filter(~garbage(F.col("text")))
    tags = clean.filter(F.col("text") != "").select("first_seen", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(HASHTAG), F.lit(1)))).alias("name"))
    seen = tags.groupBy("name").agg(F.max("first_seen").alias("last_activity"))
    known = clean.filter(~garbage(F.col("channel"))).select(_named(F.col("channel")).alias("_k")).distinct()
    spelled = known.union(known.select(F.concat(F.lit("#"), F.col("_k")))).distinct()
    return seen.join(spelled, seen.name == spelled["_k"], "left_anti")


def encrypted_channels(tx, obs, observers, region=None) -> DataFrame:
    d = F.col("decoded")
    g = _group_packets(tx, obs, observers, region).filter((d["type"] == "GRP_TXT") & (d["decryptionStatus"] == "no_key"))
    num = d["channelHash"].try_cast("int")
    h = F.coalesce(F.when(d["channelHashHex"] != "", d["channelHashHex"]), F.when(num.isNotNull(), F.lpad(F.hex(num), 2, "0")), F.lit("?"))
    return g.groupBy(h.alias("_h")).agg(F.count(F.lit(1)).alias("message_count"), F.max("first_seen").alias("last_activity")).select(
        F.concat(F.lit("enc_"), F.col("_h")).alias("hash"), F.concat(F.lit("Encrypted (0x"), F.col("_h"), F.lit(")")).alias("name"),
        "message_count", "last_activity")


def channel_messages(tx, obs, observers, channel: str, limit: int = 100, offset: int = 0, region=None,
                     after=None) -> DataFrame:
    """Messages of a channel, one per (sender, packet), a page counted from the newest end or from a cursor (time, id) on.

    ``stations`` names all stations that heard any packet of the message.
    """
    m = _decoded(tx, obs, observers, region).filter(_named(F.col("channel")) == channel)
    from_text, body = after_sender(F.col("text"), 50)
    m = m.withColumn("_who", F.when(F.col("sender") != "", F.col("sender")).otherwise(F.coalesce(from_text, F.lit("")))).withColumns(
        {"shown": F.coalesce(from_text, F.col("_who")), "body": body})
    # the page is cut first; stations and signal are looked up for its rows only
    one = m.groupBy("_who", "hash").agg(F.min(F.struct("first_seen", "id", "shown", "body", "sender_timestamp")).alias("f"),
                                        F.count(F.lit(1)).alias("repeats"))
    pg = one.select("_who", "f.*", "hash", "repeats").filter(beyond(after, "desc")).orderBy(F.col("first_seen").desc(), F.col("id").desc()).offset(offset).limit(limit)
    best = best_observation(obs.join(pg.select(F.col("id").alias("transmission_id")), "transmission_id", "left_semi"), ("path", "snr", "observer_id"))
    who = observers.select(F.col("id").alias("observer_id"), F.col("name").alias("_n"))
    label = F.coalesce(F.when(F.col("_n") != "", F.col("_n")), F.col("observer_id"))
    packets = m.select("_who", "hash", F.col("id").alias("transmission_id")).join(pg.select("_who", "hash"), ["_who", "hash"], "left_semi")
    heard = obs.select("transmission_id", "observer_id").join(packets, "transmission_id").select("_who", "hash", "observer_id").distinct()
    stations = heard.join(who, "observer_id", "left").groupBy("_who", "hash").agg(F.array_sort(F.collect_set(label)).alias("stations"))
    return (pg.join(stations, ["_who", "hash"], "left").join(best, pg.id == best.transmission_id, "left").join(who, "observer_id", "left")
            .select("id", "hash", F.col("shown").alias("sender"), F.col("body").alias("text"), F.col("first_seen").alias("timestamp"),
                    "sender_timestamp", "repeats", label.alias("observer"), F.coalesce("stations", F.array().cast("array<string>")).alias("stations"),
                    F.coalesce(F.size("path"), F.lit(0)).alias("hops"), "snr"))


# ---- analytics by address byte ---------------------------------------------------------

def name_byte(name: Column) -> Column:
    """Decimal address byte a channel name hashes to; names are hashed with a leading '#'."""
    full = F.when(F.startswith(name, F.lit("#")), name).otherwise(F.concat(F.lit("#"), name))
    inner = F.unhex(F.substring(F.sha2(full, 256), 1, 32))
    return F.conv(F.substring(F.sha2(inner, 256), 1, 2), 16, 10)


def placeholder(name: Column) -> Column:
    return name.rlike("^ch[+-]?[0-9]+$")


def channel_rows(tx, obs, observers, region=None, window: TimeWindow | None = None) -> DataFrame:
    """Group packets with their address byte, checked name and whether they are readable."""
    d = F.col("decoded")
    g = _group_packets(tx, obs, observers, region, window)
    text = lambda f: F.coalesce(d[f], F.lit(""))
    h = F.coalesce(F.when(text("channelHash") != "", text("channelHash")), F.when(text("channel_hash") != "", text("channel_hash")), F.lit("?"))
    g = g.select("id", "hash", "first_seen", h.alias("ch"), text("channel").alias("c"), text("text").alias("text"), text("sender").alias("sender"))
    hold = F.concat(F.lit("ch"), F.col("ch"))
    # every distinct (name, byte) pair would do, but hashing a short name is cheaper than a join
    wrong = (F.col("c") != "") & (F.col("c") != hold) & ~F.coalesce(name_byte(F.col("c")) == F.col("ch").try_cast("bigint").cast("string"), F.lit(False))
    return g.select("id", "hash", "first_seen", "ch", F.when((F.col("c") == "") | wrong, hold).otherwise(F.col("c")).alias("name"),
                    (wrong | ((F.col("text") == "") & (F.col("sender") == ""))).alias("encrypted"), "text", "sender")


def channel_analytics(rows: DataFrame) -> DataFrame:
    """Per address byte: best name, messages, senders, last activity, encrypted unless something was readable."""
    order = F.struct("first_seen", "id")
    real = ~placeholder(F.col("name"))
    return rows.groupBy("ch").agg(
        F.coalesce(F.min_by(F.when(real, F.col("name")), F.when(real, order)), F.min_by("name", order)).alias("name"),
        F.count(F.lit(1)).alias("messages"), F.count_distinct(F.when(F.col("sender") != "", F.col("sender"))).alias("senders"),
        F.max("first_seen").alias("last_activity"), F.bool_and("encrypted").alias("encrypted")).withColumnRenamed("ch", "hash")


def channel_top_senders(rows: DataFrame, limit: int = 15) -> DataFrame:
    return rows.filter(F.col("sender") != "").groupBy("sender").agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.col("count").desc(), "sender").limit(limit)


def channel_timeline(rows: DataFrame) -> DataFrame:
    return rows.groupBy(hour_of(F.col("first_seen")).alias("hour"), F.col("name").alias("channel")).agg(F.count(F.lit(1)).alias("count"))


def channel_msg_lengths(rows: DataFrame) -> DataFrame:
    """Byte length of every message."""
    return rows.filter(F.col("text") != "").select("id", F.octet_length("text").alias("length"))
