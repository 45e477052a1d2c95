"""Decoding of raw packet frames held as hex text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshlake.functions import names

# fixed values of the frame format
MAX_PATH_BYTES, MAX_PAYLOAD_BYTES, ADVERT_MIN_BYTES, NAME_BYTES = 64, 184, 100, 32
FRAME_TYPES = {0: "REQ", 1: "RESPONSE", 2: "TXT_MSG", 3: "ACK", 4: "ADVERT", 5: "GRP_TXT", 6: "GRP_DATA", 7: "ANON_REQ",
               8: "PATH", 9: "TRACE", 10: "MULTIPART", 11: "CONTROL", 15: "RAW_CUSTOM"}
FRAME_FIELDS = {"route_type", "payload_type", "payload_version", "path_byte", "hash_size", "hash_count", "error", "path",
                "transport_code1", "transport_code2", "payload_hex", "_h"}
ROLES = {1: "companion", 2: "repeater", 3: "room", 4: "sensor"}


def hexpart(h: Column, byte: Column | int, count: Column | int) -> Column:
    b = F.lit(byte) if isinstance(byte, int) else byte
    n = F.lit(count) if isinstance(count, int) else count
    return F.substr(h, (b * 2 + 1).cast("int"), (n * 2).cast("int"))


def uint(h: Column) -> Column:
    """Big-endian unsigned value of up to 7 bytes of hex."""
    return F.conv(h, 16, 10).cast("bigint")


def little(h: Column, byte: Column | int, count: int) -> Column:
    """Little-endian unsigned value inside a hex string."""
    b = F.lit(byte) if isinstance(byte, int) else byte
    return uint(F.concat(*[hexpart(h, b + i, 1) for i in reversed(range(count))]))


def signed(v: Column, bits: int) -> Column:
    return F.when(v >= (1 << (bits - 1)), v - (1 << bits)).otherwise(v)


def clean_hex(raw: Column) -> Column:
    return F.regexp_replace(raw, "[ \\r\\n]", "")


def split_frame(df: DataFrame, raw: str = "raw_hex") -> DataFrame:
    """Adds header bits, path bytes, hops, payload hex and ``error`` (null for a sound frame)."""
    c = F.col
    kept = df.columns
    d = df.withColumn("_h", F.lower(clean_hex(c(raw))))
    valid = c("_h").rlike("^([0-9a-f]{2})*$")
    d = d.withColumn("_len", F.when(valid, F.floor(F.length("_h") / 2).cast("int")))
    d = d.withColumn("_hb", F.when(c("_len") >= 1, uint(hexpart(c("_h"), 0, 1)).cast("int")))
    d = d.withColumns({"route_type": c("_hb").bitwiseAND(3), "payload_type": F.shiftright("_hb", 2).bitwiseAND(15),
                       "payload_version": F.shiftright("_hb", 6).bitwiseAND(3)})
    transport = c("route_type").isin(0, 3)
    d = d.withColumn("_po", F.when(transport, 5).otherwise(1))
    d = d.withColumn("path_byte", F.when(c("_len") > c("_po"), uint(hexpart(c("_h"), c("_po"), 1)).cast("int")))
    d = d.withColumns({"hash_size": F.shiftright("path_byte", 6) + 1, "hash_count": c("path_byte").bitwiseAND(63)})
    d = d.withColumn("_pl", c("hash_size") * c("hash_count"))
    d = d.withColumn("_start", c("_po") + 1 + c("_pl"))
    bad_path = (c("hash_size") == 4) | (c("_pl") > MAX_PATH_BYTES)
    err = (F.when(~F.coalesce(valid, F.lit(False)), "invalid hex").when(c("_len") < 2, "packet too short")
           .when(transport & (c("_len") < 5), "packet too short for transport codes").when(c("path_byte").isNull(), "packet too short (no path byte)")
           .when(bad_path, "invalid path encoding").when(c("_start") > c("_len"), "path exceeds buffer")
           .when(c("_len") - c("_start") > MAX_PAYLOAD_BYTES, "payload too long"))
    d = d.withColumn("error", err)
    ok = c("error").isNull()
    n = F.coalesce("hash_count", F.lit(0))
    hops = F.when(ok & (n > 0), F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.upper(
        hexpart(c("_h"), c("_po") + 1 + i * c("hash_size"), c("hash_size"))))).when(ok, F.array().cast("array<string>"))
    code = lambda at: F.when(ok & transport, F.upper(hexpart(c("_h"), at, 2)))
    d = d.withColumns({"path": hops, "transport_code1": code(1), "transport_code2": code(3),
                       "payload_hex": F.when(ok, F.substr(c("_h"), (c("_start") * 2 + 1).cast("int"), F.lit(1 << 20)))}).drop(
        "_hb", "_po", "_pl", "_start", "_len")
    # one generated row per frame: later expressions read finished fields and do not repeat the parsing
    kept = [k for k in kept if k in d.columns and k not in FRAME_FIELDS]
    return d.select(*kept, F.inline(F.array(F.struct(*[k for k in d.columns if k not in kept]))))


def decode_frames(df: DataFrame, raw: str = "raw_hex") -> DataFrame:
    """Header, path and payload of each frame, with the path rules for traces and unrelayed direct packets.

    A trace carries its hops in the payload and quarter-dB readings in the header path.
    """
    d = split_frame(df, raw)
    c = F.col
    p = c("payload_hex")
    trace = (c("payload_type") == names.TRACE) & (F.length(p) > 18)
    size = F.pow(F.lit(2.0), uint(hexpart(p, 8, 1)).bitwiseAND(3)).cast("int")
    count = F.floor((F.length(p) - 18) / 2 / size).cast("int")
    thops = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.upper(hexpart(p, F.lit(9) + i * size, size)))).otherwise(
        F.array().cast("array<string>"))
    snr = F.transform(F.filter("path", lambda h: F.length(h) == 2), lambda h: signed(uint(h), 8) / 4.0)
    odd = trace & ~c("route_type").isin(2, 3)
    quiet = c("route_type").isin(2, 3) & (c("hash_count") == 0) & (c("payload_type") != names.TRACE)
    return d.withColumns({
        "snr_values": F.when(trace & (c("hash_count") > 0), snr), "hops_completed": F.when(trace, c("hash_count")),
        "anomaly": F.when(odd, "TRACE packet with non-DIRECT routing").when((c("payload_type") == names.TRACE) & (F.length(p) < 18), "TRACE payload decode failed"),
        "hash_size": F.when(trace, size).when(quiet, 0).otherwise(c("hash_size")),
        "hash_count": F.when(trace, count).otherwise(c("hash_count")), "path": F.when(trace, thops).otherwise(c("path"))}).drop("_h")


def content_hash(raw: Column) -> Column:
    """Route-independent packet identity: type bits, path byte of traces, payload."""
    h = F.lower(raw)
    n = F.length(h)
    route = uint(hexpart(h, 0, 1)).bitwiseAND(3)
    ptype = F.shiftright(uint(hexpart(h, 0, 1)).cast("int"), 2).bitwiseAND(15)
    at = F.when(route.isin(0, 3), 5).otherwise(1)
    pb = uint(hexpart(h, at, 1)).cast("int")
    start = at + 1 + (F.shiftright(pb, 6) + 1) * pb.bitwiseAND(63)
    body = F.concat(F.lpad(F.lower(F.hex(ptype)), 2, "0"), F.when(ptype == names.TRACE, F.concat(hexpart(h, at, 1), F.lit("00"))).otherwise(F.lit("")),
                    F.substr(h, (start * 2 + 1).cast("int"), F.lit(1 << 20)))
    sound = h.rlike("^([0-9a-f]{2}){2,}$") & (n > at * 2) & (start * 2 <= n)
    return F.when(F.coalesce(sound, F.lit(False)), F.substring(F.sha2(F.unhex(body), 256), 1, 16)).otherwise(F.substring(raw, 1, 16))


def sanitize_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[\x00-\x08\x0b-\x1f\x7f]", "")


def _stage(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a generated row, so that later stages reuse them instead of repeating them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def decode_adverts(frames: DataFrame) -> DataFrame:
    """Advert bodies: key, time, role, position, name, telemetry; ``error`` when too short."""
    p, c = F.col("payload_hex"), F.col
    a = frames.filter((c("payload_type") == names.ADVERT) & c("error").isNull()).drop("error")
    n = F.floor(F.length(p) / 2)
    a = _stage(a, _n=n, _ok=n >= ADVERT_MIN_BYTES, flags=F.when(n > ADVERT_MIN_BYTES, uint(hexpart(p, 100, 1)).cast("int")))
    bit = lambda b: F.coalesce(c("flags").bitwiseAND(b) != 0, F.lit(False))
    a = _stage(a, _pos=bit(16) & (c("_n") >= 109))
    a = _stage(a, _o1=F.when(c("_pos"), 109).otherwise(101))
    a = _stage(a, _f1=bit(32) & (c("_n") >= c("_o1") + 2))
    a = _stage(a, _o2=c("_o1") + F.when(c("_f1"), 2).otherwise(0))
    a = _stage(a, _f2=bit(64) & (c("_n") >= c("_o2") + 2))
    a = _stage(a, _rest=F.substr(p, ((c("_o2") + F.when(c("_f2"), 2).otherwise(0)) * 2 + 1).cast("int"), F.lit(1 << 20)))
    # the name ends at the first zero byte; zero bytes after it are skipped before telemetry
    a = _stage(a, _name=F.regexp_extract("_rest", "^((?:(?!00)[0-9a-f]{2})*)", 1))
    tail = F.regexp_replace(F.substr(c("_rest"), F.length("_name") + 1, F.lit(1 << 20)), "^(?:00)+", "")
    a = _stage(a, _tele=F.when(bit(128), tail).otherwise(c("_rest")))
    kind = c("flags").bitwiseAND(15)
    ok, has = c("_ok"), (kind == 4) & (F.length("_tele") >= 8)
    a = _stage(a, _mv=F.when(has, little(c("_tele"), 0, 2)), _temp=F.when(has, signed(little(c("_tele"), 2, 2), 16)))
    role = F.when(kind == 2, ROLES[2]).when(kind == 3, ROLES[3]).when(kind == 4, ROLES[4]).otherwise(ROLES[1])
    # bytes that are no UTF-8 are replaced by the decoder
    name = F.substring(sanitize_name(F.decode(F.unhex("_name"), "UTF-8")), 1, NAME_BYTES)
    out = {
        "pubKey": F.when(ok, hexpart(p, 0, 32)), "timestamp": F.when(ok, little(p, 32, 4)),
        "role": F.when(ok & c("flags").isNotNull(), role),
        "lat": F.when(ok & c("_pos"), signed(little(p, 101, 4), 32) / 1e6), "lon": F.when(ok & c("_pos"), signed(little(p, 105, 4), 32) / 1e6),
        "feat1": F.when(ok & c("_f1"), little(p, c("_o1"), 2)), "feat2": F.when(ok & c("_f2"), little(p, c("_o2"), 2)),
        "name": F.when(ok & bit(128), name), "battery_mv": F.when(c("_mv").between(1, 10000), c("_mv")),
        "temperature_c": F.when(c("_temp").between(-5000, 10000), c("_temp") / 100.0),
        "error": F.when(~ok, F.lit("too short for advert")),
    }
    return a.select(*frames.drop("error").columns, *[v.alias(k) for k, v in out.items()], "flags")


def decode_payload_fields(frames: DataFrame) -> DataFrame:
    """Type-specific payload fields; short payloads get ``payload_error``."""
    c = F.col
    p, t = c("payload_hex"), c("payload_type")
    n = F.length(p) / 2
    enc = t.isin(0, 1, 2, 8)
    need = F.when(enc | (t == 3), 4).when(t == names.ADVERT, 100).when(t == names.GRP_TXT, 3).when(t == 7, 35).when(t == names.TRACE, 9).otherwise(0)
    ok = n >= need
    w = lambda cond, v: F.when(cond & ok, v)
    ack = F.concat(*[hexpart(p, i, 1) for i in (3, 2, 1, 0)])
    return frames.withColumns({
        "type": F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in FRAME_TYPES.items() if k in (0, 1, 2, 3, 4, 5, 7, 8, 9) for x in (k, v)]), t), F.lit("UNKNOWN")),
        "payload_error": F.when(p.isNotNull() & ~ok, F.when(t == names.ADVERT, "too short for advert").otherwise("too short")),
        "destHash": w(enc | (t == 7), hexpart(p, 0, 1)), "srcHash": w(enc, hexpart(p, 1, 1)),
        "mac": w(enc, hexpart(p, 2, 2)), "ack": w(t == 3, ack), "channelHash": w(t == names.GRP_TXT, uint(hexpart(p, 0, 1))),
        "channelHashHex": w(t == names.GRP_TXT, F.upper(hexpart(p, 0, 1))), "ephemeralPubKey": w(t == 7, hexpart(p, 1, 32)),
        "tag": w(t == names.TRACE, little(p, 0, 4)), "authCode": w(t == names.TRACE, little(p, 4, 4)), "traceFlags": w(t == names.TRACE, uint(hexpart(p, 8, 1)))})
