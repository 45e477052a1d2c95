"""Table schemas of the mesh data model."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


DECODED = _struct(
    type=_S, pubKey=_S, public_key=_S, destPubKey=_S, srcPubKey=_S, from_node=_S, name=_S,
    timestamp=_L, payload=_struct(timestamp=_L), lat=_D, lon=_D, channel=_S, channelHash=_S,
    channel_hash=_S, channelHashHex=_S, decryptionStatus=_S, text=_S, sender=_S, sender_timestamp=_L,
    srcHash=_S, destHash=_S, sender_key=_S, sender_name=_S, sender_short_name=_S, recipient_key=_S,
    recipient_name=_S, recipient_short_name=_S, peer_pubkey=_S,  # in messages pubkey, to Spark the same name as pubKey
)

TRANSMISSIONS = _struct(
    id=_L, raw_hex=_S, hash=_S, first_seen=_TS, route_type=_I, payload_type=_I, payload_version=_I,
    decoded=DECODED, from_pubkey=_S, channel_hash=_S,
)

OBSERVATIONS = _struct(
    id=_L, transmission_id=_L, observer_id=_S, direction=_S, snr=_D, rssi=_D, score=_I,
    path=T.ArrayType(_S), resolved_path=T.ArrayType(_S), timestamp=_TS, raw_hex=_S,
)

NODES = _struct(
    public_key=_S, name=_S, role=_S, lat=_D, lon=_D, last_seen=_TS, first_seen=_TS, advert_count=_I,
    battery_mv=_I, temperature_c=_D, foreign_advert=_B,
)

OBSERVERS = _struct(
    id=_S, name=_S, iata=_S, last_seen=_TS, first_seen=_TS, packet_count=_L, model=_S, firmware=_S,
    client_version=_S, radio=_S, battery_mv=_I, uptime_secs=_L, noise_floor=_D, inactive=_B,
    last_packet_at=_TS,
)

OBSERVER_METRICS = _struct(
    observer_id=_S, timestamp=_TS, noise_floor=_D, tx_air_secs=_L, rx_air_secs=_L, recv_errors=_L,
    battery_mv=_I, packets_sent=_L, packets_recv=_L, uptime_secs=_L, queue_len=_I,
)

DROPPED_PACKETS = _struct(
    hash=_S, raw_hex=_S, reason=_S, observer_id=_S, observer_name=_S, node_pubkey=_S, node_name=_S,
    dropped_at=_TS,
)

EDGES = _struct(
    node_a=_S, node_b=_S, count=_L, first_seen=_TS, last_seen=_TS, snr_sum=_D, snr_count=_L,
    observers=T.ArrayType(_S), observer_count=_L,
)

# one inbound broker message: topic plus JSON text
MESSAGE = _struct(topic=_S, value=_S, source=_S, ingest_time=_TS)
