"""Type and route names, and other fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: display names of payload types; the others print as UNK(n)
PAYLOAD_NAMES = {
    0: "REQ", 1: "RESPONSE", 2: "TXT_MSG", 3: "ACK", 4: "ADVERT",
    5: "GRP_TXT", 7: "ANON_REQ", 8: "PATH", 9: "TRACE", 11: "CONTROL",
}

# fixed values: route types
ROUTE_NAMES = {0: "TRANSPORT_FLOOD", 1: "FLOOD", 2: "DIRECT", 3: "TRANSPORT_DIRECT"}

ADVERT, GRP_TXT, PATH, TRACE = 4, 5, 8, 9


def _lookup(code: Column, names: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.try_element_at(table, code)


def payload_name(code: Column) -> Column:
    return F.coalesce(_lookup(code, PAYLOAD_NAMES),
                      F.when(code.isNotNull(), F.concat(F.lit("UNK("), code.cast("string"), F.lit(")"))),
                      F.lit("UNK"))


def route_name(code: Column) -> Column:
    return F.coalesce(_lookup(code, ROUTE_NAMES), F.lit("UNKNOWN"))


def is_relay(role: Column) -> Column:
    """Roles that can forward packets and so appear as a hop."""
    r = F.lower(F.coalesce(role, F.lit("")))
    return r.contains("repeater") | r.contains("room_server") | (r == "room")


def advert_key(decoded: str = "decoded") -> Column:
    return F.coalesce(F.col(f"{decoded}.pubKey"), F.col(f"{decoded}.public_key"))


def is_hex(text: Column) -> Column:
    return F.lower(text).rlike("^[0-9a-f]+$")
