"""Packet filter vocabulary as column predicates.

``Packet("snr") > 5`` builds a boolean column over the table made by :func:`fields`. A missing
field makes a comparison false, also under ``ne``; only ``none_of`` turns it around.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from meshlake.functions.time import parse_ts, ts_lit

from .packets import best_observation

# fixed values: firmware type names, display aliases, route names, duration units
TYPES = {0: "REQ", 1: "RESPONSE", 2: "TXT_MSG", 3: "ACK", 4: "ADVERT", 5: "GRP_TXT", 6: "GRP_DATA", 7: "ANON_REQ",
         8: "PATH", 9: "TRACE", 10: "MULTIPART", 11: "CONTROL", 15: "RAW_CUSTOM"}
TYPE_ALIASES = {
    "request": "REQ", "response": "RESPONSE", "direct msg": "TXT_MSG", "dm": "TXT_MSG", "ack": "ACK",
    "advert": "ADVERT", "channel msg": "GRP_TXT", "channel": "GRP_TXT", "group data": "GRP_DATA",
    "anon req": "ANON_REQ", "path": "PATH", "trace": "TRACE", "multipart": "MULTIPART", "control": "CONTROL",
    "raw": "RAW_CUSTOM", "custom": "RAW_CUSTOM",
}
ROUTES = {0: "TRANSPORT_FLOOD", 1: "FLOOD", 2: "DIRECT", 3: "TRANSPORT_DIRECT"}
ROUTE_ALIASES = {"t_flood": "TRANSPORT_FLOOD", "t_direct": "TRANSPORT_DIRECT"}
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}

NUMERIC = {"size", "snr", "rssi", "hops", "observations", "age", "payload_bytes"}


def fields(tx: DataFrame, obs: DataFrame, observers: DataFrame) -> DataFrame:
    """Packets with the columns the predicates read."""
    best = best_observation(obs, ("path", "snr", "rssi", "observer_id"))
    who = observers.select(F.col("id").alias("observer_id"), F.col("name").alias("observer_name"))
    return (tx.join(best, tx.id == best.transmission_id, "left").drop("transmission_id")
            .join(who, "observer_id", "left"))


def _named(code: Column, table: dict[int, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, code), F.lit(""))


def duration(text: str) -> float:
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([smhdw])", text)
    if not m:
        raise ValueError(f"not a duration: {text}")
    return float(m.group(1)) * SECONDS[m.group(2)]


class Packet:
    """A packet field, ready to be compared."""

    def __init__(self, name: str, now: datetime | str | None = None):
        self.name = name
        self.col = self._resolve(name, now)

    @staticmethod
    def _resolve(name: str, now) -> Column:
        text = lambda c: F.coalesce(F.col(c), F.lit(""))
        nbytes = F.when(F.coalesce(F.length("raw_hex"), F.lit(0)) > 0, F.length("raw_hex") / 2)
        simple = {
            "type": lambda: _named(F.col("payload_type"), TYPES),
            "route": lambda: _named(F.col("route_type"), ROUTES),
            "transport": lambda: F.coalesce(F.col("route_type").isin(0, 3), F.lit(False)),
            "hash": lambda: text("hash"),
            "raw": lambda: text("raw_hex"),
            "size": lambda: F.coalesce(nbytes, F.lit(0.0)),
            "snr": lambda: F.col("snr"),
            "rssi": lambda: F.col("rssi"),
            "hops": lambda: F.coalesce(F.size("path"), F.lit(0)),
            "observer": lambda: text("observer_name"),
            "observer_id": lambda: text("observer_id"),
            "observations": lambda: F.coalesce("observation_count", F.lit(0)),
            "time": lambda: F.col("first_seen"),
            "timestamp": lambda: F.col("first_seen"),
            "age": lambda: F.greatest(F.unix_seconds(ts_lit(now)) - F.unix_seconds("first_seen"), F.lit(0)),
            "path": lambda: F.coalesce(F.array_join("path", " → "), F.lit("")),
            "payload_bytes": lambda: F.greatest(F.coalesce(nbytes, F.lit(2.0)) - 2, F.lit(0.0)),
            "payload_hex": lambda: F.coalesce(F.substring("raw_hex", 5, 1 << 20), F.lit("")),
        }
        if name.startswith("payload."):
            return F.col("decoded." + name[8:])
        return simple[name]()

    @property
    def _is_number(self) -> bool:
        return self.name in NUMERIC

    def _number(self) -> Column:
        """Leading number of a text field, as lenient float parsing reads it."""
        if self._is_number:
            return self.col.cast("double")
        lead = F.regexp_extract(self.col.cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
        return F.expr("try_cast(NULL AS double)") if self.name in ("time",) else lead.try_cast("double")

    def _order(self, op: str, value) -> Column:
        if isinstance(value, str):
            value = duration(value) if re.fullmatch(r"\d+(?:\.\d+)?[smhdw]", value) else float(value)
        left, right = self._number(), F.lit(float(value))
        return _true({">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op])

    def __gt__(self, v):
        return self._order(">", v)

    def __ge__(self, v):
        return self._order(">=", v)

    def __lt__(self, v):
        return self._order("<", v)

    def __le__(self, v):
        return self._order("<=", v)

    def _equal(self, value) -> Column:
        if isinstance(value, str):
            low = value.lower()
            if self.name == "type":
                value = TYPE_ALIASES.get(low, value)
            elif self.name == "route":
                value = ROUTE_ALIASES.get(low, value)
            if self._is_number:
                try:
                    return self.col.cast("double") == float(value)
                except ValueError:
                    return F.when(self.col.isNotNull(), F.lit(False))
            return F.lower(self.col.cast("string")) == value.lower()
        if isinstance(value, bool):
            return self.col == F.lit(value)
        return self._number() == F.lit(float(value))

    def eq(self, value) -> Column:
        return _true(self._equal(value))

    def ne(self, value) -> Column:
        return _true(~self._equal(value))

    def contains(self, text: str) -> Column:
        return _true(F.contains(F.lower(self.col.cast("string")), F.lit(text.lower())))

    def starts_with(self, text: str) -> Column:
        return _true(F.startswith(F.lower(self.col.cast("string")), F.lit(text.lower())))

    def ends_with(self, text: str) -> Column:
        return _true(F.endswith(F.lower(self.col.cast("string")), F.lit(text.lower())))

    def _when(self) -> Column:
        return self.col if self.name in ("time", "timestamp") else parse_ts(self.col.cast("string"))

    def after(self, t: datetime | str) -> Column:
        return _true(self._when() > ts_lit(t))

    def before(self, t: datetime | str) -> Column:
        return _true(self._when() < ts_lit(t))

    def between(self, a, b) -> Column:
        if self._is_number:
            lo, hi = sorted((float(a), float(b)))
            return _true((self._number() >= lo) & (self._number() <= hi))
        x, y = ts_lit(a), ts_lit(b)
        return _true((self._when() >= F.least(x, y)) & (self._when() <= F.greatest(x, y)))

    def truthy(self) -> Column:
        if self.name == "transport":
            return _true(self.col)
        if self._is_number:
            return _true(self.col != 0)
        if self.name in ("time", "timestamp"):
            return self.col.isNotNull()
        return _true(~self.col.cast("string").isin("", "0", "false"))


def _true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def all_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def none_of(*conds: Column) -> Column:
    return ~any_of(*conds)
