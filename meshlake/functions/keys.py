"""Keys in half their length while rows move: full keys are hex text, which shuffle files do not shorten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_LOWER, _TEXT, _UPPER = b"\x00", b"\x01", b"\x02"


def packed(key: Column) -> Column:
    """Hex in one case as its bytes, any other text as it is, told apart by the first byte; different texts stay different."""
    b = F.unhex(key)
    return (F.when(F.lower(F.hex(b)) == key, F.concat(F.lit(_LOWER), b)).when(F.hex(b) == key, F.concat(F.lit(_UPPER), b))
            .otherwise(F.concat(F.lit(_TEXT), F.encode(key, "utf-8"))))


def unpacked(key: Column) -> Column:
    """The text that :func:`packed` was given."""
    rest = F.substr(key, F.lit(2))
    kind = F.substr(key, F.lit(1), F.lit(1))
    return F.when(kind == F.lit(_LOWER), F.lower(F.hex(rest))).when(kind == F.lit(_UPPER), F.hex(rest)).otherwise(F.decode(rest, "utf-8"))


def grouped(rows: DataFrame, by: list[str], keys: list[str], *aggs: Column) -> DataFrame:
    """``rows.groupBy(*by).agg(*aggs)`` where the columns ``keys`` of ``by`` move packed."""
    p = rows.withColumns({k: packed(F.col(k)) for k in keys})
    g = p.groupBy(*by).agg(*aggs) if aggs else p.select(*by).distinct()
    return g.withColumns({k: unpacked(F.col(k)) for k in keys})
