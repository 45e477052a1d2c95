"""Radio signal queries."""

from meshlake.functions.time import TimeWindow
from meshlake.operators import rf

from . import mesh_sql as M
from .mesh_views import NOW, MeshTables
from .registry import ORACLE, query

REGION = "EUR, mid"
WEEK = TimeWindow.parse(window="7d", now=NOW)
WEEK_SINCE = M.NOW - 7 * 86400

# observations of the region's stations
_REG = (", reg AS (SELECT obs.* FROM obs JOIN observers ON observer_id = observers.id "
        "WHERE upper(trim(iata)) IN ('EUR', 'MID'))\n")


def _args(m: MeshTables):
    return m.tx, m.obs, m.observers


@query("rf_summary", M.sql("obs", """
SELECT count(o.snr)::BIGINT AS total_packets, count(*)::BIGINT AS total_all_packets, count(DISTINCT tx.hash)::BIGINT AS total_transmissions,
  (max(coalesce(o.timestamp, tx.first_seen)) - min(coalesce(o.timestamp, tx.first_seen))) / 3600 AS time_span_hours
FROM tx LEFT JOIN obs o ON o.transmission_id = tx.id"""))
def _(m):
    return rf.rf_summary(*_args(m))


@query("rf_summary_region_week", M.sql("obs observers", _REG + f"""
SELECT count(r.snr)::BIGINT AS total_packets, count(*)::BIGINT AS total_all_packets, count(DISTINCT tx.hash)::BIGINT AS total_transmissions,
  (max(r.timestamp) - min(r.timestamp)) / 3600 AS time_span_hours
FROM reg r JOIN tx ON r.transmission_id = tx.id WHERE r.timestamp >= {WEEK_SINCE}"""))
def _(m):
    return rf.rf_summary(*_args(m), region=REGION, window=WEEK)


def _stats_sql(col: str, src: str) -> str:
    return f"""
, v AS (SELECT {col} AS x FROM {src} WHERE {col} IS NOT NULL),
s AS (SELECT x, row_number() OVER (ORDER BY x) AS rn, count(*) OVER () AS n FROM v)
SELECT (SELECT count(*) FROM v)::BIGINT AS count, coalesce(min(x), 0) AS min, coalesce(max(x), 0) AS max,
  coalesce(round(avg(x), 6), 0) AS avg, coalesce((SELECT x FROM s WHERE rn = n // 2 + 1), 0) AS median,
  coalesce(round(stddev_pop(x), 6), 0) AS stddev FROM v"""


def _rounded(df, *cols):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("rf_snr_stats", M.sql("obs", _stats_sql("snr", "obs")))
def _(m):
    return _rounded(rf.rf_snr_stats(*_args(m)), "avg", "stddev")


@query("rf_rssi_stats", M.sql("obs observers", _REG + _stats_sql("rssi", "reg")))
def _(m):
    return _rounded(rf.rf_rssi_stats(*_args(m), region=REGION), "avg", "stddev")


def _hist_sql(col: str, src: str, bins: int) -> str:
    return f"""
, v AS (SELECT {col}::DOUBLE AS x FROM {src} WHERE {col} IS NOT NULL),
b AS (SELECT min(x) AS lo, (CASE WHEN max(x) = min(x) THEN 1 ELSE max(x) - min(x) END) / {bins}::DOUBLE AS w FROM v),
h AS (SELECT least(trunc((x - lo) / w)::BIGINT, {bins - 1}) AS bin, count(*) AS n FROM v, b GROUP BY 1)
SELECT g.bin::BIGINT AS bin, lo + g.bin * w AS x, w, coalesce(n, 0)::BIGINT AS count
FROM range({bins}) g(bin) CROSS JOIN b LEFT JOIN h ON h.bin = g.bin"""


@query("rf_histogram_snr", M.sql("obs", _hist_sql("snr", "obs", 20)))
def _(m):
    return rf.rf_histogram(*_args(m), measure="snr", bins=20)


@query("rf_histogram_rssi", M.sql("obs observers", _REG + _hist_sql("rssi", "reg", 20)))
def _(m):
    return rf.rf_histogram(*_args(m), region=REGION, measure="rssi", bins=20)


@query("rf_histogram_size", M.sql("tx", _hist_sql("length(raw_hex) // 2", "tx", 25)))
def _(m):
    return rf.rf_histogram(*_args(m), measure="size", bins=25)


@query("rf_packet_sizes", M.sql("tx", """
SELECT count(*)::BIGINT AS count, min(length(raw_hex) // 2)::BIGINT AS min, max(length(raw_hex) // 2)::BIGINT AS max,
  (sum(length(raw_hex) // 2) // count(*))::BIGINT AS avg FROM tx"""))
def _(m):
    return rf.rf_packet_sizes(*_args(m))


@query("rf_packets_per_hour", M.sql("obs", """
SELECT (h // 3600) * 3600 AS hour, count(DISTINCT hash)::BIGINT AS count
FROM (SELECT hash, coalesce(o.timestamp, tx.first_seen) AS h FROM tx LEFT JOIN obs o ON o.transmission_id = tx.id) GROUP BY 1"""))
def _(m):
    return rf.rf_packets_per_hour(*_args(m))


@query("rf_payload_types", M.sql("tx", f"""
SELECT payload_type AS type, {M.type_name('payload_type')} AS name, count(DISTINCT hash)::BIGINT AS count FROM tx GROUP BY 1, 2"""))
def _(m):
    return rf.rf_payload_types(*_args(m))


@query("rf_snr_by_type", M.sql("obs", f"""
SELECT {M.type_name('payload_type')} AS name, count(snr)::BIGINT AS count, round(avg(snr), 6) AS avg, min(snr) AS min, max(snr) AS max
FROM obs JOIN tx ON transmission_id = tx.id WHERE snr IS NOT NULL AND first_seen >= {WEEK_SINCE} GROUP BY 1"""))
def _(m):
    return _rounded(rf.rf_snr_by_type(*_args(m), window=WEEK), "avg")


@query("rf_snr_by_type_all", ORACLE["rf_snr_by_type"].replace(f" AND first_seen >= {WEEK_SINCE}", ""))
def _(m):
    return _rounded(rf.rf_snr_by_type(*_args(m)), "avg")


@query("rf_signal_over_time", M.sql("obs", """
SELECT (timestamp // 3600) * 3600 AS hour, count(snr)::BIGINT AS count, round(avg(snr), 6) AS avg_snr
FROM obs WHERE snr IS NOT NULL GROUP BY 1"""))
def _(m):
    return _rounded(rf.rf_signal_over_time(*_args(m)), "avg_snr")


@query("rf_scatter", M.sql("obs", """
, p AS (SELECT id, timestamp, snr, rssi, row_number() OVER (ORDER BY timestamp, id % 64, id) - 1 AS i, count(*) OVER () AS n
  FROM obs WHERE snr IS NOT NULL AND rssi IS NOT NULL)
SELECT id, timestamp, snr, rssi FROM p WHERE i % greatest(n // 500, 1) = 0"""))
def _(m):
    return rf.rf_scatter(*_args(m))
