"""Node, station, telemetry and clock queries."""

from pyspark.sql import functions as F

from meshlake.operators import clock as K, hashes as H, nodes as N, observers as O

from . import mesh_sql as M
from .mesh_views import NOW, MeshTables
from .q_packets import OBS_A, OBS_B
from .q_topology import edges
from .registry import ORACLE, query

T = M.NOW
LATER = "2024-01-10T00:00:00Z"
L0 = 1704844800

_NR = """, links AS (SELECT DISTINCT public_key, id FROM (SELECT d_pubkey AS public_key, id FROM tx UNION ALL SELECT d_dest, id FROM tx UNION ALL SELECT d_src, id FROM tx
    UNION ALL SELECT unnest(resolved_path), transmission_id FROM obs) WHERE public_key IS NOT NULL),
oc AS (SELECT transmission_id AS t, count(*) AS oc FROM obs GROUP BY 1),
nr AS (SELECT l.public_key, tx.id, hash, first_seen, payload_type, path, snr, rssi, b.observer_id, coalesce(oc, 0) AS oc, d_sender_key, d_sender_name, d_recipient_key, d_recipient_name
  FROM links l JOIN tx ON tx.id = l.id LEFT JOIN best b ON b.transmission_id = tx.id LEFT JOIN oc ON t = tx.id)
"""
_WK = _NR + f", nw AS (SELECT * FROM nr WHERE first_seen > {T} - 7 * 86400)\n"
tr = lambda x, d: f"(trunc(({x}) * {10 ** d} + 0.5e0)::DOUBLE / {10 ** d})"


def _r(df, **digits):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _ints(df, *cols):
    return df.withColumns({c: F.coalesce(F.unix_seconds(c) if dict(df.dtypes)[c] == "timestamp" else F.col(c), F.lit(-1)) for c in cols})


@query("bulk_health", M.sql("best nodes", _NR + f"""
, top AS (SELECT * FROM nodes ORDER BY last_seen DESC, public_key LIMIT 50)
SELECT t.public_key, t.name, t.role, count(nr.id)::BIGINT AS total_transmissions, CASE WHEN count(nr.id) > 0 THEN greatest(sum(oc), 1) ELSE 0 END::BIGINT AS total_observations,
  count(*) FILTER (nr.first_seen > {T} // 86400 * 86400)::BIGINT AS packets_today, round(avg(snr), 6) AS avg_snr, coalesce(max(nr.first_seen), -1) AS last_heard
FROM top t LEFT JOIN nr ON nr.public_key = t.public_key GROUP BY 1, 2, 3"""))
def _(m):
    return _ints(_r(N.bulk_health(m.tx, m.obs, m.nodes, m.observers, NOW, 50), avg_snr=6), "last_heard")


@query("node_health", M.sql("best", _NR + f"""
SELECT public_key, count(*)::BIGINT AS total_transmissions, sum(oc)::BIGINT AS total_observations, count(*) FILTER (first_seen > {T} // 86400 * 86400)::BIGINT AS packets_today,
  round(avg(snr), 6) AS avg_snr, coalesce(floor(avg(len(path)) FILTER (len(path) > 0) + 0.5e0), 0)::INTEGER AS avg_hops, max(first_seen) AS last_heard FROM nr GROUP BY 1"""))
def _(m):
    return _r(N.node_health(m.tx, m.obs, NOW, best=m.best), avg_snr=6)


@query("node_recent_packets", M.sql("best", _NR + """
SELECT public_key, id, hash, first_seen, payload_type, snr, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY public_key ORDER BY first_seen DESC, id DESC) AS rank FROM nr) WHERE rank <= 20"""))
def _(m):
    return N.node_recent_packets(m.tx, m.obs)


@query("node_activity_timeline", M.sql("best", _WK + "SELECT public_key, first_seen // 3600 * 3600 AS hour, count(*)::BIGINT AS count FROM nw GROUP BY 1, 2"))
def _(m):
    return N.node_activity_timeline(m.tx, m.obs, NOW)


@query("node_snr_trend", M.sql("best", _WK + "SELECT public_key, id, first_seen, snr, rssi, observer_id FROM nw WHERE snr IS NOT NULL"))
def _(m):
    return N.node_snr_trend(m.tx, m.obs, NOW)


@query("node_type_breakdown", M.sql("best", _WK + "SELECT public_key, payload_type, count(*)::BIGINT AS count FROM nw GROUP BY 1, 2"))
def _(m):
    return N.node_type_breakdown(m.tx, m.obs, NOW)


@query("node_observer_coverage", M.sql("best observers", _WK + """
SELECT public_key, observer_id, count(*)::BIGINT AS packet_count, round(avg(snr), 6) AS avg_snr, round(avg(rssi), 6) AS avg_rssi, min(first_seen) AS first_seen, max(first_seen) AS last_seen, any_value(o.name) AS observer_name
FROM nw LEFT JOIN observers o ON o.id = observer_id WHERE observer_id <> '' GROUP BY 1, 2"""))
def _(m):
    return _r(N.node_observer_coverage(m.tx, m.obs, m.observers, NOW, 7), avg_snr=6, avg_rssi=6)


@query("node_hop_distribution", M.sql("best", _WK + """
SELECT public_key, CASE WHEN coalesce(len(path), 0) >= 4 THEN '4+' ELSE coalesce(len(path), 0)::VARCHAR END AS hops, count(*)::BIGINT AS count FROM nw GROUP BY 1, 2"""))
def _(m):
    return N.node_hop_distribution(m.tx, m.obs, NOW)


_PEER = _WK + """, pe AS (SELECT public_key, k AS peer_key, count(*)::BIGINT AS message_count, max(first_seen) AS last_contact, arg_min(n, (first_seen, id)) AS n FROM (
  SELECT public_key, id, first_seen, d_sender_key AS k, d_sender_name AS n FROM nw UNION ALL SELECT public_key, id, first_seen, d_recipient_key, d_recipient_name FROM nw)
  WHERE k <> '' AND k <> public_key GROUP BY 1, 2)
"""


@query("node_peers", M.sql("best", _PEER + """
SELECT public_key, peer_key, peer_name, message_count, last_contact, rank::INTEGER AS rank FROM (SELECT *, coalesce(nullif(n, ''), substr(peer_key, 1, 12)) AS peer_name,
  row_number() OVER (PARTITION BY public_key ORDER BY message_count DESC, peer_key) AS rank FROM pe) WHERE rank <= 20"""))
def _(m):
    return N.node_peers(m.tx, m.obs, NOW)


@query("node_uptime_heatmap", M.sql("best", _WK + """
SELECT public_key, ((first_seen // 86400 + 4) % 7)::INTEGER AS day_of_week, (first_seen // 3600 % 24)::INTEGER AS hour, count(*)::BIGINT AS count FROM nw GROUP BY 1, 2, 3"""))
def _(m):
    return N.node_uptime_heatmap(m.tx, m.obs, NOW)


@query("node_computed_stats", M.sql("best", _PEER + f"""
, hr AS (SELECT public_key, h, lag(h) OVER (PARTITION BY public_key ORDER BY h) AS p FROM (SELECT DISTINCT public_key, first_seen // 3600 * 3600 AS h FROM nw)),
si AS (SELECT public_key, count(*) AS hours, max((h - p) * 1000) AS g, arg_min(p, (-(h - p), p)) AS s FROM hr GROUP BY 1),
ag AS (SELECT public_key, count(*)::BIGINT AS n, coalesce(avg(snr), 0) AS me, coalesce(stddev_pop(snr), 0) AS dv, count(*) FILTER (len(path) > 0) AS wp, count(*) FILTER (len(path) > 1) AS re, count(DISTINCT observer_id)::BIGINT AS uo FROM nw GROUP BY 1),
pc AS (SELECT public_key, count(*)::BIGINT AS up FROM pe GROUP BY 1)
SELECT a.public_key, least({tr('hours * 100e0 / 168e0', 1)}, 100) AS availability_pct, coalesce(g, 0)::BIGINT AS longest_silence_ms, coalesce(CASE WHEN g > 0 THEN s END, -1) AS longest_silence_start,
  CASE WHEN me > 15 AND dv < 2 THEN 'A' WHEN me > 15 THEN 'A-' WHEN me > 12 AND dv < 3 THEN 'B+' WHEN me > 8 THEN 'B' WHEN me > 3 THEN 'C' ELSE 'D' END AS signal_grade,
  {tr('me', 1)} AS snr_mean, {tr('dv', 1)} AS snr_stddev, CASE WHEN wp > 0 THEN {tr('re * 100e0 / wp', 1)} ELSE 0 END AS relay_pct, n AS total_packets, uo AS unique_observers, coalesce(up, 0) AS unique_peers, {tr('n / 7e0', 1)} AS avg_packets_per_day
FROM ag a JOIN si ON si.public_key = a.public_key LEFT JOIN pc ON pc.public_key = a.public_key"""))
def _(m):
    return _ints(N.node_computed_stats(m.tx, m.obs, NOW, best=m.best), "longest_silence_start")


_RP = """, rp AS (SELECT DISTINCT hop, id, first_seen FROM (SELECT lower(unnest(path)) AS hop, transmission_id AS t FROM obs UNION ALL SELECT unnest(resolved_path), transmission_id FROM obs) JOIN tx ON tx.id = t WHERE hop <> '' AND payload_type <> 4)"""


@query("repeater_liveness", M.sql("obs prefixes", _RP + f"""
, hit AS (SELECT DISTINCT public_key, id, first_seen FROM (SELECT public_key, rp.id, rp.first_seen FROM relays JOIN rp ON hop = public_key UNION ALL SELECT public_key, rp.id, rp.first_seen FROM relays JOIN rp ON hop = substr(public_key, 1, 2)))
SELECT r.public_key, coalesce(max(h.first_seen), -1) AS last_relayed, count(*) FILTER (h.first_seen > {T} - 3600)::BIGINT AS relay_count_1h, count(*) FILTER (h.first_seen > {T} - 86400)::BIGINT AS relay_count_24h, coalesce(max(h.first_seen) > {T} - 86400, false) AS relay_active
FROM relays r LEFT JOIN hit h ON h.public_key = r.public_key GROUP BY 1"""))
def _(m):
    return _ints(N.repeater_liveness(m.tx, m.obs, m.nodes, NOW), "last_relayed")


@query("repeater_usefulness", M.sql("obs prefixes", """
, k AS (SELECT hop, count(DISTINCT tx.id) AS n FROM (SELECT unnest(resolved_path) AS hop, transmission_id AS t FROM obs) JOIN tx ON tx.id = t WHERE payload_type <> 4 AND hop IS NOT NULL GROUP BY 1)
SELECT public_key, coalesce(n, 0)::BIGINT AS relayed, least(coalesce(n, 0) * 1e0 / (SELECT count(*) FROM tx WHERE payload_type <> 4), 1) AS usefulness FROM relays LEFT JOIN k ON hop = public_key"""))
def _(m):
    return N.repeater_usefulness(m.tx, m.obs, m.nodes)


@query("node_paths", M.sql("best edges", f""", cand0 AS (SELECT r.public_key AS key, b.transmission_id AS t, false AS sure FROM (SELECT transmission_id, unnest(path) AS h FROM best) b JOIN relays r ON lower(h) = substr(r.public_key, 1, length(h)) AND length(h) IN (2, 4, 6, 8)
  UNION ALL SELECT k, t, true FROM (SELECT unnest(resolved_path) AS k, transmission_id AS t FROM obs) JOIN relays ON public_key = k),
cand AS (SELECT key, t, bool_or(sure) AS sure FROM cand0 GROUP BY 1, 2),
hp AS (SELECT key, t, sure, i, path[i] AS hop FROM (SELECT key, t, sure, path, unnest(range(1, len(path) + 1)) AS i FROM cand JOIN best ON transmission_id = t)),
pr AS (SELECT hop, key AS ctx FROM hp), cx AS (SELECT public_key AS ctx, public_key AS key FROM relays),
{M.resolve_cte('pr', 'cx')},
sg AS (SELECT h.key, h.t, string_agg(coalesce(pubkey, h.hop), '→' ORDER BY i) AS signature, bool_or(sure OR coalesce(pubkey = h.key OR (pubkey IS NULL AND starts_with(h.key, lower(h.hop))), false)) AS ok FROM hp h JOIN res r ON r.hop = h.hop AND r.ctx = h.key GROUP BY 1, 2),
g AS (SELECT key AS public_key, signature, count(*)::BIGINT AS count, max(first_seen) AS last_seen, arg_max(hash, (first_seen, t)) AS sample_hash FROM sg JOIN tx ON tx.id = t WHERE ok GROUP BY 1, 2)
SELECT public_key, signature, count, last_seen, sample_hash, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY public_key ORDER BY count DESC, last_seen DESC, signature) AS rank FROM g) WHERE rank <= 50"""))
def _(m):
    from meshlake.operators import resolve as R
    return N.node_paths(m.tx, m.obs, m.nodes, edges(m), NOW, R.relays(m.nodes).select(F.col("key").alias("public_key")))


@query("relay_touch", M.sql("nodes obs", f"""
, s AS (SELECT k, max(timestamp) AS t FROM (SELECT unnest(resolved_path) AS k, timestamp FROM obs) WHERE k IS NOT NULL GROUP BY 1)
SELECT public_key, CASE WHEN t IS NOT NULL AND t - last_seen >= 300 AND t <= {T} THEN t ELSE last_seen END AS last_seen FROM nodes LEFT JOIN s ON k = public_key"""))
def _(m):
    return N.relay_touch(m.nodes, m.obs, NOW).select("public_key", "last_seen")


@query("node_battery", M.sql("nodes metrics", f"""
, g AS (SELECT lower(observer_id) AS k, count(*) AS n, max(timestamp) AS ts, arg_max(battery_mv, (timestamp, battery_mv)) AS mv FROM metrics WHERE battery_mv IS NOT NULL AND timestamp >= {T} - 7 * 86400 GROUP BY 1)
SELECT public_key, coalesce(n, 0)::BIGINT AS samples, coalesce(ts, -1) AS latest_ts, coalesce(mv, -1)::INTEGER AS latest_mv, CASE WHEN mv IS NULL THEN 'unknown' WHEN mv < 3000 THEN 'critical' WHEN mv < 3300 THEN 'low' ELSE 'ok' END AS status FROM nodes LEFT JOIN g ON k = public_key"""))
def _(m):
    return _ints(N.node_battery(m.metrics, m.nodes, NOW), "latest_ts", "latest_mv")


@query("network_status", M.sql("nodes", f"""
, a AS (SELECT role, ({T} - last_seen) / 3600e0 AS age, role IN ('repeater', 'room') AS infra FROM nodes)
SELECT role, count(*)::BIGINT AS total, count(*) FILTER (age < CASE WHEN infra THEN 24 ELSE 1 END)::BIGINT AS active,
  count(*) FILTER (age >= CASE WHEN infra THEN 24 ELSE 1 END AND age < CASE WHEN infra THEN 72 ELSE 24 END)::BIGINT AS degraded, count(*) FILTER (age >= CASE WHEN infra THEN 72 ELSE 24 END)::BIGINT AS silent FROM a GROUP BY 1"""))
def _(m):
    return N.network_status(m.nodes, NOW)


_ROLES = ", ".join(f"count(*) FILTER (role = '{r}')::BIGINT AS {r}s" for r in N.COUNTED_ROLES)


@query("role_counts", M.sql("nodes", f"SELECT {_ROLES} FROM nodes WHERE last_seen > {T} - 7 * 86400"))
def _(m):
    return N.role_counts(m.nodes, NOW)


@query("role_counts_all", M.sql("nodes", f"SELECT {_ROLES} FROM nodes"))
def _(m):
    return N.role_counts_all(m.nodes)


@query("stats", M.sql("nodes obs observers", f"""
SELECT (SELECT count(*) FROM tx)::BIGINT AS total_transmissions, count(*)::BIGINT AS total_observations, (SELECT count(*) FROM nodes WHERE last_seen > {T} - 604800)::BIGINT AS total_nodes, (SELECT count(*) FROM nodes)::BIGINT AS total_nodes_all_time,
  (SELECT count(*) FROM observers WHERE NOT inactive)::BIGINT AS total_observers, count(*) FILTER (timestamp > {T} - 3600)::BIGINT AS packets_last_hour, count(*) FILTER (timestamp > {T} - 86400)::BIGINT AS packets_last_24h FROM obs"""))
def _(m):
    return N.stats(m.tx, m.obs, m.nodes, m.observers, NOW)


@query("enrich_nodes", f"""
WITH h AS ({ORACLE["node_hash_size_info"]}), c AS ({ORACLE["multibyte_capability"]}), l AS ({ORACLE["repeater_liveness"]}), u AS ({ORACLE["repeater_usefulness"]}),
n AS ({M.sql("nodes", "SELECT * FROM nodes")})
SELECT n.*, h.hash_size, h.inconsistent, h.sizes_seen, c.status, c.evidence, c.max_hash_size, l.last_relayed, l.relay_count_1h, l.relay_count_24h, l.relay_active, u.usefulness
FROM n LEFT JOIN h ON h.pubkey = n.public_key LEFT JOIN c ON c.public_key = n.public_key LEFT JOIN l ON l.public_key = n.public_key LEFT JOIN u ON u.public_key = n.public_key""")
def _(m):
    parts = (H.node_hash_size_info(m.tx, NOW), H.multibyte_capability(m.tx, m.obs, m.observers, m.nodes, NOW),
             _ints(N.repeater_liveness(m.tx, m.obs, m.nodes, NOW), "last_relayed"), N.repeater_usefulness(m.tx, m.obs, m.nodes))
    return N.enrich_nodes(m.nodes, *parts).drop("temperature_c", "foreign_advert")  # columns that no given table fills


@query("node_rankings", M.sql("best nodes", _NR + f"""
, h AS (SELECT n.public_key, count(nr.id) AS p, avg(snr) AS s, count(DISTINCT observer_id) AS o, max(nr.first_seen) AS l FROM nodes n LEFT JOIN nr ON nr.public_key = n.public_key GROUP BY 1),
v AS (SELECT public_key, 'packets' AS ranking, p::DOUBLE AS value FROM h UNION ALL SELECT public_key, 'snr', round(s, 9) FROM h UNION ALL SELECT public_key, 'observers', CASE WHEN o > 0 THEN o END FROM h UNION ALL SELECT public_key, 'recent', l FROM h)
SELECT public_key, ranking, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ranking ORDER BY value DESC, public_key) AS rank FROM v WHERE value IS NOT NULL) WHERE rank <= 10"""))
def _(m):
    everyone = m.nodes.join(N.bulk_health(m.tx, m.obs, m.nodes, m.observers, NOW, limit=None).drop("name", "role"), "public_key")
    return N.node_rankings(everyone.withColumn("avg_snr", F.round("avg_snr", 9)), N.node_observer_coverage(m.tx, m.obs, m.observers))


# ---- stations ----

@query("observers", M.sql("nodes obs observers", f"""
, n AS (SELECT observer_id, count(*) AS c FROM obs WHERE timestamp > {T} - 3600 GROUP BY 1)
SELECT o.id, o.name, o.iata, o.packet_count, coalesce(c, 0)::BIGINT AS packets_last_hour, lat, lon, role AS node_role FROM observers o LEFT JOIN n ON n.observer_id = o.id LEFT JOIN nodes ON public_key = lower(o.id) WHERE NOT inactive"""))
def _(m):
    return O.observers_list(m.obs, m.observers, m.nodes, NOW).select("id", "name", "iata", "packet_count", "packets_last_hour", "lat", "lon", "node_role")


@query("observer_counts", M.sql("observers", f"""
SELECT count(*)::BIGINT AS total, count(*) FILTER (last_seen >= {T} - 600)::BIGINT AS online, count(*) FILTER (last_seen < {T} - 600 AND last_seen >= {T} - 3600)::BIGINT AS stale, count(*) FILTER (last_seen < {T} - 3600)::BIGINT AS offline FROM observers WHERE NOT inactive"""))
def _(m):
    return O.observer_counts(m.observers, NOW)


_OW = f", ow AS (SELECT *, timestamp // 14400 * 14400 AS bucket FROM obs WHERE timestamp >= {T} - 7 * 86400)\n"


@query("observer_timeline", M.sql("obs", _OW + "SELECT observer_id, bucket, count(*)::BIGINT AS count FROM ow GROUP BY 1, 2"))
def _(m):
    return O.observer_timeline(m.obs, NOW)


@query("observer_packet_types", M.sql("obs", _OW + "SELECT observer_id, payload_type, count(*)::BIGINT AS count FROM ow JOIN tx ON tx.id = transmission_id GROUP BY 1, 2"))
def _(m):
    return O.observer_packet_types(m.tx, m.obs, NOW)


@query("observer_nodes_timeline", M.sql("obs", _OW + """
SELECT observer_id, bucket, count(DISTINCT i)::BIGINT AS count FROM (SELECT observer_id, bucket, unnest(list_concat([d_pubkey, d_srchash, d_desthash], path)) AS i FROM ow JOIN tx ON tx.id = transmission_id) WHERE i <> '' GROUP BY 1, 2"""))
def _(m):
    return O.observer_nodes_timeline(m.tx, m.obs, NOW)


@query("observer_snr_distribution", M.sql("obs", _OW + """
, s AS (SELECT observer_id, snr, trunc(snr)::INTEGER AS w, (trunc(trunc(snr) / 2) * 2)::INTEGER AS b FROM ow WHERE snr IS NOT NULL),
l AS (SELECT observer_id, CASE WHEN snr < 0 AND w <> b THEN b - 2 ELSE b END AS low FROM s)
SELECT observer_id, low, count(*)::BIGINT AS count, low || ' to ' || (low + 2) AS range FROM l GROUP BY 1, 2"""))
def _(m):
    return O.observer_snr_distribution(m.obs, NOW)


@query("observer_rssi_timeline", M.sql("obs", _OW + f"SELECT observer_id, bucket, {M.half_away('avg(rssi)', 1)} AS avg FROM ow WHERE rssi IS NOT NULL GROUP BY 1, 2"))
def _(m):
    return O.observer_rssi_timeline(m.obs, NOW)


@query("observer_recent", M.sql("obs", _OW + """
SELECT r.observer_id, r.id, transmission_id, timestamp, snr, rssi, array_to_string(path, ',') AS path, rank::INTEGER AS rank, hash, payload_type, route_type
FROM (SELECT *, row_number() OVER (PARTITION BY observer_id ORDER BY timestamp DESC, id DESC) AS rank FROM ow) r JOIN tx ON tx.id = transmission_id WHERE rank <= 20"""))
def _(m):
    return O.observer_recent(m.tx, m.obs, NOW)


_COLS = "observer_id, noise_floor, tx_air_secs, rx_air_secs, recv_errors, coalesce(battery_mv, -1) AS battery_mv, packets_sent, packets_recv, uptime_secs, queue_len, seq"
_DAILY = """, dm AS (SELECT * FROM (SELECT *, timestamp // 86400 * 86400 AS day, row_number() OVER (PARTITION BY observer_id, timestamp // 86400 ORDER BY timestamp DESC, seq DESC) AS rn FROM metrics) WHERE rn = 1)
"""


@query("observer_metrics", M.sql("metrics", _DAILY + f"SELECT {_COLS}, day AS timestamp FROM dm"))
def _(m):
    return _ints(O.observer_metrics(m.metrics, resolution="1d"), "battery_mv")


def _delta_sql(src: str, time: str, order: str, secs: int) -> str:
    f = lambda c: f"coalesce({c} < lag({c}) OVER w, false)"
    return f""", dl AS (SELECT *, {time} - lag({time}) OVER w AS gap, {' OR '.join(f(c) for c in O.COUNTERS)} AS fell,
  tx_air_secs - lag(tx_air_secs) OVER w AS dtx, rx_air_secs - lag(rx_air_secs) OVER w AS drx, recv_errors - lag(recv_errors) OVER w AS de, packets_recv - lag(packets_recv) OVER w AS dr FROM {src} WINDOW w AS (PARTITION BY observer_id ORDER BY {order})),
dk AS (SELECT *, coalesce(gap > 0 AND gap <= {2 * secs}, false) AS usable FROM dl)
SELECT observer_id, {time} AS timestamp, seq, noise_floor, coalesce(battery_mv, -1) AS battery_mv, uptime_secs, queue_len,
  CASE WHEN usable AND NOT fell THEN {M.half_away('greatest(0e0, least(100e0, dtx / gap * 100e0))', 2)} END AS tx_airtime_pct,
  CASE WHEN usable AND NOT fell THEN {M.half_away('greatest(0e0, least(100e0, drx / gap * 100e0))', 2)} END AS rx_airtime_pct,
  CASE WHEN usable AND NOT fell AND de + dr > 0 THEN {M.half_away('(de / (de + dr) * 100e0)', 2)} END AS recv_error_rate, usable AND fell AS is_reboot FROM dk"""


@query("metrics_deltas", M.sql("metrics", _delta_sql("metrics", "timestamp", "timestamp, seq", 43200)))
def _(m):
    return _ints(O.metrics_deltas(m.metrics, 43200), "battery_mv")


@query("metrics_deltas_daily", M.sql("metrics", _DAILY + _delta_sql("dm", "day", "day", 86400)))
def _(m):
    return _ints(O.metrics_deltas(O.observer_metrics(m.metrics, resolution="1d"), 86400), "battery_mv")


@query("metrics_summary", M.sql("metrics observers", f"""
, w AS (SELECT * FROM metrics WHERE timestamp >= {L0})
SELECT observer_id, any_value(o.name) AS observer_name, coalesce(any_value(o.iata), '') AS iata, arg_max(w.noise_floor, (timestamp, seq)) AS current_noise_floor, round(avg(w.noise_floor), 6) AS avg_noise_floor, max(w.noise_floor) AS max_noise_floor,
  coalesce(max(bm), -1)::INTEGER AS battery_mv, count(*)::BIGINT AS sample_count
FROM w LEFT JOIN observers o ON o.id = observer_id LEFT JOIN (SELECT observer_id AS k, battery_mv AS bm FROM (SELECT *, row_number() OVER (PARTITION BY observer_id ORDER BY timestamp DESC, seq DESC) AS r FROM w) WHERE r = 1) ON k = observer_id GROUP BY 1"""))
def _(m):
    return _ints(_r(O.metrics_summary(m.metrics, m.observers, LATER), avg_noise_floor=6), "battery_mv")


@query("metrics_summary_all", ORACLE["metrics_summary"].replace(f" WHERE timestamp >= {L0}", ""))
def _(m):
    return _ints(_r(O.metrics_summary(m.metrics, m.observers, None), avg_noise_floor=6), "battery_mv")


@query("metrics_sparkline", M.sql("metrics", f"""
SELECT observer_id, timestamp // 3600 * 3600 AS hour, string_agg(noise_floor::VARCHAR, ',' ORDER BY timestamp, noise_floor) AS noise_floor FROM metrics WHERE timestamp >= {L0} GROUP BY 1, 2"""))
def _(m):
    return O.metrics_sparkline(m.metrics, LATER).withColumn("noise_floor", F.array_join(F.col("noise_floor").cast("array<string>"), ","))


@query("metrics_sparkline_all", ORACLE["metrics_sparkline"].replace(f" WHERE timestamp >= {L0}", ""))
def _(m):
    return O.metrics_sparkline(m.metrics, None).withColumn("noise_floor", F.array_join(F.col("noise_floor").cast("array<string>"), ","))


_CMP = f""", p AS (SELECT hash, bool_or(observer_id = '{OBS_A}') AS a, bool_or(observer_id = '{OBS_B}') AS b FROM obs JOIN tx ON tx.id = transmission_id WHERE observer_id IN ('{OBS_A}', '{OBS_B}') {{w}} GROUP BY 1)
"""


@query("observer_compare", M.sql("obs", _CMP.format(w="AND route_type IN (0, 1)") + f"""
, c AS (SELECT count(*) FILTER (a AND NOT b)::BIGINT AS only_a, count(*) FILTER (b AND NOT a)::BIGINT AS only_b, count(*) FILTER (a AND b)::BIGINT AS shared FROM p)
SELECT only_a + shared AS total_a, only_b + shared AS total_b, shared, only_a, only_b, {M.half_away('shared * 100e0 / (only_b + shared)', 1)} AS a_sees_of_b, {M.half_away('shared * 100e0 / (only_a + shared)', 1)} AS b_sees_of_a FROM c"""))
def _(m):
    return O.observer_compare(m.tx, m.obs, OBS_A, OBS_B, "flood")


@query("compare_packet_sets", M.sql("obs", _CMP.format(w="") + "SELECT hash, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' ELSE 'only_b' END AS side FROM p"))
def _(m):
    return O.compare_packet_sets(m.tx, m.obs, OBS_A, OBS_B)


@query("source_liveness", f"""
WITH g AS (SELECT 'broker' || (user_id % 3) AS source, max(floor(epoch(ts))::BIGINT + 5) AS l, count(*)::BIGINT AS messages FROM events GROUP BY 1)
SELECT source, l AS last_message, messages, CASE WHEN {T} - l >= 7200 THEN 'stalled' ELSE 'ok' END AS state FROM g""")
def _(m):
    return O.source_liveness(m.messages, NOW, 7200)


@query("distinct_regions", M.sql("observers", "SELECT DISTINCT upper(trim(iata)) AS iata FROM observers WHERE iata <> ''"))
def _(m):
    return O.distinct_regions(m.observers)


# ---- clocks ----

_SK = """, sm AS (SELECT transmission_id, observer_id, obs.id AS obs_id, timestamp AS observed_ts, hash, d_pubkey AS public_key, d_timestamp AS advert_ts FROM obs JOIN tx ON tx.id = transmission_id WHERE payload_type = 4 AND d_timestamp BETWEEN 1577836800 AND 4102444800),
md AS (SELECT hash, median(observed_ts) AS m FROM sm GROUP BY 1 HAVING count(*) >= 2),
cal AS (SELECT observer_id, median(observed_ts - m) AS off, count(*)::BIGINT AS samples FROM sm JOIN md USING (hash) GROUP BY 1),
co AS (SELECT s.*, (advert_ts - observed_ts)::DOUBLE AS raw, advert_ts - observed_ts + coalesce(off, 0) AS corrected, off IS NOT NULL AS calibrated, off FROM sm s LEFT JOIN cal USING (observer_id))
"""
_SEV = lambda x: f"CASE WHEN abs({x}) >= 31536000 THEN 'no_clock' WHEN abs({x}) >= 2592000 THEN 'absurd' WHEN abs({x}) >= 3600 THEN 'critical' WHEN abs({x}) >= 300 THEN 'warning' ELSE 'ok' END"
_HS = _SK + f""", hs AS (SELECT hash, public_key, advert_ts, {tr('avg(corrected)', 1)} AS mean_skew, {tr('median(corrected)', 1)} AS median_skew, {tr('arg_min(corrected, (observed_ts, -obs_id))', 1)} AS last_skew,
  {_SEV('median(corrected)')} AS severity, count(*)::BIGINT AS samples, bool_or(calibrated) AS calibrated, max(observed_ts) AS last_observed_ts FROM co GROUP BY 1, 2, 3)
"""
_NS = _HS + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY public_key ORDER BY last_observed_ts DESC, hash DESC) AS r, max(last_observed_ts) OVER (PARTITION BY public_key) AS mx FROM hs),
rc AS (SELECT public_key, count(*)::BIGINT AS n, count(*) FILTER (abs(median_skew) <= 3600)::BIGINT AS good, median(median_skew) AS m, median(median_skew) FILTER (abs(median_skew) <= 3600) AS gm FROM rk WHERE r <= 5 AND mx - last_observed_ts <= 3600 GROUP BY 1),
al AS (SELECT public_key, trunc(sum(round(median_skew * 10)::BIGINT) / count(*) + 0.5e0)::DOUBLE / 10 AS mean_skew, {tr('median(median_skew)', 1)} AS median_skew, max(last_skew) FILTER (r = 1) AS last_skew, sum(samples)::BIGINT AS sample_count, bool_or(calibrated) AS calibrated, max(advert_ts) FILTER (r = 1) AS last_advert_ts, max(mx) AS last_observed_ts FROM rk GROUP BY 1),
nv AS (SELECT al.*, n, good, CASE WHEN good / n >= 0.1 AND n > good AND good > 0 THEN gm ELSE m END AS v FROM al JOIN rc USING (public_key)),
ns AS (SELECT public_key, mean_skew, median_skew, last_skew, {tr('v', 1)} AS recent_median_skew, CASE WHEN good / n < 0.1 THEN 'no_clock' WHEN good / n < 0.8 AND n > good THEN 'bimodal_clock' ELSE {_SEV('v')} END AS severity,
  sample_count, calibrated, last_advert_ts, last_observed_ts, {tr('good / n', 2)} AS good_fraction, n - good AS recent_bad_samples, n AS recent_samples FROM nv)
"""


def _corr(m):
    s = K.skew_samples(m.tx, m.obs)
    return K.corrected_samples(s, K.observer_calibration(s))


def _skew(m):
    return K.node_skew(K.hash_skew(_corr(m)))


@query("skew_samples", M.sql("obs", _SK + "SELECT * FROM sm"))
def _(m):
    return K.skew_samples(m.tx, m.obs)


@query("observer_calibration", M.sql("obs", _SK + 'SELECT observer_id, off AS "offset", samples FROM cal'))
def _(m):
    return K.observer_calibration(K.skew_samples(m.tx, m.obs))


@query("hash_skew", M.sql("obs", _HS + "SELECT * FROM hs"))
def _(m):
    return K.hash_skew(_corr(m))


@query("node_skew", M.sql("obs", _NS + "SELECT * FROM ns"))
def _(m):
    return _skew(m)


_DRIFT = _NS + f""", us AS (SELECT hs.public_key, hs.last_observed_ts AS t, hash, hs.median_skew AS v FROM hs JOIN ns USING (public_key) WHERE ns.severity NOT IN ('no_clock', 'bimodal_clock')),
se AS (SELECT public_key, list({{'t': t, 'v': v}} ORDER BY t, hash) AS raw FROM us GROUP BY 1 HAVING count(*) >= 5),
kp AS (SELECT *, list_reduce(list_transform(raw, lambda x: [x]), lambda a, x: CASE WHEN abs(x[1].v - a[-1].v) <= 60 THEN list_concat(a, x) ELSE a END) AS kept FROM se),
pt AS (SELECT public_key, unnest(CASE WHEN kept[-1].t - kept[1].t >= 3600 THEN kept ELSE raw END) AS p FROM kp),
sl AS (SELECT a.public_key, (b.p.v - a.p.v) / (b.p.t - a.p.t) AS s FROM pt a JOIN pt b ON a.public_key = b.public_key AND b.p.t > a.p.t),
sr AS (SELECT *, row_number() OVER (PARTITION BY public_key ORDER BY s) AS r, count(*) OVER (PARTITION BY public_key) AS n FROM sl),
mi AS (SELECT public_key, (max(s) + min(s)) / 2 * 86400 AS d FROM sr WHERE r IN ((n + 1) // 2, n // 2 + 1) GROUP BY 1),
dr AS (SELECT kp.public_key, len(raw)::BIGINT AS points, {tr("CASE WHEN raw[-1].t - raw[1].t < 3600 OR abs(coalesce(d, 0)) > 86400 THEN 0e0 ELSE coalesce(d, 0) END", 2)} AS drift_per_day FROM kp LEFT JOIN mi USING (public_key))
"""


@query("node_drift", M.sql("obs", _DRIFT + "SELECT * FROM dr"))
def _(m):
    h = K.hash_skew(_corr(m))
    return K.node_drift(h, K.node_skew(h), points=None)


@query("hash_evidence", M.sql("obs observers", _SK + f"""
, h AS (SELECT public_key, hash, max(observed_ts) AS ts, {tr('median(' + tr('corrected', 1) + ')', 1)} AS median_corrected FROM co GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY public_key ORDER BY ts DESC, hash) AS rank FROM h)
SELECT t.public_key, t.hash, ts, median_corrected, co.observer_id, obs_id, coalesce(nullif(o.name, ''), co.observer_id) AS observer_name, {tr('raw', 1)} AS raw_skew, {tr('corrected', 1)} AS corrected_skew, {tr('coalesce(off, 0)', 1)} AS "offset", calibrated
FROM t JOIN co ON co.hash = t.hash LEFT JOIN observers o ON o.id = co.observer_id WHERE rank <= 10"""))
def _(m):
    return K.hash_evidence(_corr(m), m.observers)


@query("fleet_skew", M.sql("obs nodes", _DRIFT + "SELECT ns.*, coalesce(drift_per_day, 0e0) AS drift_per_day, name, role FROM ns LEFT JOIN dr USING (public_key) LEFT JOIN nodes USING (public_key)"))
def _(m):
    h = K.hash_skew(_corr(m))
    s = K.node_skew(h)
    return K.fleet_skew(s, K.node_drift(h, s, points=None), m.nodes)


@query("classify_skew", M.sql("obs", _HS + f"SELECT hash, {_SEV('median_skew')} AS severity FROM hs"))
def _(m):
    return K.hash_skew(_corr(m)).select("hash", K.classify_skew(F.col("median_skew")).alias("severity"))


@query("role_analytics", M.sql("obs nodes", _NS + f"""
, j AS (SELECT role, severity, CASE WHEN recent_median_skew <> 0 THEN abs(recent_median_skew) ELSE abs(last_skew) END AS a FROM nodes LEFT JOIN ns ON ns.public_key = nodes.public_key)
SELECT role, count(*)::BIGINT AS node_count, count(severity)::BIGINT AS with_skew, coalesce(trunc(sum(round(a * 10)::BIGINT) * 10 / count(a) + 0.5e0)::DOUBLE / 100, 0) AS mean_abs_skew, coalesce({tr('median(a)', 2)}, 0) AS median_abs_skew,
  {', '.join(f"count(*) FILTER (severity = '{s}')::BIGINT AS {s}" for s in ('ok', 'warning', 'critical', 'absurd', 'no_clock'))} FROM j GROUP BY 1"""))
def _(m):
    return N.role_analytics(m.nodes, _skew(m))
