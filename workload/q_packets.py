"""Packet and node selection queries."""

import hashlib

from pyspark.sql import functions as F

from meshlake.operators import packets as P
from meshlake.sources import tables as S

from . import mesh_sql as M
from .mesh_views import NOW, MeshTables
from .registry import query

key = lambda n: hashlib.sha256(f"n{n}".encode()).hexdigest()
OBS_A, OBS_B = key(20).upper(), key(40).upper()
NODE = key(5)  # a repeater that both sends and relays
SINCE, UNTIL = "2024-01-10T00:00:00Z", "2024-01-20T00:00:00Z"
S0, U0 = 1704844800, 1705708800
SAMPLE_HASH = hashlib.md5(b"t7").hexdigest()[:16]


@query("load_packets", M.sql("obs observers", f"""
SELECT tx.id AS tx_id, hash, first_seen, payload_type, coalesce(o.id, -1) AS obs_id, o.observer_id, ob.name AS observer_name, snr, rssi, coalesce(o.timestamp, -1) AS timestamp
FROM tx LEFT JOIN obs o ON o.transmission_id = tx.id LEFT JOIN observers ob ON ob.id = o.observer_id WHERE first_seen >= {S0}"""))
def _(m):
    return S.load_packets(m.tx, m.obs, m.observers, since=SINCE).select(
        "tx_id", "hash", "first_seen", "payload_type", F.coalesce("obs_id", F.lit(-1)).alias("obs_id"), "observer_id",
        "observer_name", "snr", "rssi", F.coalesce(F.unix_seconds("timestamp"), F.lit(-1)).alias("timestamp"))


@query("load_packets_chunk", M.sql("obs observers", f"""
SELECT tx.id AS tx_id, hash, first_seen, coalesce(o.id, -1) AS obs_id, ob.name AS observer_name
FROM tx LEFT JOIN obs o ON o.transmission_id = tx.id LEFT JOIN observers ob ON ob.id = o.observer_id
WHERE first_seen >= {S0} AND first_seen < {U0}"""))
def _(m):
    return S.load_packets_chunk(m.tx, m.obs, m.observers, SINCE, UNTIL).select(
        "tx_id", "hash", "first_seen", F.coalesce("obs_id", F.lit(-1)).alias("obs_id"), "observer_name")


@query("packets_view", M.sql("obs observers", """
SELECT o.id AS id, tx.raw_hex, o.timestamp, ob.id AS observer_id, ob.name AS observer_name, snr, rssi, hash, payload_type
FROM obs o JOIN tx ON o.transmission_id = tx.id LEFT JOIN observers ob ON ob.id = o.observer_id AND NOT ob.inactive"""))
def _(m):
    return S.packets_view(m.tx, m.obs, m.observers).select(
        "id", "raw_hex", "timestamp", "observer_id", "observer_name", "snr", "rssi", "hash", "payload_type")


@query("incremental_since", M.sql("obs", """
SELECT id, hash, first_seen FROM tx WHERE id > 5000 ORDER BY id LIMIT 100"""))
def _(m):
    return S.incremental_since(m.tx, 5000, 100).select("id", "hash", "first_seen")


@query("node_dim", M.sql("nodes", """
SELECT public_key, name, role, lat, lon, last_seen, advert_count,
  lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) AS has_gps FROM nodes"""))
def _(m):
    return S.node_dim(m.nodes)


_FILTERED = f"""
, heard AS (SELECT DISTINCT transmission_id FROM obs JOIN observers ON observers.id = observer_id WHERE upper(trim(iata)) IN ('EUR'))
SELECT id, hash, first_seen FROM tx WHERE payload_type = 4 AND route_type = 1 AND first_seen > {S0} AND first_seen < {U0}
  AND id IN (SELECT transmission_id FROM heard)"""


@query("filter_packets", M.sql("obs observers", _FILTERED))
def _(m):
    return P.filter_packets(m.tx, m.obs, m.observers, m.nodes, type=4, route=1, region="eur", since=SINCE, until=UNTIL).select(
        "id", "hash", "first_seen")


@query("filter_packets_observed", M.sql("obs", f"""
SELECT id, hash FROM tx WHERE payload_type = 5 AND d_channel = '#chan3'
  AND id IN (SELECT transmission_id FROM obs WHERE timestamp >= {S0}) AND id IN (SELECT transmission_id FROM obs WHERE timestamp <= {U0})"""))
def _(m):
    return P.filter_packets(m.tx, m.obs, m.observers, m.nodes, type=5, channel="#chan3", since=SINCE, until=UNTIL,
                            bounds="observed").select("id", "hash")


@query("observer_semi", M.sql("obs", f"""
SELECT id, hash FROM tx WHERE id IN (SELECT transmission_id FROM obs WHERE observer_id IN ('{OBS_A}', '{OBS_B}'))"""))
def _(m):
    return P.observer_semi(m.tx, m.obs, f"{OBS_A}, {OBS_B}").select("id", "hash")


@query("region_semi", M.sql("obs observers", """
SELECT id, hash FROM tx WHERE id IN (SELECT transmission_id FROM obs JOIN observers ON observers.id = observer_id
  WHERE upper(trim(iata)) IN ('ASI', 'AFR'))"""))
def _(m):
    return P.region_semi(m.tx, m.obs, m.observers, "asi,AFR,ALL").select("id", "hash")


_NODE_IDS = """(SELECT id FROM tx WHERE d_pubkey IN ({k}) OR d_dest IN ({k}) OR d_src IN ({k})
  UNION SELECT transmission_id FROM obs WHERE list_has_any(resolved_path, [{k}]))"""


@query("node_packets", M.sql("obs", f"SELECT id, hash, first_seen FROM tx WHERE id IN {_NODE_IDS.format(k=repr(NODE))}"))
def _(m):
    return P.node_packets(m.tx, m.obs, m.nodes, NODE).select("id", "hash", "first_seen")


@query("channel_match", M.sql("tx", "SELECT id, hash FROM tx WHERE payload_type = 5 AND (d_channel = 'enc_04' OR d_hashhex = '04')"))
def _(m):
    return m.tx.filter(P.channel_match("enc_04")).select("id", "hash")


_KEYS = [key(n) for n in (5, 26, 31)]


@query("multi_node_packets", M.sql("obs", f"""
SELECT id, hash, first_seen FROM tx WHERE first_seen >= {S0} AND first_seen <= {U0}
  AND id IN {_NODE_IDS.format(k=', '.join(repr(k) for k in _KEYS))} ORDER BY first_seen DESC, id DESC LIMIT 200"""))
def _(m):
    return P.multi_node_packets(m.tx, m.obs, _KEYS, SINCE, UNTIL, limit=200).select("id", "hash", "first_seen")


@query("packet_page", M.sql("tx", "SELECT id, hash, first_seen FROM tx ORDER BY first_seen, id LIMIT 50 OFFSET 100"))
def _(m):
    return P.page(m.tx, 50, 100).select("id", "hash", "first_seen")


@query("packet_page_after", M.sql("tx", "SELECT id, hash, first_seen FROM tx WHERE first_seen > 1704844800 OR first_seen = 1704844800 AND id > 100 ORDER BY first_seen, id LIMIT 500"))
def _(m):
    return P.seek(m.tx, 500, ("2024-01-10T00:00:00Z", 100)).select("id", "hash", "first_seen")


@query("packet_page_before", M.sql("tx", "SELECT id, hash, first_seen FROM tx WHERE first_seen < 1704844800 OR first_seen = 1704844800 AND id < 100 ORDER BY first_seen DESC, id DESC LIMIT 500"))
def _(m):
    return P.seek(m.tx, 500, ("2024-01-10T00:00:00Z", 100), "desc").select("id", "hash", "first_seen")


@query("packet_total", M.sql("tx", "SELECT count(*)::BIGINT AS total FROM tx"))
def _(m):
    return P.packet_total(m.tx)


@query("grouped_packets", M.sql("best observers", """
, agg AS (SELECT transmission_id AS t, count(*)::BIGINT AS observation_count, count(DISTINCT observer_id)::BIGINT AS observer_count, max(timestamp) AS latest FROM obs GROUP BY 1)
SELECT tx.id, hash, first_seen, payload_type, route_type, coalesce(observation_count, 0) AS observation_count,
  coalesce(observer_count, 0) AS observer_count, coalesce(latest, first_seen) AS latest, b.observer_id, array_to_string(path, ',') AS path, snr, rssi, ob.name AS observer_name
FROM tx LEFT JOIN agg ON t = tx.id LEFT JOIN best b ON b.transmission_id = tx.id LEFT JOIN observers ob ON ob.id = b.observer_id
ORDER BY coalesce(latest, first_seen) DESC, tx.id DESC LIMIT 300"""))
def _(m):
    return P.grouped_packets(m.tx, m.obs, m.observers, 300)


@query("best_observation", M.sql("best", """
SELECT transmission_id, array_to_string(path, ',') AS path, snr, rssi, observer_id, timestamp,
  (SELECT count(*) FROM obs o WHERE o.transmission_id = best.transmission_id)::BIGINT AS observation_count FROM best"""))
def _(m):
    return P.best_observation(m.obs)


@query("packet_by_hash", M.sql("tx", f"SELECT id, hash, raw_hex, first_seen FROM tx WHERE hash = '{SAMPLE_HASH}'"))
def _(m):
    return P.by_hash(m.tx, SAMPLE_HASH.upper()).select("id", "hash", "raw_hex", "first_seen")


@query("packet_by_id", M.sql("tx", "SELECT id, hash, raw_hex, first_seen FROM tx WHERE id = 77"))
def _(m):
    return P.by_id(m.tx, 77).select("id", "hash", "raw_hex", "first_seen")


@query("packet_detail", M.sql("tx", """
, f AS (SELECT id, hash, length(raw_hex) // 2 AS total, CASE WHEN route_type IN (0, 3) THEN 4 ELSE 0 END AS t, raw_hex FROM tx),
g AS (SELECT *, ('0x' || substr(raw_hex, 3 + t * 2, 2))::INTEGER AS pb FROM f),
h AS (SELECT *, ((pb >> 6) + 1) * (pb & 63) AS pl FROM g)
SELECT id, hash, part, start::INTEGER AS start, size::INTEGER AS size FROM (
  SELECT id, hash, 'header' AS part, 0 AS start, 1 AS size FROM h UNION ALL
  SELECT id, hash, 'transport_codes', 1, t FROM h UNION ALL SELECT id, hash, 'path_length', t + 1, 1 FROM h UNION ALL
  SELECT id, hash, 'path', t + 2, pl FROM h UNION ALL SELECT id, hash, 'payload', t + 2 + pl, greatest(total - t - 2 - pl, 0) FROM h) WHERE size > 0"""))
def _(m):
    return P.packet_detail(m.tx)


_HASHES = [hashlib.md5(f"t{i}".encode()).hexdigest()[:16] for i in (3, 7, 8, 11, 500)]


@query("observations_for_hashes", M.sql("obs", f"""
SELECT hash, count(*)::BIGINT AS n, string_agg(o.id::VARCHAR, ',' ORDER BY timestamp, o.id) AS ids FROM obs o JOIN tx ON tx.id = transmission_id
WHERE hash IN ({', '.join(repr(h) for h in _HASHES)}) GROUP BY hash"""))
def _(m):
    return P.observations_for_hashes(m.tx, m.obs, _HASHES).select(
        "hash", "n", F.array_join(F.transform("observations", lambda o: o["id"].cast("string")), ",").alias("ids"))


@query("timestamps_since", M.sql("tx", f"SELECT first_seen FROM tx WHERE first_seen > {U0}"))
def _(m):
    return P.timestamps_since(m.tx, UNTIL)


@query("trace_packet", M.sql("obs observers", f"""
SELECT o.id, hash, observer_id, ob.name AS observer_name, snr, rssi, timestamp, array_to_string(path, ',') AS path,
  timestamp - min(timestamp) OVER () AS after_first_secs
FROM obs o JOIN tx ON tx.id = transmission_id LEFT JOIN observers ob ON ob.id = observer_id WHERE hash = '{SAMPLE_HASH}'"""))
def _(m):
    return P.trace_packet(m.tx, m.obs, m.observers, SAMPLE_HASH)


@query("list_nodes", M.sql("nodes", f"""
SELECT public_key, name, role, last_seen FROM nodes WHERE role = 'repeater' AND contains(lower(name), 're') AND last_seen > {M.NOW} - 7 * 86400
ORDER BY last_seen DESC, public_key LIMIT 50 OFFSET 10"""))
def _(m):
    return P.list_nodes(m.nodes, role="repeater", search="RE", last_heard="7d", now=NOW, offset=10).select(
        "public_key", "name", "role", "last_seen")


@query("node_totals", M.sql("nodes", "SELECT role, count(*)::BIGINT AS nodes FROM nodes WHERE contains(lower(name), 're') GROUP BY 1 UNION ALL SELECT NULL, count(*)::BIGINT FROM nodes WHERE contains(lower(name), 're')"))
def _(m):
    return P.node_totals(m.nodes, search="RE")


@query("list_nodes_region", M.sql("nodes obs observers", """
SELECT public_key, name, advert_count FROM nodes WHERE public_key IN (SELECT from_pubkey FROM tx WHERE payload_type = 4 AND id IN (
  SELECT transmission_id FROM obs JOIN observers ON observers.id = observer_id WHERE upper(trim(iata)) = 'AME'))
ORDER BY advert_count DESC, public_key LIMIT 100"""))
def _(m):
    keys = P.region_node_keys(m.tx, m.obs, m.observers, "AME")
    return P.list_nodes(m.nodes, region_keys=keys, sort_by="packetCount", limit=100).select("public_key", "name", "advert_count")


@query("search_nodes", M.sql("nodes", """
SELECT public_key, name FROM nodes WHERE contains(lower(name), 'a1') OR starts_with(public_key, 'a1') ORDER BY last_seen DESC, public_key LIMIT 10"""))
def _(m):
    return P.search_nodes(m.nodes, "A1").select("public_key", "name")


@query("node_by_prefix", M.sql("nodes", f"""
SELECT CASE WHEN count(*) = 1 THEN min(public_key) END AS public_key, count(*) > 1 AS ambiguous FROM nodes WHERE starts_with(public_key, '{NODE[:10]}')"""))
def _(m):
    return P.node_by_prefix(m.nodes, NODE[:10].upper())


@query("recent_node_packets", M.sql("obs", f"""
, top AS (SELECT * FROM tx WHERE from_pubkey = '{NODE}' ORDER BY first_seen DESC, id DESC LIMIT 20)
SELECT t.id, t.hash, t.first_seen, t.payload_type, count(o.id)::BIGINT AS n, coalesce(string_agg(o.id::VARCHAR, ',' ORDER BY timestamp DESC, o.id DESC), '') AS ids
FROM top t LEFT JOIN obs o ON o.transmission_id = t.id GROUP BY ALL"""))
def _(m):
    ids = F.transform(F.filter("observations", lambda o: o.isNotNull()), lambda o: o["id"].cast("string"))
    return P.recent_node_packets(m.tx, m.obs, NODE).select(
        "id", "hash", "first_seen", "payload_type", F.size(F.array_compact(ids)).cast("bigint").alias("n"),
        F.array_join(F.array_compact(ids), ",").alias("ids"))


@query("direct_packets", M.sql("obs", f"""
SELECT id, hash, first_seen FROM tx WHERE first_seen >= {M.NOW} - 720 * 3600 AND id IN (SELECT transmission_id FROM obs WHERE len(path) > 0 AND starts_with('{NODE}', lower(path[1])))
ORDER BY first_seen DESC, id DESC LIMIT 100"""))
def _(m):
    return P.direct_packets(m.tx, m.obs, NODE, NOW, 720, 100).select("id", "hash", "first_seen")


@query("blacklist_nodes", M.sql("nodes", """
SELECT public_key, name FROM nodes WHERE public_key NOT IN (SELECT public_key FROM nodes WHERE advert_count = 13)"""))
def _(m):
    return P.blacklist_nodes(m.nodes, m.nodes.filter("advert_count = 13"), "public_key").select("public_key", "name")


@query("type_samples", M.sql("tx", f"""
, s AS (SELECT {M.type_name('payload_type')} AS type, id, hash, length(raw_hex) // 2 AS size, first_seen // 3600 AS h FROM tx),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY size, h, id) - 1 AS rank, count(*) OVER (PARTITION BY type) AS n FROM s)
SELECT type, rank, id, hash, size FROM r WHERE rank IN (SELECT (i * r.n) // least(r.n, 8) FROM range(8) t(i) WHERE i < least(r.n, 8))"""))
def _(m):
    return P.type_samples(m.tx)


@query("dsl_predicates", M.sql("best observers", f"""
, c AS (SELECT transmission_id AS t, count(*) AS n FROM obs GROUP BY 1)
SELECT tx.id, hash FROM tx LEFT JOIN best b ON b.transmission_id = tx.id LEFT JOIN c ON c.t = tx.id LEFT JOIN observers ob ON ob.id = b.observer_id
WHERE (d_type IS NOT NULL AND payload_type = 4 OR route_type = 1 AND payload_type = 5) AND coalesce(b.snr > -5, false) AND coalesce(len(b.path), 0) BETWEEN 1 AND 4
  AND NOT coalesce(contains(lower(ob.name), 'supplier#000000001'), false) AND coalesce(c.n, 0) >= 2 AND first_seen > {S0}
  AND NOT coalesce(d_lat = 0, false)"""))
def _(m):
    from meshlake.operators import predicates as D
    f = D.fields(m.tx, m.obs, m.observers)
    p = D.Packet
    cond = D.all_of(
        D.any_of(p("type").eq("advert"), D.all_of(p("route").eq("flood"), p("type").eq("grp_txt"))),
        p("snr") > -5, p("hops").between(4, 1), D.none_of(p("observer").contains("SUPPLIER#000000001")),
        p("observations") >= 2, p("time").after(SINCE), D.none_of(p("payload.lat").eq(0)))
    return f.filter(cond).select("id", "hash")
