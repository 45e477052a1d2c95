"""Prefix size, distance, route pattern and channel queries."""

from pyspark.sql import functions as F

from meshlake.operators import channels as C, distance as D, hashes as H, subpaths as S
from meshlake.session import cut_lineage

from . import mesh_sql as M
from .mesh_views import NOW, MeshTables
from .q_topology import edges
from .registry import ORACLE, query

REGION = "EUR"

_FRAME = """, fr AS (SELECT *, (pb >> 6) + 1 AS hs, route_type IN (2, 3) AND (pb & 63) = 0 AS zero FROM (
  SELECT *, ('0x' || substr(raw_hex, CASE WHEN route_type IN (0, 3) THEN 11 ELSE 3 END, 2))::INTEGER AS pb FROM tx))"""
_HOME = """, home AS (SELECT public_key, arg_min(region, (-n, region)) AS region FROM (
  SELECT d_pubkey AS public_key, upper(trim(iata)) AS region, count(*) AS n FROM tx JOIN obs ON transmission_id = tx.id JOIN observers ON observers.id = observer_id
  WHERE payload_type = 4 AND route_type IN (2, 3) AND (('0x' || substr(raw_hex, 3, 2))::INTEGER & 63) = 0 GROUP BY 1, 2) GROUP BY 1)"""
_SIZED = _FRAME + ", sized AS (SELECT * FROM fr WHERE hs <= 3), hop AS (SELECT s.*, path FROM sized s JOIN best ON best.transmission_id = s.id WHERE len(path) > 0)\n"


def _a(m):
    return m.tx, m.obs, m.observers


@query("hash_size_distribution", M.sql("best", _SIZED + """
SELECT count(*)::BIGINT AS total, count(*) FILTER (hs = 1)::BIGINT AS size_1, count(*) FILTER (hs = 2)::BIGINT AS size_2, count(*) FILTER (hs = 3)::BIGINT AS size_3 FROM hop"""))
def _(m):
    return H.hash_size_distribution(*_a(m))


@query("hash_size_hourly", M.sql("best", _SIZED + """
SELECT (first_seen // 3600) * 3600 AS hour, count(*) FILTER (hs = 1)::BIGINT AS size_1, count(*) FILTER (hs = 2)::BIGINT AS size_2, count(*) FILTER (hs = 3)::BIGINT AS size_3 FROM hop GROUP BY 1"""))
def _(m):
    return H.hash_size_hourly(*_a(m))


@query("hash_top_hops", M.sql("best pst", _SIZED + """, t AS (SELECT hex, count(*) AS c FROM (SELECT unnest(path) AS hex FROM hop) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)
SELECT hex, ((length(hex) + 1) // 2)::BIGINT AS size, c::BIGINT AS count, name, lo AS pubkey FROM t LEFT JOIN pst ON prefix = lower(hex) LEFT JOIN relays ON public_key = lo"""))
def _(m):
    return H.hash_top_hops(*_a(m), m.nodes)


_ADV = """, adv AS (SELECT d_pubkey AS pubkey, coalesce(arg_min(d_name, (first_seen, id)), substr(d_pubkey, 1, 8)) AS name,
  coalesce(arg_max(hs, (first_seen, id)) FILTER (NOT zero), 0)::INTEGER AS hash_size, count(*)::BIGINT AS packets, max(first_seen) AS last_seen
  FROM {src} WHERE payload_type = 4 AND d_pubkey <> '' GROUP BY d_pubkey),
advr AS (SELECT a.*, role FROM adv a LEFT JOIN nodes ON public_key = pubkey)
"""


@query("hash_multibyte_nodes", M.sql("obs nodes", _FRAME + ", sized AS (SELECT * FROM fr WHERE hs <= 3)" + _ADV.format(src="sized") + """
SELECT pubkey, name, role, hash_size, packets, last_seen FROM advr WHERE hash_size > 1"""))
def _(m):
    return H.hash_multibyte_nodes(*_a(m), m.nodes)


@query("hash_by_repeaters", M.sql("obs nodes", _FRAME + ", sized AS (SELECT * FROM fr WHERE hs <= 3)" + _ADV.format(src="sized") + """
SELECT hash_size::INTEGER AS hash_size, sum(c)::BIGINT AS count FROM (SELECT hash_size, 1 AS c FROM advr WHERE contains(lower(role), 'repeater') UNION ALL SELECT unnest([1, 2, 3]), 0) GROUP BY 1"""))
def _(m):
    return H.hash_by_repeaters(*_a(m), m.nodes)


@query("region_attribution", M.sql("obs nodes observers", _FRAME + _HOME + f""", inreg AS (SELECT DISTINCT transmission_id AS t FROM obs JOIN observers ON observers.id = observer_id WHERE upper(trim(iata)) = '{REGION}'),
sized AS (SELECT fr.* FROM fr LEFT JOIN inreg ON t = id LEFT JOIN home h ON payload_type = 4 AND h.public_key = d_pubkey AND region = '{REGION}' WHERE hs <= 3 AND (t IS NOT NULL OR region IS NOT NULL))""" + _ADV.format(src="sized") + f"""
SELECT pubkey, name, role, hash_size, packets, last_seen FROM advr WHERE hash_size > 1 AND pubkey NOT IN (SELECT public_key FROM home WHERE region <> '{REGION}')"""))
def _(m):
    return H.region_attribution(*_a(m), m.nodes, REGION)


@query("node_home_region", M.sql("obs observers", _HOME + "SELECT * FROM home"))
def _(m):
    return H.node_home_region(*_a(m))


_INFO = _FRAME + f""", seq AS (SELECT d_pubkey AS pubkey, hs, first_seen, id, lag(hs) OVER (PARTITION BY d_pubkey ORDER BY first_seen, id) AS prev
  FROM fr WHERE payload_type = 4 AND first_seen >= {M.NOW} - 604800 AND NOT zero AND d_pubkey <> ''),
info AS (SELECT pubkey, arg_max(hs, (first_seen, id))::INTEGER AS hash_size, array_to_string(list_sort(list(DISTINCT hs)), ',') AS sizes_seen, count(*)::BIGINT AS adverts,
  count(*) >= 3 AND count(DISTINCT hs) >= 2 AND count(*) FILTER (hs <> prev) >= 2 AS inconsistent, max(hs) AS top FROM seq GROUP BY 1)
"""


@query("node_hash_size_info", M.sql("tx", _INFO + "SELECT pubkey, hash_size, sizes_seen, adverts, inconsistent FROM info"))
def _(m):
    return H.node_hash_size_info(m.tx, NOW)


_SN = _INFO + """, sn AS (SELECT public_key, name, role, coalesce(lat, 0) AS lat, coalesce(lon, 0) AS lon, coalesce(hash_size, 0) AS hash_size, coalesce(inconsistent, false) AS inconsistent
  FROM nodes LEFT JOIN info ON pubkey = public_key),
mem AS (SELECT *, upper(substr(public_key, 1, 2 * hash_size)) AS prefix FROM sn WHERE role = 'repeater' AND hash_size BETWEEN 1 AND 3)
"""


def _info(m):
    return H.node_hash_size_info(m.tx, NOW)


@query("inconsistent_nodes", M.sql("tx nodes", _SN + "SELECT public_key, name, role, hash_size FROM sn WHERE inconsistent AND role IN ('repeater', 'room_server')"))
def _(m):
    return H.inconsistent_nodes(m.nodes, _info(m)).select("public_key", "name", "role", "hash_size")


@query("hash_collisions", M.sql("tx nodes", _SN + f""", g AS (SELECT hash_size, prefix, count(*) AS appearances, count(*) FILTER (lat <> 0 OR lon <> 0) AS with_coords FROM mem GROUP BY 1, 2 HAVING count(*) > 1),
d AS (SELECT a.hash_size, a.prefix, max({M.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS d FROM mem a JOIN mem b ON a.hash_size = b.hash_size AND a.prefix = b.prefix AND a.public_key < b.public_key
  WHERE (a.lat <> 0 OR a.lon <> 0) AND (b.lat <> 0 OR b.lon <> 0) GROUP BY 1, 2)
SELECT g.hash_size, g.prefix, appearances::BIGINT AS appearances, with_coords::BIGINT AS with_coords, round(coalesce(d, 0), 6) AS max_dist_km,
  CASE WHEN with_coords < 2 THEN 'incomplete' WHEN coalesce(d, 0) < 50 THEN 'local' WHEN coalesce(d, 0) < 200 THEN 'regional' ELSE 'distant' END AS classification
FROM g LEFT JOIN d ON d.hash_size = g.hash_size AND d.prefix = g.prefix"""))
def _(m):
    return H.hash_collisions(m.nodes, _info(m)).withColumn("max_dist_km", F.round("max_dist_km", 6))


@query("hash_space_stats", M.sql("tx nodes", _SN + """, per AS (SELECT hash_size, prefix, count(*) AS n FROM mem GROUP BY 1, 2)
SELECT s::INTEGER AS size, (SELECT count(*) FROM sn)::BIGINT AS total_nodes, (SELECT count(*) FROM mem WHERE hash_size = s)::BIGINT AS nodes_for_byte, (SELECT count(*) FROM sn WHERE hash_size = s)::BIGINT AS using_this_size,
  (SELECT count(*) FROM per WHERE hash_size = s)::BIGINT AS unique_prefixes, (SELECT count(*) FROM per WHERE hash_size = s AND n > 1)::BIGINT AS collision_count,
  (256 ** s)::BIGINT AS space_size, (SELECT count(*) FROM per WHERE hash_size = s) / (256e0 ** s) * 100 AS pct_used FROM range(1, 4) t(s)"""))
def _(m):
    return H.hash_space_stats(m.nodes, _info(m))


@query("hash_matrix", M.sql("tx nodes", _SN + """, per AS (SELECT hash_size, prefix, count(*) AS n FROM mem WHERE hash_size <= 2 GROUP BY 1, 2),
c AS (SELECT substr(prefix, 1, 2) AS cell, sum(n) FILTER (hash_size = 1) AS a, sum(n) FILTER (hash_size = 2) AS b, count(*) FILTER (hash_size = 2 AND n > 1) AS k, max(n) FILTER (hash_size = 2 AND n > 1) AS mx FROM per GROUP BY 1)
SELECT printf('%02X', i) AS cell, coalesce(a, 0)::BIGINT AS one_byte_nodes, coalesce(b, 0)::BIGINT AS two_byte_nodes, coalesce(k, 0)::BIGINT AS two_byte_collisions, coalesce(mx, 0)::BIGINT AS max_collision
FROM range(256) t(i) LEFT JOIN c ON cell = printf('%02X', i)"""))
def _(m):
    return H.hash_matrix(m.nodes, _info(m))


@query("multibyte_capability", M.sql("best nodes", _INFO + ", sized AS (SELECT * FROM fr WHERE hs <= 3)" + _ADV.format(src="sized") + """,
hp AS (SELECT lower(h) AS prefix, max(hs) AS seen FROM (SELECT hs, unnest(path) AS h FROM fr JOIN best ON best.transmission_id = fr.id WHERE payload_type <> 8 AND hs >= 2) GROUP BY 1),
su AS (SELECT public_key, max(seen) AS sus FROM nodes JOIN range(1, 4) t(n) ON true JOIN hp ON prefix = substr(public_key, 1, 2 * n) GROUP BY 1),
j AS (SELECT n.*, coalesce(CASE WHEN top >= 2 THEN top END, CASE WHEN a.hash_size > 1 THEN a.hash_size END) AS conf, sus FROM nodes n LEFT JOIN info i ON i.pubkey = n.public_key LEFT JOIN adv a ON a.pubkey = n.public_key LEFT JOIN su ON su.public_key = n.public_key)
SELECT public_key, name, role, last_seen, CASE WHEN conf IS NOT NULL THEN 'confirmed' WHEN sus IS NOT NULL THEN 'suspected' ELSE 'unknown' END AS status,
  CASE WHEN conf IS NOT NULL THEN 'advert' WHEN sus IS NOT NULL THEN 'path' ELSE '' END AS evidence, coalesce(conf, sus, 1)::INTEGER AS max_hash_size FROM j"""))
def _(m):
    return H.multibyte_capability(*_a(m), m.nodes, NOW)


@query("prefix_check", M.sql("nodes", """
, q AS (SELECT upper(public_key) AS key, s AS bytes, upper(substr(public_key, 1, 2 * s)) AS prefix FROM nodes, range(1, 4) t(s)),
c AS (SELECT s, upper(substr(public_key, 1, 2 * s)) AS prefix, count(*) AS n FROM nodes, range(1, 4) t(s) WHERE role = 'repeater' GROUP BY 1, 2)
SELECT key, bytes::INTEGER AS bytes, q.prefix, (coalesce(n, 0) - (key IN (SELECT upper(public_key) FROM nodes WHERE role = 'repeater'))::INTEGER)::BIGINT AS colliders FROM q LEFT JOIN c ON c.s = bytes AND c.prefix = q.prefix"""))
def _(m):
    return H.prefix_check(m.nodes, m.nodes.select(F.col("public_key").alias("key")))


@query("free_prefixes", M.sql("nodes", """
SELECT printf('%04X', i) AS prefix FROM range(65536) t(i) WHERE printf('%04X', i) NOT IN (SELECT upper(substr(public_key, 1, 4)) FROM nodes WHERE role = 'repeater')"""))
def _(m):
    return H.free_prefixes(m.nodes, 2)


@query("prefix_overview", M.sql("nodes", """
, p AS (SELECT s, substr(public_key, 1, 2 * s) AS p, count(*) AS n FROM nodes, range(1, 4) t(s) WHERE role = 'repeater' GROUP BY 1, 2)
SELECT s::INTEGER AS size, count(*)::BIGINT AS used, count(*) FILTER (n > 1)::BIGINT AS colliding, ((256 ** s) - count(*))::BIGINT AS available,
  CASE WHEN (SELECT count(*) FROM nodes WHERE role = 'repeater') < 20 THEN 1 ELSE 2 END::INTEGER AS recommended FROM p GROUP BY s"""))
def _(m):
    return H.prefix_overview(m.nodes)


# ---- distance ----

_DIST = f""", {M.HEADS}, hd AS (SELECT * FROM heads WHERE len(path) > 0),
{M.context_cte('hd')},
hc AS (SELECT id AS ctx, key FROM hctx), hops AS (SELECT id, i - 1 AS pos, path[i] AS hop FROM (SELECT id, path, unnest(range(1, len(path) + 1)) AS i FROM hd)),
pr AS (SELECT hop, id AS ctx FROM hops),
{M.resolve_cte('pr', 'hc')},
stops AS (SELECT h.id, pos, g.public_key AS pk, n.name, g.lat, g.lon, contains(lower(role), 'repeater') AS rep FROM hops h JOIN res r ON r.hop = h.hop AND r.ctx = h.id JOIN gpsn g ON g.public_key = r.pubkey JOIN nodes n ON n.public_key = r.pubkey
  UNION ALL SELECT hd.id, -1, g.public_key, n.name, g.lat, g.lon, contains(lower(role), 'repeater') FROM hd JOIN gpsn g ON g.public_key = sender JOIN nodes n ON n.public_key = sender),
pairs2 AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, pk AS from_pk, name AS from_name, rep AS ra, lat AS la, lon AS oa,
  lead(pk) OVER w AS to_pk, lead(name) OVER w AS to_name, lead(rep) OVER w AS rb, lead(lat) OVER w AS lb, lead(lon) OVER w AS ob FROM stops WINDOW w AS (PARTITION BY id ORDER BY pos)),
dh AS (SELECT p.id, hash, first_seen, b.snr, p.pos, from_pk, from_name, to_pk, to_name, km, {M.half_away('km', 2)} AS dist,
  CASE WHEN ra AND rb THEN 'R↔R' WHEN NOT ra AND NOT rb THEN 'C↔C' ELSE 'C↔R' END AS type
  FROM (SELECT *, {M.haversine('la', 'oa', 'lb', 'ob')} AS km FROM pairs2 WHERE to_pk IS NOT NULL) p JOIN tx ON tx.id = p.id JOIN best b ON b.transmission_id = p.id WHERE km <= 300)
"""


def _hops(m: MeshTables):
    """The hop table that all distance reports read."""
    return m.hops


@query("distance_hops", M.sql("best edges", _DIST + """
SELECT id, hash, first_seen, snr, (row_number() OVER (PARTITION BY id ORDER BY pos) - 1)::INTEGER AS pos, from_pk, to_pk, round(km, 6) AS km, dist, type FROM dh"""))
def _(m):
    return D.distance_hops(m.tx, m.obs, m.nodes, edges(m), NOW, max_km=D.MAX_KM).drop("from_name", "to_name").withColumn("km", F.round("km", 6))


_EVERY_KM = _DIST.replace("WHERE km <= 300", "WHERE km IS NOT NULL")


@query("distance_rejected", M.sql("best edges", _EVERY_KM + "SELECT type, count(*) FILTER (km > 300)::BIGINT AS rejected, count(*)::BIGINT AS hops FROM dh GROUP BY 1"))
def _(m):
    return D.distance_rejected(D.distance_hops(m.tx, m.obs, m.nodes, edges(m), NOW), D.MAX_KM)


@query("distance_category_stats", M.sql("best edges", _DIST + f""", r AS (SELECT type, dist, row_number() OVER (PARTITION BY type ORDER BY dist) AS rn, count(*) OVER (PARTITION BY type) AS n FROM dh),
t AS (SELECT unnest(['R↔R', 'C↔R', 'C↔C']) AS type)
SELECT t.type, count(dist)::BIGINT AS count, coalesce(floor(sum(round(dist * 100)::BIGINT) / count(dist) + 0.5e0) / 100, 0) AS avg, coalesce({M.half_away('max(dist) FILTER (rn = n // 2 + 1)', 2)}, 0) AS median,
  coalesce({M.half_away('min(dist)', 2)}, 0) AS min, coalesce({M.half_away('max(dist)', 2)}, 0) AS max FROM t LEFT JOIN r ON r.type = t.type GROUP BY 1"""))
def _(m):
    return D.distance_category_stats(_hops(m))


@query("distance_histogram", M.sql("best edges", _DIST + f""", b AS (SELECT min(dist) AS lo, (CASE WHEN max(dist) = min(dist) THEN 1 ELSE max(dist) - min(dist) END) / 25e0 AS w FROM dh),
h AS (SELECT least(trunc((dist - lo) / w)::BIGINT, 24) AS bin, count(*) AS n FROM dh, b GROUP BY 1)
SELECT g.bin::BIGINT AS bin, {M.half_away('(lo + g.bin * w)', 1)} AS x, {M.half_away('w', 1)} AS w, coalesce(n, 0)::BIGINT AS count FROM range(25) g(bin) CROSS JOIN b LEFT JOIN h ON h.bin = g.bin"""))
def _(m):
    return D.distance_histogram(_hops(m))


@query("distance_over_time", M.sql("best edges", _DIST + f"""
SELECT (first_seen // 3600) * 3600 AS hour, floor(sum(round(dist * 100)::BIGINT) / count(dist) + 0.5e0) / 100 AS avg, count(*)::BIGINT AS count FROM dh GROUP BY 1"""))
def _(m):
    return D.distance_over_time(_hops(m))


@query("distance_top_hops", M.sql("best edges", _DIST + """
, g AS (SELECT least(from_pk, to_pk) AS a, greatest(from_pk, to_pk) AS b, count(*)::BIGINT AS obs_count, max(snr) AS best_snr, median(snr) AS median_snr,
  arg_min({'from_pk': from_pk, 'from_name': from_name, 'to_pk': to_pk, 'to_name': to_name, 'dist': dist, 'type': type, 'hash': hash, 'first_seen': first_seen}, (-dist, first_seen, id, pos)) AS h FROM dh GROUP BY 1, 2)
SELECT h.from_pk, h.from_name, h.to_pk, h.to_name, h.dist, h.type, h.hash, h.first_seen, obs_count, best_snr, median_snr FROM g ORDER BY h.dist DESC, a, b LIMIT 20"""))
def _(m):
    return D.distance_top_hops(_hops(m))


@query("distance_top_paths", M.sql("best edges", _DIST + f"""
SELECT id, hash, first_seen, {M.half_away('round(sum(km), 9)', 2)} AS total_dist, count(*)::BIGINT AS hop_count, string_agg(from_pk || '>' || to_pk, ',' ORDER BY pos) AS hops FROM dh
GROUP BY 1, 2, 3 ORDER BY total_dist DESC, id LIMIT 20"""))
def _(m):
    return D.distance_top_paths(_hops(m)).withColumn("hops", F.array_join(F.transform("hops", lambda h: F.concat(h["from_pk"], F.lit(">"), h["to_pk"])), ","))


@query("distance_summary", M.sql("best edges", _DIST + f"""
SELECT count(*)::BIGINT AS total_hops, count(DISTINCT id)::BIGINT AS total_paths, floor(sum(round(dist * 100)::BIGINT) / count(dist) + 0.5e0) / 100 AS avg_dist, {M.half_away('max(dist)', 2)} AS max_dist FROM dh"""))
def _(m):
    return D.distance_summary(_hops(m))


# ---- route patterns ----

_SP = """, pa AS (SELECT tx.id, list_transform(path, lambda h: lower(h)) AS p, observer_id, d_pubkey FROM tx JOIN best ON best.transmission_id = tx.id WHERE len(path) >= 2),
sc AS (SELECT array_to_string(p[s:s + l - 1], ',') AS raw, count(*)::BIGINT AS count FROM (SELECT p, l, unnest(range(1, len(p) - l + 2)) AS s FROM (SELECT p, unnest(range(2, least(8, len(p)) + 1)) AS l FROM pa)) GROUP BY 1)
"""


@query("subpath_counts", M.sql("best", _SP + "SELECT raw, count FROM sc"))
def _(m):
    return S.subpath_counts(S._source(*_a(m), None))


_NAMED = _SP + f""", {M.HEADS},
{M.context_cte()}, ac AS (SELECT DISTINCT 'all' AS ctx, key FROM hctx),
sl AS (SELECT raw, count, unnest(string_split(raw, ',')) AS hop, generate_subscripts(string_split(raw, ','), 1) AS i FROM sc),
wanted AS (SELECT DISTINCT hop, 'all' AS ctx FROM sl),
{M.resolve_cte('wanted', 'ac')},
nm AS (SELECT raw, count, string_agg(coalesce(n.name, sl.hop), ' → ' ORDER BY i) AS path, count(*)::INTEGER AS hops FROM sl JOIN res ON res.hop = sl.hop LEFT JOIN relays n ON n.public_key = pubkey GROUP BY raw, count),
ng AS (SELECT path, hops, sum(count)::BIGINT AS count, min(raw) AS raw FROM nm GROUP BY 1, 2), tp AS (SELECT count(*) AS t FROM pa)
"""


@query("subpath_top", M.sql("best edges", _NAMED + f"SELECT path, hops, count, raw, {M.half_away('count * 100e0 / t', 1)} AS pct FROM ng, tp WHERE hops BETWEEN 2 AND 4 ORDER BY count DESC, path LIMIT 100"))
def _(m):
    return S.subpath_top(*_a(m), m.nodes, edges(m), NOW, 2, 4, 100)


@query("subpath_top_all", ORACLE["subpath_top"].replace(" WHERE hops BETWEEN 2 AND 4", ""))
def _(m):
    return S.subpath_top(*_a(m), m.nodes, edges(m), NOW, 2, 8, 100)


@query("subpath_top_bulk", M.sql("best edges", _NAMED + f"""
, g AS (SELECT unnest([0, 1, 2]) AS grp, unnest([2, 3, 5]) AS lo, unnest([2, 4, 8]) AS hi, unnest([50, 30, 20]) AS k),
r AS (SELECT grp, k, ng.*, row_number() OVER (PARTITION BY grp ORDER BY count DESC, path) AS rank FROM ng JOIN g ON hops BETWEEN lo AND hi)
SELECT grp AS "group", path, hops, count, raw, rank::INTEGER AS rank, {M.half_away('count * 100e0 / t', 1)} AS pct FROM r, tp WHERE rank <= k"""))
def _(m):
    return S.subpath_top_bulk(*_a(m), m.nodes, edges(m), NOW, [(2, 2, 50), (3, 4, 30), (5, 8, 20)])



def _pair() -> list[str]:
    import hashlib
    k = lambda n: hashlib.sha256(f"n{n}".encode()).hexdigest().upper()
    # second and third relay of station 2's routes, as two-byte hops
    return [k(2 * 20 + 5 + 0)[:4], k(2 * 20 + 10 + 1)[:4]]


_SEQ = _pair()
_M0 = f""", mt AS (SELECT id, hash, first_seen, snr, rssi, observer_id, unnest(list_filter(range(1, len(p)), lambda s: p[s:s + 1] = ['{_SEQ[0].lower()}', '{_SEQ[1].lower()}'])) AS at
  FROM (SELECT tx.id, hash, first_seen, snr, rssi, observer_id, list_transform(path, lambda h: lower(h)) AS p FROM tx JOIN best ON best.transmission_id = tx.id WHERE len(path) >= 2))
"""


@query("subpath_detail", M.sql("best", _M0 + """
SELECT count(*)::BIGINT AS total_matches, coalesce(min(first_seen), -1) AS first_seen, coalesce(max(first_seen), -1) AS last_seen, round(avg(snr), 6) AS avg_snr, round(avg(rssi), 6) AS avg_rssi, count(snr)::BIGINT AS samples FROM mt"""))
def _(m):
    s = S.subpath_detail(*_a(m), m.nodes, m.spark.createDataFrame([], "node_a string, node_b string, count bigint, last_seen timestamp, observer_count bigint"), NOW, _SEQ)["summary"]
    return s.withColumns({"avg_snr": F.round("avg_snr", 6), "avg_rssi": F.round("avg_rssi", 6),
                          "first_seen": F.coalesce(F.unix_seconds("first_seen"), F.lit(-1)), "last_seen": F.coalesce(F.unix_seconds("last_seen"), F.lit(-1))})


def _detail(m, part, need_edges=False):
    e = edges(m) if need_edges else m.spark.createDataFrame([], "node_a string, node_b string, count bigint, last_seen timestamp, observer_count bigint")
    return S.subpath_detail(*_a(m), m.nodes, e, NOW, _SEQ)[part]


@query("subpath_detail_hours", M.sql("best", _M0 + """
SELECT h::INTEGER AS hour, count(id)::BIGINT AS count FROM range(24) t(h) LEFT JOIN mt ON (first_seen // 3600) % 24 = h GROUP BY 1"""))
def _(m):
    return _detail(m, "hours")


@query("subpath_detail_observers", M.sql("best observers", _M0 + """
SELECT ob.name AS observer_name, count(*)::BIGINT AS count FROM mt JOIN observers ob ON ob.id = observer_id AND ob.name <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def _(m):
    return _detail(m, "observers")


@query("subpath_detail_parents", M.sql("best edges", _M0 + f""", {M.HEADS}, hd AS (SELECT * FROM heads WHERE id IN (SELECT id FROM mt)),
{M.context_cte('hd')}, hc AS (SELECT id AS ctx, key FROM hctx), hops AS (SELECT id, path[i] AS hop, i FROM (SELECT id, path, unnest(range(1, len(path) + 1)) AS i FROM hd)),
pr AS (SELECT hop, id AS ctx FROM hops),
{M.resolve_cte('pr', 'hc')},
nm AS (SELECT h.id, string_agg(coalesce(n.name, h.hop), ' → ' ORDER BY i) AS path FROM hops h JOIN res r ON r.hop = h.hop AND r.ctx = h.id LEFT JOIN relays n ON n.public_key = r.pubkey GROUP BY 1)
SELECT path, count(*)::BIGINT AS count FROM mt JOIN nm ON nm.id = mt.id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"""))
def _(m):
    return _detail(m, "parents", True)


# ---- channels ----

_CH = """, g AS (SELECT *, strpos(d_text, ': ') AS sep FROM tx WHERE payload_type = 5),
cm AS (SELECT id, hash, first_seen, coalesce(nullif(d_channel, ''), 'unknown') AS name, coalesce(d_text, '') AS text, coalesce(d_sender, '') AS sender, sep,
  CASE WHEN sep > 1 THEN substr(d_text, sep + 2) ELSE d_text END AS msg FROM g WHERE d_type = 'CHAN')
"""


@query("channels", M.sql("tx", _CH + """
SELECT name, count(*)::BIGINT AS message_count, max(first_seen) AS last_activity, arg_max(msg, (first_seen, id)) FILTER (text <> '') AS last_message,
  arg_max(sender, (first_seen, id)) FILTER (sender <> '' AND text <> '') AS last_sender FROM cm GROUP BY 1"""))
def _(m):
    return C.channels(*_a(m))


@query("discovered_channels", M.sql("tx", _CH + """
SELECT tag AS name, max(first_seen) AS last_activity FROM (SELECT first_seen, unnest(regexp_extract_all(text, '#[A-Za-z0-9_\\-]+')) AS tag FROM cm)
WHERE tag NOT IN (SELECT name FROM cm) AND substr(tag, 2) NOT IN (SELECT name FROM cm) GROUP BY 1"""))
def _(m):
    return C.discovered_channels(*_a(m))


@query("encrypted_channels", M.sql("obs observers", f"""
SELECT 'enc_' || d_hashhex AS hash, 'Encrypted (0x' || d_hashhex || ')' AS name, count(*)::BIGINT AS message_count, max(first_seen) AS last_activity FROM tx
WHERE payload_type = 5 AND d_type = 'GRP_TXT' AND d_status = 'no_key' AND id IN (SELECT transmission_id FROM obs JOIN observers ON observers.id = observer_id WHERE upper(trim(iata)) = '{REGION}') GROUP BY d_hashhex"""))
def _(m):
    return C.encrypted_channels(*_a(m), REGION)


@query("channel_messages", M.sql("best observers", _CH + """, mm AS (SELECT *, CASE WHEN sep > 1 AND sep - 1 < 50 THEN substr(text, 1, sep - 1) END AS ft FROM cm WHERE name = 'talk3'),
pg AS (SELECT id, hash, coalesce(ft, CASE WHEN sender <> '' THEN sender ELSE coalesce(ft, '') END) AS sender, CASE WHEN ft IS NOT NULL THEN substr(text, sep + 2) ELSE text END AS text, first_seen FROM mm ORDER BY first_seen DESC, id DESC LIMIT 40 OFFSET 5)
SELECT pg.id, hash, pg.sender, pg.text, pg.first_seen AS timestamp, 1::BIGINT AS repeats, coalesce(nullif(ob.name, ''), b.observer_id) AS observer, coalesce(len(path), 0)::INTEGER AS hops, snr, coalesce(stations, '') AS stations
FROM pg LEFT JOIN (SELECT transmission_id, array_to_string(list_sort(list(DISTINCT coalesce(nullif(o.name, ''), x.observer_id))), ',') AS stations FROM obs x LEFT JOIN observers o ON o.id = x.observer_id GROUP BY 1) st ON st.transmission_id = pg.id
LEFT JOIN best b ON b.transmission_id = pg.id LEFT JOIN observers ob ON ob.id = b.observer_id"""))
def _(m):
    return C.channel_messages(*_a(m), "talk3", 40, 5).drop("sender_timestamp")


@query("channel_messages_after", M.sql("best observers", _CH + """, mm AS (SELECT *, CASE WHEN sep > 1 AND sep - 1 < 50 THEN substr(text, 1, sep - 1) END AS ft FROM cm WHERE name = 'talk3' AND first_seen < 1705276800),
pg AS (SELECT id, hash, coalesce(ft, CASE WHEN sender <> '' THEN sender ELSE coalesce(ft, '') END) AS sender, CASE WHEN ft IS NOT NULL THEN substr(text, sep + 2) ELSE text END AS text, first_seen FROM mm ORDER BY first_seen DESC, id DESC LIMIT 40)
SELECT pg.id, hash, pg.sender, pg.text, pg.first_seen AS timestamp, 1::BIGINT AS repeats, coalesce(nullif(ob.name, ''), b.observer_id) AS observer, coalesce(len(path), 0)::INTEGER AS hops, snr, coalesce(stations, '') AS stations
FROM pg LEFT JOIN (SELECT transmission_id, array_to_string(list_sort(list(DISTINCT coalesce(nullif(o.name, ''), x.observer_id))), ',') AS stations FROM obs x LEFT JOIN observers o ON o.id = x.observer_id GROUP BY 1) st ON st.transmission_id = pg.id
LEFT JOIN best b ON b.transmission_id = pg.id LEFT JOIN observers ob ON ob.id = b.observer_id"""))
def _(m):
    return C.channel_messages(*_a(m), "talk3", 40, after=("2024-01-15T00:00:00Z", -1)).drop("sender_timestamp")


_CA = f""", cr AS (SELECT id, first_seen, ch, hold, wrong OR (text = '' AND sender = '') AS encrypted, CASE WHEN c = '' OR wrong THEN hold ELSE c END AS name, text, sender FROM (
  SELECT *, 'ch' || ch AS hold, c <> '' AND c <> 'ch' || ch AND NOT coalesce({M.channel_byte("CASE WHEN starts_with(c, '#') THEN c ELSE '#' || c END")} = ch, false) AS wrong FROM (
    SELECT id, first_seen, coalesce(nullif(d_channelhash, ''), '?') AS ch, coalesce(d_channel, '') AS c, coalesce(d_text, '') AS text, coalesce(d_sender, '') AS sender FROM tx WHERE payload_type = 5)))
"""


@query("channel_analytics", M.sql("tx", _CA + """
SELECT ch AS hash, coalesce(arg_min(name, (first_seen, id)) FILTER (NOT regexp_full_match(name, 'ch[+-]?[0-9]+')), arg_min(name, (first_seen, id))) AS name, count(*)::BIGINT AS messages,
  count(DISTINCT nullif(sender, ''))::BIGINT AS senders, max(first_seen) AS last_activity, bool_and(encrypted) AS encrypted FROM cr GROUP BY 1"""))
def _(m):
    return C.channel_analytics(C.channel_rows(*_a(m)))


@query("channel_top_senders", M.sql("tx", _CA + "SELECT sender, count(*)::BIGINT AS count FROM cr WHERE sender <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"))
def _(m):
    return C.channel_top_senders(C.channel_rows(*_a(m)))


@query("channel_timeline", M.sql("tx", _CA + "SELECT (first_seen // 3600) * 3600 AS hour, name AS channel, count(*)::BIGINT AS count FROM cr GROUP BY 1, 2"))
def _(m):
    return C.channel_timeline(C.channel_rows(*_a(m)))


@query("channel_msg_lengths", M.sql("tx", _CA + "SELECT id, strlen(text)::INTEGER AS length FROM cr WHERE text <> ''"))
def _(m):
    return C.channel_msg_lengths(C.channel_rows(*_a(m)))
