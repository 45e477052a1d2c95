"""Topology, hop resolution and neighbor graph queries."""

from pyspark.sql import functions as F

from meshlake.functions import geo
from meshlake.session import cut_lineage
from meshlake.operators import graph as G, packets as P, regional as X, resolve as R, topology as T

from . import mesh_sql as M
from .mesh_views import NOW, MeshTables
from .registry import query


def edges(m: MeshTables):
    """The persisted edge table the resolver reads."""
    return m.edges


def _a(m):
    return m.tx, m.best, m.observers


def _full(m):
    return m.tx, m.best, m.observers, m.nodes, edges(m), NOW


_P = ", p AS (SELECT tx.id, d_pubkey, observer_id, path, snr FROM tx JOIN best ON best.transmission_id = tx.id WHERE len(path) > 0)\n"


@query("topo_hop_distribution", M.sql("best", _P + "SELECT len(path)::INTEGER AS hops, count(*)::BIGINT AS count FROM p GROUP BY 1"))
def _(m):
    return T.topo_hop_distribution(*_a(m))


@query("topo_hop_stats", M.sql("best", _P + """
SELECT avg(len(path)) AS avg_hops, (SELECT h FROM (SELECT len(path) AS h, row_number() OVER (ORDER BY len(path)) AS r, count(*) OVER () AS n FROM p) WHERE r = n // 2 + 1)::INTEGER AS median_hops,
  max(len(path))::INTEGER AS max_hops FROM p"""))
def _(m):
    return T.topo_hop_stats(*_a(m)).withColumn("median_hops", F.col("median_hops").cast("int"))


@query("topo_hops_vs_snr", M.sql("best", _P + """
SELECT len(path)::INTEGER AS hops, count(*)::BIGINT AS count, round(avg(snr), 6) AS avg_snr FROM p WHERE snr IS NOT NULL GROUP BY 1"""))
def _(m):
    return T.topo_hops_vs_snr(*_a(m)).withColumn("avg_snr", F.round("avg_snr", 6))


# names of distinct hops in the context of the whole selection
def _names(hops: str) -> str:
    return f""", heads AS (SELECT tx.id, d_pubkey AS sender, observer_id, path FROM tx JOIN best ON best.transmission_id = tx.id),
{M.context_cte()},
allctx AS (SELECT DISTINCT 'all' AS ctx, key FROM hctx),
wanted AS (SELECT DISTINCT h AS hop, 'all' AS ctx FROM ({hops})),
{M.resolve_cte('wanted', 'allctx')},
lab AS (SELECT hop, pubkey, n.name FROM res LEFT JOIN relays n ON n.public_key = pubkey)
"""


_HOPS = _P + """, hc AS (SELECT h AS hop, count(*) AS c FROM (SELECT unnest(path) AS h FROM p) GROUP BY 1),
mg AS (SELECT coalesce(CASE WHEN n = 1 THEN lo END, '?' || hop) AS who, arg_min(hop, (-length(hop), hop)) AS hop, sum(c)::BIGINT AS count
  FROM hc LEFT JOIN pst ON prefix = substr(lower(hop), 1, 8) GROUP BY 1),
top AS (SELECT hop, count FROM mg ORDER BY count DESC, hop LIMIT 20)
"""


@query("topo_top_repeaters", M.sql("best edges", _HOPS + _names("SELECT hop AS h FROM top") +
                                   "SELECT top.hop, count, name, pubkey FROM top LEFT JOIN lab ON lab.hop = top.hop"))
def _(m):
    return T.topo_top_repeaters(*_full(m))


_PAIRS = _P + """, pc AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS c FROM (
    SELECT path[i] AS x, path[i + 1] AS y FROM (SELECT path, unnest(range(1, len(path))) AS i FROM p)) GROUP BY 1, 2),
pj AS (SELECT a, b, c, CASE WHEN pa.n = 1 AND pb.n = 1 THEN pa.lo END AS ka, CASE WHEN pa.n = 1 AND pb.n = 1 THEN pb.lo END AS kb
  FROM pc LEFT JOIN pst pa ON pa.prefix = substr(lower(a), 1, 8) LEFT JOIN pst pb ON pb.prefix = substr(lower(b), 1, 8)),
pk AS (SELECT coalesce(least(ka, kb), '?' || a) AS ga, coalesce(greatest(ka, kb), '?' || b) AS gb,
  CASE WHEN ka > kb THEN b ELSE a END AS x, CASE WHEN ka > kb THEN a ELSE b END AS y, c FROM pj),
pm AS (SELECT arg_min(x, (-length(x), x)) AS x, arg_min(y, (-length(y), y)) AS y, sum(c)::BIGINT AS count FROM pk GROUP BY ga, gb),
top AS (SELECT least(x, y) AS hop_a, greatest(x, y) AS hop_b, count FROM pm ORDER BY count DESC, 1, 2 LIMIT 15)
"""


@query("topo_top_pairs", M.sql("best edges", _PAIRS + _names("SELECT hop_a AS h FROM top UNION SELECT hop_b FROM top") + """
SELECT hop_a, hop_b, count, a.name AS name_a, a.pubkey AS pubkey_a, b.name AS name_b, b.pubkey AS pubkey_b
FROM top LEFT JOIN lab a ON a.hop = hop_a LEFT JOIN lab b ON b.hop = hop_b"""))
def _(m):
    return T.topo_top_pairs(*_full(m))


_REACH = _P + """, rr AS (SELECT observer_id, path[i] AS hop, min(len(path) - i + 1) AS min_dist, max(len(path) - i + 1) AS max_dist, count(*) AS count
  FROM (SELECT observer_id, path, unnest(range(1, len(path) + 1)) AS i FROM p) GROUP BY 1, 2),
st AS (SELECT id AS observer_id, CASE WHEN name <> '' THEN name ELSE id END AS observer_name FROM observers)
"""


@query("topo_observer_reach", M.sql("best edges observers", _REACH + _names("SELECT hop AS h FROM rr") + """
SELECT rr.observer_id, rr.hop, min_dist::INTEGER AS min_dist, max_dist::INTEGER AS max_dist, count::BIGINT AS count, observer_name, name, pubkey
FROM rr LEFT JOIN st ON st.observer_id = rr.observer_id LEFT JOIN lab ON lab.hop = rr.hop"""))
def _(m):
    return T.topo_observer_reach(*_full(m))


@query("topo_multi_observer", M.sql("best edges observers", _REACH + """, top AS (SELECT hop, count(*) AS observers FROM rr GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 50)
""" + _names("SELECT hop AS h FROM top") + """
SELECT rr.hop, name, pubkey, observers::BIGINT AS observers, rr.observer_id, observer_name, min_dist::INTEGER AS min_dist, count::BIGINT AS count
FROM top JOIN rr ON rr.hop = top.hop LEFT JOIN st ON st.observer_id = rr.observer_id LEFT JOIN lab ON lab.hop = rr.hop"""))
def _(m):
    return T.topo_multi_observer(*_full(m))


@query("topo_best_path", M.sql("best edges observers", _REACH + """, nb AS (SELECT hop, min(min_dist) AS min_dist, arg_min(observer_id, (min_dist, observer_id)) AS observer_id FROM rr GROUP BY 1),
top AS (SELECT * FROM nb ORDER BY min_dist, hop LIMIT 50)
""" + _names("SELECT hop AS h FROM top") + """
SELECT top.hop, min_dist::INTEGER AS min_dist, top.observer_id, observer_name, name, pubkey
FROM top LEFT JOIN st ON st.observer_id = top.observer_id LEFT JOIN lab ON lab.hop = top.hop"""))
def _(m):
    return T.topo_best_path(*_full(m))


# ---- resolution ----

@query("prefix_candidates", M.sql("prefixes", """
SELECT prefix, public_key AS key, name, role, lat, lon, lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) AS gps, advert_count AS adverts FROM prefixes"""))
def _(m):
    return R.prefix_candidates(m.nodes)


_OBS_HOPS = ", hops AS (SELECT DISTINCT unnest(path) AS hop FROM obs)\n"


@query("resolve_simple", M.sql("obs pst", _OBS_HOPS + """, fg AS (SELECT prefix, min(public_key) AS g FROM prefixes WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) GROUP BY 1)
SELECT hop, CASE WHEN n = 1 THEN lo ELSE coalesce(g, lo) END AS pubkey FROM hops LEFT JOIN pst ON pst.prefix = lower(hop) LEFT JOIN fg ON fg.prefix = lower(hop)"""))
def _(m):
    return R.resolve_simple(m.obs.select(F.explode("path").alias("hop")), m.nodes)


# every station with every hop it reported directly, in the station's own surroundings
_STATION_PAIRS = """, pairs AS (SELECT DISTINCT path[len(path)] AS hop, lower(observer_id) AS ctx FROM obs WHERE len(path) > 0),
pctx AS (SELECT DISTINCT ctx, ctx AS key FROM pairs),
"""


def _station_pairs(m):
    pairs = m.obs.filter(F.size("path") > 0).select(F.try_element_at("path", F.lit(-1)).alias("hop"), F.lower("observer_id").alias("ctx")).distinct()
    return pairs, pairs.select("ctx", F.col("ctx").alias("key")).distinct()


@query("resolve_hops", M.sql("edges", _STATION_PAIRS + M.resolve_cte("pairs", "pctx") + """
SELECT hop, ctx, pubkey, method, round(score, 9) AS score, name FROM res LEFT JOIN relays n ON n.public_key = pubkey"""))
def _(m):
    pairs, ctx = _station_pairs(m)
    return R.resolve_hops(pairs, ctx, m.nodes, edges(m), NOW).select(
        "hop", "ctx", "pubkey", "method", F.round("score", 9).alias("score"), "name")


@query("hop_context", M.sql("best pst", ", " + M.HEADS + ",\n" + M.context_cte() + "\nSELECT id, key FROM hctx"))
def _(m):
    return R.hop_context(R.packet_heads(m.tx, P.best_observation(m.obs, ("observer_id", "path"))), m.nodes)


@query("resolve_hops_report", M.sql("edges", _STATION_PAIRS + M.resolve_cte("pairs", "pctx") + """
SELECT r.hop, r.ctx, c.public_key AS candidate, c.name, c.role, round(coalesce(x.w, 0), 9) AS affinity, coalesce(x.count, 0)::BIGINT AS count,
  c.public_key = r.pubkey AS chosen, method, CASE WHEN method IN ('unique_prefix', 'neighbor_affinity') THEN method ELSE 'ambiguous' END AS confidence
FROM res r JOIN prefixes c ON c.prefix = lower(r.hop) LEFT JOIN res_near x ON x.ctx = r.ctx AND x.other = c.public_key"""))
def _(m):
    pairs, ctx = _station_pairs(m)
    return R.hop_report(pairs, ctx, m.nodes, edges(m), NOW).withColumn("affinity", F.round("affinity", 9))


@query("resolve_path")
def _(m):
    heads = R.packet_heads(m.tx, P.best_observation(m.obs, ("observer_id", "path"))).filter(F.size("path") > 0)
    return R.resolve_paths(heads.select("sender", "observer_id", "path"), m.nodes, edges(m), NOW)


# ---- graph ----

@query("edges_from_observations", M.sql("sure", """
, e AS (SELECT least(known, o) AS node_a, greatest(known, o) AS node_b, cnt, ls FROM (
  SELECT known, cnt, ls, CASE WHEN direct THEN hop WHEN n = 1 THEN lo END AS o FROM feed LEFT JOIN pst ON NOT direct AND prefix = hop) WHERE o IS NOT NULL AND known <> o)
SELECT node_a, node_b, sum(cnt)::BIGINT AS count, max(ls) AS last_seen FROM e GROUP BY 1, 2"""))
def _(m):
    return G.edges_from_observations(m.tx, m.obs, m.nodes)


@query("neighbor_edges", M.sql("edges", "SELECT * FROM edges"))
def _(m):
    return G.neighbor_edges(m.tx, m.obs, m.nodes)


@query("rejected_edges", M.sql("sure", "SELECT coalesce(sum(cnt), 0)::BIGINT AS rejected, count(DISTINCT (node_a, node_b))::BIGINT AS pairs FROM sure WHERE far"))
def _(m):
    return G.rejected_edges(m.tx, m.obs, m.nodes)


_AMB = f", amb AS (SELECT known, hop AS prefix, {M.EDGE_COLS}, max(n2) AS candidates FROM cls WHERE other IS NULL GROUP BY 1, 2)"


@query("ambiguous_edges", M.sql("edges", _AMB + """
SELECT known, prefix, count, snr_sum, snr_count, first_seen, last_seen, observer_count, candidates FROM amb"""))
def _(m):
    return G.ambiguous_edges(m.tx, m.obs, m.nodes)


@query("edge_score", M.sql("edges", f"""
SELECT node_a, node_b, round({M.score('count', 'last_seen')}, 9) AS score, round(least(1e0, greatest(observer_count, 1) / 3e0), 9) AS confidence FROM edges"""))
def _(m):
    return G.edge_score(edges(m), NOW).select("node_a", "node_b", F.round("score", 9).alias("score"), F.round("confidence", 9).alias("confidence"))


# ambiguous edges resolved in the context of their known node
_FOUND = _AMB + """, apairs AS (SELECT DISTINCT prefix AS hop, known AS ctx FROM amb), actx AS (SELECT DISTINCT ctx, ctx AS key FROM apairs),
""" + M.resolve_cte("apairs", "actx", "ar") + f""", found AS (SELECT ctx AS known, hop AS prefix, pubkey, method FROM ar
  WHERE method IN ('unique_prefix', 'neighbor_affinity', 'geo_proximity') AND pubkey <> ctx),
rows2 AS (SELECT node_a, node_b, observer, cnt, ssum, scnt, fs, ls FROM sure WHERE NOT far
  UNION ALL SELECT least(c.known, pubkey), greatest(c.known, pubkey), observer, cnt, ssum, scnt, fs, ls FROM cls c
  JOIN found f ON f.known = c.known AND f.prefix = c.hop WHERE c.other IS NULL),
edges2 AS (SELECT node_a, node_b, {M.EDGE_COLS} FROM rows2 GROUP BY 1, 2)"""


@query("resolve_ambiguous", M.sql("edges", _FOUND + "SELECT * FROM edges2"))
def _(m):
    return G.resolve_ambiguous(m.tx, m.obs, m.nodes, NOW)


# what is left then, resolved by similarity of neighborhoods
_JACC = _FOUND + f""", rest AS (SELECT c.* FROM cls c LEFT JOIN found f ON f.known = c.known AND f.prefix = c.hop WHERE c.other IS NULL AND f.known IS NULL),
resta AS (SELECT known, hop AS prefix, {M.EDGE_COLS}, max(n2) AS candidates FROM rest GROUP BY 1, 2),
both2 AS (SELECT node_a AS key, node_b AS other FROM edges2 UNION SELECT node_b, node_a FROM edges2),
jc AS (SELECT a.known, a.prefix, c.public_key AS candidate,
  (SELECT count(*) FROM both2 x JOIN both2 y ON x.other = y.other WHERE x.key = a.known AND y.key = c.public_key) AS i,
  (SELECT count(*) FROM both2 x WHERE x.key = a.known) AS dk, (SELECT count(*) FROM both2 y WHERE y.key = c.public_key) AS dc
  FROM resta a JOIN prefixes c ON c.prefix = a.prefix AND c.public_key <> a.known WHERE a.count >= 3 AND a.candidates >= 2),
js AS (SELECT *, CASE WHEN dk + dc - i > 0 THEN i / (dk + dc - i) ELSE 0 END AS jaccard FROM jc),
jr AS (SELECT *, row_number() OVER (PARTITION BY known, prefix ORDER BY jaccard DESC, candidate) AS r FROM js),
pick AS (SELECT a.known, a.prefix, a.candidate AS pubkey FROM jr a JOIN jr b ON a.known = b.known AND a.prefix = b.prefix AND b.r = 2
  WHERE a.r = 1 AND CASE WHEN b.jaccard = 0 THEN a.jaccard > 0 ELSE a.jaccard / b.jaccard >= 3 END),
rows3 AS (SELECT * FROM rows2 UNION ALL SELECT least(c.known, pubkey), greatest(c.known, pubkey), observer, cnt, ssum, scnt, fs, ls
  FROM rest c JOIN pick f ON f.known = c.known AND f.prefix = c.hop),
edges3 AS (SELECT node_a, node_b, {M.EDGE_COLS} FROM rows3 GROUP BY 1, 2),
open3 AS (SELECT known, hop AS prefix, {M.EDGE_COLS}, max(n2) AS candidates FROM (SELECT c.* FROM rest c LEFT JOIN pick f ON f.known = c.known AND f.prefix = c.hop WHERE f.known IS NULL) GROUP BY 1, 2),
full3 AS (SELECT node_a, node_b, '' AS prefix, false AS ambiguous, 0 AS candidates, count, first_seen, last_seen, snr_sum, snr_count, observer_count FROM edges3
  UNION ALL SELECT known, NULL, prefix, true, candidates, count, first_seen, last_seen, snr_sum, snr_count, observer_count FROM open3)
"""


@query("jaccard_disambiguate", M.sql("edges", _JACC + "SELECT * FROM edges3"))
def _(m):
    return G.jaccard_disambiguate(m.tx, m.obs, m.nodes, NOW)


def _graph(m):
    return cut_lineage(G.full_graph(m.tx, m.obs, m.nodes, NOW))


_INFO = """, info AS (SELECT public_key AS key, name, role, lat, lon FROM nodes UNION ALL
  SELECT lower(id), name, 'observer', NULL, NULL FROM observers WHERE lower(id) NOT IN (SELECT public_key FROM nodes))"""


@query("node_neighbors", M.sql("edges observers", _JACC + _INFO + f""",
sc AS (SELECT *, {M.score('count', 'last_seen')} AS score FROM full3 WHERE count >= 2),
sides AS (SELECT node_a AS node, node_b AS neighbor, * FROM sc WHERE NOT ambiguous UNION ALL SELECT node_b, node_a, * FROM sc WHERE NOT ambiguous),
loose AS (SELECT node_a AS node, * FROM sc WHERE ambiguous),
fits AS (SELECT l.node, l.prefix, count(*) AS m, min(s.neighbor) AS neighbor FROM loose l JOIN sides s ON s.node = l.node AND starts_with(s.neighbor, l.prefix) GROUP BY 1, 2),
fold AS (SELECT l.node, f.neighbor, sum(l.count) AS more, max(l.last_seen) AS later FROM loose l JOIN fits f ON f.node = l.node AND f.prefix = l.prefix AND m = 1 GROUP BY 1, 2),
allr AS (SELECT s.node, s.neighbor, '' AS prefix, s.count + coalesce(more, 0) AS count, score, first_seen, greatest(last_seen, coalesce(later, last_seen)) AS last_seen, snr_sum, snr_count, false AS ambiguous
  FROM sides s LEFT JOIN fold f ON f.node = s.node AND f.neighbor = s.neighbor
  UNION ALL SELECT l.node, NULL, l.prefix, count, score, first_seen, last_seen, snr_sum, snr_count, true FROM loose l
  LEFT JOIN fits f ON f.node = l.node AND f.prefix = l.prefix AND m = 1 WHERE f.node IS NULL)
SELECT node, neighbor, b.name AS neighbor_name, b.role AS neighbor_role, prefix, count::BIGINT AS count, round(score, 9) AS score, first_seen, last_seen,
  round(CASE WHEN snr_count > 0 THEN snr_sum / snr_count END, 6) AS avg_snr, ambiguous,
  round(CASE WHEN a.lat IS NOT NULL AND NOT (a.lat = 0 AND a.lon = 0) AND b.lat IS NOT NULL AND NOT (b.lat = 0 AND b.lon = 0) THEN {M.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} END, 6) AS distance_km
FROM allr LEFT JOIN info a ON a.key = node LEFT JOIN info b ON b.key = neighbor"""))
def _(m):
    return G.node_neighbors(_graph(m), m.nodes, m.observers, NOW, min_count=2).withColumns(
        {c: F.round(c, d) for c, d in (("score", 9), ("avg_snr", 6), ("distance_km", 6))})


_GE = _JACC + _INFO + f""", ge AS (SELECT node_a AS source, coalesce(node_b, 'prefix:' || prefix) AS target, count AS weight, {M.score('count', 'last_seen')} AS score, ambiguous,
  CASE WHEN snr_count > 0 THEN snr_sum / snr_count END AS avg_snr FROM full3 WHERE count >= 5)
"""


@query("neighbor_graph_edges", M.sql("edges observers", _GE + """
SELECT source, target, weight, round(score, 9) AS score, ambiguous, round(avg_snr, 6) AS avg_snr FROM ge WHERE score >= 0.001
  AND (source IN (SELECT key FROM info WHERE role = 'room') OR target IN (SELECT key FROM info WHERE role = 'room'))"""))
def _(m):
    return G.graph_edges(_graph(m), m.nodes, m.observers, NOW, min_score=0.001, role="ROOM").withColumns(
        {"score": F.round("score", 9), "avg_snr": F.round("avg_snr", 6)})


@query("neighbor_graph_nodes", M.sql("edges observers", _GE + """
, ends AS (SELECT source AS key FROM ge WHERE score >= 0.001 UNION ALL SELECT target FROM ge WHERE score >= 0.001)
SELECT e.key, count(*)::BIGINT AS neighbor_count, any_value(name) AS name, any_value(role) AS role FROM ends e LEFT JOIN info i ON i.key = e.key WHERE NOT starts_with(e.key, 'prefix:') GROUP BY e.key"""))
def _(m):
    return G.graph_nodes(G.graph_edges(_graph(m), m.nodes, m.observers, NOW, min_score=0.001), m.nodes, m.observers)


@query("neighbor_graph_stats", M.sql("edges observers", _GE + """
, k AS (SELECT source AS key FROM ge WHERE score >= 0.001 UNION SELECT target FROM ge WHERE score >= 0.001)
SELECT (SELECT count(*) FROM k WHERE NOT starts_with(key, 'prefix:'))::BIGINT AS total_nodes, count(*)::BIGINT AS total_edges, count(*) FILTER (ambiguous)::BIGINT AS ambiguous_edges,
  count(*) * 2e0 / (SELECT count(*) FROM k WHERE NOT starts_with(key, 'prefix:')) AS avg_cluster_size FROM ge WHERE score >= 0.001"""))
def _(m):
    return G.graph_stats(G.graph_edges(_graph(m), m.nodes, m.observers, NOW, min_score=0.001), m.nodes, m.observers)


@query("affinity_debug", M.sql("edges", _JACC + f"""
, cov AS (SELECT prefix, sum(count) AS c FROM amb WHERE length(prefix) = 2 GROUP BY 1)
SELECT count(*)::BIGINT AS total_edges, count(*) FILTER (NOT ambiguous)::BIGINT AS resolved, count(*) FILTER (ambiguous AND candidates > 0)::BIGINT AS ambiguous,
  count(*) FILTER (ambiguous AND candidates = 0)::BIGINT AS unresolved, {M.half_away(f"avg({M.score('count', 'last_seen')}) FILTER (NOT ambiguous)", 3)} AS avg_score,
  (SELECT {M.half_away("count(*) FILTER (c >= 3) * 100e0 / count(*)", 1)} FROM cov) AS cold_start_coverage FROM full3"""))
def _(m):
    return G.affinity_debug(_graph(m), G.ambiguous_edges(m.tx, m.obs, m.nodes), NOW)


@query("affinity_candidates", M.sql("edges", _JACC.replace("WHERE a.count >= 3 AND a.candidates >= 2", "WHERE a.candidates >= 2") + f"""
SELECT known, prefix, candidate, {M.half_away('jaccard', 3)} AS jaccard FROM js"""))
def _(m):
    rows, amb, found = G._context_stage(m.tx, m.obs, m.nodes, NOW)
    rows, rest = (cut_lineage(t) for t in G._merge(rows, amb, found))
    left = rest.groupBy("known", F.col("hop").alias("prefix")).agg(F.max("candidates").alias("candidates"))
    return G.affinity_candidates(left, m.nodes, G.edge_table(rows))


@query("path_inspect")
def _(m):
    best = P.best_observation(m.obs, ("path",)).filter(F.size("path") > 0).select("path").distinct()
    req = best.select(F.array_join("path", ",").alias("id"), F.col("path").alias("prefixes"))
    return G.path_inspect(req, m.nodes, edges(m), NOW, limit=3)


@query("resolve_path_regional")
def _(m):
    """All ways of the packets' best observations; a region's centre is the mean position of its stations."""
    place = m.nodes.filter(geo.has_gps(F.col("lat"), F.col("lon"))).select(F.lower("public_key").alias("_k"), "lat", "lon")
    heads = R.packet_heads(m.tx, m.best)
    for col, end in (("sender", "origin"), ("observer_id", "station")):
        p = place.select(F.col("_k").alias(f"_{end}"), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon"))
        heads = heads.join(p, F.lower(col) == F.col(f"_{end}"), "left").drop(f"_{end}")
    at = m.observers.join(place, F.lower("id") == F.col("_k")).groupBy(F.upper(F.trim("iata")).alias("iata")).agg(
        F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))
    return X.resolve_path_regional(heads, m.nodes, edges(m), NOW, m.observers, at).select(
        "path", "observer_id", "origin_lat", "origin_lon", "pos", "hop", "pubkey", "method", "candidates", "regional", "unreliable")
