"""DuckDB common table expressions that read the driver's tables as mesh tables."""

from __future__ import annotations

MACROS = ""  # the driver runs one statement per query, so helpers are inlined as text

NOW = 1706659200


def key(expr: str) -> str:
    return f"sha256('n' || ({expr})::VARCHAR)"


def le(expr: str, n: int) -> str:
    h = f"printf('%0{2 * n}x', (({expr})::BIGINT % {1 << (8 * n)} + {1 << (8 * n)}) % {1 << (8 * n)})"
    return "(" + " || ".join(f"substr({h}, {2 * i + 1}, 2)" for i in reversed(range(n))) + ")"


def lat(k: str) -> str:
    return (f"CASE WHEN {k} % 13 = 0 THEN NULL WHEN {k} % 11 = 0 THEN 0e0 ELSE "
            f"(4000 + (({k} // 20) % 10) * 50 + ({k} % 20) * 5) / 100 END")


def lon(k: str) -> str:
    return (f"CASE WHEN {k} % 13 = 0 THEN NULL WHEN {k} % 11 = 0 THEN 0e0 ELSE "
            f"(-12000 + (({k} // 20 // 10) % 20) * 50 + (({k} * 7) % 20) * 5) / 100 END")


def channel_byte(name: str) -> str:
    return f"('0x' || substr(sha256(unhex(substr(sha256({name}), 1, 32))), 1, 2))::INTEGER::VARCHAR"


def hops(cluster: str, shift: str, count: str, size: str) -> str:
    return (f"list_transform(range(greatest({count}, 0)), lambda i: "
            f"upper(substr({key(f'({cluster}) * 20 + 5 * ((({shift}) + i) % 4) + i % 3')}, 1, ({size}) * 2)))")


NODES = f"""
nodes AS (SELECT {key('p_partkey')} AS public_key, p_name || ' ' || (p_partkey % 97) AS name,
  CASE WHEN p_partkey % 5 <= 1 THEN 'repeater' WHEN p_partkey % 10 = 2 THEN 'room' WHEN p_partkey % 5 = 2 THEN 'room_server'
       WHEN p_partkey % 5 = 3 THEN 'companion' ELSE 'sensor' END AS role,
  {lat('p_partkey')} AS lat, {lon('p_partkey')} AS lon,
  {NOW} - (p_partkey % 400) * 3600 AS last_seen, {NOW} - (p_partkey % 400) * 3600 - 2592000 AS first_seen,
  (p_partkey % 50)::INTEGER AS advert_count, (2800 + (p_partkey * 37) % 1500)::INTEGER AS battery_mv
  FROM part)"""

OBSERVERS = f"""
observers AS (SELECT upper({key('s_suppkey * 20')}) AS id, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE s_name END AS name,
  CASE WHEN s_suppkey % 7 = 0 THEN ' ' || lower(substr(r_name, 1, 3)) ELSE upper(substr(r_name, 1, 3)) END AS iata,
  {NOW} - (s_suppkey % 100) * 60 AS last_seen, s_suppkey % 17 = 0 AS inactive, s_suppkey * 11 AS packet_count,
  'v1.' || (s_suppkey % 4) AS firmware, (3000 + s_suppkey % 1200)::INTEGER AS battery_mv,
  (-120 + s_suppkey % 30)::DOUBLE AS noise_floor
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

ORD = """
ord AS (SELECT o_orderkey AS o, o_custkey AS c, o_totalprice AS price,
  (1704067200 + (date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % 30) * 86400 + (o_orderkey * 7919) % 86400)::BIGINT AS sec,
  ((o_orderkey // 3) % 4)::INTEGER AS route, (CASE WHEN o_orderkey % 97 = 0 THEN 4 ELSE 1 + o_orderkey % 3 END)::INTEGER AS size,
  (CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 5 WHEN '3' THEN 2 WHEN '4' THEN 8 ELSE
    CASE o_orderkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 7 WHEN 4 THEN 9 ELSE 10 END END)::INTEGER AS ptype
  FROM orders)"""

TALK = """
talk AS (SELECT 1000000000000 + conv_id * 1000 + turn AS k, conv_id, turn, role AS who, text,
  (1704067200 + (conv_id * 7907 + turn * 61) % 2592000)::BIGINT AS sec FROM conversations)"""

ADVERT_SECS = ("CASE WHEN c % 10 <= 5 THEN sec + o % 7 - 3 WHEN c % 10 = 6 THEN sec + 900 + o % 30 "
               "WHEN c % 10 = 7 THEN sec - 90000 WHEN c % 10 = 8 THEN 86400 * (o % 100) "
               "ELSE CASE WHEN o % 3 = 0 THEN 1600000000 + o % 1000 ELSE sec END END")

# light header view: no frame bytes
_TX_COMMON = f"""
  substr(md5('t' || o), 1, 16) AS hash, sec AS first_seen, route AS route_type, ptype AS payload_type,
  CASE WHEN ptype = 4 THEN 'ADVERT' WHEN ptype = 5 AND o % 4 = 0 THEN 'GRP_TXT' WHEN ptype = 5 THEN 'CHAN'
       WHEN ptype = 2 THEN 'TXT_MSG' END AS d_type,
  CASE WHEN ptype = 4 THEN {key('c')} END AS d_pubkey,
  CASE WHEN ptype = 2 AND o % 2 = 0 THEN {key('c + 1')} END AS d_dest,
  CASE WHEN ptype = 2 AND o % 4 = 0 THEN {key('c')} END AS d_src,
  CASE WHEN ptype = 4 THEN 'node ' || c END AS d_name,
  CASE WHEN ptype = 4 THEN {ADVERT_SECS} END AS d_timestamp,
  CASE WHEN ptype = 4 THEN coalesce({lat('c')}, 0e0) END AS d_lat,
  CASE WHEN ptype = 4 THEN coalesce({lon('c')}, 0e0) END AS d_lon,
  CASE WHEN ptype = 5 AND o % 4 <> 0 THEN '#chan' || (o % 7) END AS d_channel,
  CASE WHEN ptype = 5 AND o % 4 <> 0 THEN {channel_byte("'#chan' || (o % 7)")}
       WHEN ptype = 5 THEN (o % 16)::VARCHAR END AS d_channelhash,
  CASE WHEN ptype = 5 AND o % 4 = 0 THEN printf('%02X', o % 16) END AS d_hashhex,
  CASE WHEN ptype = 5 AND o % 4 = 0 THEN 'no_key' WHEN ptype = 5 THEN 'decrypted' END AS d_status,
  CASE WHEN ptype = 5 AND o % 4 <> 0 THEN 'user' || (c % 50) || ': order ' || o || ' see #topic' || (o % 11)
    || CASE WHEN o % 5 = 0 THEN ' and #chan' || (o % 9) ELSE '' END END AS d_text,
  CASE WHEN ptype = 5 AND o % 4 <> 0 AND o % 3 <> 0 THEN 'user' || (c % 50) END AS d_sender,
  CASE WHEN ptype IN (0, 1, 2, 8) THEN substr({key('c')}, 1, 2) END AS d_srchash,
  CASE WHEN ptype IN (0, 1, 2, 8) THEN substr({key('c + 1')}, 1, 2) END AS d_desthash,
  CASE WHEN ptype = 2 AND o % 8 = 2 THEN {key('c')} END AS d_sender_key,
  CASE WHEN ptype = 2 AND o % 8 = 2 THEN 'node ' || c END AS d_sender_name,
  CASE WHEN ptype = 2 AND o % 8 = 2 THEN {key('c + 1')} END AS d_recipient_key,
  CASE WHEN ptype = 2 AND o % 8 = 2 THEN 'node ' || (c + 1) END AS d_recipient_name,
  CASE WHEN ptype = 4 THEN {key('c')} END AS from_pubkey,
  CASE WHEN ptype = 5 AND o % 4 <> 0 THEN '#chan' || (o % 7) WHEN ptype = 5 THEN 'enc_' || printf('%02X', o % 16) END AS channel_hash"""

_TALK_TX = f"""
  SELECT k AS id, '1500' || md5('c' || k) AS raw_hex, substr(md5('c' || k), 1, 16) AS hash, sec AS first_seen, 1 AS route_type, 5 AS payload_type,
  'CHAN' AS d_type, NULL AS d_pubkey, NULL AS d_dest, NULL AS d_src, NULL AS d_name, NULL AS d_timestamp, NULL AS d_lat,
  NULL AS d_lon, 'talk' || (conv_id % 8) AS d_channel,
  CASE WHEN conv_id % 3 = 0 THEN '300' ELSE {channel_byte("'#talk' || (conv_id % 8)")} END AS d_channelhash,
  NULL AS d_hashhex, 'decrypted' AS d_status, who || ': ' || text AS d_text,
  CASE WHEN turn % 2 = 0 THEN who END AS d_sender, NULL AS d_srchash, NULL AS d_desthash, NULL AS d_sender_key,
  NULL AS d_sender_name, NULL AS d_recipient_key, NULL AS d_recipient_name, NULL AS from_pubkey,
  'talk' || (conv_id % 8) AS channel_hash FROM talk"""

_FLAGS = "(CASE WHEN c % 5 <= 1 THEN 2 WHEN c % 5 = 2 THEN 3 WHEN c % 5 = 3 THEN 1 ELSE 4 END) + 144"
_BODY = f"""CASE WHEN ptype = 4 THEN {key('c')} || {le(ADVERT_SECS, 4)} || sha256({key('c')}) || sha256({key('c')} || 's')
    || printf('%02x', {_FLAGS})
    || {le(f"round(coalesce({lat('c')}, 0e0) * 1000000)", 4)} || {le(f"round(coalesce({lon('c')}, 0e0) * 1000000)", 4)}
    || lower(hex('node ' || c))
    || CASE WHEN c % 5 = 4 THEN '00' || {le('3000 + c % 1000', 2)} || {le('(c % 60) * 100 - 1000', 2)} ELSE '' END
  ELSE md5('b' || o) END"""
_RAW = f"""printf('%02x', route + ptype * 4) || CASE WHEN route IN (0, 3) THEN '01020304' ELSE '' END
  || printf('%02x', (size - 1) * 64 + o % 5)
  || lower(array_to_string({hops('c // 20', 'o', 'o % 5', 'least(size, 3)')}, '')) || {_BODY}"""

TX = f"{ORD},{TALK},\ntx AS (SELECT o AS id, {_RAW} AS raw_hex, {_TX_COMMON} FROM ord UNION ALL {_TALK_TX})"

OBS = f"""
obs AS (SELECT ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
    round(l_quantity * 100)::BIGINT, round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT,
    round(l_tax * 100)::BIGINT, l_returnflag, l_linestatus, epoch(l_shipdate)::BIGINT)), 1, 13))::BIGINT AS id,
  l_orderkey AS transmission_id, upper({key('l_suppkey * 20')}) AS observer_id,
  CASE WHEN round(l_tax * 100) <> 0 THEN round(l_discount * 100) * 2.5::DOUBLE - 10 + l_linenumber * 0.25::DOUBLE END AS snr,
  CASE WHEN round(l_tax * 100) <> 0 OR l_returnflag <> 'R' THEN l_quantity::INTEGER - 120.0::DOUBLE END AS rssi,
  l_quantity::INTEGER AS score,
  {hops('l_suppkey', 'o', 'CASE WHEN l_partkey % 50 = 0 THEN 10 ELSE l_linenumber - 1 END', 'least(size, 3)')} AS path,
  list_transform(range(CASE WHEN l_partkey % 50 = 0 THEN 10 ELSE l_linenumber - 1 END), lambda i:
    CASE WHEN size > 1 OR i % 2 = 0 THEN {key('l_suppkey * 20 + 5 * ((o + i) % 4) + i % 3')} END) AS resolved_path,
  sec + l_linenumber * 3 AS timestamp
  FROM lineitem JOIN ord ON l_orderkey = o
  UNION ALL
  SELECT k * 10, k, upper({key('(conv_id % 10) * 20')}), turn * 0.5::DOUBLE, -90.0::DOUBLE, 1,
  {hops('conv_id % 10', 'k', 'conv_id % 3', '2')},
  list_transform({hops('conv_id % 10', 'k', 'conv_id % 3', '32')}, lambda h: lower(h)),
  sec + 1 FROM talk)"""

METRICS = f"""
metrics AS (SELECT upper({key('user_id * 20')}) AS observer_id, floor(epoch(ts))::BIGINT AS timestamp,
  -120.0::DOUBLE + event_id % 20 AS noise_floor, (up * (1 + user_id % 3)) // 20 AS tx_air_secs, up // 9 AS rx_air_secs,
  up // 700 AS recv_errors, CASE WHEN event_id % 5 <> 0 THEN (3000 + event_id % 1500)::INTEGER END AS battery_mv,
  up // 11 AS packets_sent, up // 7 AS packets_recv, up AS uptime_secs, (event_id % 6)::INTEGER AS queue_len, event_id AS seq
  FROM (SELECT *, (floor(epoch(ts))::BIGINT + user_id * 1000) % 432000 AS up FROM events))"""

# best observation per transmission: longest path, then newest, then smallest id
BEST = """
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transmission_id
    ORDER BY len(path) DESC, timestamp DESC, id) AS best_rn FROM obs) WHERE best_rn = 1)"""

# relays by every hex prefix a hop can carry (2..8 and 16 characters) plus the full key
PREFIXES = """
relays AS (SELECT * FROM nodes WHERE role IN ('repeater', 'room', 'room_server')),
prefixes AS (SELECT substr(public_key, 1, n) AS prefix, r.* FROM relays r, (SELECT unnest([2, 3, 4, 5, 6, 7, 8, 16]) AS n)
  UNION ALL SELECT public_key AS prefix, r.* FROM relays r)"""

TYPE_NAME = ("CASE {c} WHEN 0 THEN 'REQ' WHEN 1 THEN 'RESPONSE' WHEN 2 THEN 'TXT_MSG' WHEN 3 THEN 'ACK' "
             "WHEN 4 THEN 'ADVERT' WHEN 5 THEN 'GRP_TXT' WHEN 7 THEN 'ANON_REQ' WHEN 8 THEN 'PATH' WHEN 9 THEN 'TRACE' "
             "WHEN 11 THEN 'CONTROL' ELSE CASE WHEN {c} IS NULL THEN 'UNK' ELSE 'UNK(' || {c} || ')' END END")


def type_name(col: str) -> str:
    return TYPE_NAME.format(c=col)


def haversine(a1: str, o1: str, a2: str, o2: str) -> str:
    a = (f"(pow(sin(radians({a2} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) "
         f"* pow(sin(radians({o2} - {o1}) / 2), 2))")
    return f"(12742e0 * atan2(sqrt({a}), sqrt(1 - {a})))"


def half_away(x: str, d: int) -> str:
    return f"(sign({x}) * floor(abs({x}) * {10 ** d} + 0.5e0) / {10 ** d})"


_PARTS = {"nodes": [NODES], "observers": [OBSERVERS], "tx": [TX], "obs": [TX, OBS], "metrics": [METRICS],
          "best": [TX, OBS, BEST], "prefixes": [NODES, PREFIXES]}


def sql(views: str, body: str) -> str:
    """``WITH`` the named views (and what they need) in front of a query body.

    A body may start with further CTEs, written as ``, name AS (...) SELECT ...``.
    """
    parts: list[str] = []
    for v in views.split():
        for p in _PARTS[v]:
            if p not in parts:
                parts.append(p)
    return "WITH " + ",".join(parts) + "\n" + body


# ---- neighbor graph and hop resolution -------------------------------------------------

PST = """
pst AS (SELECT prefix, count(*) AS n, min(public_key) AS lo, max(public_key) AS hi FROM prefixes GROUP BY prefix)"""

FEED = """
feed AS (SELECT known, hop, direct, observer, count(*) AS cnt, coalesce(sum(snr), 0) AS ssum, count(snr) AS scnt, min(timestamp) AS fs, max(timestamp) AS ls FROM (
  SELECT lower(d_pubkey) AS known, CASE WHEN len(path) > 0 THEN lower(path[1]) ELSE lower(observer_id) END AS hop, len(path) = 0 AS direct,
    lower(observer_id) AS observer, snr, timestamp FROM obs JOIN tx ON transmission_id = tx.id WHERE payload_type = 4 AND d_pubkey <> ''
  UNION ALL SELECT lower(observer_id), lower(path[len(path)]), false, lower(observer_id), snr, timestamp FROM obs WHERE len(path) > 0)
  WHERE known <> hop GROUP BY ALL),
cls AS (SELECT *, CASE WHEN direct THEN hop WHEN n = 1 AND n2 = 1 THEN lo WHEN n = 2 AND n2 = 1 THEN CASE WHEN lo = known THEN hi ELSE lo END END AS other
  FROM (SELECT f.*, n, lo, hi, coalesce(n, 0) - CASE WHEN me.public_key IS NOT NULL AND starts_with(known, hop) THEN 1 ELSE 0 END AS n2,
     coalesce(n = 1 AND me.public_key IS NOT NULL AND starts_with(known, hop), false) AS only_me
   FROM feed f LEFT JOIN pst ON NOT direct AND hop = prefix LEFT JOIN relays me ON known = me.public_key) WHERE NOT only_me),
gpsn AS (SELECT public_key, lat, lon FROM nodes WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)),
sure AS (SELECT * FROM (SELECT least(known, other) AS node_a, greatest(known, other) AS node_b, observer, cnt, ssum, scnt, fs, ls,
    coalesce({HAV} > 500, false) AS far
  FROM cls LEFT JOIN gpsn a ON a.public_key = least(known, other) LEFT JOIN gpsn b ON b.public_key = greatest(known, other)
  WHERE other IS NOT NULL AND known <> other))"""
FEED = FEED.replace("{HAV}", haversine("a.lat", "a.lon", "b.lat", "b.lon"))

EDGE_COLS = ("sum(cnt)::BIGINT AS count, sum(ssum) AS snr_sum, sum(scnt)::BIGINT AS snr_count, min(fs) AS first_seen, max(ls) AS last_seen, "
             "count(DISTINCT observer)::BIGINT AS observer_count")
EDGES = f"""
edges AS (SELECT node_a, node_b, {EDGE_COLS} FROM sure WHERE NOT far GROUP BY 1, 2)"""


def score(count: str, last: str) -> str:
    return f"(least(1e0, {count} / 100e0) * exp(greatest(({NOW} - {last}) / 3600e0, 0) * (-ln(2e0) / 168e0)))"


def neighbors_cte(name: str = "nbr", edges: str = "edges") -> str:
    w = f"{score('count', 'last_seen')} * least(1e0, greatest(observer_count, 1) / 3e0)"
    return f"""{name} AS (SELECT node_a AS key, node_b AS other, {w} AS w, count FROM {edges}
  UNION ALL SELECT node_b, node_a, {w}, count FROM {edges})"""


def resolve_cte(pairs: str, ctx: str, name: str = "res", edges: str = "edges") -> str:
    """CTEs that resolve ``pairs(hop, ctx)`` in contexts ``ctx(ctx, key)`` into ``res(hop, ctx, pubkey, method, score)``."""
    n = name
    return f"""{neighbors_cte(n + '_nbr', edges)},
{n}_p AS (SELECT DISTINCT hop, ctx FROM {pairs}),
{n}_near AS (SELECT ctx, other, w, count FROM (SELECT c.ctx, b.other, b.w, b.count,
    row_number() OVER (PARTITION BY c.ctx, b.other ORDER BY b.w DESC, b.count DESC) AS r FROM {ctx} c JOIN {n}_nbr b USING (key)) WHERE r = 1),
{n}_aff AS (SELECT p.hop, p.ctx, x.other, x.w, x.count,
    row_number() OVER (PARTITION BY p.hop, p.ctx ORDER BY x.w DESC, x.count DESC, x.other) AS r
  FROM {n}_p p JOIN pst ON pst.prefix = lower(p.hop) AND pst.n > 1 JOIN {n}_near x ON x.ctx = p.ctx
  JOIN prefixes c ON c.prefix = lower(p.hop) AND c.public_key = x.other WHERE x.w > 0),
{n}_win AS (SELECT a.hop, a.ctx, a.other, a.w FROM {n}_aff a LEFT JOIN {n}_aff b ON b.hop = a.hop AND b.ctx = a.ctx AND b.r = 2
  WHERE a.r = 1 AND a.count >= 3 AND (b.w IS NULL OR a.w >= 3 * b.w)),
{n}_mid AS (SELECT ctx, round(avg(g.lat), 9) AS clat, round(avg(g.lon), 9) AS clon FROM {ctx} JOIN gpsn g ON g.public_key = key
  JOIN relays r ON r.public_key = key GROUP BY ctx) ,
{n}_geo AS (SELECT hop, ctx, public_key AS other FROM (SELECT p.hop, p.ctx, c.public_key,
    row_number() OVER (PARTITION BY p.hop, p.ctx ORDER BY round(sqrt(pow(radians(c.lat - clat), 2) + pow(radians(c.lon - clon) * cos(radians((clat + c.lat) / 2)), 2)), 12), c.public_key) AS r
  FROM {n}_p p JOIN {n}_mid m ON m.ctx = p.ctx JOIN pst ON pst.prefix = lower(p.hop) AND pst.n > 1
  JOIN prefixes c ON c.prefix = lower(p.hop) AND c.lat IS NOT NULL AND c.lon IS NOT NULL AND NOT (c.lat = 0 AND c.lon = 0)) WHERE r = 1),
{n}_fav AS (SELECT prefix, max(CASE WHEN rg = 1 AND gps THEN public_key END) AS fg, max(CASE WHEN ra = 1 THEN public_key END) AS fa FROM (
    SELECT prefix, public_key, lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) AS gps,
      row_number() OVER (PARTITION BY prefix, lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) ORDER BY advert_count DESC, public_key) AS rg,
      row_number() OVER (PARTITION BY prefix ORDER BY advert_count DESC, public_key) AS ra FROM prefixes) GROUP BY prefix),
{n} AS (SELECT p.hop, p.ctx,
    CASE WHEN pst.n = 1 THEN pst.lo ELSE coalesce(w.other, g.other, fg, fa) END AS pubkey,
    CASE WHEN pst.n IS NULL THEN 'no_match' WHEN pst.n = 1 THEN 'unique_prefix' WHEN w.other IS NOT NULL THEN 'neighbor_affinity'
      WHEN g.other IS NOT NULL THEN 'geo_proximity' WHEN fg IS NOT NULL THEN 'gps_preference' ELSE 'observation_count_fallback' END AS method,
    CASE WHEN pst.n = 1 THEN 1e0 WHEN pst.n > 1 THEN coalesce(w.w, 0e0) ELSE 0e0 END AS score
  FROM {n}_p p LEFT JOIN pst ON pst.prefix = lower(p.hop) LEFT JOIN {n}_win w ON w.hop = p.hop AND w.ctx = p.ctx
  LEFT JOIN {n}_geo g ON g.hop = p.hop AND g.ctx = p.ctx LEFT JOIN {n}_fav f ON f.prefix = lower(p.hop))"""


# context keys of a packet selection heads(id, sender, observer_id, path)
def context_cte(heads: str = "heads", name: str = "hctx") -> str:
    return f"""{name} AS (SELECT DISTINCT id, key FROM (SELECT id, lower(sender) AS key FROM {heads} WHERE sender <> ''
  UNION ALL SELECT id, lower(observer_id) FROM {heads} WHERE length(observer_id) >= 4
  UNION ALL SELECT id, lo FROM (SELECT id, unnest(path) AS h FROM {heads}) JOIN pst ON prefix = lower(h) AND n = 1))"""


HEADS = """heads AS (SELECT tx.id, d_pubkey AS sender, observer_id, path FROM tx JOIN best ON best.transmission_id = tx.id)"""

_PARTS.update({"pst": [NODES, PREFIXES, PST], "sure": [NODES, PREFIXES, PST, TX, OBS, FEED],
               "edges": [NODES, PREFIXES, PST, TX, OBS, FEED, EDGES]})
