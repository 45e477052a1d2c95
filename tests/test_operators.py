"""Hand-made cases and brute-force comparisons for operators that have no SQL counterpart."""

import itertools
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from meshlake.operators import clock as K, frames as X, graph as G, hashes as H, ingest as I, nodes as N, resolve as R
from meshlake.plans import rollups as U

NOW = "2024-01-31T00:00:00Z"


def key(prefix: str, n: int) -> str:
    return prefix + f"{n:0{64 - len(prefix)}x}"


def node(pk, role="repeater", lat=40.0, lon=-100.0, adverts=1, name=None):
    return (pk, name or pk[:6], role, lat, lon, adverts)


def nodes_df(spark, rows):
    return spark.createDataFrame(rows, "public_key string, name string, role string, lat double, lon double, advert_count int").withColumn(
        "last_seen", F.lit("2024-01-30").cast("timestamp"))


def edges_df(spark, rows):
    df = spark.createDataFrame(rows, "node_a string, node_b string, count long, hours int, observer_count long")
    return df.withColumn("last_seen", F.timestamp_seconds(F.lit(1706659200) - F.col("hours") * 3600)).drop("hours")


# ---- resolution ----

A1, A2, B1, C1 = key("aa11", 1), key("aa22", 2), key("bb33", 3), key("cc44", 4)


def resolve(spark, nodes, edges, hop, ctx):
    hops = spark.createDataFrame([(hop, "c")], "hop string, ctx string")
    context = spark.createDataFrame([("c", k) for k in ctx], "ctx string, key string")
    r = R.resolve_hops(hops, context, nodes, edges, NOW).first()
    return r["pubkey"], r["method"]


def test_tiers(spark):
    n = nodes_df(spark, [node(A1, lat=40.0), node(A2, lat=45.0, adverts=9), node(B1, lat=44.9), node(C1, role="companion")])
    none = edges_df(spark, [(key("00", 9), key("01", 9), 1, 0, 1)])
    strong = edges_df(spark, [(A1, B1, 100, 0, 3)])
    close = edges_df(spark, [(A1, B1, 100, 0, 3), (A2, B1, 50, 0, 3)])
    few = edges_df(spark, [(A1, B1, 2, 0, 3)])
    assert resolve(spark, n, none, "CC", [])[1] == "no_match"
    assert resolve(spark, n, none, "AA11", []) == (A1, "unique_prefix")
    assert resolve(spark, n, strong, "AA", [B1]) == (A1, "neighbor_affinity")
    assert resolve(spark, n, close, "AA", [B1]) == (A2, "geo_proximity")
    assert resolve(spark, n, few, "AA", [B1]) == (A2, "geo_proximity")
    assert resolve(spark, n, none, "AA", []) == (A2, "gps_preference")
    bare = nodes_df(spark, [node(A1, lat=0.0, lon=0.0), node(A2, lat=None, lon=None)])
    assert resolve(spark, bare, none, "AA", []) == (A1, "observation_count_fallback")


def test_path_uses_previous_hop(spark):
    n = nodes_df(spark, [node(A1, lat=40.0), node(A2, lat=45.0), node(B1, lat=44.9), node(C1, lat=10.0)])
    none = edges_df(spark, [(key("00", 9), key("01", 9), 1, 0, 1)])
    p = spark.createDataFrame([("", "", ["BB33", "AA"]), ("", "", ["CC44", "DD", "AA"]), ("", "", [])], "sender string, observer_id string, path array<string>")
    got = {tuple(r.path): r.resolved_path for r in R.resolve_paths(p, n, none, NOW).collect()}
    assert got[("BB33", "AA")] == [B1, A2]
    # an unresolved hop leaves no anchor behind it, so the context-free favourite is taken
    assert got[("CC44", "DD", "AA")] == [C1, None, A1]
    assert got[()] == []


# ---- chains ----

def brute_chains(prefixes, relays, edges, now_hours_ago):
    def score(prev, cur, choices):
        e, rec, g = 1.0, 1.0, 1.0
        if prev:
            hit = edges.get(frozenset((prev[0], cur[0])))
            e = rec = 0.0
            if hit:
                cnt, hours = hit
                e = min(1, cnt / 100) * math.exp(-math.log(2) / 168 * hours)
                rec = 1.0 if hours <= 24 else max(0.1, 24 / hours)
            d = haversine(prev, cur)
            g = max(0.1, 50 / d) if d > 50 else 1.0
        return max(0.05, 0.35 * e + 0.20 * g + 0.15 * rec + 0.30 / choices)

    beam = [((), 1.0)]
    for p in prefixes:
        c = [r for r in relays if r[0].startswith(p.lower())]
        nxt = [(b + (r,), s * score(b[-1] if b else None, r, len(c))) for b, s in beam for r in c]
        nxt.sort(key=lambda x: (-round(x[1], 12), ",".join(r[0] for r in x[0])))
        beam = nxt[:20]
    return [([r[0] for r in b], s ** (1 / len(prefixes))) for b, s in beam]


def haversine(a, b):
    la, lo, lb, ob = map(math.radians, (a[1], a[2], b[1], b[2]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
    return 12742 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_path_inspect_equals_brute_force(spark):
    rnd = random.Random(5)
    relays = [(key(f"{p}{i:02x}", i), 40 + rnd.random() * 3, -100 + rnd.random() * 3) for p in ("aa", "bb", "cc") for i in range(7)]
    pairs = rnd.sample(list(itertools.combinations(range(len(relays)), 2)), 40)
    e = {frozenset((relays[i][0], relays[j][0])): (rnd.randrange(1, 150), rnd.randrange(0, 300)) for i, j in pairs}
    nd = nodes_df(spark, [node(k, lat=la, lon=lo) for k, la, lo in relays])
    ed = edges_df(spark, [(min(p), max(p), c, h, 1) for p, (c, h) in e.items()])
    req = [("r1", ["aa", "bb", "cc"]), ("r2", ["cc", "aa", "cc", "bb"]), ("r3", ["bb"]), ("none", ["aa", "ff"])]
    got = {}
    for r in G.path_inspect(spark.createDataFrame(req, "id string, prefixes array<string>"), nd, ed, NOW, 5).collect():
        got.setdefault(r.id, []).append((r.rank, r.path, r.score, r.speculative))
    assert "none" not in got
    for rid, prefixes in req[:3]:
        want = brute_chains(prefixes, relays, e, None)[:5]
        have = sorted(got[rid])
        assert [h[2] for h in have] == pytest.approx([round(s * 1000) / 1000 for _, s in want], abs=1.1e-3)
        assert have[0][1] == want[0][0] and all(h[3] == (h[2] < 0.7) for h in have)


def test_path_inspect_keeps_every_chain_step_and_answer(spark):
    relays = [(key(f"aa{i:02x}", i), 40.0, -100.0) for i in range(30)] + [(key(f"bb{i:02x}", i), 40.0, -100.0) for i in range(2)]
    far, bb = relays[29][0], relays[30][0]  # the only edge starts at the last of thirty equal beginnings
    nd = nodes_df(spark, [node(k, lat=la, lon=lo) for k, la, lo in relays])
    ed = edges_df(spark, [(min(far, bb), max(far, bb), 100, 1, 1)])
    req = [("short", ["aa", "bb"]), ("long", [far, bb] * 33)]
    got = {}
    for r in G.path_inspect(spark.createDataFrame(req, "id string, prefixes array<string>"), nd, ed, NOW, 60).collect():
        got.setdefault(r.id, {})[r.rank] = r.path
    assert got["short"][1] == [far, bb] and len(got["short"]) == 60
    assert got["long"] == {1: [far, bb] * 33}


def test_path_inspect_leaves_out_only_chains_that_cannot_win(spark):
    rnd = random.Random(11)
    relays = [(key(f"{p}{i:02x}", i), *((0.0, 0.0) if rnd.random() < 0.3 else (40 + rnd.random() * 6, -100 + rnd.random() * 6)))
              for p in ("aa", "bb", "cc") for i in range(9)]
    pairs = rnd.sample(list(itertools.combinations(range(len(relays)), 2)), 12)
    e = {frozenset((relays[i][0], relays[j][0])): (rnd.randrange(1, 150), rnd.randrange(0, 300)) for i, j in pairs}

    def hop(a, b):
        c, hours = e.get(frozenset((a[0], b[0])), (0, None))
        d = haversine(a, b) if a[1] and b[1] else 0.0
        rec = 0.0 if hours is None else 1.0 if hours <= 24 else max(0.1, 24 / hours)
        w = 0.0 if hours is None else min(1, c / 100) * math.exp(-math.log(2) / 168 * hours)
        return max(0.05, 0.35 * w + 0.20 * (max(0.1, 50 / d) if d > 50 else 1.0) + 0.15 * rec + 0.30 / 9)

    nd = nodes_df(spark, [node(k, lat=la, lon=lo) for k, la, lo in relays])
    ed = edges_df(spark, [(min(p), max(p), c, h, 1) for p, (c, h) in e.items()])
    req = [(",".join(x), list(x)) for x in (("aa", "bb", "cc"), ("cc", "aa", "bb", "aa"), ("bb", "bb"), ("cc",))]
    got = {}
    for r in G.path_inspect(spark.createDataFrame(req, "id string, prefixes array<string>"), nd, ed, NOW, 3).collect():
        got.setdefault(r.id, {})[r.rank] = r.path
    for rid, prefixes in req:
        every = []
        for way in itertools.product(*[[r for r in relays if r[0].startswith(p)] for p in prefixes]):
            s = math.log(0.7 + 0.30 / 9) + sum(math.log(hop(a, b)) for a, b in zip(way, way[1:]))
            every.append((-round(s, 12), [r[0] for r in way]))
        assert [got[rid][i] for i in (1, 2, 3)] == [w for _, w in sorted(every)[:3]]


def test_path_inspect_moves_few_rows_under_a_crowded_prefix(spark):
    relays = [(key(f"{p}{i:03x}", i), *((0.0, 0.0) if i % 6 == 5 else (40 + i / 50, -100.0))) for p in ("aa", "bb") for i in range(300)]
    nd = nodes_df(spark, [node(k, lat=la, lon=lo) for k, la, lo in relays])
    ed = edges_df(spark, [(relays[0][0], relays[300][0], 1, 1, 1)])
    req = spark.createDataFrame([("r", ["aa", "bb", "aa"])], "id string, prefixes array<string>")
    before = _rows_shuffled(spark)
    assert G.path_inspect(req, nd, ed, NOW, 3).count() == 3
    assert _rows_shuffled(spark) - before < 20_000  # 300 times 900 in each step if all chains met


def _rows_shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))



def test_jaccard_choice_moves_numbers_and_picks_as_the_scores_say(spark):
    rnd = random.Random(2)
    far = [key(f"{i:02x}ff", i) for i in range(30)]
    cands = [key(f"aa{i:02x}", i) for i in range(4)]
    nd = nodes_df(spark, [node(k) for k in far + cands])
    pairs = {(min(p), max(p)) for p in ((rnd.choice(far + cands), rnd.choice(far)) for _ in range(120)) if p[0] != p[1]}
    ed = edges_df(spark, [(a, b, 1, 1, 1) for a, b in sorted(pairs)])
    amb = spark.createDataFrame([(k, "aa", 5, 4) for k in far] + [(key("ee", 1), "aa", 5, 4)], "known string, prefix string, count long, candidates long")
    near = {k: {b if a == k else a for a, b in pairs if k in (a, b)} for k in far + cands}
    want = {}
    for k in far:
        s = sorted(((-len(near[k] & near[c]) / (len(near[k] | near[c]) or 1), c) for c in cands))
        if s[0][0] < 0 and (s[1][0] == 0 or s[0][0] / s[1][0] >= 3):
            want[k] = s[0][1]
    picked = G.jaccard_choice(amb, nd, ed)
    assert {r.known: r.pubkey for r in picked.collect()} == want and want
    # the scores are ranked under numbers, not keys
    window = next(x for x in picked._jdf.queryExecution().analyzed().toString().split("\n") if "row_number() windowspecdefinition" in x)
    types = dict(re.findall(r"(known|candidate)#\d+(L?)", window))
    assert types == {"known": "L", "candidate": "L"}


# ---- relays ----

def test_repeater_liveness_counts_both_spellings_once_and_never_shuffles_packets_by_hop(spark):
    nd = nodes_df(spark, [node(A1), node(A2), node(B1), node(C1, role="companion")])
    tx = spark.createDataFrame([(1, 2, 60), (2, 2, 7200), (3, 4, 60), (4, None, 3 * 86400), (5, 2, 100)], "id long, payload_type int, ago long").withColumn(
        "first_seen", F.timestamp_seconds(F.lit(1706659200) - F.col("ago")))
    obs = spark.createDataFrame([(1, ["AA", "BB33"], [A1, None]), (1, ["AA"], None), (2, ["CC"], [A2]), (3, ["AA"], [A1]), (4, None, [B1]), (5, ["aa"], [None])],
                                "transmission_id long, path array<string>, resolved_path array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = N.repeater_liveness(tx, obs, nd, NOW)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {r.public_key: (r.relay_count_1h, r.relay_count_24h, r.relay_active) for r in out.collect()}
    assert got == {A1: (2, 2, True), A2: (2, 3, True), B1: (0, 0, False)}
    assert not re.search(r"hashpartitioning\(hop#\d+, (id|transmission_id)#", plan)


def test_rf_rollup_bins_brings_one_row_a_packet_to_its_cell(spark):
    rnd = random.Random(3)
    tx = spark.createDataFrame([(i, i % 3 or None, "00" * (i + 1) if i else None) for i in range(6)], "id long, payload_type int, raw_hex string")
    rows = [(i, rnd.randrange(6), rnd.choice("XY"), rnd.choice([None, 1.0, 5.5, -3.0]), rnd.choice([None, -90.0, -40.0]), rnd.randrange(2)) for i in range(80)]
    obs = spark.createDataFrame(rows, "id long, transmission_id long, observer_id string, snr double, rssi double, h long").withColumn(
        "timestamp", F.timestamp_seconds(F.lit(1706659200) + F.col("h") * 3600)).drop("h")
    out = U.rf_rollup_bins(tx, obs)
    r = U._rf_rows(tx, obs)
    k = ["hour", "payload_type", "observer_id"]
    parts = [r.select(*k, F.lit(m).alias("measure"), U.bin_of(F.col(m), m).alias("bin")).filter("bin IS NOT NULL") for m in ("snr", "rssi")]
    parts.append(r.select(*k, "transmission_id", "size").distinct().select(*k, F.lit("size").alias("measure"), U.bin_of(F.col("size"), "size").alias("bin")))
    want = parts[0].union(parts[1]).union(parts[2]).groupBy(*k, "measure", "bin").count()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert not re.search(r"hashpartitioning\([^)]*measure#", out._jdf.queryExecution().executedPlan().toString())


# ---- clocks ----

def brute_drift(points, last=None):
    if points[-1][0] - points[0][0] < 3600:
        return 0.0
    kept = [points[0]]
    for p in points[1:]:
        if abs(p[1] - kept[-1][1]) <= 60:
            kept.append(p)
    if len(kept) < 2 or kept[-1][0] - kept[0][0] < 3600:
        kept = points
    kept = kept[-last:] if last else kept
    s = [(b[1] - a[1]) / (b[0] - a[0]) for i, a in enumerate(kept) for b in kept[i + 1:] if b[0] > a[0]]
    d = statistics.median(s) * 86400
    return 0.0 if abs(d) > 86400 else d


def test_drift_uses_the_whole_series(spark):
    steady = [(1_706_000_000 + 600 * i, 0.1 * (i if i < 500 else 500)) for i in range(700)]  # gains, then stands still for 200 points
    h = spark.createDataFrame([("n", t, f"{t:x}", v) for t, v in steady], "public_key string, last_observed_ts long, hash string, median_skew double")
    sk = spark.createDataFrame([("n", "ok")], "public_key string, severity string")
    assert K.node_drift(h, sk, points=None).first().drift_per_day == pytest.approx(14.4, abs=0.011)  # most pairs of all points gain 0.1 s in 600 s
    assert K.node_drift(h, sk, points=200).first().drift_per_day == 0


@pytest.mark.parametrize("kind", ["noise", "ties", "flat"])
def test_median_slope_of_a_long_series_is_exact(kind):
    rnd = random.Random(kind)
    t = [float(x) for x in sorted(rnd.randrange(0, 9000) for _ in range(1200))]
    v = [{"noise": round(rnd.gauss(x / 99, 5), 1), "ties": float(rnd.randrange(2)), "flat": 3.0}[kind] for x in t]
    want = statistics.median((b - a) / (y - x) for (x, a), (y, b) in itertools.combinations(zip(t, v), 2) if y > x)
    assert K._theil_sen(K.np.array(t), K.np.array(v), small=10) == want


@pytest.mark.parametrize("kind", ["noise", "ties", "flat", "steps"])
def test_slopes_are_closed_in_by_counting(kind):
    rnd = random.Random(kind)
    t = [float(x) for x in sorted(rnd.randrange(0, 9000) for _ in range(400))]
    v = [{"noise": round(rnd.gauss(x / 99, 5), 1), "ties": float(rnd.randrange(2)), "flat": 3.0, "steps": 0.1 * min(i, 200)}[kind] for i, x in enumerate(t)]
    t, v = (K.np.array(x) for x in zip(*sorted(zip(t, v))))
    ti, vi = K.np.rint(t - t[0]).astype("int64"), K.np.rint((v - v[0]) * 10).astype("int64")
    want = sorted((b - a) / (y - x) for (x, a), (y, b) in itertools.combinations(zip(t, v), 2) if y > x)
    for rank in (0, len(want) // 3, len(want) // 2, len(want) - 1):
        assert K._slope_at(t, v, ti, vi, len(want), rank, few=300, sample=200) == pytest.approx(want[rank], abs=1e-12)


def test_inversions_and_a_long_series():
    rnd = random.Random(2)
    x = K.np.array([rnd.randrange(30) for _ in range(77)])
    want = {(p, q) for p, q in itertools.combinations(range(77), 2) if x[q] < x[p]}
    n, p, q = K._inversions(x, K.np.arange(len(want)))
    assert n == len(want) and set(zip(p.tolist(), q.tolist())) == want
    t = 1_700_000_000.0 + 30 * K.np.arange(200_000)
    assert K._theil_sen(t, K.np.round(1e-6 * (t - t[0]), 1)) * 86400 == pytest.approx(0.0864, abs=1e-4)
    odd = K.np.array([0.0, 1.0, 2.5, 4.0] * 5)  # times that are no whole seconds list their slopes
    assert K._theil_sen(odd, odd * 2, small=10) == 2.0


def test_drift_equals_brute_force(spark):
    rnd = random.Random(11)
    series, rows = {}, []
    for n, size in (("slow", 300), ("jumpy", 80), ("short", 4), ("brief", 6)):
        step = 900 if n != "brief" else 10
        pts = [(1700000000 + i * step, round(i * 0.02 + rnd.random() + (5000 if n == "jumpy" and 20 < i < 40 else 0), 1)) for i in range(size)]
        series[n] = pts
        rows += [(n, f"{n}{i:04d}", t, v) for i, (t, v) in enumerate(pts)]
    h = spark.createDataFrame(rows, "public_key string, hash string, last_observed_ts long, median_skew double")
    sk = spark.createDataFrame([(n, "ok") for n in series], "public_key string, severity string")
    for last in (None, 200):  # the whole series, as by default, or its end
        got = {r.public_key: r.drift_per_day for r in (K.node_drift(h, sk) if last is None else K.node_drift(h, sk, points=last)).collect()}
        assert set(got) == {"slow", "jumpy", "brief"}
        for n, d in got.items():
            assert d == pytest.approx(brute_drift(series[n], last), abs=0.011)


@pytest.mark.parametrize("skew,label", [(0, "ok"), (-299.9, "ok"), (300, "warning"), (-3600, "critical"), (86400 * 30, "absurd"), (86400 * 365, "no_clock")])
def test_severity(spark, skew, label):
    assert spark.range(1).select(K.classify_skew(F.lit(float(skew))).alias("s")).first()["s"] == label


# ---- collisions ----

def test_longest_distance_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = [node(key("ab", i), lat=rnd.uniform(-60, 60), lon=rnd.uniform(-170, 170)) for i in range(1, 120)]
    rows += [node(key("cd", i), lat=47 + rnd.random() / 9, lon=8 + rnd.random() / 9) for i in range(1, 40)]
    rows += [node(key("ef", 1)), node(key("ef", 2), lat=0.0, lon=0.0)]
    info = spark.createDataFrame([(r[0], 1, False) for r in rows], "pubkey string, hash_size int, inconsistent boolean")
    got = {r.prefix: r for r in H.hash_collisions(nodes_df(spark, rows), info).collect()}
    for p in ("ab", "cd"):
        pts = [(None, r[3], r[4]) for r in rows if r[0].startswith(p)]
        want = max(haversine(a, b) for a, b in itertools.combinations(pts, 2))
        assert got[p.upper()].max_dist_km == pytest.approx(want, rel=1e-9)
    assert (got["AB"].classification, got["CD"].classification, got["EF"].classification) == ("distant", "local", "incomplete")


# ---- frames and ingest ----

def decoded(spark, hexes):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hexes)], "i int, raw_hex string")
    return [r for r in X.decode_frames(df).orderBy("i").collect()]


def test_frame_headers_and_paths(spark):
    plain, transport, bad, short, spaced, zero = decoded(spark, [
        "1102AABB" + "00" * 10, "14" + "01020304" + "41CCDD" + "00" * 8, "11C0", "11", "11 02\nAA BB 00 00 00", "1200" + "00" * 8])
    assert (plain.route_type, plain.payload_type, plain.hash_size, plain.path) == (1, 4, 1, ["AA", "BB"])
    assert (transport.transport_code1, transport.transport_code2, transport.hash_size, transport.path) == ("0102", "0304", 2, ["CCDD"])
    assert bad.error == "invalid path encoding" and short.error == "packet too short"
    assert spaced.path == ["AA", "BB"] and zero.hash_size == 0


def test_trace_hops_come_from_the_payload(spark):
    t = decoded(spark, ["2602" + "0CF4" + "01000000" + "02000000" + "01" + "AABBCCDD"])[0]
    assert t.path == ["AABB", "CCDD"] and t.hash_size == 2 and t.snr_values == [3.0, -3.0] and t.hops_completed == 2


def test_content_hash_ignores_route_and_path(spark):
    body = "aa" * 12
    df = spark.createDataFrame([("1100" + body,), ("1202AABB" + body,), ("10" + "01020304" + "00" + body,), ("15" + "00" + body,), ("1",)], "raw_hex string")
    h = [r[0] for r in df.select(X.content_hash(F.col("raw_hex"))).collect()]
    assert h[0] == h[1] == h[2] != h[3] and h[4] == "1"


@pytest.mark.parametrize("text,want", [("5.5 dB", 5.5), ("-80dBm", -80.0), ("7", 7.0), ("12 km", 12.0), ("n/a", None)])
def test_numbers_with_units(spark, text, want):
    assert spark.range(1).select(I.number(F.lit(text)).alias("x")).first()["x"] == want


@pytest.mark.parametrize("pk,lat,name,reason", [
    ("ab", 1.0, "x", "pubkey too short"), ("0" * 64, 1.0, "x", "pubkey is all zeros"), ("a" * 64, 91.0, "x", "invalid lat"),
    ("a" * 64, 1.0, "x\x01y", "name contains control characters"), ("a" * 64, 1.0, "n" * 65, "name too long"), ("a" * 64, 1.0, "tab\tok", None)])
def test_advert_rules(spark, pk, lat, name, reason):
    df = spark.createDataFrame([(pk, lat, 2.0, name)], "public_key string, lat double, lon double, name string")
    assert I.validate_adverts(df).first()["reason"] == reason


def test_windows_reach_the_scan_of_both_fact_tables(spark, tmp_path):
    from meshlake import schemas
    from meshlake.functions.time import TimeWindow, utc
    from meshlake.operators import nodes as N, rf, topology
    from meshlake.sources.tables import read_table, write_table
    from workload.registry import tables

    m = tables(spark, "/root/testdata/sf0.001")
    root = str(tmp_path / "lake")
    write_table(m.tx, root, "transmissions")
    write_table(m.obs, root, "observations")
    tx, obs = read_table(spark, root, "transmissions"), read_table(spark, root, "observations")
    last = m.tx.agg({"first_seen": "max"}).first()[0]
    window = TimeWindow(utc(last) - __import__("datetime").timedelta(days=7), None)
    reports = [N.node_activity_timeline(tx, obs, last), N.node_computed_stats(tx, obs, last), rf.rf_snr_by_type(tx, obs, m.observers, window=window),
               topology.topo_hop_distribution(tx, obs, m.observers, window=window)]
    for r in reports:
        plan = r._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.split("FileScan")[1:] if "transmission_id" in x or "first_seen" in x]
        assert scans and all("day" in x.split("PartitionFilters:")[1].split("PushedFilters")[0] for x in scans)


def test_limits_are_obeyed_or_refused(spark):
    from meshlake.operators import packets as P

    tx = spark.range(60_000).selectExpr("id", "timestamp_seconds(id) AS first_seen")
    assert P.page(tx, 55_000).count() == 55_000
    with pytest.raises(ValueError):
        P.page(tx, 0)


def test_trace_hops_of_eight_bytes_resolve(spark):
    from meshlake.operators import resolve as R

    key = "0123456789abcdef" + "0" * 48
    nodes = spark.createDataFrame([(key, "a", "repeater", 1.0, 2.0, 3)], "public_key string, name string, role string, lat double, lon double, advert_count int")
    hops = spark.createDataFrame([("0123456789ABCDEF",), ("0123456789abcdff",)], "hop string")
    assert {r.hop: r.pubkey for r in R.resolve_simple(hops, nodes).collect()} == {"0123456789ABCDEF": key, "0123456789abcdff": None}
