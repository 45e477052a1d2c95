"""Resolution and neighborhood similarity around a hub: equal to counting by hand, without multiplying by its degree."""

import random

import pytest
from pyspark.sql import functions as F

from meshlake.operators import graph as G, resolve as R

NOW = "2024-01-31T00:00:00Z"


def hub_edges(spark, degree, small=6):
    """A hub known to everyone, and small neighborhoods that share some neighbors."""
    rows = [(f"{i:08x}", "ff000000", 50 + i % 50) for i in range(degree)]
    rows += [(f"{a:08x}", f"{b:08x}", 20) for a in range(small) for b in range(small, small + 20) if (a + b) % 3]
    e = spark.createDataFrame(rows, "node_a string, node_b string, count long")
    return e.withColumns({"last_seen": F.lit("2024-01-30").cast("timestamp"), "observer_count": F.lit(3)}), rows


def nodes_of(spark, keys):
    return spark.createDataFrame([(k, f"n{k}", "repeater", 40.0, -118.0, 1) for k in keys], "public_key string, name string, role string, lat double, lon double, advert_count int")


def neighbors(rows):
    out = {}
    for a, b, n in rows:
        out.setdefault(a, {})[b] = n
        out.setdefault(b, {})[a] = n
    return out


def test_near_candidates_equal_all_edges_of_the_context(spark):
    rng = random.Random(1)
    edges, rows = hub_edges(spark, 400)
    nb = neighbors(rows)
    nodes = nodes_of(spark, sorted(nb))
    cand = R.prefix_candidates(nodes)
    ctx = {f"c{i}": {"ff000000", *(f"{rng.randrange(400):08x}" for _ in range(3))} for i in range(8)} | {"all": set(nb)}
    pairs = [(h, c) for c in ctx for h in ("00", "0000", "FF", "00000010", "ab")]
    want = {}
    for h, c in pairs:
        for key in ctx[c]:
            for other, n in nb[key].items():
                if other.startswith(h.lower()):
                    want[c, h.lower(), other] = max(n, want.get((c, h.lower(), other), 0))
    context = spark.createDataFrame([(c, k) for c, ks in ctx.items() for k in ks], "ctx string, key string")
    for heavy in (1, 128, 10**6):
        got = R.near_candidates(spark.createDataFrame(pairs, "hop string, ctx string"), context, cand, edges, NOW, heavy).collect()
        assert {(r.ctx, r.prefix, r.other): r.w["count"] for r in got} == want



def test_similarity_equals_sets(spark):
    edges, rows = hub_edges(spark, 300)
    nb = neighbors(rows)
    nodes = nodes_of(spark, sorted(nb))
    amb = spark.createDataFrame([("00000000", "0000", 5, 9), ("ff000000", "00", 5, 9), ("00000001", "ff", 5, 2)], "known string, prefix string, count long, candidates long")
    got = {(r.known, r.candidate): r.jaccard for r in G.jaccard_scores(amb, nodes, edges).collect()}
    assert len(got) > 300
    for (a, b), j in got.items():
        x, y = set(nb.get(a, ())), set(nb.get(b, ()))
        assert abs(j - (len(x & y) / len(x | y) if x | y else 0.0)) < 1e-12, (a, b)


def test_a_hub_is_looked_up_and_not_expanded(spark):
    """Pairs of the hub with small nodes: the expanded side has the small nodes' neighbors only."""
    edges, rows = hub_edges(spark, 10_000)
    degree = {k: len(v) for k, v in neighbors(rows).items()}
    nb = G.both_ways(edges)
    deg = nb.groupBy("key").agg(F.count(F.lit(1)).alias("d"))
    pairs = spark.range(5000).select(F.lit("ff000000").alias("known"), F.format_string("%08x", "id").alias("candidate"))
    work = pairs.join(deg.select(F.col("key").alias("candidate"), "d"), "candidate").agg(F.sum(F.least("d", F.lit(degree["ff000000"])))).first()[0]
    assert work == sum(degree[f"{i:08x}"] for i in range(5000)) and work < 6000
    nodes = nodes_of(spark, ["ff000000", *(f"{i:08x}" for i in range(5000))])
    amb = spark.createDataFrame([("ff000000", "0000", 5, 9)], "known string, prefix string, count long, candidates long")
    assert G.jaccard_scores(amb, nodes, edges).count() == 5000


@pytest.mark.parametrize("direct, spread", [(64, 6.0), (4, 6.0), (4, 170.0), (4, 0.0)])
def test_nearest_candidate_is_that_of_all_pairs(spark, direct, spread):
    """Crowded prefixes: cells and the search of the whole prefix give the nearest of all, ties to the smallest key."""
    import math
    import random

    from meshlake.functions import geo

    rnd = random.Random(5)
    nodes = [(f"{i % 3:02x}{i:06x}", rnd.choice([-1, 1]) * (rnd.randrange(1, 60) * 0.05 + (spread / 2 if i % 50 == 0 else 0.0)) + (40.0 if spread < 90 else 0.0),
              rnd.randrange(1, 60) * 0.05 + (spread if i % 40 == 0 else 0.0)) for i in range(600)]
    cand = spark.createDataFrame([(p, k, la, lo, True) for k, la, lo in nodes for p in (k[:2], k)], "prefix string, key string, lat double, lon double, gps boolean")
    ctx = [(f"c{c}", nodes[rnd.randrange(600)][0]) for c in range(80) for _ in range(3)]
    context = spark.createDataFrame(sorted(set(ctx)), "ctx string, key string")
    pairs = spark.createDataFrame([(f"0{p}", f"c{c}") for c in range(80) for p in range(3)], "hop string, ctx string")
    full = cand.filter(F.col("prefix") == F.col("key")).select("key", "lat", "lon")
    mean = context.join(full, "key").groupBy("ctx").agg(F.round(F.avg("lat"), 9).alias("clat"), F.round(F.avg("lon"), 9).alias("clon"))
    d = geo.equirect(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon"))
    want = pairs.join(mean, "ctx").join(cand.withColumnRenamed("key", "ck"), F.col("prefix") == F.col("hop")).groupBy("hop", "ctx").agg(
        F.min(F.struct(F.round(d, 12).alias("d"), "ck"))["ck"].alias("key"))
    got = R.geo_choice(pairs, context, cand, direct)
    assert got.count() == 240 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pairs_do_not_meet_every_candidate_of_a_crowded_prefix(spark):
    """Of 4,900 candidates on a grid, a hop meets those of nine cells."""
    places = spark.range(4900).select(F.lit("aa").alias("prefix"), F.format_string("aa%06x", "id").alias("key"), (F.col("id") % 70 * 0.1 + 10).alias("lat"), (F.floor(F.col("id") / 70) * 0.1).alias("lon"))
    width, around, whole = R._spots(places, 64)
    assert around.agg(F.max(F.size("places"))).first()[0] <= 64
    assert whole.select(F.size("places")).first()[0] == 4900


def test_candidates_found_along_edges_are_those_of_all_pairs(spark):
    """Random graph with hubs, crowded prefixes: every candidate of some similarity, and no other."""
    rnd = random.Random(3)
    keys = [f"{i % 4:02x}{i:06x}" for i in range(160)]
    ends = {tuple(sorted(rnd.sample(keys, 2))) for _ in range(220)} | {(min(keys[0], k), max(keys[0], k)) for k in keys[1:140]}
    e = spark.createDataFrame(sorted(ends), "node_a string, node_b string")
    nodes = nodes_of(spark, keys)
    asked = spark.createDataFrame([(k, f"0{p}") for k in keys[:40] for p in range(4)], "known string, prefix string")
    every = G.jaccard_scores(asked, nodes, e)
    got = G.alike_candidates(asked, nodes, e).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, every.filter("jaccard > 0").select("known", "prefix", "candidate", "jaccard").collect()))
    assert 0 < len(got) < every.count() and {r.known for r in got} & {keys[0]}


def test_candidates_of_ambiguous_edges_are_not_moved_in_pairs(spark):
    from meshlake.operators import graph as G
    keys = [f"{p}{i:02x}" + "0" * 60 for p in ("aa", "bb") for i in range(6)]
    nodes = spark.createDataFrame([(k, k[:4], "repeater", None, None, 1) for k in keys], "public_key string, name string, role string, lat double, lon double, advert_count int")
    rows = [(keys[0], keys[6]), (keys[0], keys[7]), (keys[1], keys[6]), (keys[1], keys[7]), (keys[2], keys[7]), (keys[2], keys[8]), (keys[9], keys[10])]
    edges = spark.createDataFrame(rows, "node_a string, node_b string")
    amb = spark.createDataFrame([(keys[0], "aa", 5), (keys[3], "bb", 6), (keys[6], "bb", 5), (keys[2], "aa", 1), ("ff" * 32, "aa", 6)], "known string, prefix string, candidates int")
    got = G.affinity_candidates(amb, nodes, edges)
    want = G.jaccard_scores(amb.filter("candidates >= 2"), nodes, edges)
    told = lambda df: sorted((r.known, r.prefix, r.candidate, round(r.jaccard, 3)) for r in df.collect())
    assert told(got) == told(want) and len(told(got)) == 5 + 6 + 5 + 6 and {r[3] for r in told(got)} > {0.0, 1.0}
    # what comes after edges and candidates have met is no exchange by pairs
    assert "candidate" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x)
