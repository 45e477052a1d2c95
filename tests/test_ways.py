"""Hops of whole ways: the same as packet by packet, and each way once."""

import random

import pytest
from pyspark.sql import functions as F

from meshlake.operators import distance as D, resolve as R
from meshlake.session import cut_lineage

NOW = "2024-01-31T00:00:00Z"


@pytest.fixture(scope="module")
def mesh(spark):
    rng = random.Random(5)
    keys = sorted({f"{rng.choice('ab')}{rng.choice('0123')}{rng.randrange(16 ** 3):03x}" + "0" * 11 for _ in range(300)})
    role = lambda i: ("repeater", "room", "companion")[i % 3]
    place = lambda i: (None, None) if i % 7 == 0 else (40 + rng.randrange(60) / 10, -118 + rng.randrange(60) / 10)
    nodes = spark.createDataFrame([(k, f"n{i % 90}", role(i), *place(i), rng.randrange(5)) for i, k in enumerate(keys)],
                                  "public_key string, name string, role string, lat double, lon double, advert_count int")
    # some ends are stations that are no node; equal counts make ties
    ends = [*keys, "feed01", "feed02"]
    e = {tuple(sorted(rng.sample(ends, 2))): rng.choice((1, 2, 5, 20, 60)) for _ in range(4000)}
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in e.items()], "node_a string, node_b string, count long").withColumns(
        {"last_seen": F.lit("2024-01-30").cast("timestamp"), "observer_count": F.lit(3)})
    hop = lambda: (h := rng.choice(keys)[: rng.choice((2, 2, 4, 5, 16))], h.upper() if rng.random() < 0.5 else h)[1]
    ways = [(rng.choice((None, "", *keys)), rng.choice(("FEED01", "feed02", "x1", *keys[:9])), [hop() for _ in range(rng.randrange(1, 6))] + rng.choice(([], ["zz"], ["AB"])))
            for _ in range(200)]
    packets = [(i, *rng.choice(ways)) for i in range(900)]
    return spark.createDataFrame(packets, "id long, sender string, observer_id string, path array<string>"), nodes, edges


def test_ways_equal_packet_by_packet(spark, mesh):
    heads, nodes, edges = mesh
    want = {(r.id, r.hop.lower(), r.pubkey) for r in R.resolve_packet_hops(heads, nodes, edges, NOW).filter("pubkey IS NOT NULL").collect()}
    named = heads.withColumn("ctx", R.way_id())
    ways = cut_lineage(R.distinct_ways(named))
    assert ways.count() == len({(r.sender or "", r.observer_id, tuple(r.path)) for r in heads.collect()}) < heads.count()
    numbers = cut_lineage(R.numbered_keys(nodes, edges))
    order = [r.key for r in numbers.orderBy("k").collect()]
    assert order == sorted(order)
    got = R.resolve_ways(ways, nodes, numbers, edges, NOW).join(numbers, "k").join(named.select("id", "ctx"), "ctx").collect()
    assert len(got) == len(want) and {(r.id, r.prefix, r.key) for r in got} == want


def test_hops_of_a_long_way_are_resolved_once(spark, mesh):
    """Hops follow the path, with the sender first; packets of a way share them."""
    heads, nodes, edges = mesh
    tx = heads.select("id", F.col("id").cast("string").alias("hash"), F.lit("2024-01-30").cast("timestamp").alias("first_seen"), F.struct(F.col("sender").alias("pubKey")).alias("decoded"))
    obs = heads.select("id", F.col("id").alias("transmission_id"), "observer_id", "path", F.lit(1.0).alias("snr"), F.lit("2024-01-30").cast("timestamp").alias("timestamp"))
    place = {r.public_key: r for r in nodes.filter("lat IS NOT NULL").collect()}
    found = {(r.id, r.pos): r.pubkey for r in R.resolve_packet_hops(heads, nodes, edges, NOW).collect()}
    want = set()
    for r in heads.collect():
        stops = [k for k in [r.sender, *(found[r.id, i] for i in range(len(r.path)))] if k in place]
        want |= {(r.id, i, a, place[a].name, b, place[b].name) for i, (a, b) in enumerate(zip(stops, stops[1:]))}
    got = D.distance_hops(tx, obs, nodes, edges, NOW).collect()
    assert len(got) == len(want) and {(r.id, r.pos, r.from_pk, r.from_name, r.to_pk, r.to_name) for r in got} == want


def test_longest_paths_bring_only_their_hops_together(spark):
    """The exchange of all hops holds sums, not lists of keys."""
    rows = [(i, f"h{i}", p, f"a{i}", f"b{i}", float(i % 7 + p), float(i % 7 + p)) for i in range(60) for p in range(3)]
    hops = spark.createDataFrame(rows, "id long, hash string, pos int, from_pk string, to_pk string, km double, dist double").withColumn(
        "first_seen", F.lit("2024-01-30").cast("timestamp"))
    want = sorted(D.distance_paths(hops).collect(), key=lambda r: (-r.total_dist, r.id))[:5]
    top = D.distance_top_paths(hops, 5)
    assert top.collect() == want
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "LeftSemi" in plan
