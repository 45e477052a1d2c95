"""Which node is meant by a short hop prefix.

Prefixes are exploded into an equi-join table once; hops are reduced to distinct (hop, context)
pairs before any candidate is looked at, and only ambiguous pairs meet the candidate list.
A context is a set of node keys kept as rows ``(ctx, key)``, so it may be as large as the mesh.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from meshlake.functions import geo, names
from meshlake.functions.keys import grouped
from meshlake.functions.ranks import top_per_group
from meshlake.functions.time import ts_lit
from meshlake.session import cut_lineage

# fixed values of the affinity rules
PREFIX_LENGTHS = (2, 3, 4, 5, 6, 7, 8, 16)  # characters: what a path, a filter or a trace of 1, 2, 4 or 8 bytes can hold
SATURATION_COUNT = 100
HALF_LIFE_HOURS = 168.0
CONFIDENT_RATIO = 3.0
MIN_OBSERVATIONS = 3
OBSERVER_SATURATION = 3.0


# ---- candidates ------------------------------------------------------------------------

def relays(nodes: DataFrame) -> DataFrame:
    return nodes.filter(names.is_relay(F.col("role"))).select(
        F.lower("public_key").alias("key"), "name", "role", "lat", "lon",
        geo.has_gps(F.col("lat"), F.col("lon")).alias("gps"), F.coalesce("advert_count", F.lit(0)).alias("adverts"))


def _under_prefixes(rows: DataFrame) -> DataFrame:
    n = F.length("key")
    lens = F.array_distinct(F.array_append(F.array(*[F.lit(x) for x in PREFIX_LENGTHS]), n))
    lens = F.filter(lens, lambda x: x <= n)
    return rows.withColumn("_n", F.explode(lens)).withColumn("prefix", F.substr(F.col("key"), F.lit(1), F.col("_n"))).drop("_n")


def prefix_candidates(nodes: DataFrame) -> DataFrame:
    """Relays under every key prefix of the lengths that hops have, and under the full key."""
    return _under_prefixes(relays(nodes)).select("prefix", "key", "name", "role", "lat", "lon", "gps", "adverts")


def prefix_stats(candidates: DataFrame) -> DataFrame:
    """Per prefix: number of candidates, smallest and largest key, context-free favourites."""
    fav = F.struct(-F.col("adverts"), F.col("key"))
    return candidates.groupBy("prefix").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"),
        F.min(F.when(F.col("gps"), F.col("key"))).alias("first_gps"),
        F.min(F.when(F.col("gps"), fav)).alias("_g"), F.min(fav).alias("_a")).select(
        "prefix", "n", "lo", "hi", "first_gps", F.col("_g.key").alias("fav_gps"), F.col("_a.key").alias("fav_any"))


def unique_prefixes(nodes: DataFrame) -> DataFrame:
    """(prefix, key) of prefixes that mean exactly one relay."""
    c = prefix_candidates(nodes).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    return c.filter(F.col("n") == 1).select("prefix", "key")


def resolve_simple(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """hop -> its only candidate, else the first with a position, else the first."""
    st = prefix_stats(prefix_candidates(nodes))
    return hops.select("hop").distinct().join(st, F.lower("hop") == st.prefix, "left").select(
        "hop", F.when(F.col("n") == 1, F.col("lo")).otherwise(F.coalesce("first_gps", "lo")).alias("pubkey"))


# ---- edge weights ----------------------------------------------------------------------

def edge_score(count: Column, last_seen: Column, now: datetime | str) -> Column:
    """Saturating count with exponential decay (half-life one week)."""
    hours = F.greatest((F.unix_micros(ts_lit(now)) - F.unix_micros(last_seen)) / 3.6e9, F.lit(0.0))
    return F.least(F.lit(1.0), count / float(SATURATION_COUNT)) * F.exp(hours * (-math.log(2) / HALF_LIFE_HOURS))


def edge_confidence(observer_count: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(observer_count, F.lit(1)) / OBSERVER_SATURATION)


def neighbor_list(edges: DataFrame, now: datetime | str) -> DataFrame:
    """Both directions of every edge: (key, other, weight, count)."""
    w = edge_score(F.col("count"), F.col("last_seen"), now) * edge_confidence(F.col("observer_count"))
    e = edges.select("node_a", "node_b", w.alias("weight"), "count")
    return e.select(F.col("node_a").alias("key"), F.col("node_b").alias("other"), "weight", "count").union(
        e.select(F.col("node_b").alias("key"), F.col("node_a").alias("other"), "weight", "count"))


# ---- contexts --------------------------------------------------------------------------

def _ends() -> Column:
    """Keys of a packet's sender and station."""
    hex_id = F.when((F.length("observer_id") >= 4) & names.is_hex(F.col("observer_id")), F.lower("observer_id"))
    return F.array_compact(F.array(F.when(F.col("sender") != "", F.lower("sender")), hex_id))


def hop_context(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, key): sender, station and unambiguous hops of each packet.

    ``heads`` has id, sender, observer_id, path.
    """
    ends = heads.select("id", F.explode(_ends()).alias("key"))
    hop = heads.select("id", F.explode(F.array_distinct(F.transform("path", F.lower))).alias("prefix"))
    anchors = hop.join(unique_prefixes(nodes), "prefix").select("id", "key")
    return ends.union(anchors).distinct()


def aggregate_context(context: DataFrame) -> DataFrame:
    """Union of all contexts, under one context name."""
    return context.select(F.lit("all").alias("ctx"), "key").distinct()


def whole_context(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """`aggregate_context` of the `hop_context` of all ``heads``: senders, stations and hops are brought together each by itself, not by packet."""
    ends = grouped(heads.select(F.explode(_ends()).alias("key")), ["key"], ["key"])
    hop = heads.select(F.explode(F.transform("path", F.lower)).alias("prefix")).distinct()
    return aggregate_context(ends.union(hop.join(unique_prefixes(nodes), "prefix").select("key")))


def shared_contexts(context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Name equal contexts alike: ``(id, ctx)`` and ``(ctx, key)``.

    A packet's context holds at most its path length plus two keys, so it fits an array.
    """
    named = context.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("_keys"))
    named = named.withColumn("ctx", F.md5(F.array_join("_keys", ",")))
    keys = named.select("ctx", "_keys").groupBy("ctx").agg(F.any_value("_keys").alias("_keys"))
    return named.select("id", "ctx"), keys.select("ctx", F.explode("_keys").alias("key"))


# ---- tiers -----------------------------------------------------------------------------

def near_candidates(pairs: DataFrame, context: DataFrame, candidates: DataFrame, edges: DataFrame, now, heavy: int = 128) -> DataFrame:
    """(ctx, prefix, other, w): strongest edge between a context and each candidate of the hops asked for in it.

    Edges are labelled with the prefixes of their far end, so a context's keys meet only neighbours that are candidates,
    however many neighbours a hub has. A context of more than ``heavy`` keys meets its edges first and the hops asked
    for then, so keys and hops are not multiplied there.
    """
    asked = pairs.select("ctx", F.lower("hop").alias("prefix")).distinct()
    cand = candidates.select("prefix", F.col("key").alias("other")).join(asked.select("prefix").distinct(), "prefix", "left_semi")
    near = neighbor_list(edges, now).filter("weight > 0")
    sized = context.distinct().join(context.groupBy("ctx").agg((F.count(F.lit(1)) > heavy).alias("_heavy")), "ctx")
    strongest = F.max(F.struct("weight", "count")).alias("w")
    light = sized.filter("NOT _heavy").join(asked, "ctx").join(near.join(cand, "other"), ["key", "prefix"]).groupBy("ctx", "prefix", "other").agg(strongest)
    large = sized.filter("_heavy").join(near, "key").groupBy("ctx", "other").agg(strongest).join(cand, "other").join(asked, ["ctx", "prefix"], "left_semi")
    return light.unionByName(large)


def affinity_choice(pairs: DataFrame, context: DataFrame, candidates: DataFrame, edges: DataFrame, now) -> DataFrame:
    """Candidates that are graph neighbours of the context: (hop, ctx, key, weight) where one clearly wins."""
    scored = pairs.withColumn("prefix", F.lower("hop")).join(near_candidates(pairs, context, candidates, edges, now), ["ctx", "prefix"])
    order = [F.col("w.weight").desc(), F.col("w.count").desc(), F.col("other")]
    top2 = top_per_group(scored, ["hop", "ctx"], order, 2, "r")
    g = top2.groupBy("hop", "ctx").agg(
        F.max(F.when(F.col("r") == 1, F.struct(F.col("other").alias("key"), "w"))).alias("b"),
        F.max(F.when(F.col("r") == 2, F.col("w.weight"))).alias("second"))
    sure = (F.col("b.w.count") >= MIN_OBSERVATIONS) & (
        F.col("second").isNull() | (F.col("b.w.weight") >= CONFIDENT_RATIO * F.col("second")))
    return g.filter(sure).select("hop", "ctx", F.col("b.key").alias("key"), F.col("b.w.weight").alias("weight"))


def _spots(candidates: DataFrame, direct: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where a prefix's candidates lie: its cell width, its places by neighborhood, its places as a whole.

    Of the candidates at one place only the smallest key can be the nearest. A prefix of at most ``direct`` places is one
    neighborhood (no width). Else places go into square cells about four of which hold one place, and a neighborhood is
    a cell with the eight around it.
    """
    spot = candidates.groupBy("prefix", "lat", "lon").agg(F.min("key").alias("ck"))
    high, wide = F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")
    n = F.count(F.lit(1))
    width = spot.groupBy("prefix").agg(
        F.when(n > direct, 2 * F.greatest(F.sqrt(high * wide / n), (high + wide) / n)).alias("width"))
    spot = spot.join(width, "prefix").withColumn("place", F.struct("lat", "lon", "ck"))
    step = F.explode(F.when(F.col("width").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(
        F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])))
    around = spot.withColumn("d", step).select(
        "prefix", (_cell("lon", "width") + F.col("d.x")).alias("x"), (_cell("lat", "width") + F.col("d.y")).alias("y"), "place")
    around = around.groupBy("prefix", "x", "y").agg(F.collect_list("place").alias("places"))
    whole = spot.filter("width IS NOT NULL").groupBy("prefix").agg(F.collect_list("place").alias("places"))
    return width, around, whole


def _cell(degrees: str, width: str) -> Column:
    return F.when(F.col(width).isNull(), F.lit(0)).otherwise(F.floor(F.col(degrees) / F.col(width))).cast("bigint")


def _nearest() -> Column:
    """Distance and key of the nearest of ``places`` to (clat, clon)."""
    d = lambda p: geo.equirect(F.col("clat"), F.col("clon"), p["lat"], p["lon"])
    return F.array_min(F.transform("places", lambda p: F.struct(F.round(d(p), 12).alias("d"), p["ck"].alias("ck"))))


def geo_choice(pairs: DataFrame, context: DataFrame, candidates: DataFrame, direct: int = 64, places: DataFrame | None = None) -> DataFrame:
    """Candidate nearest to the mean position of the context: (hop, ctx, key).

    A pair meets the candidates in the cells around the mean position, one row with their list, so neither rows nor lists
    grow with the number of candidates. What lies outside is at least a cell's width off; only where the nearest found
    is no nearer than that are all places of the prefix looked at. ``places`` has the key and position of relays where
    ``candidates`` are not under their full keys too.
    """
    full = places if places is not None else candidates.filter((F.col("prefix") == F.col("key")) & F.col("gps")).select("key", "lat", "lon")
    # summing in key order would need a sort; means are rounded so their last bits do not matter
    center = context.join(full, "key").groupBy("ctx").agg(
        F.round(F.avg("lat"), 9).alias("clat"), F.round(F.avg("lon"), 9).alias("clon"))
    asked = pairs.withColumn("prefix", F.lower("hop"))
    cand = candidates.filter("gps").join(asked.select("prefix").distinct(), "prefix", "left_semi")
    return nearest_choice(asked.select("hop", "ctx", "prefix").join(center, "ctx"), cand, direct)


def nearest_choice(asked: DataFrame, candidates: DataFrame, direct: int = 64) -> DataFrame:
    """Nearest of the candidates with a position for (hop, ctx, prefix, clat, clon) rows: (hop, ctx, key)."""
    width, around, whole = _spots(candidates, direct)
    q = asked.join(width, "prefix").withColumns(
        {"x": _cell("clon", "width"), "y": _cell("clat", "width")})
    q = q.join(around, ["prefix", "x", "y"], "left").withColumn("b", _nearest()).drop("places")
    # outside are |dlat| or |dlon| of a width or more, the latter at latitudes within half a width of the middle
    off = F.radians("width") * F.greatest(F.lit(0.0), F.cos(F.radians(F.least(F.abs("clat") + F.col("width") / 2, F.lit(90.0)))))
    sure = F.col("width").isNull() | F.coalesce(F.col("b.d") + 1e-11 < off, F.lit(False))
    near = q.filter(sure).select("hop", "ctx", F.col("b.ck").alias("key"))
    rest = q.filter(~sure).drop("b").join(whole, "prefix").withColumn("b", _nearest())
    return near.unionByName(rest.select("hop", "ctx", F.col("b.ck").alias("key")))


def resolve_hops(hops: DataFrame, context: DataFrame, nodes: DataFrame, edges: DataFrame, now: datetime | str,
                 with_node: bool = True, candidates: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """Tiered resolution of distinct (hop, ctx): hop, ctx, pubkey, method, score [, name, role, lat, lon, gps].

    unique_prefix, then neighbor_affinity, geo_proximity, gps_preference,
    observation_count_fallback, else no_match.
    """
    cand = prefix_candidates(nodes) if candidates is None else candidates
    st = prefix_stats(cand.join(hops.select(F.lower("hop").alias("prefix")).distinct(), "prefix", "left_semi"))
    base = hops.select("hop", "ctx").distinct().join(st, F.lower("hop") == st.prefix, "left")
    amb = base.filter(F.col("n") > 1).select("hop", "ctx")
    aff = affinity_choice(amb, context, cand, edges, now).select(
        F.col("hop").alias("ah"), F.col("ctx").alias("ac"), F.col("key").alias("ak"), F.col("weight").alias("aw"))
    near = geo_choice(amb, context, cand, places=places).select(
        F.col("hop").alias("gh"), F.col("ctx").alias("gc"), F.col("key").alias("gk"))
    j = (base.join(aff, (F.col("n") > 1) & (F.col("hop") == F.col("ah")) & (F.col("ctx") == F.col("ac")), "left")
         .join(near, (F.col("n") > 1) & (F.col("hop") == F.col("gh")) & (F.col("ctx") == F.col("gc")), "left"))
    out = j.select(
        "hop", "ctx",
        F.when(F.col("n") == 1, F.col("lo")).otherwise(F.coalesce("ak", "gk", "fav_gps", "fav_any")).alias("pubkey"),
        F.when(F.col("n").isNull(), "no_match").when(F.col("n") == 1, "unique_prefix")
        .when(F.col("ak").isNotNull(), "neighbor_affinity").when(F.col("gk").isNotNull(), "geo_proximity")
        .when(F.col("fav_gps").isNotNull(), "gps_preference").otherwise("observation_count_fallback").alias("method"),
        F.when(F.col("n") == 1, F.lit(1.0)).when(F.col("n") > 1, F.coalesce("aw", F.lit(0.0))).otherwise(F.lit(0.0)).alias("score"))
    if not with_node:
        return out
    info = relays(nodes).select(F.col("key").alias("pubkey"), "name", "role", "lat", "lon", "gps")
    return out.join(info, "pubkey", "left")


def packet_heads(tx: DataFrame, best: DataFrame) -> DataFrame:
    """id, sender, observer_id, path as the contexts need them."""
    return tx.join(best, tx.id == best.transmission_id).select(
        "id", F.col("decoded.pubKey").alias("sender"), "observer_id", "path")


def resolve_packet_hops(heads: DataFrame, nodes: DataFrame, edges: DataFrame, now) -> DataFrame:
    """Every hop of every packet resolved in the packet's own context: id, pos, hop, pubkey, name, ..."""
    ids, ctx = shared_contexts(hop_context(heads, nodes))
    hops = heads.select("id", F.posexplode("path").alias("pos", "hop")).join(ids, "id")
    # the resolver reads the distinct pairs and contexts several times
    pairs = cut_lineage(hops.select("hop", "ctx").distinct())
    return hops.join(resolve_hops(pairs, cut_lineage(ctx), nodes, edges, now), ["hop", "ctx"]).drop("ctx")


# ---- whole ways ------------------------------------------------------------------------

def way_id() -> Column:
    """Names alike the packets of one sender, station and path: they have one context and the same hops."""
    text = [F.coalesce(c, F.lit("")) for c in ("sender", "observer_id")]
    return F.unhex(F.md5(F.concat_ws("|", *text, F.array_join("path", ",", "~"))))


def distinct_ways(heads: DataFrame) -> DataFrame:
    """One row for packets with the same `way_id` (``ctx``): ctx, sender, observer_id, path."""
    return heads.groupBy("ctx").agg(*[F.any_value(c).alias(c) for c in ("sender", "observer_id", "path")])


def numbered_keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, k): keys of nodes and edges with numbers in the keys' order, so that ties fall as they do between keys. To be written before use."""
    keys = nodes.select(F.explode(F.array("public_key", F.lower("public_key"))).alias("key")).union(
        edges.select(F.explode(F.array("node_a", "node_b")).alias("key")))
    return keys.filter("key IS NOT NULL").distinct().orderBy("key").withColumn("k", F.monotonically_increasing_id())


def resolve_ways(ways: DataFrame, nodes: DataFrame, numbers: DataFrame, edges: DataFrame, now: datetime | str) -> DataFrame:
    """The tiers of `resolve_hops` for every hop of `distinct_ways`: (ctx, prefix, k), hops without candidates left out.

    Rows hold numbers (`numbered_keys`) in place of keys. What is known of a way's ends and hops is brought together in
    one row; only hops still open then meet edges, and only those left open by edges meet positions.
    """
    r = relays(nodes).join(numbers, "key")
    asked = ways.select("ctx", F.explode(F.array_distinct(F.transform("path", F.lower))).alias("prefix"))
    cand = cut_lineage(_under_prefixes(r).select("prefix", F.col("k").alias("key"), "lat", "lon", "gps", "adverts").join(
        asked.select("prefix").distinct(), "prefix", "left_semi"))
    fav = F.struct(-F.col("adverts"), F.col("key"))
    # of a single candidate, its position
    st = cand.groupBy("prefix").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("k"), F.min(F.when(F.col("gps"), fav)).alias("_g"), F.min(fav).alias("_a"),
        F.min(F.when(F.col("gps"), F.col("lat"))).alias("lat"), F.min(F.when(F.col("gps"), F.col("lon"))).alias("lon"))
    one = F.col("n") == 1
    st = st.select("prefix", "n", F.when(one, F.col("k")).alias("k"), F.when(~one, F.coalesce("_g.key", "_a.key")).alias("fav"),
                   F.col("_g").isNotNull().alias("placed"), F.when(one, F.col("lat")).alias("lat"), F.when(one, F.col("lon")).alias("lon"))
    fields = ("prefix", "n", "k", "fav", "placed", "lat", "lon")
    place = numbers.join(r.filter("gps").select("key", "lat", "lon"), "key", "left")
    ends = ways.select("ctx", F.explode(F.array_distinct(_ends())).alias("key")).join(place, "key").withColumns(
        {"prefix": F.lit(None).cast("string"), "n": F.lit(None).cast("long"), "fav": F.lit(None).cast("long"), "placed": F.lit(None).cast("boolean")})
    rows = asked.join(st, "prefix").select("ctx", F.struct(*fields).alias("e")).union(ends.select("ctx", F.struct(*fields).alias("e")))
    # a path holds at most 63 hops, so what is known of a way fits one row
    known = F.array_distinct(F.transform(F.filter("es", lambda e: F.coalesce(e["n"], F.lit(1)) == 1), lambda e: F.struct(e["k"].alias("k"), e["lat"].alias("lat"), e["lon"].alias("lon"))))
    spots = F.filter("known", lambda x: x["lat"].isNotNull())
    mean = lambda c: F.round(F.aggregate(spots, F.lit(0.0), lambda a, x: a + x[c]) / F.when(F.size(spots) > 0, F.size(spots)), 9)
    per = cut_lineage(rows.groupBy("ctx").agg(F.collect_list("e").alias("es")).withColumn("known", known).select(
        "ctx", F.transform("known", lambda x: x["k"]).alias("keys"), mean("lat").alias("clat"), mean("lon").alias("clon"),
        F.transform(F.filter("es", lambda e: e["n"] == 1), lambda e: F.struct(e["prefix"].alias("prefix"), e["k"].alias("k"))).alias("sure"),
        F.transform(F.filter("es", lambda e: e["n"] > 1), lambda e: F.struct(
            e["prefix"].alias("prefix"), e["fav"].alias("fav"), e["placed"].alias("placed"))).alias("open")))
    hops = per.select("ctx", "keys", "clat", "clon", F.explode("open").alias("o")).select("ctx", "keys", "clat", "clon", "o.*")
    met = hops.select("ctx", "prefix", F.explode("keys").alias("k")).join(_strongest(cand, numbers, edges, now), ["k", "prefix"]).groupBy(
        "ctx", "prefix").agg(F.flatten(F.collect_list("top")).alias("t")).withColumn("b", F.array_min("t"))
    met = met.withColumn("second", F.array_min(F.filter("t", lambda x: x["other"] != F.col("b.other"))))
    clear = (-F.col("b.c") >= MIN_OBSERVATIONS) & (F.col("second").isNull() | (-F.col("b.w") >= CONFIDENT_RATIO * -F.col("second.w")))
    won = met.filter(clear).select("ctx", "prefix", F.col("b.other").alias("won"))
    hops = cut_lineage(hops.drop("keys").join(won, ["ctx", "prefix"], "left"))
    # a placed prefix and a way with a middle always give a nearest candidate
    by_place = F.col("won").isNull() & F.col("placed") & F.col("clat").isNotNull()
    near = nearest_choice(hops.filter(by_place).select(F.col("prefix").alias("hop"), "ctx", "prefix", "clat", "clon"), cand.filter("gps"))
    return (per.select("ctx", F.explode("sure").alias("s")).select("ctx", "s.prefix", "s.k")
            .unionByName(hops.filter(~by_place).select("ctx", "prefix", F.coalesce("won", "fav").alias("k")))
            .unionByName(near.select("ctx", F.col("hop").alias("prefix"), F.col("key").alias("k"))))


def _strongest(candidates: DataFrame, numbers: DataFrame, edges: DataFrame, now: datetime | str) -> DataFrame:
    """(k, prefix, top): a key's two strongest edges to candidates of a prefix.

    The best two candidates of several keys are among their best twos.
    """
    a, b = (numbers.select(F.col("key").alias(c), F.col("k").alias(f"_{c}")) for c in ("node_a", "node_b"))
    e = edges.join(a, "node_a").join(b, "node_b").select(
        F.col("_node_a").alias("node_a"), F.col("_node_b").alias("node_b"), "count", "last_seen", "observer_count")
    near = neighbor_list(e, now).filter("weight > 0").withColumnRenamed("key", "k")
    near = near.join(candidates.select("prefix", F.col("key").alias("other")), "other")
    two = top_per_group(near, ["k", "prefix"], [F.col("weight").desc(), F.col("count").desc(), F.col("other")], 2, "r")
    return two.groupBy("k", "prefix").agg(F.collect_list(F.struct(
        (-F.col("weight")).alias("w"), (-F.col("count")).alias("c"), "other")).alias("top"))


def hop_report(hops: DataFrame, context: DataFrame, nodes: DataFrame, edges: DataFrame, now) -> DataFrame:
    """All candidates of each (hop, ctx) with their affinity, the chosen one marked, and a confidence label."""
    cand = prefix_candidates(nodes)
    picked = resolve_hops(hops, context, nodes, edges, now, with_node=False)
    near = near_candidates(hops, context, cand, edges, now).withColumnRenamed("other", "key")
    rows = (picked.withColumn("prefix", F.lower("hop")).join(cand, "prefix").join(near, ["ctx", "prefix", "key"], "left"))
    label = (F.when(F.col("method").isin("unique_prefix", "neighbor_affinity"), F.col("method"))
             .otherwise(F.lit("ambiguous")))
    return rows.select("hop", "ctx", F.col("key").alias("candidate"), "name", "role",
                       F.coalesce("w.weight", F.lit(0.0)).alias("affinity"), F.coalesce("w.count", F.lit(0)).alias("count"),
                       (F.col("key") == F.col("pubkey")).alias("chosen"), "method", label.alias("confidence"))


def resolve_paths(paths: DataFrame, nodes: DataFrame, edges: DataFrame, now, start_context: tuple[str, ...] = ("sender", "observer_id")) -> DataFrame:
    """Hop by hop resolution where the previous resolved hop joins the context.

    ``paths`` has path plus the context columns; the result adds ``resolved_path``. One round per
    path position, over distinct (hop, context) only; a path holds at most 63 hops. Rounds are
    written out so that the plan does not grow.
    """
    cols = [c for c in paths.columns]
    rows = paths.distinct().withColumn("_prev", F.lit(None).cast("string")).withColumn(
        "_out", F.array().cast("array<string>"))
    rows, cand = cut_lineage(rows), cut_lineage(prefix_candidates(nodes))
    longest = rows.agg(F.max(F.size("path"))).first()[0] or 0
    for i in range(longest):
        live = rows.filter(F.size("path") > i)
        parts = F.array_compact(F.array(*[F.when(F.col(c) != "", F.lower(c)) for c in start_context], F.col("_prev")))
        live = live.withColumn("_keys", F.array_sort(F.array_distinct(parts))).withColumn("ctx", F.md5(F.array_join("_keys", ",")))
        live = live.withColumn("hop", F.get("path", F.lit(i)))
        ctx = live.select("ctx", F.explode("_keys").alias("key")).distinct()
        got = resolve_hops(live, ctx, nodes, edges, now, False, cand).select("hop", "ctx", "pubkey")
        step = live.join(got, ["hop", "ctx"]).select(
            *cols, F.col("pubkey").alias("_prev"), F.array_append("_out", F.col("pubkey")).alias("_out"))
        done = rows.filter(F.size("path") <= i)
        rows = cut_lineage(step.select(rows.columns).unionByName(done))
    return rows.select(*cols, F.col("_out").alias("resolved_path"))
