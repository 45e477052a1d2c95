"""Address prefix sizes, collisions and multi-byte capability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshlake.functions import geo, names
from meshlake.functions.ranks import with_previous
from meshlake.functions.time import hour_of, ts_lit

from . import resolve as R
from .packets import best_observation, heard_ids, obs_in_region, region_codes

LOCAL_KM, REGIONAL_KM = 50.0, 200.0


def _byte(pos: Column) -> Column:
    return F.conv(F.substr(F.col("raw_hex"), pos, F.lit(2)), 16, 10).cast("int")


def frame_header(tx: DataFrame) -> DataFrame:
    """Adds the header's route bits and the path byte; unreadable frames are left out."""
    ok = tx.filter((F.length("raw_hex") >= 4) & names.is_hex(F.substring("raw_hex", 1, 4)))
    h = ok.withColumn("route_bits", _byte(F.lit(1)).bitwiseAND(3))
    at = F.when(F.col("route_bits").isin(0, 3), 11).otherwise(3)
    return h.filter(F.length("raw_hex") >= at + 1).withColumn("path_byte", _byte(at)).withColumns({
        "hash_size": F.shiftright("path_byte", 6) + 1,
        "zero_hop": F.col("route_bits").isin(2, 3) & (F.col("path_byte").bitwiseAND(63) == 0)})


def home_regions(tx: DataFrame, obs: DataFrame, observers: DataFrame) -> DataFrame:
    """Most frequent region of the stations that heard a node's unrelayed direct adverts."""
    head = tx.filter((F.col("payload_type") == names.ADVERT) & (F.length("raw_hex") >= 4)
                     & names.advert_key().isNotNull() & (names.advert_key() != "")
                     & _byte(F.lit(1)).bitwiseAND(3).isin(2, 3) & (_byte(F.lit(3)).bitwiseAND(63) == 0))
    head = head.select(F.col("id").alias("transmission_id"), names.advert_key().alias("public_key"))
    where = observers.select(F.col("id").alias("observer_id"), F.upper(F.trim("iata")).alias("region")).filter(
        F.col("region") != "")
    votes = obs.select("transmission_id", "observer_id").join(head, "transmission_id").join(where, "observer_id")
    n = votes.groupBy("public_key", "region").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("public_key").agg(F.min(F.struct(-F.col("n"), F.col("region").alias("r"))).alias("b")).select(
        "public_key", F.col("b.r").alias("region"))


node_home_region = home_regions


def sized_packets(tx: DataFrame, obs: DataFrame, observers: DataFrame, region: str | None = None) -> DataFrame:
    """Packets with a usable prefix size (1..3).

    With a region, adverts of nodes at home there count even when nobody there heard them.
    """
    p = frame_header(tx).filter(F.col("hash_size") <= 3)
    codes = region_codes(region)
    if codes is None:
        return p
    ids = heard_ids(obs_in_region(obs, observers, region)).withColumn("_heard", F.lit(True))
    home = home_regions(tx, obs, observers).filter(F.col("region").isin(*codes)).select(
        F.col("public_key").alias("_home"))
    key = F.when(F.col("payload_type") == names.ADVERT, names.advert_key())
    return (p.join(ids, p.id == ids.transmission_id, "left").drop("transmission_id")
            .join(home, key == F.col("_home"), "left")
            .filter(F.col("_heard").isNotNull() | F.col("_home").isNotNull()).drop("_heard", "_home"))


def _with_hops(p: DataFrame, obs: DataFrame) -> DataFrame:
    best = best_observation(obs, ("path",)).filter(F.size("path") > 0)
    return p.join(best.select("transmission_id", "path"), p.id == best.transmission_id).drop("transmission_id")


def hash_size_distribution(tx, obs, observers, region=None) -> DataFrame:
    """Relayed packets per prefix size; sizes without traffic show as zero."""
    p = _with_hops(sized_packets(tx, obs, observers, region), obs)
    n = [F.count_if(F.col("hash_size") == s).alias(f"size_{s}") for s in (1, 2, 3)]
    return p.agg(F.count(F.lit(1)).alias("total"), *n)


def hash_size_hourly(tx, obs, observers, region=None) -> DataFrame:
    p = _with_hops(sized_packets(tx, obs, observers, region), obs)
    n = [F.count_if(F.col("hash_size") == s).alias(f"size_{s}") for s in (1, 2, 3)]
    return p.groupBy(hour_of(F.col("first_seen")).alias("hour")).agg(*n)


def hash_top_hops(tx, obs, observers, nodes, region=None, limit: int = 50) -> DataFrame:
    p = _with_hops(sized_packets(tx, obs, observers, region), obs)
    top = (p.select(F.explode("path").alias("hex")).groupBy("hex").agg(F.count(F.lit(1)).alias("count"))
           .orderBy(F.col("count").desc(), "hex").limit(limit))
    st = R.prefix_stats(R.prefix_candidates(nodes)).select("prefix", F.col("lo").alias("pubkey"))
    who = R.relays(nodes).select(F.col("key").alias("pubkey"), "name")
    return top.join(st, F.lower("hex") == F.col("prefix"), "left").join(who, "pubkey", "left").select(
        "hex", F.floor((F.length("hex") + 1) / 2).alias("size"), "count", "name", "pubkey")


def advert_sizes(tx, obs, observers, nodes, region=None) -> DataFrame:
    """Per advertising node: prefix size of its last relayed advert (0 if none), adverts, last time."""
    p = sized_packets(tx, obs, observers, region).filter(F.col("payload_type") == names.ADVERT)
    p = p.select(names.advert_key().alias("pubkey"), "id", "first_seen", "hash_size", "zero_hop",
                 F.col("decoded.name").alias("n")).filter(F.col("pubkey") != "")
    order = F.struct("first_seen", "id")
    g = p.groupBy("pubkey").agg(
        F.coalesce(F.max_by(F.when(~F.col("zero_hop"), F.col("hash_size")), F.when(~F.col("zero_hop"), order)), F.lit(0)).alias("hash_size"),
        F.count(F.lit(1)).alias("packets"), F.max("first_seen").alias("last_seen"), F.min_by("n", order).alias("n"))
    roles = nodes.select(F.col("public_key").alias("pubkey"), "role")
    g = g.join(roles, "pubkey", "left").select(
        "pubkey", F.coalesce(F.when(F.col("n") != "", F.col("n")), F.substring("pubkey", 1, 8)).alias("name"), "role",
        "hash_size", "packets", "last_seen")
    codes = region_codes(region)
    if codes is None:
        return g
    abroad = home_regions(tx, obs, observers).filter(~F.col("region").isin(*codes)).select(F.col("public_key").alias("pubkey"))
    return g.join(abroad, "pubkey", "left_anti")


def hash_multibyte_nodes(tx, obs, observers, nodes, region=None) -> DataFrame:
    return advert_sizes(tx, obs, observers, nodes, region).filter(F.col("hash_size") > 1)


region_attribution = hash_multibyte_nodes


def hash_by_repeaters(tx, obs, observers, nodes, region=None) -> DataFrame:
    a = advert_sizes(tx, obs, observers, nodes, region).filter(F.contains(F.lower("role"), F.lit("repeater")))
    base = tx.sparkSession.range(1, 4).select(F.col("id").cast("int").alias("hash_size"), F.lit(0).cast("bigint").alias("c"))
    return a.groupBy("hash_size").agg(F.count(F.lit(1)).alias("c")).unionByName(base).groupBy("hash_size").agg(
        F.sum("c").alias("count"))


def node_hash_size_info(tx: DataFrame, now) -> DataFrame:
    """Prefix sizes a node advertised in the last 7 days, and whether it keeps flipping."""
    p = frame_header(tx.filter((F.col("payload_type") == names.ADVERT)
                               & (F.col("first_seen") >= ts_lit(now) - F.expr("INTERVAL 7 DAYS"))))
    p = p.filter(~F.col("zero_hop")).select(names.advert_key().alias("pubkey"), "first_seen", "id", "hash_size").filter(F.col("pubkey") != "")
    s = with_previous(p, ["pubkey"], ["first_seen", "id"], F.floor(F.unix_seconds("first_seen") / 3600), ["hash_size"])
    order = F.struct("first_seen", "id")
    g = s.groupBy("pubkey").agg(
        F.max_by("hash_size", order).alias("hash_size"), F.sort_array(F.collect_set("hash_size")).alias("sizes_seen"),
        F.count(F.lit(1)).alias("adverts"), F.count_if(F.col("hash_size") != F.col("prev_hash_size")).alias("changes"))
    return g.select("pubkey", "hash_size", "sizes_seen", "adverts",
                    ((F.col("adverts") >= 3) & (F.size("sizes_seen") >= 2) & (F.col("changes") >= 2)).alias("inconsistent"))


def sized_nodes(nodes: DataFrame, info: DataFrame) -> DataFrame:
    n = nodes.select("public_key", "name", "role", F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lon", F.lit(0.0)).alias("lon"))
    return n.join(info.withColumnRenamed("pubkey", "public_key"), "public_key", "left").withColumns({
        "hash_size": F.coalesce("hash_size", F.lit(0)), "inconsistent": F.coalesce("inconsistent", F.lit(False))})


def inconsistent_nodes(nodes: DataFrame, info: DataFrame) -> DataFrame:
    return sized_nodes(nodes, info).filter(F.col("inconsistent") & F.col("role").isin("repeater", "room_server"))


def regional_nodes(nodes: DataFrame, tx: DataFrame, obs: DataFrame, observers: DataFrame, region: str | None) -> DataFrame:
    """Nodes that advertised to, or are stations on packets heard in, a region."""
    if region_codes(region) is None:
        return nodes
    ids = heard_ids(obs_in_region(obs, observers, region))
    adv = tx.join(ids, tx.id == ids.transmission_id, "left_semi").select(F.explode(F.array_compact(F.array(
        "decoded.pubKey", "decoded.public_key"))).alias("public_key"))
    sta = obs.join(ids, "transmission_id", "left_semi").select(F.col("observer_id").alias("public_key"))
    return nodes.join(adv.union(sta).distinct(), "public_key", "left_semi")


def _members(nodes: DataFrame, info: DataFrame) -> DataFrame:
    """Repeaters under the prefix of the size they use."""
    s = sized_nodes(nodes, info).filter((F.col("role") == "repeater") & F.col("hash_size").between(1, 3))
    return s.filter(F.length("public_key") >= F.col("hash_size") * 2).withColumn(
        "prefix", F.upper(F.substr(F.col("public_key"), F.lit(1), F.col("hash_size") * 2)))


def hash_collisions(nodes: DataFrame, info: DataFrame) -> DataFrame:
    """Prefixes shared by several repeaters, with the largest distance between them.

    Only points that can end the longest line are paired: with centre c, r = |p - c| and a line
    of length L already found, any end of a longer one has r >= L - max(r). That keeps the rim of
    a group and drops its interior, exactly. Equal positions count once.
    """
    m = _members(nodes, info)
    here = (F.col("lat") != 0) | (F.col("lon") != 0)
    groups = m.groupBy("hash_size", "prefix").agg(F.count(F.lit(1)).alias("appearances"), F.count_if(here).alias("with_coords")).filter(
        F.col("appearances") > 1)
    k = ["hash_size", "prefix"]
    x, y, z = geo.unit_vector(F.col("lat"), F.col("lon"))
    pts = m.filter(here).join(groups.filter(F.col("with_coords") > 1).select(*k), k, "left_semi").select(*k, "lat", "lon").distinct()
    pts = pts.withColumns({"x": x, "y": y, "z": z})
    mid = pts.groupBy(*k).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    gap = lambda a, b, c, d, e, f: F.sqrt(F.pow(a - d, F.lit(2)) + F.pow(b - e, F.lit(2)) + F.pow(c - f, F.lit(2)))
    c = F.col
    pts = pts.join(mid, k).withColumn("r", gap(c("x"), c("y"), c("z"), c("cx"), c("cy"), c("cz")))
    far = pts.groupBy(*k).agg(F.max(F.struct("r", "x", "y", "z")).alias("f"))
    line = pts.join(far, k).withColumn("l", gap(c("x"), c("y"), c("z"), c("f.x"), c("f.y"), c("f.z"))).groupBy(*k).agg(
        F.max("l").alias("l"), F.max("f.r").alias("rmax"))
    rim = pts.join(line, k).filter(c("r") >= c("l") - c("rmax") - 1e-9).select(*k, "lat", "lon")
    other = rim.select(*k, c("lat").alias("lat2"), c("lon").alias("lon2"))
    pairs = rim.join(other, k).filter((c("lat") < c("lat2")) | ((c("lat") == c("lat2")) & (c("lon") < c("lon2"))))
    longest = pairs.groupBy(*k).agg(F.max(geo.haversine_km(c("lat"), c("lon"), c("lat2"), c("lon2"))).alias("d"))
    out = groups.join(longest, k, "left").withColumn("max_dist_km", F.coalesce("d", F.lit(0.0)))
    label = (F.when(c("with_coords") < 2, "incomplete").when(c("max_dist_km") < LOCAL_KM, "local")
             .when(c("max_dist_km") < REGIONAL_KM, "regional").otherwise("distant"))
    return out.select(*k, "appearances", "with_coords", "max_dist_km", label.alias("classification"))


def collision_members(nodes: DataFrame, info: DataFrame) -> DataFrame:
    """The nodes behind every shared prefix."""
    m = _members(nodes, info)
    shared = m.groupBy("hash_size", "prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return m.join(shared, ["hash_size", "prefix"], "left_semi").select("hash_size", "prefix", "public_key", "name", "lat", "lon")


def hash_space_stats(nodes: DataFrame, info: DataFrame) -> DataFrame:
    """Per size: nodes, users, distinct prefixes, collisions, share of the address space."""
    s = sized_nodes(nodes, info)
    total = s.agg(F.count(F.lit(1))).scalar()
    using = s.groupBy(F.col("hash_size").alias("size")).agg(F.count(F.lit(1)).alias("using_this_size"))
    per = _members(nodes, info).groupBy("hash_size", "prefix").agg(F.count(F.lit(1)).alias("n"))
    pre = per.groupBy(F.col("hash_size").alias("size")).agg(
        F.sum("n").alias("nodes_for_byte"), F.count(F.lit(1)).alias("unique_prefixes"), F.count_if(F.col("n") > 1).alias("collision_count"))
    sizes = nodes.sparkSession.range(1, 4).select(F.col("id").cast("int").alias("size"))
    z = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    space = F.pow(F.lit(256.0), F.col("size"))
    return sizes.join(using, "size", "left").join(pre, "size", "left").select(
        "size", total.alias("total_nodes"), z("nodes_for_byte"), z("using_this_size"), z("unique_prefixes"), z("collision_count"),
        space.cast("bigint").alias("space_size"), (F.coalesce("unique_prefixes", F.lit(0)) / space * 100).alias("pct_used"))


def hash_matrix(nodes: DataFrame, info: DataFrame) -> DataFrame:
    """All 256 first bytes: one-byte members, two-byte members, two-byte collisions and the largest one."""
    per = _members(nodes, info).filter(F.col("hash_size") <= 2).groupBy("hash_size", "prefix").agg(F.count(F.lit(1)).alias("n"))
    two = F.col("hash_size") == 2
    cell = per.groupBy(F.substring("prefix", 1, 2).alias("cell")).agg(
        F.sum(F.when(~two, F.col("n"))).alias("one_byte_nodes"), F.sum(F.when(two, F.col("n"))).alias("two_byte_nodes"),
        F.count_if(two & (F.col("n") > 1)).alias("two_byte_collisions"), F.max(F.when(two & (F.col("n") > 1), F.col("n"))).alias("max_collision"))
    grid = nodes.sparkSession.range(256).select(F.lpad(F.hex("id"), 2, "0").alias("cell"))
    z = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return grid.join(cell, "cell", "left").select("cell", z("one_byte_nodes"), z("two_byte_nodes"), z("two_byte_collisions"), z("max_collision"))


def multibyte_capability(tx, obs, observers, nodes, now) -> DataFrame:
    """confirmed by an advert, suspected from a multi-byte path through the node's prefix, or unknown."""
    info = node_hash_size_info(tx, now).select(F.col("pubkey").alias("public_key"), F.array_max("sizes_seen").alias("advertised"))
    adopt = hash_multibyte_nodes(tx, obs, observers, nodes).select(F.col("pubkey").alias("public_key"), F.col("hash_size").alias("adopted"))
    head = frame_header(tx.filter(F.coalesce("payload_type", F.lit(-1)) != names.PATH)).filter(F.col("hash_size") >= 2)
    hops = _with_hops(head, obs).select(F.explode(F.array_distinct(F.transform("path", F.lower))).alias("prefix"), "hash_size").groupBy(
        "prefix").agg(F.max("hash_size").alias("seen"))
    mine = nodes.select("public_key", F.explode(F.array(*[F.substring(F.lower("public_key"), 1, n) for n in (2, 4, 6)])).alias("prefix"))
    susp = mine.join(hops, "prefix").groupBy("public_key").agg(F.max("seen").alias("suspected"))
    j = nodes.select("public_key", "name", "role", "last_seen").join(info, "public_key", "left").join(adopt, "public_key", "left").join(
        susp, "public_key", "left")
    conf = F.coalesce(F.when(F.col("advertised") >= 2, F.col("advertised")), F.col("adopted"))
    return j.select(
        "public_key", "name", "role", "last_seen",
        F.when(conf.isNotNull(), "confirmed").when(F.col("suspected").isNotNull(), "suspected").otherwise("unknown").alias("status"),
        F.when(conf.isNotNull(), "advert").when(F.col("suspected").isNotNull(), "path").otherwise("").alias("evidence"),
        F.coalesce(conf, F.col("suspected"), F.lit(1)).alias("max_hash_size"))


def prefix_check(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Repeaters sharing the first 1, 2 or 3 bytes of each given key, the key itself not counted."""
    rep = nodes.filter(F.col("role") == "repeater").select(F.upper("public_key").alias("k"))
    sizes = F.array(F.lit(1), F.lit(2), F.lit(3))
    counts = rep.select("k", F.explode(sizes).alias("bytes")).groupBy(
        "bytes", F.substr(F.col("k"), F.lit(1), F.col("bytes") * 2).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    q = keys.select(F.upper(F.trim("key")).alias("key"))
    full = F.length("key") >= 8
    q = q.select("key", F.explode(sizes).alias("bytes")).filter(full | (F.length("key") == F.col("bytes") * 2)).withColumn(
        "prefix", F.substr(F.col("key"), F.lit(1), F.col("bytes") * 2))
    own = rep.select(F.col("k").alias("key"), F.lit(1).alias("own"))
    return q.join(counts, ["bytes", "prefix"], "left").join(own, "key", "left").select(
        "key", "bytes", "prefix", (F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("colliders"))


def free_prefixes(nodes: DataFrame, size: int = 2) -> DataFrame:
    """Prefixes of a size that no repeater uses."""
    used = nodes.filter(F.col("role") == "repeater").select(F.upper(F.substring("public_key", 1, 2 * size)).alias("prefix")).distinct()
    return nodes.sparkSession.range(256 ** size).select(F.lpad(F.hex("id"), 2 * size, "0").alias("prefix")).join(used, "prefix", "left_anti")


def prefix_overview(nodes: DataFrame) -> DataFrame:
    """Used and shared prefixes per size, and the recommended size."""
    rep = nodes.filter(F.col("role") == "repeater").select(F.upper("public_key").alias("k"))
    total = rep.agg(F.count(F.lit(1))).scalar()
    per = rep.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("size"), "k").groupBy(
        "size", F.substr(F.col("k"), F.lit(1), F.col("size") * 2).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("size").agg(F.count(F.lit(1)).alias("used"), F.count_if(F.col("n") > 1).alias("colliding")).select(
        "size", "used", "colliding", (F.pow(F.lit(256.0), F.col("size")).cast("bigint") - F.col("used")).alias("available"),
        F.when(total < 20, 1).otherwise(2).alias("recommended"))
