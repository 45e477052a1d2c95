"""Packet and node selection: filters, paging, representative observations."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from meshlake.functions import names
from meshlake.functions.ranks import top_per_group
from meshlake.functions.time import TimeWindow, ts_lit, utc
from meshlake.functions import geo

DEFAULT_PAGE = 50


# ---- regions and observers -------------------------------------------------------------

def region_codes(region: str | None) -> list[str] | None:
    """Codes of a comma list, upper-cased; ``None`` when there is no restriction."""
    if region is None:
        return None
    codes = [c.strip().upper() for c in region.split(",") if c.strip()]
    if not codes or "ALL" in codes:
        codes = [c for c in codes if c != "ALL"]
    return codes or None


def region_observers(observers: DataFrame, region: str) -> DataFrame:
    return observers.filter(F.upper(F.trim("iata")).isin(*(region_codes(region) or []))).select(
        F.col("id").alias("observer_id"))


def obs_in_region(obs: DataFrame, observers: DataFrame, region: str | None) -> DataFrame:
    """Observations made by the region's observers; an unknown region yields none."""
    if region_codes(region) is None:
        return obs
    return obs.join(region_observers(observers, region), "observer_id", "left_semi")


def heard_ids(obs: DataFrame) -> DataFrame:
    """Distinct transmissions of some observations, deduplicated before they are shuffled."""
    return obs.select("transmission_id").distinct()


def tx_in_region(tx: DataFrame, obs: DataFrame, observers: DataFrame, region: str | None) -> DataFrame:
    if region_codes(region) is None:
        return tx
    ids = heard_ids(obs_in_region(obs, observers, region))
    return tx.join(ids, tx.id == ids.transmission_id, "left_semi")


def observer_semi(tx: DataFrame, obs: DataFrame, observer_ids: str | list[str]) -> DataFrame:
    """Transmissions heard by any of the listed observers."""
    wanted = observer_ids.split(",") if isinstance(observer_ids, str) else observer_ids
    ids = heard_ids(obs.filter(F.col("observer_id").isin(*[w.strip() for w in wanted])))
    return tx.join(ids, tx.id == ids.transmission_id, "left_semi")


region_semi = tx_in_region


# ---- time ------------------------------------------------------------------------------

def heard_in(obs: DataFrame, window: TimeWindow | None) -> DataFrame:
    """Observations that packets first seen in the window can have.

    A packet's time is that of its first hearing, so none of its observations is older than the window. Packets
    without a time have observations without one. The bounds are plain comparisons and reach the scan: the days
    of a table stored by day, else the statistics of its row groups.
    """
    if window is None or window.since is None:
        return obs
    since = ts_lit(window.since)
    out = obs.filter(F.col("timestamp").isNull() | (F.col("timestamp") >= since))
    return out.filter(F.col("day").isNull() | (F.col("day") >= F.to_date(since))) if "day" in obs.columns else out


def seen_in(tx: DataFrame, window: TimeWindow | None) -> DataFrame:
    """Packets first seen in the window, by day first where the table is stored by day."""
    if window is None:
        return tx
    out = tx.filter(window.holds(F.col("first_seen")))
    if "day" in tx.columns:
        days = [F.col("day") >= F.to_date(ts_lit(window.since))] if window.since else []
        days += [F.col("day") <= F.to_date(ts_lit(window.until))] if window.until else []
        for d in days:
            out = out.filter(F.col("day").isNull() | d)
    return out


# ---- representative observation --------------------------------------------------------

def best_observation(obs: DataFrame, cols: tuple[str, ...] = ("path", "snr", "rssi", "observer_id", "timestamp")) -> DataFrame:
    """One row per transmission: longest path, then newest, then smallest id.

    ``obs`` may also be the table kept of these rows (`best_table`, `plans.upkeep`), which is read as it is.
    """
    if "observation_count" in obs.columns:
        return obs.select("transmission_id", *cols, "observation_count")
    order = F.struct(F.coalesce(F.size("path"), F.lit(0)), F.col("timestamp"), (-F.col("id")))
    best = obs.groupBy("transmission_id").agg(
        F.max_by(F.struct(*cols), order).alias("_best"), F.count(F.lit(1)).alias("observation_count"))
    return best.select("transmission_id", *[F.col("_best")[c].alias(c) for c in cols], "observation_count")


def best_table(obs: DataFrame) -> DataFrame:
    """What reports read of each packet's best observation, to be kept."""
    return best_observation(obs, ("path", "snr", "rssi", "observer_id", "timestamp", "resolved_path"))


def with_best(tx: DataFrame, obs: DataFrame, cols: tuple[str, ...] = ("path", "snr", "rssi", "observer_id", "timestamp"),
              how: str = "inner") -> DataFrame:
    best = best_observation(obs, cols)
    return tx.join(best, tx.id == best.transmission_id, how).drop("transmission_id")


# ---- node membership -------------------------------------------------------------------

def node_links(tx: DataFrame, obs: DataFrame) -> DataFrame:
    """(public_key, id): nodes named in a packet or resolved as one of its relays, once each."""
    named = tx.select("id", F.explode(F.array_distinct(F.array_compact(F.array(
        "decoded.pubKey", "decoded.destPubKey", "decoded.srcPubKey")))).alias("public_key"))
    relayed = obs.select(F.col("transmission_id").alias("id"), F.explode(F.array_distinct("resolved_path")).alias("public_key"))
    return (named.unionByName(relayed).filter(F.col("public_key").isNotNull() & (F.col("public_key") != ""))
            .distinct())


def node_packets(tx: DataFrame, obs: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Packets of one node given by key or by name."""
    keys = nodes.filter((F.col("public_key") == node) | (F.col("name") == node)).agg(
        F.coalesce(F.min("public_key"), F.lit(node)).alias("k"))
    key = keys.scalar()
    d = F.col("decoded")
    relayed = heard_ids(obs.filter(F.array_contains("resolved_path", key)))
    named = tx.filter((d["pubKey"] == key) | (d["destPubKey"] == key) | (d["srcPubKey"] == key)).select(
        F.col("id").alias("transmission_id"))
    ids = named.union(relayed).distinct()
    return tx.join(ids, tx.id == ids.transmission_id, "left_semi")


def multi_node_packets(tx: DataFrame, obs: DataFrame, keys: list[str], since: datetime | str | None = None,
                       until: datetime | str | None = None, limit: int = DEFAULT_PAGE, offset: int = 0,
                       order: str = "desc", after: Cursor | None = None) -> DataFrame:
    """Union over several nodes, inclusive time bounds, one page, by offset or after a cursor."""
    d = F.col("decoded")
    named = tx.filter(d["pubKey"].isin(*keys) | d["destPubKey"].isin(*keys) | d["srcPubKey"].isin(*keys)).select(
        F.col("id").alias("transmission_id"))
    relayed = heard_ids(obs.filter(F.arrays_overlap("resolved_path", F.array(*[F.lit(k) for k in keys]))))
    ids = named.union(relayed).distinct()
    hit = tx.join(ids, tx.id == ids.transmission_id, "left_semi")
    hit = hit.filter(TimeWindow(utc(since) if since else None, utc(until) if until else None).holds(F.col("first_seen")))
    return page(hit.filter(beyond(after, order)), limit, offset, order)


# ---- filters ---------------------------------------------------------------------------

def channel_match(channel: str) -> Column:
    """Decoded channel name, or ``enc_<HEX>`` for an undecodable one."""
    d = F.col("decoded")
    hit = d["channel"] == channel
    if channel.startswith("enc_"):
        hit = F.coalesce(hit, F.lit(False)) | (d["channelHashHex"] == channel[4:])
    return F.coalesce((F.col("payload_type") == names.GRP_TXT) & hit, F.lit(False))


def filter_packets(tx: DataFrame, obs: DataFrame, observers: DataFrame, nodes: DataFrame, *, type: int | None = None,
                   route: int | None = None, hash: str | None = None, observer: str | None = None,
                   region: str | None = None, node: str | None = None, channel: str | None = None,
                   since: datetime | str | None = None, until: datetime | str | None = None,
                   bounds: str = "exclusive") -> DataFrame:
    """Conjunction of the given filters.

    ``bounds='exclusive'`` compares ``first_seen``; ``'observed'`` keeps a packet when some
    observation lies inside the inclusive range.
    """
    out = tx.filter((F.col("hash") != "") & F.col("first_seen").isNotNull())
    if type is not None:
        out = out.filter(F.col("payload_type") == type)
    if route is not None:
        out = out.filter(F.col("route_type") == route)
    if hash:
        out = out.filter(F.col("hash") == hash.lower())
    if channel:
        out = out.filter(channel_match(channel))
    if bounds == "exclusive":
        if since:
            out = out.filter(F.col("first_seen") > ts_lit(since))
        if until:
            out = out.filter(F.col("first_seen") < ts_lit(until))
    else:
        for cond in ([F.col("timestamp") >= ts_lit(since)] if since else []) + (
                [F.col("timestamp") <= ts_lit(until)] if until else []):
            ids = heard_ids(obs.filter(cond))
            out = out.join(ids, out.id == ids.transmission_id, "left_semi")
    if observer:
        out = observer_semi(out, obs, observer)
    if region:
        out = tx_in_region(out, obs, observers, region)
    if node:
        out = node_packets(out, obs, nodes, node)
    return out


def page(tx: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0, order: str = "asc") -> DataFrame:
    if limit <= 0 or offset < 0:
        raise ValueError("a page needs a positive limit and an offset of 0 or more")
    cols = [F.col("first_seen"), F.col("id")]
    return tx.orderBy(*[c.desc() if order == "desc" else c.asc() for c in cols]).offset(offset).limit(limit)


Cursor = tuple[datetime | str | None, int]


def beyond(after: Cursor | None, order: str = "asc", time: str = "first_seen", ident: str = "id") -> Column:
    """Rows that come after the row of a cursor (its time and id) in the order of `page`; rows without a time come first in "asc", last in "desc"."""
    if after is None:
        return F.lit(True)
    t, i = F.col(time), F.col(ident)
    up = order != "desc"
    same = i > after[1] if up else i < after[1]
    if after[0] is None:
        return (t.isNull() & same) | t.isNotNull() if up else t.isNull() & same
    at = ts_lit(utc(after[0]))
    # the plain bound is implied by the rest, and is what reaches the scan
    return (t >= at) & ((t > at) | same) if up else ((t <= at) & ((t < at) | same)) | t.isNull()


def _page_days(tx: DataFrame, after: Cursor | None, limit: int, up: bool) -> DataFrame:
    """The days from the cursor on that hold a page: one day is looked at, then two, four and so on, until they do."""
    first, last = tx.agg(F.min("day"), F.max("day")).first()
    undated = tx.filter(F.col("day").isNull())
    at = utc(after[0]).date() if after and after[0] is not None else None
    got = undated if up and at is None else tx.filter(F.lit(False))
    if first is not None and (up or after is None or at is not None):
        as_date = lambda d: d if isinstance(d, date) else date.fromisoformat(str(d))
        first, last = as_date(first), as_date(last)
        edge, span = (max(at or first, first) if up else min(at or last, last)), 1
        while first <= edge <= last:
            lo, hi = (edge, edge + timedelta(days=span - 1)) if up else (edge - timedelta(days=span - 1), edge)
            days = tx.filter((F.col("day") >= F.lit(lo)) & (F.col("day") <= F.lit(hi)))
            with_undated = up and at is None
            if days.limit(limit).count() >= limit:
                return days.unionByName(undated) if with_undated else days
            if (hi >= last) if up else (lo <= first):
                return days.unionByName(undated) if with_undated or not up else days
            span *= 2
    return got if up else undated


def seek(tx: DataFrame, limit: int = DEFAULT_PAGE, after: Cursor | None = None, order: str = "asc") -> DataFrame:
    """The page after the row of a cursor (None: the first page), in the order of `page`.

    Any page costs one page: no rows before it are brought together, and of a table stored by day only the days that the page
    lies in are read, at most twice as many as needed. The cursor of the next page is first_seen and id of the last row.
    """
    if limit <= 0:
        raise ValueError("a page needs a positive limit")
    rest = tx.filter(beyond(after, order))
    if "day" in tx.columns:
        rest = _page_days(rest, after, limit, order != "desc")
    return page(rest, limit, 0, order)


def packet_total(tx: DataFrame) -> DataFrame:
    return tx.agg(F.count(F.lit(1)).alias("total"))


def grouped_packets(tx: DataFrame, obs: DataFrame, observers: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """One row per packet with observation and observer counts, newest activity first.

    Only times are aggregated over all observations; counts and paths are looked up for the page.
    """
    newest = obs.groupBy("transmission_id").agg(F.max("timestamp").alias("_latest"))
    heads = tx.join(newest, tx.id == newest.transmission_id, "left").select(
        "id", "hash", "first_seen", "payload_type", "route_type", F.coalesce("_latest", "first_seen").alias("latest"))
    top = heads.orderBy(F.col("latest").desc(), F.col("id").desc()).offset(offset).limit(limit)
    shown = obs.join(top.select(F.col("id").alias("transmission_id")), "transmission_id", "left_semi")
    best = best_observation(shown, ("observer_id", "path", "snr", "rssi"))
    heard = shown.groupBy("transmission_id").agg(F.count_distinct("observer_id").alias("observer_count"))
    found = best.join(heard, "transmission_id").withColumnRenamed("transmission_id", "id")
    top = top.join(found, "id", "left").select(
        "id", "hash", "first_seen", "payload_type", "route_type", F.coalesce("observation_count", F.lit(0)).alias("observation_count"),
        F.coalesce("observer_count", F.lit(0)).alias("observer_count"), "latest", "observer_id", "path", "snr", "rssi")
    who = observers.select(F.col("id").alias("observer_id"), F.col("name").alias("observer_name"))
    return top.join(who, "observer_id", "left")


def by_hash(tx: DataFrame, hash: str) -> DataFrame:
    return tx.filter(F.col("hash") == hash.lower())


def by_id(tx: DataFrame, ident: int) -> DataFrame:
    return tx.filter(F.col("id") == ident)


def packet_detail(tx: DataFrame) -> DataFrame:
    """Byte ranges of a frame: header, transport codes, path length, path, payload."""
    nib = lambda pos: F.conv(F.substr(F.col("raw_hex"), pos, F.lit(2)), 16, 10).cast("int")
    route = F.conv(F.substring("raw_hex", 1, 2), 16, 10).cast("int").bitwiseAND(3)
    t_len = F.when(route.isin(0, 3), 4).otherwise(0)
    path_byte = nib(F.lit(3) + t_len * 2)
    p_len = (F.shiftright(path_byte, 6) + 1) * path_byte.bitwiseAND(63)
    total = F.floor(F.length("raw_hex") / 2).cast("int")
    seg = lambda label, start, size: F.struct(F.lit(label).alias("part"), start.cast("int").alias("start"), size.cast("int").alias("size"))
    start = t_len + 2
    parts = F.array(seg("header", F.lit(0), F.lit(1)), seg("transport_codes", F.lit(1), t_len),
                    seg("path_length", t_len + 1, F.lit(1)), seg("path", start, p_len),
                    seg("payload", start + p_len, F.greatest(total - start - p_len, F.lit(0))))
    return tx.select("id", "hash", F.explode(parts).alias("s")).select(
        "id", "hash", "s.part", "s.start", "s.size").filter(F.col("size") > 0)


def observations_for_hashes(tx: DataFrame, obs: DataFrame, hashes: list[str] | DataFrame) -> DataFrame:
    """Observations of the given packets (a list, or a table with a column ``hash``), nested per hash."""
    if isinstance(hashes, DataFrame):
        pick = tx.join(hashes.select(F.lower("hash").alias("hash")).distinct(), "hash", "left_semi")
    else:
        pick = tx.filter(F.col("hash").isin(*[h.lower() for h in hashes]))
    pick = pick.select(F.col("id").alias("transmission_id"), "hash")
    rows = obs.join(pick, "transmission_id").select("hash", F.struct("timestamp", "id", "observer_id", "snr", "rssi", "path").alias("o"))
    return rows.groupBy("hash").agg(F.sort_array(F.collect_list("o")).alias("observations"), F.count(F.lit(1)).alias("n"))


def timestamps_since(tx: DataFrame, since: datetime | str) -> DataFrame:
    return tx.filter(F.col("first_seen") > ts_lit(since)).select("first_seen").orderBy("first_seen")


def trace_packet(tx: DataFrame, obs: DataFrame, observers: DataFrame, hash: str) -> DataFrame:
    """All hearings of one packet in time order, with the delay after the first."""
    pick = by_hash(tx, hash).select(F.col("id").alias("transmission_id"), "hash")
    rows = obs.join(pick, "transmission_id")
    first = rows.agg(F.min("timestamp")).scalar()
    who = observers.select(F.col("id").alias("observer_id"), F.col("name").alias("observer_name"))
    return (rows.join(who, "observer_id", "left")
            .select("id", "hash", "observer_id", "observer_name", "snr", "rssi", "timestamp", "path",
                    (F.unix_seconds("timestamp") - F.unix_seconds(first)).alias("after_first_secs"))
            .orderBy("timestamp", "id"))


def recent_node_packets(tx: DataFrame, obs: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """Latest packets sent by a node, each with its observations nested."""
    top = tx.filter(F.col("from_pubkey") == key).orderBy(F.col("first_seen").desc(), F.col("id").desc()).limit(limit)
    o = obs.select("transmission_id", F.struct("timestamp", "id", "observer_id", "snr", "rssi", "path").alias("o"))
    return (top.join(o, top.id == o.transmission_id, "left")
            .groupBy("id", "hash", "first_seen", "payload_type")
            .agg(F.sort_array(F.collect_list("o"), asc=False).alias("observations")))


def direct_packets(tx: DataFrame, obs: DataFrame, key: str, now: datetime | str | None = None, hours: int | None = None,
                   limit: int = 200) -> DataFrame:
    """Packets some observation of which has the node as first hop."""
    first = F.lower(F.get("path", F.lit(0)))
    ids = heard_ids(obs.filter((F.size("path") > 0) & F.startswith(F.lit(key.lower()), first)))
    base = tx
    if hours is not None and now is not None:
        base = base.filter(F.col("first_seen") >= ts_lit(now) - F.make_dt_interval(hours=F.lit(hours)))
    return (base.join(ids, base.id == ids.transmission_id, "left_semi")
            .orderBy(F.col("first_seen").desc(), F.col("id").desc()).limit(limit))


# ---- node lists ------------------------------------------------------------------------

NODE_SORTS = {
    "name": lambda: [F.col("name").asc_nulls_first()],
    "lastSeen": lambda: [F.col("last_seen").desc_nulls_last()],
    "packetCount": lambda: [F.col("advert_count").desc_nulls_last()],
}


def matching_nodes(nodes: DataFrame, *, role: str | None = None, search: str | None = None,
                   before: datetime | str | None = None, last_heard: str | None = None, now: datetime | str | None = None,
                   region_keys: DataFrame | None = None) -> DataFrame:
    """Node filters; ``region_keys`` is a one-column table of keys heard in a region."""
    out = nodes
    if role:
        out = out.filter(F.col("role") == role)
    if search:
        out = out.filter(F.contains(F.lower("name"), F.lit(search.lower())))
    if before:
        out = out.filter(F.col("first_seen") <= ts_lit(before))
    if last_heard and now:
        w = {"1h": 1, "6h": 6, "24h": 24, "7d": 168, "30d": 720}.get(last_heard)
        if w:
            out = out.filter(F.col("last_seen") > ts_lit(now) - F.make_dt_interval(hours=F.lit(w)))
    if region_keys is not None:
        out = out.join(region_keys, "public_key", "left_semi")
    return out


def list_nodes(nodes: DataFrame, *, limit: int = 50, offset: int = 0, sort_by: str = "lastSeen", **filters) -> DataFrame:
    order = NODE_SORTS.get(sort_by, NODE_SORTS["lastSeen"])()
    return matching_nodes(nodes, **filters).orderBy(*order, "public_key").offset(offset).limit(limit)


def node_totals(nodes: DataFrame, **filters) -> DataFrame:
    """Nodes that the filters of `list_nodes` leave, by role and in all (role null): role, nodes."""
    per = matching_nodes(nodes, **filters).groupBy(F.coalesce("role", F.lit("")).alias("role")).agg(F.count(F.lit(1)).alias("nodes"))
    return per.unionByName(per.agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes")).select(F.lit(None).cast("string").alias("role"), "nodes"))


def region_node_keys(tx: DataFrame, obs: DataFrame, observers: DataFrame, region: str) -> DataFrame:
    """Keys of nodes whose adverts were heard by a region's observers."""
    adv = tx.filter((F.col("payload_type") == names.ADVERT) & F.col("from_pubkey").isNotNull())
    return tx_in_region(adv, obs, observers, region).select(F.col("from_pubkey").alias("public_key")).distinct()


def search_nodes(nodes: DataFrame, text: str, limit: int = 10) -> DataFrame:
    hit = F.contains(F.lower("name"), F.lit(text.lower())) | F.startswith(F.lower("public_key"), F.lit(text.lower()))
    return nodes.filter(hit).orderBy(F.col("last_seen").desc(), "public_key").limit(limit)


def node_by_prefix(nodes: DataFrame, prefix: str) -> DataFrame:
    """The one node with a key prefix of at least 8 hex characters; ``ambiguous`` when there are more."""
    p = prefix.lower()
    valid = len(p) >= 8 and all(c in "0123456789abcdef" for c in p)
    hit = nodes.filter(F.startswith("public_key", F.lit(p)) if valid else F.lit(False))
    return hit.agg(F.count(F.lit(1)).alias("matches"), F.min("public_key").alias("k")).select(
        F.when(F.col("matches") == 1, F.col("k")).alias("public_key"), (F.col("matches") > 1).alias("ambiguous"))


def blacklist_nodes(df: DataFrame, blacklist: DataFrame, *cols: str) -> DataFrame:
    """Hide rows that carry a blacklisted key in any of the columns."""
    bl = blacklist.select(F.lower("public_key").alias("_bl"))
    for c in cols:
        df = df.join(bl, F.lower(df[c]) == bl["_bl"], "left_anti")
    return df


def type_samples(tx: DataFrame, per_type: int = 8) -> DataFrame:
    """Up to ``per_type`` packets per type, evenly spaced by size rank.

    Ranks come from per-size counts, so a type that dominates the traffic is not sorted whole;
    ties inside one size are broken by id.
    """
    base = tx.select("id", "hash", names.payload_name(F.col("payload_type")).alias("type"),
                     F.floor(F.length("raw_hex") / 2).alias("size"),
                     F.floor(F.unix_seconds("first_seen") / 3600).alias("_h"))
    counts = base.groupBy("type", "size", "_h").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("type").orderBy("size", "_h")
    cells = counts.withColumn("off", F.sum("n").over(w) - F.col("n")).withColumn(
        "total", F.sum("n").over(W.partitionBy("type")))
    k = F.least(F.col("total"), F.lit(per_type))
    picks = cells.withColumn("k", k).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_type - 1)))).filter(F.col("i") < F.col("k"))
    picks = picks.withColumn("rank", F.floor(F.col("i") * F.col("total") / F.col("k"))).filter(
        (F.col("rank") >= F.col("off")) & (F.col("rank") < F.col("off") + F.col("n")))
    cell_ranks = picks.groupBy("type", "size", "_h", "off").agg(F.collect_set("rank").alias("ranks"))
    rows = base.join(cell_ranks, ["type", "size", "_h"])
    rn = F.row_number().over(W.partitionBy("type", "size", "_h").orderBy("id"))
    return (rows.withColumn("rank", F.col("off") + rn - 1).filter(F.array_contains("ranks", F.col("rank")))
            .select("type", "rank", "id", "hash", "size"))
