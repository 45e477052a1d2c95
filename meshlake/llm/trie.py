"""Trie of conversation prefixes, measured along an Euler tour.

Every distinct sequence of a conversation's first d turns is a node of depth d. A turn becomes a digest, a sequence of
turns the polynomial of their digests modulo a Mersenne prime, which composes: rows are dealt by range over
(conversation, place), each task folds its piece of a conversation, and pieces are put together by one row per piece.
So no conversation, however long, has to fit into one task, and no text is shuffled.

The tour enters and leaves every node once. An arc's successor is known locally: entering a node is followed by entering
its first child, or leaving it where it has none; leaving it is followed by entering its next sibling, or leaving its parent. The list
of arcs is ranked by rounds of splicing: a coin per arc and round, drawn from a hash of its name, lets about a quarter
of the arcs be absorbed by their predecessor, which takes over their sums; when `last` arcs remain, one task walks
them, and the absorbed arcs get their sums from their absorbers, in reverse. Work falls by a quarter each round, so all rounds
together cost four times the first. Sums before the arcs that enter and leave a node differ by its subtree's.

Children of one node, members of one node and turns of one conversation are all handled in pieces of range partitions.

Defined results: rows without a conversation id take no part; a null turn comes first, null roles and texts are empty;
turns of one number are ordered by role, then by digest of the text, repeated rows follow each other; texts of any
length count whole; a conversation without turns ends at the root; no conversations, no nodes; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, blank, forget, partitions, ship, stored

ship(__name__)

PRIME = (1 << 127) - 1
BASE = 0x5851F42D4C957F2D14057B7EF767814F
EMPTY = bytes(16)
ARC = ("conv_id", "depth", "leaves_it")


def _dealt(df: DataFrame, what: str, *order: str) -> DataFrame:
    """The rows dealt in order over range partitions and written down with their partition's number."""
    n = partitions(df.sparkSession)
    return stored(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), what)


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 1), mark (digest of role and text) and words of the text, of every turn; written down."""
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    sha = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", F.unhex(sha).alias("mark"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    # repeated rows are told apart, so that many of them do not meet in one partition
    rows = stored(rows.withColumn("salt", F.monotonically_increasing_id()), "turns")
    order = ("turn", "role", "mark", "salt")
    dealt = _dealt(rows, "dealt", "conv_id", *order)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = dealt.groupBy("part", "conv_id").count().select("part", "conv_id", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)) + F.col("before")
    out = stored(dealt.join(pieces, ["part", "conv_id"]).select("conv_id", place.cast("long").alias("place"), "mark", "words"), "numbered")
    forget(rows, dealt)
    return out


def shared_starts(turns: DataFrame, group: int = 20, variants: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from the first conversation of their group of ids, and the list of all.

    Of conversation c, the first h turns are replaced with those of c - c % group; h is the checksum of c modulo `variants`.
    """
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % variants
    convs = turns.select("conv_id").distinct()
    first = turns.filter((F.col("conv_id") % group == 0) & (F.col("place") < variants)).withColumnRenamed("conv_id", "from_id")
    lent = convs.withColumns({"from_id": F.col("conv_id") - F.col("conv_id") % group, "h": shared}).join(first, "from_id").filter(F.col("place") <= F.col("h"))
    own = turns.filter(F.col("place") > shared)
    return own.unionByName(lent.select(*own.columns)), convs


def _fold(batches):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    conv, k, h = None, 0, 0
    for b in batches:
        ks, hs, before = [], [], []
        for c, mark in zip(b["conv_id"].tolist(), b["mark"], strict=True):
            if c != conv:
                conv, k, h = c, 0, 0
            before.append(h.to_bytes(16, "big"))
            h = (h * BASE + int.from_bytes(mark[:15], "big") + 1) % PRIME
            k += 1
            ks.append(k)
            hs.append(h.to_bytes(16, "big"))
        yield pd.DataFrame({"conv_id": b["conv_id"], "part": part, "depth": ks, "digest": hs, "parent": before, "words": b["words"]})


def _joined(first: bytes, n: int, then: bytes) -> bytes:
    """Digest of a sequence from those of its beginning and of the n turns that follow."""
    return ((int.from_bytes(first, "big") * pow(BASE, n, PRIME) + int.from_bytes(then, "big")) % PRIME).to_bytes(16, "big")


def _carry(batches):
    """What lies before each piece of a conversation; pieces come in order."""
    conv, n, h = None, 0, EMPTY
    for b in batches:
        ns, hs = [], []
        for c, size, digest in zip(b["conv_id"].tolist(), b["n"].tolist(), b["digest"], strict=True):
            if c != conv:
                conv, n, h = c, 0, EMPTY
            ns.append(n)
            hs.append(h)
            n, h = n + size, _joined(h, size, digest)
        yield pd.DataFrame({"conv_id": b["conv_id"], "part": b["part"], "before": ns, "start": hs})


def _settle(batches):
    for b in batches:
        for at in b.index[b["before"] > 0]:
            n, start = int(b.at[at, "depth"]), b.at[at, "start"]
            b.at[at, "digest"] = _joined(start, n, b.at[at, "digest"])
            b.at[at, "parent"] = _joined(start, n - 1, b.at[at, "parent"])
        b["depth"] += b["before"]
        yield b[["conv_id", "depth", "digest", "parent", "words"]]


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest of the first `depth` turns, digest without the last of them, its words; for every turn."""
    n = partitions(turns.sparkSession)
    rows = turns.select("conv_id", "place", "mark", "words").repartitionByRange(n, "conv_id", "place").sortWithinPartitions("conv_id", "place")
    local = stored(rows.mapInPandas(_fold, "conv_id long, part int, depth long, digest binary, parent binary, words long"), "folded")
    pieces = local.groupBy("part", "conv_id").agg(F.max("depth").alias("n"), F.max_by("digest", "depth").alias("digest"))
    pieces = pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").mapInPandas(_carry, "conv_id long, part int, before long, start binary")
    out = local.join(pieces, ["part", "conv_id"]).mapInPandas(_settle, "conv_id long, depth long, digest binary, parent binary, words long")
    out = stored(out, "prefixes")
    forget(local)
    return out


def _hashed(batches):
    """SHA-256 of the blocks of each node, which come in order."""
    node, sha, out = None, None, []
    for b in batches:
        for depth, digest, text in zip(b["depth"].tolist(), b["digest"], b["text"], strict=True):
            if (depth, digest) != node:
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = (depth, digest), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(text.encode())
        if out:
            yield pd.DataFrame(out, columns=["depth", "digest", "ends_sha256"])
            out = []
    if node is not None:
        yield pd.DataFrame([(*node, sha.hexdigest())], columns=["depth", "digest", "ends_sha256"])


def member_digests(ends: DataFrame, block: int = 512) -> DataFrame:
    """depth, digest, ends_sha256: of the ascending, comma-joined conversations that end at each node."""
    dealt = _dealt(ends, "ends", "depth", "digest", "conv_id")
    at = F.row_number().over(Window.partitionBy("part", "depth", "digest").orderBy("conv_id")) - 1
    blocks = dealt.withColumn("block", F.floor(at / block)).groupBy("part", "block", "depth", "digest")
    blocks = blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text"))
    order = ("depth", "digest", "part", "block")
    out = blocks.repartition(partitions(ends.sparkSession), "depth", "digest").sortWithinPartitions(*order).select("depth", "digest", "text")
    return out.mapInPandas(_hashed, "depth long, digest binary, ends_sha256 string")


def nodes_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes with members, words, family (parent, first child, next sibling, number of children) and end digest; written down."""
    some = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"), F.first("parent").alias("parent"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(EMPTY).alias("digest"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), F.lit(None).cast("binary").alias("parent"))
    nodes = stored(some.unionByName(root), "nodes")
    # children in pieces: one row a piece meets the parent and the first child of the next piece
    kids = _dealt(nodes.filter("depth > 0").select("depth", "parent", "conv_id"), "kids", "depth", "parent", "conv_id")
    pieces = kids.groupBy("part", "depth", "parent").agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"))
    pieces = pieces.withColumn("then", F.lead("first").over(Window.partitionBy("depth", "parent").orderBy("part")))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    sibling = F.lead("conv_id").over(Window.partitionBy("part", "depth", "parent").orderBy("conv_id"))
    kids = kids.join(pieces.join(above, ["depth", "parent"]), ["part", "depth", "parent"]).select("depth", "conv_id", "parent_conv_id", F.coalesce(sibling, "then").alias("next_conv_id"))
    family = pieces.groupBy("depth", "parent").agg(F.min("first").alias("child_conv_id"), F.sum("n").alias("n_children"))
    family = family.select((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest"), "child_conv_id", "n_children")
    ends = convs.join(rows.groupBy("conv_id").agg(F.max(F.struct("depth", "digest")).alias("end")), "conv_id", "left")
    ends = ends.select("conv_id", F.coalesce("end.depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("end.digest", F.lit(EMPTY)).alias("digest"))
    out = nodes.drop("parent").join(kids, ["depth", "conv_id"], "left").join(family, ["depth", "digest"], "left").join(member_digests(ends), ["depth", "digest"], "left")
    return stored(out.withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))}), "family")


def _arc(conv: str, depth: Column, leaves: bool) -> Column:
    return F.struct(F.col(conv).alias("conv_id"), depth.alias("depth"), F.lit(leaves).alias("leaves_it"))


def tour(nodes: DataFrame) -> DataFrame:
    """The arcs of the tour: name, successor's name (null for the last), and what each adds to the sums."""
    d, none = F.col("depth"), F.lit(0).cast("long")
    enter = nodes.select(_arc("conv_id", d, False).alias("arc"), F.when(F.col("n_children") > 0, _arc("child_conv_id", d + 1, False)).otherwise(_arc("conv_id", d, True)).alias("next"),
                         F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    on = F.when(F.col("next_conv_id").isNotNull(), _arc("next_conv_id", d, False)).when(d > 0, _arc("parent_conv_id", d - 1, True))
    return enter.unionByName(nodes.select(_arc("conv_id", d, True).alias("arc"), on.alias("next"), none.alias("leaves"), none.alias("saved"))).withColumn("steps", F.lit(1).cast("long"))


def _walker(sums: tuple[str, ...]):
    def walk(batches):
        found = [b for b in batches if len(b)]
        if not found:
            return
        rows = pd.concat(found, ignore_index=True)
        names = list(zip(*(rows[f"a{i}"] for i in range(3)), strict=True))
        on = [None if pd.isna(c) else (int(c), int(d), bool(o)) for c, d, o in zip(*(rows[f"n{i}"] for i in range(3)), strict=True)]
        at, weights = {x: i for i, x in enumerate(names)}, rows[list(sums)].to_numpy()
        out, heads = [], set(names) - set(on)
        for x in heads:
            done = [0] * len(sums)
            while x is not None:
                i = at[x]
                out.append((*x, *done))
                done = [a + int(b) for a, b in zip(done, weights[i], strict=True)]
                x = on[i]
        yield pd.DataFrame(out, columns=[*ARC, *sums])

    return walk


def list_ranks(arcs: DataFrame, sums: tuple[str, ...], last: int = 1 << 14) -> DataFrame:
    """Of every arc of a list (arc, next) the sums over the arcs before it."""
    live = stored(arcs, "arcs")
    made, gone = [live], []
    while live.count() > last:
        coin = lambda a, r=len(gone): F.xxhash64(F.lit(r), a).bitwiseAND(F.lit(1)) == 1
        takes = ~coin(F.col("arc")) & F.col("next").isNotNull() & coin(F.col("next"))
        taken = live.filter(coin(F.col("arc"))).select(F.col("arc").alias("key"), F.col("next").alias("on"), *[F.col(s).alias(f"{s}_on") for s in sums])
        takers = live.filter(takes).select(F.col("next").alias("key"), "arc", *sums)
        there = F.col("arc").isNotNull()
        spliced = taken.join(takers, "key", "left").select(
            F.coalesce("arc", "key").alias("arc"), F.col("on").alias("next"), *[(F.coalesce(s, F.lit(0)) + F.col(f"{s}_on")).alias(s) for s in sums],
            F.when(there, F.col("key")).alias("gone"), *[F.col(s).alias(f"{s}_off") for s in sums])
        rest = live.filter(~coin(F.col("arc")) & ~takes).select("arc", "next", *sums)
        state = stored(spliced.unionByName(rest, allowMissingColumns=True), "spliced")
        made.append(state)
        live = state.select("arc", "next", *sums)
        gone.append(state.filter("gone IS NOT NULL").select(F.col("gone"), F.col("arc"), *[f"{s}_off" for s in sums]))
    flat = live.select(*[F.col(f"arc.{c}").alias(f"a{i}") for i, c in enumerate(ARC)], *[F.col(f"next.{c}").alias(f"n{i}") for i, c in enumerate(ARC)], *sums)
    ranked = flat.repartition(1).mapInPandas(_walker(sums), f"conv_id long, depth long, leaves_it boolean, {', '.join(f'{s} long' for s in sums)}")
    parts = [stored(ranked.select(F.struct(*ARC).alias("arc"), *sums), "ranks")]
    for lost in reversed(gone):
        known = parts[0]
        for p in parts[1:]:
            known = known.union(p)
        found = lost.join(known, "arc").select(F.col("gone").alias("arc"), *[(F.col(s) + F.col(f"{s}_off")).alias(s) for s in sums])
        parts.append(stored(found, "ranks"))
    forget(*made)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def prefix_trie(turns: DataFrame, convs: DataFrame, last: int = 1 << 14) -> DataFrame:
    """Every node: conv_id (smallest member; with the depth its name), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and enter and leave: places of its arcs in the tour.

    `turns` has conv_id, place, mark and words as in `numbered_turns`, `convs` all conv_id, those without turns too.
    """
    rows = prefixes(turns)
    nodes = nodes_of(rows, convs)
    ranks = list_ranks(tour(nodes), ("steps", "leaves", "saved"), last)
    of = lambda s, out: F.max(F.when(F.col("arc.leaves_it") == out, F.col(s)))
    sums = ranks.groupBy(F.col("arc.conv_id").alias("conv_id"), F.col("arc.depth").alias("depth")).agg(
        (of("leaves", True) - of("leaves", False)).alias("n_leaves"), (of("saved", True) - of("saved", False)).alias("saved_tokens"), of("steps", False).alias("enter"), of("steps", True).alias("leave"))
    out = nodes.join(sums, ["conv_id", "depth"])
    forget(rows)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "enter", "leave")
