"""Shards of near equal bytes by histogram sort.

Rows are ordered by a 63-bit key: 31 bits from the text, so equal texts are neighbours, then 32 bits from the id,
so a group of copies of any size can still be cut. The splitters between shards are found without moving rows:
each round counts the exact bytes below candidate keys on all partitions, and the candidates of the next round
refine the cells that hold a splitter, until every splitter is within tolerance or its cell is a single key. Then
rows move once, range-partitioned by (shard, key).

Counts are sums over equal key prefixes, so a round brings at most `shards * 2**step` cells to the driver, whatever
the input. Slots come from partition totals: a shard may span many partitions.

Defined results: null text counts as empty (size `overhead`, checksum 0); null ids are keys like others; rows
equal in id and text share a key and stay in one shard; fewer rows than shards leave shards empty; no rows give
no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank, partitions, stored

KEY_BITS = 63


def sort_key(text: str, id: str) -> Column:
    group = F.xxhash64(blank(text)).bitwiseAND(F.lit((1 << 31) - 1))
    single = F.xxhash64(F.lit(1), F.col(id)).bitwiseAND(F.lit((1 << 32) - 1))
    return F.shiftleft(group, 32).bitwiseOR(single)


def splitters(keyed: DataFrame, shards: int, tolerance: float = 0.001, first: int = 12, step: int = 8) -> list[int]:
    """`shards - 1` keys; shard i takes keys from splitter i - 1 up to, not including, splitter i.

    `keyed` has `key` and `size`. Each is within `tolerance` of a mean shard's bytes, or at a border of the one key
    that holds the wanted byte.
    """
    shift = KEY_BITS - first
    cells = _cells(keyed, shift)
    total = sum(n for _, n in cells)
    wanted = [total * i / shards for i in range(1, shards)]
    slack = tolerance * total / shards
    found: dict[int, int] = {}
    # bytes below every cell that may hold a splitter: cell -> (bytes below, bytes within)
    open_cells = _below(cells, 0)
    while True:
        refine: dict[int, int] = {}
        for i, w in enumerate(wanted):
            if i in found:
                continue
            cell, below, within = _holding(open_cells, w)
            if cell is None:
                found[i] = 0
                continue
            low, high = abs(w - below), abs(below + within - w)
            if min(low, high) <= slack or shift == 0:
                found[i] = (cell if low <= high else cell + 1) << shift
            else:
                refine[cell] = below
        if not refine:
            return [found[i] for i in range(len(wanted))]
        step_now = min(step, shift)
        inner = keyed.filter(F.shiftright("key", shift).isin(list(refine)))
        shift -= step_now
        parts: dict[int, list[tuple[int, int]]] = {}
        for cell, n in _cells(inner, shift):
            parts.setdefault(cell >> step_now, []).append((cell, n))
        open_cells = [x for cell, below in sorted(refine.items()) for x in _below(parts[cell], below)]


def _cells(keyed: DataFrame, shift: int) -> list[tuple[int, int]]:
    rows = keyed.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("n")).collect()
    return sorted((r.cell, r.n) for r in rows)


def _below(cells: list[tuple[int, int]], base: int) -> list[tuple[int, int, int]]:
    out = []
    for cell, n in cells:
        out.append((cell, base, n))
        base += n
    return out


def _holding(cells: list[tuple[int, int, int]], w: float) -> tuple[int | None, int, int]:
    """The cell with below < w <= below + within; the nearest earlier one where w lies in a gap."""
    if not cells:
        return None, 0, 0
    return cells[max(0, bisect_left(cells, w, key=lambda x: x[1]) - 1)]


def shard_of(key: Column, splits: list[int], first: int = 0) -> Column:
    """Binary search among sorted splitters as nested conditions."""
    if not splits:
        return F.lit(first)
    m = len(splits) // 2
    return F.when(key < F.lit(splits[m]), shard_of(key, splits[:m], first)).otherwise(shard_of(key, splits[m + 1 :], first + m + 1))


def in_order(df: DataFrame, by: list[str]) -> DataFrame:
    """`df` range-sorted and written once, with `_part` and `_row`: the partition and the place in it."""
    at = F.monotonically_increasing_id()
    s = df.repartitionByRange(max(1, partitions(df.sparkSession)), *by).sortWithinPartitions(*by)
    return stored(s.withColumn("_at", at).withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"), "sorted")


def histogram_sort(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text", overhead: int = 16, tolerance: float = 0.001) -> DataFrame:
    """Every row's size (UTF-8 bytes plus `overhead`), text_crc32, key, shard and slot."""
    t = blank(text)
    keyed = stored(docs.select(F.col(id), (F.octet_length(t) + overhead).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
                               sort_key(text, id).alias("key")), "keys")
    splits = splitters(keyed, shards, tolerance)
    placed = in_order(keyed.withColumn("shard", shard_of(F.col("key"), splits).cast("int")), ["shard", "key", id])
    sums = placed.groupBy("_part", "shard").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_part", "shard", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"))
    return placed.join(base, ["_part", "shard"]).withColumn("slot", F.col("_base") + F.col("_row")).select(id, "size", "text_crc32", "key", "shard", "slot")
