"""N-gram Jaccard join as an exact join in metric space.

A document is its set of distinct word shingles. The distance 1 - |x & y| / |x | y| is a metric, and so is the size
of the symmetric difference; two documents link when the first is at most r. The join narrows in steps that lose no
link:

1. Equal sets become one point with a number of copies.
2. Windows around points. A link leaves at most a share r of a set outside the other, so of the first
   floor(r |x|) + 1 shingles of x in a fixed global order one is shared, and the same for y. Each such shingle is a
   pivot whose cell both points enter. The order puts shingles that a sample finds frequent last, which keeps
   boilerplate from being a pivot and changes no result.
3. Inside a cell, triangle inequalities with virtual pivots: distance to the empty set is the size, and
   distances to the classes of a hash partition of all shingles differ by at most the symmetric difference. Pairs
   that fail them cannot link. A cell beyond a fixed number of points is first split into pairs of blocks by size.
   What is left falls into groups; groups that share points make a region, which gets
   the whole set of each member once.
4. Regions join exactly. Large ones recursively: pivots are drawn from the members, each member goes to its nearest
   pivot (a Voronoi cell), and those within 2r of a border are replicated across it. Regions beyond a fixed number
   of members are first split into pairs of blocks, so no task holds more than two blocks.

Regions report a spanning star per group of linked members and link counts, never all pairs; components of the stars
come from alternating large-star and small-star rounds, each written to the shared folder.

Defined results: null and empty texts, and texts of blanks, have an empty set, link with nothing and are components
of their own; with fewer words than a shingle the whole sequence is the one shingle; rows with equal ids are one document,
which links with whatever any of its texts links with, and each row gets a result; rows without id take no part; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, forget, mixed, partitions, ship, stored, tidy, windows_hash, word_hashes

ship(__name__)

#: A set is compared by the counts of so many classes of its shingles: more for larger sets, whose counts vary less.
TIERS = ((64, 1024), (256, 4096), (1024, 16384), (4096, 1 << 62))
LEAF = 512


def class_counts(s: np.ndarray) -> np.ndarray:
    n = next(c for c, most in TIERS if len(s) <= most)
    return np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) % n, minlength=n), 65535).astype("<u2")


def shingle_set(text: str | None, hashes: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles after lower-casing A-Z."""
    h = hashes.of(text.encode().lower().split()) if text else np.zeros(0, dtype=np.uint64)
    if len(h) < 2:
        return mixed(h)
    if len(h) < k:  # distinct from shingles of that many words elsewhere: only as long texts hold them
        return windows_hash(h, len(h))
    return np.unique(windows_hash(h, k))


def whole_keys(batches: Iterator[pd.DataFrame], key: list[str] | str) -> Iterator[pd.DataFrame]:
    """Frames of a key-sorted partition, cut so that no key continues in the next frame."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[key].to_numpy()
        same = keys == keys[-1]
        if same.ndim > 1:
            same = same.all(axis=1)
        first = len(pdf) - int(np.argmin(same[::-1])) if not same.all() else 0
        if first:
            held.append(pdf.iloc[:first])
            yield pd.concat(held, ignore_index=True)
            held = [pdf.iloc[first:]]
        else:
            before = held[-1][key].to_numpy()[-1] if held else keys[-1]
            if np.any(before != keys[-1]):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _points(k: int, num: int, den: int, frequent: np.ndarray):
    """Of each text: size, identity and class counts of its set, and the pivots whose cells it enters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashes = word_hashes()
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = shingle_set(text, hashes, k)
                n = len(s)
                keys = s
                if n:
                    late = np.zeros(n, dtype=bool)
                    if len(frequent):
                        at = np.searchsorted(frequent, s)
                        at[at == len(frequent)] = 0
                        late = frequent[at] == s
                    keep = n - -(-num * n // den) + 1
                    early = s[~late]
                    keys = early[:keep] if len(early) >= keep else np.concatenate([early, s[late][: keep - len(early)]])
                counts = class_counts(s)
                rows.append((i, n, np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)), counts.tobytes(), _as_long(keys)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "sid", "counts", "keys"])

    return tidy(run)


def _shingles(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = word_hashes()
        for pdf in batches:
            for a in range(0, len(pdf), 200):
                sets = [shingle_set(t, hashes, k) for t in pdf["text"].iloc[a : a + 200]]
                yield pd.DataFrame({"key": _as_long(np.concatenate(sets))})

    return tidy(run)


def frequent_shingles(docs: DataFrame, k: int, one_in: int = 32, least: int = 4, most: int = 1_000_000) -> np.ndarray:
    """Shingles that at least `least` of the sampled documents hold, sorted; the more frequent ones if they are over `most`.

    They only decide which shingles are pivots last: any list gives the same links.
    """
    some = docs.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(one_in)) == 0).select("text")
    counted = stored(some.mapInPandas(_shingles(k), "key long").groupBy("key").count().filter(F.col("count") >= least), "frequent")
    # the lowest count from which on there are not too many
    held = 0
    for r in sorted(counted.groupBy("count").agg(F.count(F.lit(1)).alias("keys")).collect(), key=lambda r: -r["count"]):
        held += r["keys"]
        if held > most:
            least = r["count"] + 1
            break
    top = counted.filter(F.col("count") >= least).select("key").toArrow()["key"].to_numpy()
    forget(counted)
    return np.sort(top.astype(np.int64).view(np.uint64))


def _can_link(a, b, num: int, den: int):
    """Whether sets of sizes a <= b may link."""
    return a * den >= b * num


def _shared(num: int, den: int, block_rows: int):
    """Points of each cell but those that are alone as far as sizes tell, dealt to tasks (a, b). Input is sorted by (key, n).

    A cell of more than `block_rows` points is cut into blocks, which are bands of sizes as the points come by size;
    its tasks are the pairs of blocks, without those whose sizes cannot link.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_keys(batches, "key"):
            key, n = pdf["key"].to_numpy(), pdf["n"].to_numpy()
            near = (key[1:] == key[:-1]) & _can_link(n[:-1], n[1:], num, den)
            keep = np.append(near, False) | np.append(False, near)
            pdf, n = pdf.loc[keep, ["key", "rep"]].assign(a=0, b=0, block=0), n[keep]
            if not len(pdf):
                continue
            key = pdf["key"].to_numpy()
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            yield pdf[np.repeat(size <= block_rows, size)]
            for first, rows in zip(start[size > block_rows], size[size > block_rows], strict=True):
                blocks = [slice(first + x, first + min(x + block_rows, rows)) for x in range(0, rows, block_rows)]
                for i, x in enumerate(blocks):
                    for j, y in enumerate(blocks[i:], i):
                        if not _can_link(n[x.stop - 1], n[y.start], num, den):
                            break
                        parts = [pdf[x].assign(a=i, b=j, block=i)] + ([pdf[y].assign(a=i, b=j, block=j)] if j > i else [])
                        yield pd.concat(parts, ignore_index=True)

    return tidy(run)


def _merged(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after the rows `left` meet the rows `right`; a label is the first row of its group."""
    left, right = label[left], label[right]
    to = np.arange(len(label))
    while True:
        new = to.copy()
        low = np.minimum(to[left], to[right])
        np.minimum.at(new, to[left], low)
        np.minimum.at(new, to[right], low)
        new = new[new]
        if (new == to).all():
            return to[label]
        to = new


def _groups(num: int, den: int):
    """Groups of a task's points that sizes and class counts do not keep apart: (point, smallest point).

    Only which points are together matters, so pairs go into labels at once, and points that are together are not
    compared again: a cell of near copies is one group after few steps.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_keys(batches, ["key", "a", "b"]):
            key, a, b, block, n, rep = (pdf[c].to_numpy() for c in ("key", "a", "b", "block", "n", "rep"))
            tier = pdf["counts"].map(len).to_numpy() // 2
            table, line = {}, {}
            for c, _ in TIERS:  # counts of all larger sets, too, folded into this many classes
                rows = np.flatnonzero(tier >= c)
                line[c] = np.cumsum(tier >= c) - 1
                table[c] = np.stack([np.frombuffer(x, dtype="<u2").reshape(-1, c).sum(axis=0, dtype=np.int32) for x in pdf["counts"].iloc[rows]]) if len(rows) else None
            start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            task = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
            label = np.arange(len(key))
            at = np.arange(len(key) - 1)
            step = 1
            while len(at):
                # sorted by size: once i cannot link with i + step, it cannot with any later one
                at = at[at + step < len(key)]
                at = at[(task[at] == task[at + step]) & _can_link(n[at], n[at + step], num, den)]
                if step & (step - 1) == 0:  # tasks that are one group already are done
                    open_ = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)
                    at = at[open_[task[at]]]
                # a task of two blocks compares one with the other; each block has a task of its own
                apart_still = at[(label[at] != label[at + step]) & ((a[at] == b[at]) | (block[at] != block[at + step]))]
                for c, _ in TIERS:
                    some = apart_still[tier[apart_still] == c]
                    for x in range(0, len(some), 6_000_000 // c):
                        i = some[x : x + 6_000_000 // c]
                        apart = np.abs(table[c][line[c][i]] - table[c][line[c][i + step]]).sum(axis=1, dtype=np.int64)
                        # |x ^ y| <= (den - num) (|x| + |y|) / (den + num) for every link
                        i = i[apart * (den + num) <= (den - num) * (n[i] + n[i + step])]
                        if len(i):
                            label = _merged(label, i, i + step)
                step += 1
            used = np.bincount(label, minlength=len(label))[label] > 1
            if used.any():
                low = rep.copy()
                np.minimum.at(low, label, rep)
                yield pd.DataFrame({"rep": rep[used], "lead": low[label[used]]}).drop_duplicates()

    return tidy(run)


def _with_sets(k: int):
    """Whole sets, one row for each task that a point takes part in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashes = word_hashes()
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                data = shingle_set(r.text, hashes, k).tobytes()
                if np.uint64(xxhash.xxh3_64_intdigest(data)).view(np.int64) != r.sid:
                    continue  # another text of the same id
                rows += [(s["lead"], s["a"], s["b"], s["block"], r.rep, r.copies, data) for s in r.spots]
                if len(rows) > 500:
                    yield pd.DataFrame(rows, columns=["lead", "a", "b", "block", "rep", "copies", "data"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["lead", "a", "b", "block", "rep", "copies", "data"])

    return tidy(run)


class Region:
    """Members of one region and what the exact join finds among them."""

    FINE = 256

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den, self.r = num, den, 1 - num / den
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        owner, every = np.repeat(np.arange(len(sets)), self.n), np.concatenate(sets)
        self.counts = np.bincount(owner * self.FINE + (every >> np.uint64(40)).astype(np.int64) % self.FINE, minlength=len(sets) * self.FINE).reshape(-1, self.FINE).astype(np.int32)
        _, self.code = np.unique(every, return_inverse=True)
        self.start = np.append(0, np.cumsum(self.n))
        self.mark = np.zeros(int(self.code.max()) + 1 if len(self.code) else 0, dtype=np.int32)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def common(self, x: int, y: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of member x with members y."""
        own = self.code[self.start[x] : self.start[x + 1]]
        self.mark[own] = 1
        out = np.zeros(len(y), dtype=np.int64)
        most = max(1, 4_000_000 // max(1, int(self.n[y].max(initial=1))))
        for k in range(0, len(y), most):
            part = y[k : k + most]
            held = self.mark[self.code[np.repeat(self.start[part] - (np.cumsum(self.n[part]) - self.n[part]), self.n[part]) + np.arange(self.n[part].sum())]]
            out[k : k + most] = np.add.reduceat(held, np.cumsum(self.n[part]) - self.n[part])
        self.mark[own] = 0
        return out

    def join(self, rows: np.ndarray, sides: list[np.ndarray]) -> None:
        """Links among `rows`, between members of which every array in `sides` marks at least one."""
        if len(rows) > LEAF:
            pivots = rows[np.linspace(0, len(rows) - 1, 8).astype(int)]
            common = np.stack([self.common(p, rows) for p in pivots], axis=1)
            d = 1 - common / (self.n[rows][:, None] + self.n[pivots][None, :] - common)
            home = d.argmin(axis=1)
            near = d - d.min(axis=1)[:, None] <= 2 * self.r + 1e-9
            cells = [(near[:, j] & (home > j)) | (home == j) for j in range(len(pivots))]
            if max(c.sum() for c in cells) <= 0.7 * len(rows):
                for j, c in enumerate(cells):
                    if (home[c] == j).any():
                        own = np.zeros(len(self.n), dtype=bool)
                        own[rows[home == j]] = True
                        self.join(rows[c], [*sides, own])
                return
        rows = rows[np.argsort(self.n[rows], kind="stable")]
        n, counts = self.n[rows], self.counts[rows]
        ends = np.searchsorted(n * self.num, n * self.den, side="right")  # the largest set that a set may link with
        for i, x in enumerate(rows):
            near = slice(i + 1, int(ends[i]))
            apart = np.abs(counts[near] - counts[i]).sum(axis=1, dtype=np.int64)
            keep = apart * (self.den + self.num) <= (self.den - self.num) * (n[near] + n[i])
            y = rows[near][keep]
            for s in sides:
                if not s[x]:
                    y = y[s[y]]
            if len(y):
                common = self.common(x, y)
                y = y[common * self.den >= self.num * (self.n[x] + self.n[y] - common)]
                self.pairs.append((np.full(len(y), x), y))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([p[k] for p in self.pairs] or [np.zeros(0, dtype=np.int64)]) for k in (0, 1))


def _joined(num: int, den: int):
    """Per task: (point, root of its linked group, links found)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_keys(batches, ["lead", "a", "b"]):
            out = []
            for (lead, a, b), g in frame.groupby(["lead", "a", "b"], sort=False):
                if len(g) < 2:
                    continue
                rep, copies, block = (g[c].to_numpy() for c in ("rep", "copies", "block"))
                region = Region([np.frombuffer(x, dtype=np.uint64) for x in g["data"]], num, den)
                # a task of two blocks joins one with the other; each block has a task of its own
                region.join(np.arange(len(g)), [block == a, block == b] if a != b else [])
                x, y = region.links()
                if not len(x):
                    continue
                root = np.arange(len(g))
                order = np.argsort(rep, kind="stable")
                place = np.empty(len(g), dtype=np.int64)
                place[order] = np.arange(len(g))
                root = place.copy()  # labels are places in the order of points
                while True:
                    new = root.copy()
                    low = np.minimum(root[x], root[y])
                    np.minimum.at(new, x, low)
                    np.minimum.at(new, y, low)
                    if (new == root).all():
                        break
                    root = new
                links = np.bincount(x, copies[y], len(g)) + np.bincount(y, copies[x], len(g))
                used = np.unique(np.concatenate([x, y]))
                out.append(pd.DataFrame({"rep": rep[used], "root": rep[order[root[used]]], "links": links[used].astype(np.int64)}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return tidy(run)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v): root is its component's smallest node.

    Large-star and small-star rounds until nothing changes; each round is a table in the shared folder.
    """
    now, mark = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges"), None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")) \
                     .select("e.u", "e.v").filter("u <> v").distinct()
        then = stored(small, "edges")
        forget(now)
        now = then
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def jaccard_join(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, block_rows: int = 2048) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and n_links (documents linked with) of every
    document; two link when den * |intersection| >= num * |union| of their k-word shingle sets."""
    if not 0 < num <= den:
        raise ValueError("the least similarity must be in (0, 1]")
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull())
    frequent = frequent_shingles(docs, k)
    points = stored(docs.mapInPandas(_points(k, num, den, frequent), "doc_id long, n long, sid long, counts binary, keys array<long>"), "points")
    sets = stored(points.filter("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies")), "sets")
    one = stored(points.join(sets.select(F.col("rep").alias("doc_id"), "sid", "n"), ["doc_id", "sid", "n"], "left_semi")
                 .select(F.col("doc_id").alias("rep"), "n", "counts", "keys"), "one")
    parts = partitions(spark)
    cells = one.select(F.explode("keys").alias("key"), "rep", "n").repartition(parts, "key").sortWithinPartitions("key", "n")
    shared = cells.mapInPandas(_shared(num, den, block_rows), "key long, rep long, a int, b int, block int")
    near = shared.join(one.select("rep", "n", "counts"), "rep").repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b", "n")
    spots = stored(near.mapInPandas(_groups(num, den), "rep long, lead long").distinct(), "spots")
    forget(one)
    # a region is a component of the groups; its members in blocks, the pairs of blocks are its tasks
    home = components(spots.select(F.col("rep").alias("u"), F.col("lead").alias("v")))
    home = home.union(home.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "rep").withColumnRenamed("root", "lead")
    size = home.groupBy("lead").agg(F.count(F.lit(1)).alias("rows")).select("lead", F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks"))
    dealt = home.join(size, "lead").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    task = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.col("lead"), F.least(o, F.col("block")).alias("a"), F.greatest(o, F.col("block")).alias("b"), F.col("block")))
    dealt = dealt.select("rep", task.alias("spots"))
    want = dealt.join(sets.select("rep", "sid", "n", "copies"), "rep")
    members = want.join(docs.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "sid", "copies", "spots", "text")
    found = members.mapInPandas(_with_sets(k), "lead long, a int, b int, block int, rep long, copies long, data binary") \
                   .repartition(parts, "lead", "a", "b").sortWithinPartitions("lead", "a", "b")
    regions = stored(found.mapInPandas(_joined(num, den), "rep long, root long, links long"), "regions")
    # an id whose rows have different texts holds their sets together
    known = points.filter("n > 0")
    several = known.groupBy("doc_id").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).filter("x <> y").select("doc_id")
    several = known.join(several, "doc_id", "left_semi").join(sets.select("sid", "n", "rep"), ["sid", "n"])
    edges = regions.select(F.col("rep").alias("u"), F.col("root").alias("v")).union(several.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    roots = components(edges)
    links = regions.groupBy("rep").agg(F.sum("links").alias("links"))
    of_set = sets.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left").select(
        "sid", "n", F.coalesce("root", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    filled = points.filter("n > 0").select("doc_id", "n", "sid").join(of_set, ["sid", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    empty = points.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return filled.union(empty).withColumnRenamed("doc_id", id)
