"""Suffix-array dedup over sparse suffixes: passages of at least `least` words that occur more than once.

Only suffixes at content-selected positions are kept: where the hash of the next k words is the smallest of a window
of such hashes (a minimiser). With k + window - 1 = least, every passage of `least` words holds such a position, and
copies hold them at the same places. Suffixes are brought together by their first k words, and those that begin like
no other drop out. Suffixes that agree in the `least - k` words before and after as well are one class with a number of
members and a first occurrence. Classes with the same beginning are then compared as neighbours and extended word
by word to both sides: `least - k` words suffice, because a longer passage holds further positions, whose passages
overlap and are united in the end. So a word is marked exactly if it lies in a run of `least` words that
occurs again, in another document or elsewhere in its own.

Counting and first occurrences combine before every shuffle, so a passage in a third of all documents is a few rows
per task. Classes of a very frequent beginning are compared by the hashes of their runs, each a key of its own,
instead of within one task. Texts are read twice: for the positions, and for the words around the classes.

Defined results: null and empty texts and texts shorter than `least` words have no passages; rows with equal id and
text are one document; ids with several texts get the passages of all of them in one row, so make ids unique before
cutting; rows without id take no part and are never cut; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, mixed, partitions, ship, stored, tidy, windows_hash, word_hashes
from .jaccard import whole_keys

ship(__name__)

PAD = 0x123456789ABCDEF1
SPANS = "array<struct<start:long,end:long>>"


def sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over every run of `width` values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def positions(h: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept suffixes of a text's word hashes, and the hashes of their first k words."""
    if len(h) < least:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    g, window = windows_hash(h, k), least - k + 1
    edge = np.zeros(window - 1, dtype=np.uint64)
    lowest = np.concatenate([edge, sliding(g, window, np.minimum), edge])
    at = np.flatnonzero(g == sliding(lowest, window, np.maximum))  # smallest of some window that holds it
    return at, g[at]


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _marks(k: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, around = word_hashes(), least - k
        pad = np.full(around, PAD, dtype=np.uint64)
        powers = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(2 * around)], dtype=np.uint64)
        for pdf in batches:
            parts = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                h = hashes.of(text.encode().split()) if text else pad[:0]
                at, g = positions(h, k, least)
                if not len(at):
                    continue
                view = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, h, pad]), around) if around else np.zeros((len(h) + k, 0), dtype=np.uint64)
                ctx = np.zeros(len(at), dtype=np.uint64)
                for a in range(0, len(at), 100_000):
                    p = at[a : a + 100_000]
                    ctx[a : a + 100_000] = (view[p] * powers[:around]).sum(axis=1) + (view[p + around + k] * powers[around:]).sum(axis=1)
                # bit o: a run with o words before the position exists
                most, few = np.minimum(at, around), np.maximum(at - (len(h) - least), 0)
                sides = (np.int64(2) << most) - (np.int64(1) << few)
                parts.append(pd.DataFrame({"gram": _long(g), "ctx": _long(mixed(ctx)), "doc_id": i, "pos": at.astype(np.int32), "sides": sides}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return tidy(run)


def _windows(k: int, least: int):
    """Hashes of the runs of `least` words that hold a class's beginning: by the number of words before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, around = word_hashes(), least - k
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                h = hashes.of(r.text.encode().split()) if r.text else np.zeros(0, dtype=np.uint64)
                if len(h) < least:
                    continue
                w, g = windows_hash(h, least), windows_hash(h, k)
                for m in r.asked:
                    if m["pos"] >= len(g) or g[m["pos"]].view(np.int64) != m["gram"]:
                        continue  # another text of the same id
                    start = m["pos"] - np.arange(around + 1)
                    ok = (start >= 0) & (start < len(w))
                    # a run that does not exist is a value that only this class and side has
                    none = mixed(np.uint64(np.int64(m["ctx"]).view(np.uint64)) + np.arange(around + 1, dtype=np.uint64))
                    rows.append((m["gram"], m["ctx"], m["hot"], r.doc_id, m["pos"], np.where(ok, w[np.where(ok, start, 0)], none).astype("<u8").tobytes()))
            yield pd.DataFrame(rows, columns=["gram", "ctx", "hot", "doc_id", "pos", "runs"])

    return tidy(run)


def _compare():
    """Neighbours with the same beginning: which runs occur in another class, and in an earlier one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_keys(batches, "gram"):
            runs = np.frombuffer(b"".join(pdf["runs"]), dtype="<u8").reshape(len(pdf), -1)
            gram, doc, pos = (pdf[c].to_numpy() for c in ("gram", "doc_id", "pos"))
            again, later = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            for o in range(runs.shape[1]):
                order = np.lexsort((pos, doc, runs[:, o], gram))
                same = (gram[order][1:] == gram[order][:-1]) & (runs[order, o][1:] == runs[order, o][:-1])
                after = np.append(False, same)
                again[order] |= (after | np.append(same, False)).astype(np.int64) << o
                later[order] |= after.astype(np.int64) << o
            keep = again != 0
            yield pd.DataFrame({"gram": gram, "ctx": pdf["ctx"].to_numpy(), "again": again, "later": later})[keep]

    return tidy(run)


def _united(k: int, least: int):
    """Spans of a document from its marked positions."""

    def spans(at: np.ndarray, mask: np.ndarray) -> list[dict]:
        back = np.arange(least - k + 1)
        start = np.unique((at[:, None] - back)[(mask[:, None] >> back) & 1 == 1])
        if not len(start):
            return []
        cut = np.flatnonzero(start[1:] > start[:-1] + least)
        first, last = np.append(start[0], start[cut + 1]), np.append(start[cut], start[-1]) + least
        return [{"start": int(a), "end": int(z)} for a, z in zip(first, last, strict=True)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, at, again, later in zip(pdf["doc_id"], pdf["at"], pdf["again"], pdf["later"], strict=True):
                at = np.asarray(at, dtype=np.int64)
                rows.append((i, spans(at, np.asarray(again)), spans(at, np.asarray(later))))
            yield pd.DataFrame(rows, columns=["doc_id", "spans", "later"])

    return tidy(run)


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 50, k: int | None = None, hot: int = 1000) -> DataFrame:
    """One row per document that holds a repeated passage: its `spans` (word ranges, end excluded), and `later`: the
    ranges that an earlier occurrence (smaller id, then position) makes superfluous."""
    k = least // 2 + 1 if k is None else k
    if not 0 < k <= least:
        raise ValueError("a suffix must begin with at most as many words as a passage has")
    spark, around = docs.sparkSession, least - k
    if around > 61:
        raise ValueError("least - k must be below 62")
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull())
    marks = stored(docs.mapInPandas(_marks(k, least), "gram long, ctx long, doc_id long, pos int, sides long"), "marks")
    twice = marks.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    kept = stored(marks.join(twice, "gram", "left_semi"), "suffixes")
    forget(marks)
    # rows of equal id and text give the same occurrence twice: occurrences count once
    classes = stored(kept.groupBy("gram", "ctx").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max(F.struct("doc_id", "pos")).alias("last")), "classes")
    rivals = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", (F.col("n") > hot).alias("hot"))
    asked = classes.join(rivals, "gram").select(F.col("first.doc_id").alias("doc_id"), F.struct("gram", "ctx", F.col("first.pos").alias("pos"), "hot").alias("one"))
    asked = asked.groupBy("doc_id").agg(F.collect_list("one").alias("asked"))
    runs = docs.join(asked, "doc_id").mapInPandas(_windows(k, least), "gram long, ctx long, hot boolean, doc_id long, pos int, runs binary")
    runs = stored(runs.dropDuplicates(["gram", "ctx"]), "runs")
    near = runs.filter("not hot").repartition(partitions(spark), "gram").sortWithinPartitions("gram").mapInPandas(_compare(), "gram long, ctx long, again long, later long")
    side = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(around)), lambda o: F.substring(F.col("runs"), o * 8 + 1, F.lit(8))))
    each = runs.filter("hot").select("gram", "ctx", F.struct("doc_id", "pos").alias("own"), side.alias("o", "run"))
    met = each.groupBy("gram", "o", "run").agg(F.min("own").alias("least"), F.max("own").alias("most")).filter("least <> most")
    far = each.join(met, ["gram", "o", "run"]).select("gram", "ctx", F.expr("shiftleft(1L, o)").alias("bit"), (F.col("own") > F.col("least")).alias("after"))
    far = far.groupBy("gram", "ctx").agg(F.expr("bit_or(bit)").alias("again"), F.expr("bit_or(if(after, bit, 0L))").alias("later"))
    found = near.union(far)
    known = classes.join(found, ["gram", "ctx"], "left").filter("first <> last or again is not null")
    own = F.struct(F.col("doc_id"), F.col("pos"))
    several, ahead = F.col("first") != F.col("last"), F.col("first") != own
    hits = kept.join(known, ["gram", "ctx"]).select(
        "doc_id", "pos", F.when(several, F.col("sides")).otherwise(F.col("again")).alias("again"),
        F.when(ahead, F.col("sides")).otherwise(F.coalesce("later", F.lit(0))).alias("later"))
    hits = hits.groupBy("doc_id").agg(F.collect_list("pos").alias("at"), F.collect_list("again").alias("again"), F.collect_list("later").alias("later"))
    out = hits.mapInPandas(_united(k, least), f"doc_id long, spans {SPANS}, later {SPANS}")
    return out.withColumnRenamed("doc_id", id)


def cut_out(docs: DataFrame, ranges: DataFrame, id: str = "doc_id", text: str = "text", spans: str = "later") -> DataFrame:
    """`docs` without the words in the ranges that `ranges` has for their id, nor the blanks behind them; texts
    without ranges stay as they are, and texts of which no word is left go."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")

    def run(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, cut in zip(texts, cuts, strict=True):
            if t is not None and cut is not None and len(cut):
                ends = [m.span() for m in word.finditer(t)]
                parts, at = [], 0
                for c in sorted(cut, key=lambda c: c["start"]):
                    a, z = c["start"], min(c["end"], len(ends))
                    if a < z:
                        parts.append(t[at : ends[a][0]])
                        at = ends[z - 1][1]
                parts.append(t[at:])
                t = "".join(parts)
            out.append(t)
        return pd.Series(out, dtype=object)

    cut = ranges.select(F.col(id).alias("_id"), F.col(spans).alias("_cut")).filter(F.size("_cut") > 0)
    df = docs.join(cut, docs[id] == cut["_id"], "left")
    new = F.when(F.col("_cut").isNull(), F.col(text)).otherwise(F.pandas_udf(run, "string")(F.col(text), F.col("_cut")))
    df = df.withColumn(text, new).filter(F.col("_cut").isNull() | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    return df.select(*docs.columns)
