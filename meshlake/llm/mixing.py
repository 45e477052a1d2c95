"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight and a schedule: piecewise linear rates over training time 0..1. The rate integrates to
the source's cumulative demand for words, scaled to end at its target. Documents of a source stand in a fixed
pseudo-random order; a document whose words begin at cumulative position c is trained on when demand reaches c, so
inverting the demand gives its time, and sorting by time gives the curriculum. Targets above the source's size
run through the order a second time; the document on the border of a target gives only its first words.

Everything is DataFrame functions. Running sums never put a source into one task: each source is cut into
pseudo-random buckets of bounded size, a window over the buckets' totals gives their starts, and a window
inside a bucket the rest.

Defined results: null source is a source of its own, ordered last; null or empty text has size 0 and takes
nothing; equal rows count as rows of their own; sources without words have target 0; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, blank

Schedule = Sequence[tuple[float, float]]

#: Rates at times 0..1 by weight: heavily weighted sources fade, lightly weighted ones come in late.
SCHEDULES: Mapping[float, Schedule] = {
    5: ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    1: ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)),
}
EVEN: Schedule = ((0.0, 1.0), (1.0, 1.0))
#: Rows of one bucket, about.
BUCKET_ROWS = 500


def n_words(text: str) -> Column:
    """Number of words of a text column; null has none."""
    ends = F.trim(blank(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(ends == "", 0).otherwise(F.regexp_count(ends, F.lit(f"[{BLANK}]+")) + 1).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: source_size, weight, target.

    Targets are `share` of all sizes by weight, at most `cap` times the source's size, the excess shared again by
    weight. That is the water level L with sum(min(cap * size, L * weight)) = share * all: sources are ordered by
    the level at which they fill up, and L is the highest of the levels that follow from filling the first ones.
    """
    s = sized.groupBy("source", "_src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1))
    full = (cap * F.col("source_size")).cast("double")
    fill = Window.orderBy(F.col("_full_at"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumns({"_full": full, "_full_at": full / F.col("weight")})
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("_level", level)
    # filling one source more raises the level while too few are full, and lowers it afterwards
    target = F.least(F.col("_full"), F.max("_level").over(everything) * F.col("weight"))
    return s.select("source", "_src", "source_size", "source_rows", "weight", target.alias("target"))


def _with_source_key(df: DataFrame) -> DataFrame:
    """`_src`: the source as a key that is never null."""
    return df.withColumn("_src", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))


def demand_time(fraction: Column, schedule: Schedule) -> Column:
    """The time at which a piecewise linear rate has delivered `fraction` of its integral over 0..1."""
    total = sum((t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(schedule, schedule[1:], strict=False))
    if total <= 0:
        raise ValueError("a schedule needs a positive integral")
    out, done = None, 0.0
    for (t0, r0), (t1, r1) in zip(schedule, schedule[1:], strict=False):
        slope = (r1 - r0) / (t1 - t0)
        need = fraction * F.lit(total) - F.lit(done)
        # r0 x + slope x^2 / 2 = need, in the form that also holds for slope 0
        here = F.lit(t0) + 2 * need / (F.lit(r0) + F.sqrt(F.greatest(F.lit(r0 * r0) + 2 * F.lit(slope) * need, F.lit(0.0))))
        done += (t1 - t0) * (r0 + r1) / 2
        here = F.when(fraction * F.lit(total) <= F.lit(done), here)
        out = here if out is None else F.coalesce(out, here)
    return F.coalesce(out, F.lit(1.0))


def _ordered(sized: DataFrame, targets: DataFrame, id: str, seed: str) -> DataFrame:
    """`_start`: words before the row in its source's fixed order; with the columns of `targets`."""
    n = sized.select(F.count(F.lit(1))).first()[0]
    digits = 1
    while 16**digits * BUCKET_ROWS < n:
        digits += 1
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string")))
    df = sized.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    sums = df.groupBy("_src", "_bucket").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_src", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")).join(targets.drop("source"), "_src")
    inside = Window.partitionBy("_src", "_bucket").orderBy("_key", F.col(id)).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["_src", "_bucket"])
    return df.withColumn("_start", F.col("_base") + F.col("_inside")).drop("_src", "_bucket", "_base", "_inside", "_key")


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", size: Column | None = None, weights: Sequence[float] = (5, 2, 1),
        share: float = 1.5, cap: float = 2.0, schedules: Mapping[float, Schedule] = SCHEDULES, seed: str = "mix", keep: Sequence[str] = ()) -> DataFrame:
    """Each document once: size, source_size, target, `first` and `second` (words taken in either pass), taken, and
    `at_first`, `at_second`: the times 0..1 of its passes, null where a pass takes nothing.

    `keep` names columns of `docs` to carry along. `cap` is at most 2, as there are two passes.
    """
    if not 0 < cap <= 2:
        raise ValueError("cap must be in (0, 2]")
    carried = [F.col(c).alias(f"_keep_{c}") for c in keep]
    sized = _with_source_key(docs.select(F.col(id).alias("_id"), F.col(source).alias("source"), (n_words("text") if size is None else size).alias("size"), *carried))
    df = _ordered(sized, source_targets(sized, weights, share, cap), "_id", seed)
    goal = F.round("target").cast("long")
    part = lambda left: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("_start")))
    df = df.withColumns({"first": part(goal), "second": part(goal - F.col("source_size"))})

    def time(start: Column) -> Column:
        done = F.when(F.col("target") > 0, start / F.col("target")).otherwise(0.0)
        out = demand_time(done, EVEN)
        for w, schedule in schedules.items():
            out = F.when(F.col("weight") == float(w), demand_time(done, schedule)).otherwise(out)
        return out

    df = df.withColumns({
        "taken": F.col("first") + F.col("second"),
        "at_first": F.when(F.col("first") > 0, time(F.col("_start"))),
        "at_second": F.when(F.col("second") > 0, time(F.col("_start") + F.col("source_size"))),
    })
    return df.select(F.col("_id").alias(id), *[F.col(f"_keep_{c}").alias(c) for c in keep if c not in (id, source, "size")],
                     *([F.col("source").alias(source)] if source != "size" else []), "size", "source_size", "target", "first", "second", "taken", "at_first", "at_second")


def curriculum(mixed: DataFrame) -> DataFrame:
    """One row for each pass of a document that takes words (`words`, `at`), range-sorted by time."""
    passes = F.array(*[F.struct(F.col(n).alias("words"), F.col(f"at_{n}").alias("at")) for n in ("first", "second")])
    one = mixed.withColumn("_pass", F.explode(passes)).filter(F.col("_pass.words") > 0)
    cols = [c for c in mixed.columns if c not in ("first", "second", "at_first", "at_second")]
    return one.select(*cols, F.col("_pass.words").alias("words"), F.col("_pass.at").alias("at")).orderBy("at", *[c for c in cols if c == "doc_id"])
