from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from meshlake.functions import geo, numeric, ranks
from meshlake.functions.time import TimeWindow, parse_ts, snap


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_window_is_inclusive_and_keeps_missing_times(spark):
    w = TimeWindow.parse(frm="2024-01-01T00:00:00Z", to="2024-01-02T00:00:00Z")
    times = ["2023-12-31 23:59:59", "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-02 00:00:01", None]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert df.filter(w.holds(F.col("t"))).count() == 3


def test_window_alias_and_nonsense():
    assert TimeWindow.parse(window="7d", now="2024-01-08T00:00:00Z").since == datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert TimeWindow.parse(window="2y", now="2024-01-08T00:00:00Z").unbounded
    assert TimeWindow.parse(frm="yesterday").unbounded


@pytest.mark.parametrize("x,digits,want", [(1.25, 1, 1.3), (-1.25, 1, -1.3), (2.004, 2, 2.0)])
def test_half_away(spark, x, digits, want):
    assert one(spark, numeric.half_away(F.lit(x), digits)) == pytest.approx(want)


@pytest.mark.parametrize("x,want", [(-1.24, -1.1), (1.24, 1.2), (-0.04, 0.0)])
def test_trunc_round_is_biased_for_negatives(spark, x, want):
    assert one(spark, numeric.trunc_round(F.lit(x), 1)) == pytest.approx(want)


@pytest.mark.parametrize("vals,upper,true", [([1.0, 2.0, 3.0, 4.0], 3.0, 2.5), ([5.0, 1.0, 9.0], 5.0, 5.0)])
def test_medians(spark, vals, upper, true):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = df.agg(numeric.upper_median("v").alias("u"), numeric.true_median("v").alias("t")).first()
    assert (r["u"], r["t"]) == (upper, true)


def test_snap(spark):
    assert [one(spark, snap(F.lit(s), 300)) for s in (149, 150, 449, 450)] == [0, 300, 300, 600]


@pytest.mark.parametrize("text", ["2024-01-01T00:00:05Z", "2024-01-01T00:00:05", "2024-01-01 00:00:05", "2024-01-01T01:00:05+01:00", "2024-01-01T00:00:05.000Z"])
def test_parse_layouts(spark, text):
    assert one(spark, F.unix_seconds(parse_ts(F.lit(text)))) == 1704067205


def test_area(spark):
    square = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    inside = lambda la, lo, **k: one(spark, geo.in_area(F.lit(la), F.lit(lo), square, **k))
    assert inside(5.0, 5.0) and not inside(5.0, 10.2) and inside(5.0, 10.2, buffer_km=30) and inside(0.0, 0.0)


def test_previous_row_across_chunks_equals_plain_lag(spark):
    import random
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}", t, rnd.randrange(9)) for t in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    got = {(r.k, r.t): r.prev_v for r in ranks.with_previous(df, ["k"], ["t"], F.floor(F.col("t") / 7), ["v"]).collect()}
    want, last = {}, {}
    for k, t, v in rows:
        want[(k, t)] = last.get(k)
        last[k] = v
    assert got == want


def test_every_kth_equals_global_rank(spark):
    rows = [(i * 37 % 1000, (i * i) % 50) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, s long").withColumn("t", F.timestamp_seconds(F.col("s") * 997))
    got = sorted(r.id for r in ranks.every_kth(df, "t", "id", 30).collect())
    order = [i for i, s in sorted(rows, key=lambda r: (r[1], r[0] % 64, r[0]))]
    assert got == sorted(order[::33])
