"""Rollups kept by increments, a prune and a rehash equal a rebuild; only touched hours are read and replaced."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from meshlake import schemas
from meshlake.operators import ingest as I, retention as T
from meshlake.plans import rollups as U, upkeep as K
from meshlake.session import checkpoint_dir, exists
from meshlake.sources.tables import write_table

NODES = [f"{c}{d}" + "0" * 62 for c, d in ("a1", "b2", "c3", "d4")]


def facts(spark):
    rng = random.Random(2)
    tx, obs = [], []
    for i in range(60):
        day, hour = 1 + i % 5, rng.choice([3, 7])
        kind = rng.choice([4, 5, 5, 2])
        body = f"{i // 2:08x}" if i < 8 else f"{i:08x}"  # the first eight are four packets, stored twice
        tx.append((i, f"11{'01a1' if i % 2 else '00'}{body}", f"old{i}", f"2024-01-0{day} 0{hour}:{i:02d}:00", kind, "user" if kind == 5 else None))
        for j in range(rng.randint(1, 3)):
            obs.append((i * 10 + j, i, f"S{rng.randrange(3)}", rng.choice([None, 1.0, 4.5]), -80.0 - j, [n[:2] for n in NODES[: rng.randrange(4)]], f"2024-01-0{day} 0{hour}:{i:02d}:0{j}"))
    t = spark.createDataFrame(tx, "id long, raw_hex string, hash string, t string, payload_type int, who string")
    none = {f.name: F.lit(None).cast(f.dataType) for f in schemas.DECODED}
    decoded = F.struct(*[c.alias(k) for k, c in {**none, "type": F.when(F.col("who").isNotNull(), "CHAN"), "channel": F.lit("#c"), "text": F.concat("who", F.lit(": hi")), "sender": F.col("who"),
                                                    "pubKey": F.when(F.col("payload_type") == 4, NODES[3])}.items()])
    t = t.select("id", "raw_hex", "hash", F.col("t").cast("timestamp").alias("first_seen"), F.lit(1).alias("route_type"), "payload_type", F.lit(0).alias("payload_version"), decoded.alias("decoded"),
                 F.lit(None).cast("string").alias("from_pubkey"), F.lit(None).cast("string").alias("channel_hash"))
    o = spark.createDataFrame(obs, "id long, transmission_id long, observer_id string, snr double, rssi double, path array<string>, t string")
    full = F.transform("path", lambda h: F.concat(h, F.lit("0" * 62)))
    o = o.select("id", "transmission_id", "observer_id", F.lit("rx").alias("direction"), "snr", "rssi", F.lit(1).alias("score"), "path", full.alias("resolved_path"), F.col("t").cast("timestamp").alias("timestamp"),
                 F.lit(None).cast("string").alias("raw_hex"))
    n = spark.createDataFrame([(k, f"n{i}", "repeater", 40.0 + i / 10, -118.0, i) for i, k in enumerate(NODES)], "public_key string, name string, role string, lat double, lon double, advert_count int")
    return t, o, n


def folder(spark):
    return f"{checkpoint_dir(spark)}/upkeep-{uuid.uuid4().hex}"


def by_day(spark, df, name):
    root = folder(spark)
    write_table(df, root, name, "overwrite")
    return spark.read.parquet(f"{root}/{name}")


def all_rows(spark, root, tables):
    return {n: sorted(map(str, K.kept(spark, root, n).drop("hour_key").collect())) for n in tables}


def test_kept_rollups_equal_a_rebuild(spark):
    tx, obs, nodes = facts(spark)
    tx, obs = by_day(spark, tx, "transmissions"), by_day(spark, obs, "observations")
    tables = list(K.builders(tx, obs, nodes, K.Touched([], [])))
    root = folder(spark)
    first = K.refresh(spark, tx, obs.filter("id < 300"), nodes, root)
    assert K.watermark(spark, root) < 300 and first.heard
    K.refresh(spark, tx, obs, nodes, root)
    assert K.watermark(spark, root) == obs.agg(F.max("id")).first()[0]
    assert K.refresh(spark, tx, obs, nodes, root) == K.Touched([], [])

    # a prune removes the first days, whose hours go; a rehash merges packets that stay
    kept, rest = T.prune_packets(tx, obs, "2024-01-06T00:00:00Z", 3)
    gone = K.touched_by_prune(tx, obs, kept)
    hashed, moved = I.rehash_backfill(kept, rest)
    merged = K.touched_by_rehash(kept, rest, hashed, moved)
    assert hashed.count() < kept.count() and merged.seen and gone.seen
    hashed, moved = by_day(spark, hashed.drop("day"), "transmissions"), by_day(spark, moved.drop("day"), "observations")
    K.refresh(spark, hashed, moved, nodes, root, changed=gone | merged)
    again = folder(spark)
    K.refresh(spark, hashed, moved, nodes, again)
    got, want = all_rows(spark, root, tables), all_rows(spark, again, tables)
    assert got == want and sum(map(len, want.values())) > 100
    assert not exists(spark, f"{root}/rf_rollup/hour_key=2024-01-01-03") and not exists(spark, f"{root}/_aside/rf_rollup")


def test_reports_read_the_kept_best_observation(spark):
    from meshlake.operators import distance as D, nodes as N, packets as P, topology as TO

    tx, obs, nodes = facts(spark)
    best = P.best_table(obs)
    assert best.count() == tx.count()
    same = lambda f: sorted(map(str, f(obs).collect())) == sorted(map(str, f(best).collect()))
    edges = spark.createDataFrame([(NODES[0], NODES[1], 9, 3)], "node_a string, node_b string, count long, observer_count int").withColumn("last_seen", F.lit("2024-01-05").cast("timestamp"))
    now = "2024-01-06T00:00:00Z"
    assert same(lambda o: TO.topo_top_repeaters(tx, o, None, nodes, edges, now)) and same(lambda o: D.distance_hops(tx, o, nodes, edges, now))
    for f in (N.node_health, N.node_computed_stats):
        assert sorted(map(str, f(tx, obs, now).collect())) == sorted(map(str, f(tx, obs, now, best=best).collect()))
    few = nodes.limit(1)
    health = N.node_health(tx, obs, now)
    assert sorted(map(str, N.node_health(tx, obs, now, pubkeys=few).collect())) == sorted(map(str, health.join(few, "public_key", "left_semi").collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_touched_hours_reach_the_day_folders(spark):
    tx, obs, nodes = facts(spark)
    tx, obs = by_day(spark, tx, "transmissions"), by_day(spark, obs, "observations")
    touched = K.touched_by_new(tx, obs, 590)
    assert touched.heard and min(touched.seen).day == 5
    for name, (_, build) in K.builders(tx, obs, nodes, touched).items():
        if name.startswith("distance"):  # read the hop table
            continue
        text = plan(build())
        scans = [line for line in text.splitlines() if "FileScan" in line and ("timestamp#" in line or "first_seen#" in line)]
        assert scans and all("day#" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans), (name, text)


def test_hours_by_list_equal_hours_by_join(spark):
    tx, obs, _ = facts(spark)
    hours = K.touched_by_new(tx, obs, 400).heard
    table = spark.createDataFrame([(h,) for h in hours], "hour timestamp")
    a, b = U.rf_rollup_hour(tx, obs, hours), U.rf_rollup_hour(tx, obs, table)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 0
    assert U.rf_rollup_hour(tx, obs, []).count() == 0


@pytest.mark.parametrize("step", ["build", "move"])
def test_a_failed_refresh_is_repeated(spark, monkeypatch, step):
    tx, obs, nodes = facts(spark)
    root = folder(spark)
    few = lambda *a: {k: v for k, v in real(*a).items() if k in ("rf_rollup", "rf_rollup_tx")}
    real = K.builders
    monkeypatch.setattr(K, "builders", few)
    with monkeypatch.context() as patch:
        done = []
        target = "swap_hours" if step == "build" else "move"
        ok = getattr(K, target)
        patch.setattr(K, target, lambda *a: done.append(a) or (ok(*a) if len(done) < 2 else 1 / 0))
        with pytest.raises(ZeroDivisionError):
            K.refresh(spark, tx, obs, nodes, root)
    assert K.watermark(spark, root) == -1
    K.refresh(spark, tx, obs, nodes, root)
    want = sorted(map(str, U.rf_rollup_hour(tx, obs).collect()))
    assert sorted(map(str, K.kept(spark, root, "rf_rollup").drop("hour_key").collect())) == want
