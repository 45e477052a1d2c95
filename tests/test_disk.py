"""What jobs of several steps leave on the disk."""

import os

from pyspark.sql import functions as F

from meshlake.session import CLEANUP, SETTINGS
from workload.registry import tables


def shuffle_files(spark):
    jvm = spark.sparkContext._jvm
    dirs = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, names in os.walk(str(d)) for f in names if f.startswith("shuffle_")}


def test_shuffle_files_go_with_their_query(spark):
    assert SETTINGS[CLEANUP] == "true"
    tables(spark, "/root/testdata/sf0.001")
    assert spark.conf.get(CLEANUP) == "true"
    before = shuffle_files(spark)
    rows = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    want = sorted(map(tuple, rows.collect()))
    assert want == [(k, 100) for k in range(10)] and not shuffle_files(spark) - before
    # asked again, the same frame makes them anew
    assert sorted(map(tuple, rows.collect())) == want


def test_rollups_keep_their_texts_though_they_move_packed(spark):
    from meshlake.plans import rollups as U
    from meshlake.session import checkpoint_dir
    rows = [("2024-01-01 05:10:00", k, n) for n, k in enumerate(["ab" * 32, "AB" * 32, "aB", "abc", "", None, "nöt hex", "*"])]
    df = spark.createDataFrame(rows, "at string, k string, n long").select(F.date_trunc("hour", F.col("at").cast("timestamp")).alias("hour"), "k", "n")
    root = f"{checkpoint_dir(spark)}/packed-rollup"
    U.write_rollup(df, root)
    assert sorted(spark.read.parquet(root).select("n", "k").collect()) == [(n, k) for _, k, n in rows]
    plan = U.distance_hourly(df.select("hour", F.lit("C↔R").alias("type"), F.lit(1.0).alias("dist"), F.col("n").alias("id")),
                             df.select(F.col("n").alias("transmission_id"), F.upper("k").alias("observer_id")))._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex" in plan.split("Aggregate [hour")[-1]


def test_refresh_leaves_no_hop_table(spark):
    from meshlake.plans import upkeep as K
    from meshlake.session import checkpoint_dir, exists
    m, root = tables(spark, "/root/testdata/sf0.001"), f"{checkpoint_dir(spark)}/kept-hops"
    K.refresh(spark, m.tx, m.obs, m.nodes, root, grain="day", only=("distance_hourly",))
    assert K.kept(spark, root, "distance_hourly").count() > 0 and not exists(spark, f"{root}/_aside/hops") and not exists(spark, f"{root}/node_rollup")
