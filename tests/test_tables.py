"""The workload's packet tables: small rows, and no shuffle by packet."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from meshlake.operators.packets import best_table
from meshlake.session import cut_by_key
from workload.mesh_views import MeshTables


@pytest.fixture(scope="module")
def mesh(spark):
    return MeshTables(spark, "/root/testdata/sf0.001")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packets_meet_their_observations_without_a_shuffle(mesh):
    assert "Exchange" not in _plan(best_table(mesh.obs))
    assert "Exchange" not in _plan(mesh.tx.hint("merge").join(mesh.obs, mesh.tx.id == mesh.obs.transmission_id).select("hash", "snr"))


def test_no_full_key_is_written_with_an_observation(spark, mesh):
    stored = spark.read.parquet(*mesh.obs.inputFiles())
    longest = stored.select([F.max(F.length(F.col(c).cast("string"))).alias(c) for c in stored.columns if c != "path"]).first()
    assert max(n for n in longest if n is not None) < 32
    assert stored.select(F.max(F.array_max(F.transform("path", F.length)))).first()[0] <= 6
    keys = mesh.obs.agg(F.min(F.length("observer_id")), F.max(F.array_max(F.transform("resolved_path", F.length)))).first()
    assert tuple(keys) == (64, 64)


def test_a_table_by_key_has_one_file_a_bucket(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 2).repartition(5, "id")
    t = cut_by_key(df, "id", 5)
    assert len(t.inputFiles()) == 5
    assert sorted(map(tuple, t.collect())) == [(i, 2 * i) for i in range(1000)]
    assert "Exchange" not in _plan(t.groupBy("id").agg(F.sum("v")))


def test_telemetry_after_zero_bytes_is_the_same_as_sql(spark, tmp_path):
    """Sensors whose battery value begins with a zero byte (3584 mV): zero bytes after the name are skipped."""
    import duckdb

    import __spark_entry__ as entry
    from tools.compare import rows

    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        t = os.path.basename(f).removesuffix(".parquet")
        src = f"SELECT * FROM '/root/testdata/sf0.1/orders.parquet' WHERE o_custkey % 1000 IN (584, 589)" if t == "orders" else f"SELECT * FROM '{f}'"
        con.sql(f"COPY ({src}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = entry.queries()["decode_adverts"](spark, str(tmp_path)).toPandas()
    assert (got.battery_mv == -1).any() and (got.battery_mv > 0).any()
    assert rows(got) == rows(con.sql(entry.oracle_sql()["decode_adverts"]).df())


def test_no_full_key_is_written_with_a_best_observation(spark, mesh):
    stored = spark.read.parquet(*mesh.best.inputFiles())
    longest = stored.select([F.max(F.length(F.col(c).cast("string"))).alias(c) for c in stored.columns if c != "path"]).first()
    assert max(n for n in longest if n is not None) < 32
    want = best_table(mesh.obs)
    assert sorted(mesh.best.columns) == sorted(want.columns)
    assert mesh.best.select(want.columns).exceptAll(want).isEmpty() and want.exceptAll(mesh.best.select(want.columns)).isEmpty()
