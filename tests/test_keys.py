"""Full keys move as bytes: half the shuffled text, the same groups."""

import pytest
from pyspark.sql import functions as F

from meshlake.functions.keys import grouped, packed, unpacked
from meshlake.operators import nodes as N
from meshlake.plans import rollups as U
from workload.mesh_views import NOW, MeshTables

ODD = ["", "0", "00", "0a", "0A", "aF", "abc", "a1b2", "A1B2", "g0", "?00", "é", " 00", "00 ", "\x00\x01", "1234", None, "ab" * 32, "AB" * 32]


@pytest.fixture(scope="module")
def mesh(spark):
    return MeshTables(spark, "/root/testdata/sf0.001")


def test_packed_keys_come_back_and_stay_apart(spark):
    df = spark.createDataFrame([(k,) for k in ODD], "k string")
    p = df.select("k", packed(F.col("k")).alias("p")).select("k", "p", unpacked(F.col("p")).alias("u")).collect()
    assert [r.u for r in p] == ODD
    assert len({bytes(r.p) for r in p if r.p is not None}) == len(ODD) - 1
    assert {len(r.p) for r in p if r.k and len(r.k) == 64} == {33}
    got = grouped(df.union(df), ["k"], ["k"], F.count(F.lit(1)).alias("n")).collect()
    assert sorted((r.k is None, r.k or "", r.n) for r in got) == sorted((k is None, k or "", 2) for k in ODD)


@pytest.mark.parametrize("name", ["node_rollup_hour", "node_health", "node_recent_packets", "relay_touch", "repeater_usefulness"])
def test_keys_are_packed_before_they_are_shuffled(mesh, name):
    df = {"node_rollup_hour": lambda: U.node_rollup_hour(mesh.tx, mesh.obs),
          "node_health": lambda: N.node_health(mesh.tx, mesh.obs, NOW, best=mesh.best),
          "node_recent_packets": lambda: N.node_recent_packets(mesh.tx, mesh.obs),
          "relay_touch": lambda: N.relay_touch(mesh.nodes, mesh.obs, NOW),
          "repeater_usefulness": lambda: N.repeater_usefulness(mesh.tx, mesh.obs, mesh.nodes)}[name]()
    assert "unhex(" in df._jdf.queryExecution().optimizedPlan().toString()
