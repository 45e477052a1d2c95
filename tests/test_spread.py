"""Deviations that lie on a border of rounding."""

import pytest
from pyspark.sql import functions as F

from meshlake.operators import nodes as N

BORDER = [9.0, 1.0, 12.25, -9.0, 5.25, -3.5]  # deviation 7.25 exactly; summed up in some orders it is 7.249999999999999


@pytest.mark.parametrize("order", [BORDER, BORDER[::-1], sorted(BORDER)])
def test_a_deviation_does_not_follow_the_order_of_rows(spark, order):
    tx = spark.createDataFrame([(i, f"h{i}", f"2024-01-30 0{i}:00:00", 4, ("ab",)) for i in range(6)], "id long, hash string, t string, payload_type int, decoded struct<pubKey:string>")
    tx = tx.withColumn("decoded", F.struct("decoded.pubKey", *[F.lit(None).cast("string").alias(c) for c in ("destPubKey", "srcPubKey", "name")])).withColumn("first_seen", F.col("t").cast("timestamp"))
    obs = spark.createDataFrame([(i, i, "S", x, -80.0, 1, ["aa"], [None], f"2024-01-30 0{i}:00:01") for i, x in enumerate(order)],
                                "id long, transmission_id long, observer_id string, snr double, rssi double, score int, path array<string>, resolved_path array<string>, t string")
    obs = obs.withColumn("timestamp", F.col("t").cast("timestamp"))
    got = N.node_computed_stats(tx.coalesce(1), obs.coalesce(1), "2024-01-31T00:00:00Z").collect()
    assert [(r.public_key, r.total_packets, r.snr_stddev) for r in got] == [("ab", 6, 7.3)]
