"""Pages by cursor against pages by offset, over a table stored by day."""

import pytest
from pyspark.sql import functions as F

from meshlake.operators import packets as P


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("days") / "tx")
    rows = [(i, None if i % 17 == 0 else f"2024-01-{1 + (i * i) % 9 + (10 if i % 5 == 0 else 0):02d} 0{i % 3}:00:00") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, t string").select("id", F.col("t").cast("timestamp").alias("first_seen"))
    df.withColumn("day", F.to_date("first_seen")).write.partitionBy("day").parquet(root)
    return spark.read.parquet(root)


@pytest.mark.parametrize("order", ["asc", "desc"])
@pytest.mark.parametrize("by_day", [True, False])
def test_cursors_walk_the_table_once(spark, stored, order, by_day):
    tx = stored if by_day else stored.drop("day")
    want = [(r.first_seen, r.id) for r in P.page(tx, 1000, 0, order).collect()]
    got, after = [], None
    while True:
        rows = P.seek(tx, 45, after, order).collect()
        if not rows:
            break
        got += [(r.first_seen, r.id) for r in rows]
        after = got[-1]
    assert got == want and len(got) == 200


def test_a_page_reads_its_days_only(stored):
    df = P.seek(stored, 5, ("2024-01-05T00:00:00Z", -1))
    assert {str(r.day) for r in df.collect()} == {"2024-01-05"}
    text = df._jdf.queryExecution().executedPlan().toString()
    part = text.split("PartitionFilters: [")[1].split("]")[0]
    assert ">= 2024-01-05" in part and "<= 2024-01-05" in part
    assert "Offset" not in text


def test_edges(spark, stored):
    assert P.seek(stored, 5, ("2030-01-01T00:00:00Z", 1)).count() == 0
    assert [r.first_seen for r in P.seek(stored, 5, ("2000-01-01T00:00:00Z", 1), "desc").collect()] == [None] * 5
    assert P.seek(stored.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        P.seek(stored, 0)
