"""Every area once against DuckDB at the smallest scale, plus streams against batches."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows

SF = "/root/testdata/sf0.001"
SAMPLE = ["rf_summary", "rf_histogram_snr", "filter_packets", "dsl_predicates", "type_samples", "topo_top_pairs", "resolve_hops", "jaccard_disambiguate",
          "distance_summary", "subpath_counts", "channel_analytics", "hash_collisions", "node_computed_stats", "repeater_liveness", "metrics_deltas",
          "node_skew", "decode_adverts", "content_hash", "rf_from_rollup", "distance_from_rollup", "ingest_stream", "hourly_tumbling", "stream_dedup", "ingest_merge_hearings", "ingest_merge_nodes", "topo_hop_stats"]


ALL_TIME = ["rf_snr_by_type_all", "rf_from_rollup_all", "channels_from_rollup_all", "distance_from_rollup_all", "metrics_summary_all", "metrics_sparkline_all", "subpath_top_all"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, con, name):
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["rf_rollup_scatter_all", "distance_rejected", *ALL_TIME])
def test_nothing_left_out_is_the_same_as_sql(spark, con, name):
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_whole_forms_have_no_window():
    sql = entry.oracle_sql()
    assert all(sql[n] != sql[n.removesuffix("_all")] for n in ALL_TIME)


def test_stored_hops_of_every_length(spark):
    from meshlake.plans import rollups
    from pyspark.sql import functions as F

    tx = spark.createDataFrame([(1, "h", "a")], "id long, hash string, pk string").select("id", "hash", F.lit("2024-01-01").cast("timestamp").alias("first_seen"), F.struct(F.col("pk").alias("pubKey")).alias("decoded"))
    obs = spark.createDataFrame([(1, 1, 2.0, ["b", "c"], None)], "id long, transmission_id long, snr double, path array<string>, resolved_path array<string>")
    nodes = spark.createDataFrame([("a", "A", "repeater", 40.0, 8.0), ("b", "B", "repeater", 41.0, 8.0), ("c", "C", "repeater", 49.0, 8.0)], "public_key string, name string, role string, lat double, lon double")
    assert sorted(round(r.km) for r in rollups.stored_hops(tx, obs, nodes).collect()) == [111, 890]
    assert [round(r.km) for r in rollups.stored_hops(tx, obs, nodes, max_km=300.0).collect()] == [111]


@pytest.mark.parametrize("per_trigger", [1, 3, 100])
def test_metrics_stream_is_the_batch_at_any_trigger_size(spark, tmp_path, per_trigger):
    from pyspark.sql import functions as F

    from meshlake.operators import ingest, observers
    from meshlake.streaming import jobs
    from workload.registry import tables

    m = tables(spark, SF)
    s = m.metrics.withColumn("tx_air_secs", F.when(F.col("seq") % 7 != 0, F.col("tx_air_secs")))  # counters may be null
    s.orderBy("seq").repartition(6, "seq").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", per_trigger).parquet(str(tmp_path / "in"))
    jobs.metrics_stream(source, str(tmp_path / "out"), str(tmp_path / "ck"), 43200)
    got = observers.metrics_deltas(jobs.stored_samples(s, str(tmp_path / "out")), 43200)
    want = observers.metrics_deltas(ingest.metrics_snap(s, 43200), 43200)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_liveness_stream_reports_every_source(spark):
    got = entry.queries()["liveness_stream"](spark, SF).collect()
    assert {r.source for r in got} == {"broker0", "broker1", "broker2", "broker9"}
