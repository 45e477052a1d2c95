"""Collects the registered queries of all areas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshlake.session import CLEANUP

from .mesh_views import MeshTables, flat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


_VIEWS: dict[tuple[str, str], MeshTables] = {}


def tables(spark: SparkSession, sf_dir: str) -> MeshTables:
    """The mesh tables of one directory, derived once per Spark application and read by all its queries."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # hours and weekdays are UTC by definition
    spark.conf.set(CLEANUP, "true")
    k = (spark.sparkContext.applicationId, sf_dir)
    if k not in _VIEWS:
        _VIEWS[k] = MeshTables(spark, sf_dir)
    return _VIEWS[k]


def query(name: str, oracle: str | None = None):
    """Register ``fn(MeshTables) -> DataFrame`` under a name, with its DuckDB text if there is one."""

    def wrap(fn: Callable[[MeshTables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: flat(fn(tables(spark, sf_dir)))
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return wrap
