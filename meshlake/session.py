"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
}

#: Shuffle files go when their query ends, not when the driver happens to collect its garbage: jobs of many steps hold the files of one.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SETTINGS[CLEANUP] = "true"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("meshlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Reliable replacement for recomputation in iterative plans: the written table
    survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    # keys are hex text, which dictionaries no longer hold on large tables; zstd halves it there
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by_key(df: DataFrame, key: str, parts: int) -> DataFrame:
    """As :func:`cut_lineage`, in ``parts`` buckets of ``key``, so that joins and groups by the key need no shuffle.

    Rows should lie in ``parts`` hash partitions of the key already, else each task writes a file per bucket.
    """
    spark = df.sparkSession
    name = f"cut_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(name)
    return spark.table(name)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The partition folders (``name=value``) in a folder."""
    fs, p = _file_system(spark, path)
    return sorted(str(x.getPath()) for x in (fs.listStatus(p) if fs.exists(p) else []) if "=" in x.getPath().getName())


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _file_system(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"cannot move {path} to {to}")
