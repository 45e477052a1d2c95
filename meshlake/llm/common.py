"""Helpers shared by the corpus operators: word hashing inside tasks, tables in the shared folder."""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these characters; `bytes.split()` cuts at the same ones.
BLANK = r"\x20\x09-\x0D"
WORD = f"[^{BLANK}]+"

MASK = (1 << 64) - 1


def ship(name: str) -> None:
    """Send a module's task functions by value, so executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def kept(key: tuple, make):
    """`make()`, once per worker process: what a worker has learned serves its later tasks, too.

    A worker remembers one such thing at a time, so an idle one does not hold the memory of all it ever did.
    """
    holder = sys.modules.setdefault("_llm_worker_memory", types.ModuleType("_llm_worker_memory"))
    if key not in holder.__dict__.setdefault("held", {}):
        holder.held.clear()
        holder.held[key] = make()
    return holder.held[key]


def tidy(run):
    """A task function that hands freed memory back to the system when its task ends: idle workers stay small."""

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share (`spark.checkpoint.dir`)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The table written to the shared folder and read back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by `stored` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered for the words seen lately."""

    def __init__(self, keep: int = 120_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.keep:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def word_hashes() -> WordHashes:
    return kept(("word hashes",), WordHashes)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection, so nothing collides that did not before)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive values, in order (a polynomial, built by doubling)."""
    base = 0x9E3779B97F4A7C15
    acc, done, power, size = None, 0, h, 1
    while True:
        if k & size:  # the run of `done` values is followed by one of `size`
            if acc is None:
                acc, done = power, size
            else:
                n = len(h) - done - size + 1
                acc, done = acc[:n] * np.uint64(pow(base, size, 1 << 64)) + power[done : done + n], done + size
        size *= 2
        if size > k:
            return mixed(acc)
        n = len(h) - size + 1
        power = power[:n] * np.uint64(pow(base, size // 2, 1 << 64)) + power[size // 2 : size // 2 + n]


def blank(c: str):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(c), F.lit(""))
