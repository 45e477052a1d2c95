"""Token files: the ids of a corpus in document order, range-coded, and their reader.

A token file is a Parquet table of records. A record holds consecutive whole documents: their ids and sizes, and
their token stream cut into blocks of a fixed number of ids, each coded by `tokencode` from a fresh model and with
a checksum of its own. Records follow the order of document ids: `part` numbers the range partitions, `seq` the records
in one, `before` counts the part's ids before a record. Start positions over the whole corpus come from the parts'
totals, so nothing but one row per part is ever added up in one place.

Texts are tokenised after the range exchange. The library encodes each distinct blank-separated chunk once per
worker: its normaliser and pre-tokeniser never look across white space, so a text's ids are its chunks' ids in order.

Defined results: a null or empty text has only its end id; null ids come first; rows with equal ids are written
one after another, ordered by text; longer texts than a record make a record of their own; no rows
give an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokencode
from .common import kept, partitions, ship
from .pieces import ragged

ship(__name__)

RECORD = "part int, seq long, before long, vocab int, n_tokens long, ids array<long>, sizes array<long>, block_size int, blocks array<binary>"
MARK = "\x01"


class ChunkTokenizer:
    """A tokenizers-library tokenizer with a memory of the chunks seen lately."""

    def __init__(self, json: str, remember: int = 400_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(json)
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        marks = self._ids(MARK)
        self.mark = marks[0] if len(marks) == 1 else None
        self.remember = remember
        self._reset()

    def _reset(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.pool, self.at, self.len = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[bytes]) -> None:
        """Many chunks go through the library as one text, with a mark between them; those that hold the mark go alone."""
        odd = [c for c in new if self.mark is None or MARK.encode() in c]
        new = [c for c in new if not (self.mark is None or MARK.encode() in c)]
        flat, size = [], []
        for k in range(0, len(new), 20_000):
            ids = np.array(self._ids(f" {MARK} ".join(c.decode() for c in new[k : k + 20_000])), dtype=np.int32)
            cut = np.flatnonzero(ids == self.mark)
            edge = np.concatenate([[-1], cut, [len(ids)]])
            flat.append(ids[ids != self.mark])
            size.append(np.diff(edge) - 1)
        for c in odd:
            flat.append(np.array(self._ids(c.decode()), dtype=np.int32))
            size.append(np.array([len(flat[-1])]))
        sizes = np.concatenate(size).astype(np.int64)
        base = len(self.pool)
        self.seen.update(zip(new + odd, range(len(self.at), len(self.at) + len(sizes)), strict=True))
        self.pool = np.concatenate([self.pool, *flat])
        self.at = np.concatenate([self.at, base + np.cumsum(sizes) - sizes])
        self.len = np.concatenate([self.len, sizes])

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the end id, and the number of each text's ids."""
        chunks = [t.encode().split() if t else [] for t in texts]
        new = {c for cs in chunks for c in cs if c not in self.seen}
        if self.seen and len(self.seen) + len(new) > self.remember:
            self._reset()
            new = {c for cs in chunks for c in cs}
        if new:
            self._learn(list(new))
        find = self.seen.__getitem__
        many = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        code = np.fromiter((find(c) for cs in chunks for c in cs), dtype=np.int64, count=int(many.sum()))
        length = self.len[code]
        flat = ragged(self.pool, self.at[code], length)
        upto, last = np.append(0, np.cumsum(length)), np.cumsum(many)
        sizes = upto[last] - upto[last - many]
        flat = np.insert(flat, np.cumsum(sizes), np.int32(end))
        return flat, sizes + 1


def _records(json: str, end: int, block_size: int, record_size: int):
    key = ("tokenizer", zlib.crc32(json.encode()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tok = kept(key, lambda: ChunkTokenizer(json))
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        flats: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        n = 0

        def record() -> pd.DataFrame:
            nonlocal seq, before, n
            flat, size = np.concatenate(flats), np.concatenate(sizes)
            blocks = tokencode.encode_blocks([flat[i : i + block_size] for i in range(0, len(flat), block_size)], tok.vocab)
            row = {"part": part, "seq": seq, "before": before, "vocab": tok.vocab, "n_tokens": len(flat), "ids": list(ids),
                   "sizes": size, "block_size": block_size, "blocks": blocks}
            seq, before, n = seq + 1, before + len(flat), 0
            ids.clear()
            flats.clear()
            sizes.clear()
            return pd.DataFrame([row])

        for pdf in batches:
            for k in range(0, len(pdf), 500):
                some = pdf.iloc[k : k + 500]
                flat, size = tok.encode(list(some["text"]), end)
                flats.append(flat)
                sizes.append(size)
                ids += [None if pd.isna(x) else int(x) for x in some["id"]]
                n += len(flat)
                if n >= record_size:
                    yield record()
        if ids:
            yield record()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end: int, id: str = "doc_id", text: str = "text",
                 block_size: int = 4096, record_size: int = 1 << 22) -> None:
    """Tokenise every text of `docs` and write the token file at `path`, in ascending order of `id`.

    A record ends after about `record_size` ids; the coder advances its blocks side by side.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        json = f.read()
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "id").sortWithinPartitions("id", "text")
    rows.mapInPandas(_records(json, end, block_size, record_size), RECORD).write.parquet(path)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            flat = np.concatenate([np.zeros(0, dtype=np.int64), *tokencode.decode_blocks(list(r.blocks), int(r.vocab))]).astype("<u4")
            sizes = np.asarray(r.sizes)
            stop = np.cumsum(sizes)
            if len(flat) != sizes.sum() or len(flat) != r.n_tokens:
                raise ValueError("a record's blocks do not hold as many ids as its head says")
            for k in range(0, len(sizes), 2000):
                z = stop[k : k + 2000]
                a = z - sizes[k : k + 2000]
                yield pd.DataFrame({"part": r.part, "id": pd.array([None if x is None or x != x else int(x) for x in r.ids[k : k + 2000]], dtype="Int64"), "_at": r.before + a, "n_tokens": z - a,
                                    "tokens": [flat[i:j].tobytes() for i, j in zip(a, z, strict=True)]})


def read_tokens(spark: SparkSession, path: str, id: str = "doc_id") -> DataFrame:
    """One row per document of a token file: its id, start (ids of all documents before it), n_tokens, and tokens as
    little-endian unsigned 32-bit integers. Raises ValueError where a block is damaged."""
    records = spark.read.schema(RECORD).parquet(path)
    totals = records.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    base = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    docs = records.select("part", "before", "vocab", "n_tokens", "ids", "sizes", "blocks").mapInPandas(
        _documents, "part int, id long, _at long, n_tokens long, tokens binary")
    # one row per part: as many as the writer had partitions
    return docs.join(F.broadcast(base), "part").select(F.col("id").alias(id), (F.col("base") + F.col("_at")).alias("start"), "n_tokens", "tokens")
