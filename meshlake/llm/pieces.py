"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of texts is cut into segments that no piece can span, and each distinct segment is encoded once: symbols
of all segments lie in one flat numpy array; every round looks up the ranks of neighbouring pairs, finds each
segment's best rank (a segmented minimum), merges its leftmost non-overlapping pairs at once and compacts,
until no pair remains. That equals merging one pair at a time, best score first and leftmost among equals, because
a merge can only make pairs of worse rank; pieces for which that does not hold are merged one by one.

The work is done per Arrow batch inside tasks, without a shuffle. Segments seen lately are remembered up to a fixed
number, so memory is bounded.

Defined results: a null text counts as empty and an empty text has no pieces (only begin and end ids, if asked
for); texts are encoded whole; equal rows give equal ids; other columns pass through; no rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, ship, tidy

ship(__name__)

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
CODES = 0x110000
NONE = np.int32(2**31 - 1)


def ragged(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[start[i] : start[i] + length[i]] one after another."""
    total = int(length.sum())
    shift = np.repeat(start - (np.cumsum(length) - length), length)
    return pool[shift + np.arange(total, dtype=np.int64)]


class PieceModel:
    """Tables of a SentencePiece BPE model (identity normalisation, dummy prefix, byte fallback)."""

    def __init__(self, proto: bytes, remember: int = 150_000):
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto.FromString(proto)
        norm = m.normalizer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or m.trainer_spec.treat_whitespace_as_suffix or not plain:
            raise ValueError("the model is not BPE with byte fallback, a dummy prefix and unchanged characters")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in m.pieces):
            raise ValueError("the model has user-defined or unused pieces")
        n = len(m.pieces)
        self.n, self.base = n, n + CODES
        self.bos, self.eos = m.trainer_spec.bos_id, m.trainer_spec.eos_id
        piece = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for i, p in enumerate(m.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        # symbols: pieces by id, characters that are no piece by n + code
        self.char = np.arange(n, n + CODES, dtype=np.int32)
        for s, i in piece.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        symbol = lambda s: piece.get(s, n + ord(s) if len(s) == 1 else None)
        levels = {s: r for r, s in enumerate(sorted({m.pieces[i].score for i in piece.values()}, reverse=True))}
        rank = {i: levels[m.pieces[i].score] for i in piece.values()}
        keys, to, loose, inner = [], [], set(), set()
        for s, i in piece.items():
            inner.update(zip(s, s[1:], strict=False))
            for k in range(1, len(s)):
                a, b = symbol(s[:k]), symbol(s[k:])
                if a is None or b is None:
                    continue
                keys.append(a * self.base + b)
                to.append(i)
                loose.update(x for x, part in ((a, s[:k]), (b, s[k:])) if len(part) > 1 and rank[i] <= rank[x])
        order = np.argsort(keys)
        self.keys, self.to = np.array(keys, dtype=np.int64)[order], np.array(to, dtype=np.int32)[order]
        self.rank = np.full(n, NONE, dtype=np.int32)
        self.rank[list(rank)] = list(rank.values())
        self.loose = np.zeros(n, dtype=bool)
        self.loose[list(loose)] = True
        # neighbouring characters inside any piece: between all others a segment may end
        chars = sorted({c for pair in inner for c in pair})
        self.kind = np.zeros(CODES, dtype=np.int32)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.inside = np.zeros((len(chars) + 1,) * 2, dtype=bool)
        for a, b in inner:
            self.inside[self.kind[ord(a)], self.kind[ord(b)]] = True
        if any(b == SPACE and a != SPACE for a, b in inner):
            raise ValueError("a piece holds a space after another character")
        alone = "" if "\n" in chars else "\n"
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|{alone}" if alone else "")).findall
        # bytes that each id stands for
        text = [b"" if p.type == CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b" \xe2\x81\x87 " if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode()
                for p in m.pieces]
        self.text = np.frombuffer(b"".join(text), dtype=np.uint8)
        self.text_len = np.array([len(t) for t in text], dtype=np.int64)
        self.text_at = np.cumsum(self.text_len) - self.text_len
        self.silent = np.array([p.type == CONTROL for p in m.pieces])
        self.spaced = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in m.pieces])
        self.remember = remember
        self.seen: dict[str, int] = {}
        self.pool, self.at, self.len = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def merged(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all segments (numbered in `seg`, ascending) after merging, with their segments."""
        done_sym, done_at, done_seg = [], [], []
        at = np.arange(len(sym))
        while len(sym) > 1:
            key = sym[:-1].astype(np.int64) * self.base + sym[1:]
            found = np.searchsorted(self.keys, key)
            found[found == len(self.keys)] = 0
            ok = (self.keys[found] == key) & (seg[:-1] == seg[1:])
            to = np.where(ok, self.to[found], -1)
            rank = np.append(np.where(ok, self.rank[to], NONE), NONE)
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            open_ = np.repeat(best != NONE, size)
            if not open_.all():
                done_sym.append(sym[~open_])
                done_at.append(at[~open_])
                done_seg.append(seg[~open_])
                if not open_.any():
                    sym = sym[:0]
                    break
            take = np.flatnonzero((rank == np.repeat(best, size)) & open_)
            # of overlapping pairs in a row, every second one from the left
            run = np.append(True, np.diff(take) != 1)
            place = np.arange(len(take))
            take = take[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            if self.loose[to[take]].any():
                owner = seg[take]
                leads = np.append(True, owner[1:] != owner[:-1])
                bad = np.isin(owner, owner[self.loose[to[take]]])
                take = take[leads | ~bad]
            sym[take] = to[take]
            open_[take + 1] = False
            sym, seg, at = sym[open_], seg[open_], at[open_]
        done_sym.append(sym)
        done_at.append(at[: len(sym)])
        done_seg.append(seg[: len(sym)])
        sym, at, seg = map(np.concatenate, (done_sym, done_at, done_seg))
        order = np.argsort(at, kind="stable")
        return sym[order], seg[order]

    def _learn(self, new: list[str]) -> None:
        """Encode segments and remember them."""
        codes = np.frombuffer("".join(new).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        word = np.repeat(np.arange(len(new)), sizes)
        kind = self.kind[codes]
        joined = np.append(False, self.inside[kind[:-1], kind[1:]] & (word[1:] == word[:-1]))
        sym, part = self.merged(self.char[codes], np.cumsum(~joined))
        of_part = word[np.flatnonzero(~joined)]  # the word of each part, parts numbered from 1
        owner = of_part[part - 1]
        plain = sym < self.n
        if not plain.all():  # characters that are no piece become their bytes
            spelled = [self.byte_ids[list(chr(s - self.n).encode())] if s >= self.n else [s] for s in sym[~plain]]
            width = np.ones(len(sym), dtype=np.int64)
            width[~plain] = [len(x) for x in spelled]
            out = np.repeat(sym, width)
            out[np.repeat(~plain, width)] = np.concatenate(spelled)
            sym, owner = out, np.repeat(owner, width)
        size = np.bincount(owner, minlength=len(new))
        base = len(self.pool)
        self.seen.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.pool = np.concatenate([self.pool, sym.astype(np.int32)])
        self.at = np.concatenate([self.at, base + np.cumsum(size) - size])
        self.len = np.concatenate([self.len, size])

    def encode(self, texts: list[str | None], ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's ids."""
        parts = [self.cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = {p for ps in parts for p in ps if p not in self.seen}
        if len(self.seen) + len(new) > self.remember and self.seen:
            self.seen, self.pool, self.at, self.len = {}, self.pool[:0], self.at[:0], self.len[:0]
            new = {p for ps in parts for p in ps}
        if new:
            self._learn(list(new))
        find = self.seen.__getitem__
        many = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
        code = np.fromiter((find(p) for ps in parts for p in ps), dtype=np.int64, count=int(many.sum()))
        length = self.len[code]
        flat = ragged(self.pool, self.at[code], length)
        upto = np.append(0, np.cumsum(length))
        last = np.cumsum(many)
        sizes = upto[last] - upto[last - many]
        if ends:
            stop = np.cumsum(sizes)
            flat = np.insert(flat, np.ravel(np.column_stack([stop - sizes, stop])), np.tile(np.array([self.bos, self.eos], dtype=np.int32), len(sizes)))
            sizes = sizes + 2
        return flat, sizes

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of id sequences that lie one after another."""
        flat = np.asarray(flat, dtype=np.int64)
        if len(flat) and (flat.min() < 0 or flat.max() >= self.n):
            raise ValueError("an id is not in the model")
        size = self.text_len[flat]
        raw = ragged(self.text, self.text_at[flat], size).tobytes()
        upto = np.append(0, np.cumsum(size))
        out, at = [], 0
        for n in sizes:
            a, z = int(upto[at]), int(upto[at + n])
            ids = flat[at : at + n]
            lead = np.argmin(self.silent[ids]) if n else 0
            if n and self.spaced[ids[lead]]:
                a += 1
            t = raw[a:z]
            try:
                out.append(t.decode())
            except UnicodeDecodeError:  # one replacement for each byte that is no character
                out.append(re.sub("[\udc80-\udcff]", "�", t.decode(errors="surrogateescape")))
            at += n
        return out


def _chunks(rows: list, most: int = 500_000) -> Iterator[list]:
    """Parts of a bounded number of characters or ids; a longer row ends its part."""
    part, n = [], 0
    for t in rows:
        part.append(t)
        n += 0 if t is None else len(t)
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", ends: bool = True) -> DataFrame:
    """`docs` with the ids of each text as array<int>, with begin and end ids if `ends`."""
    with open(model_path, "rb") as f:
        proto = f.read()
    key = ("pieces", model_path, zlib.crc32(proto))

    def run(s: pd.Series) -> pd.Series:
        model = kept(key, lambda: PieceModel(proto))
        out = []
        for part in _chunks(list(s)):
            flat, sizes = model.encode(part, ends)
            out += np.split(flat, np.cumsum(sizes)[:-1])
        return pd.Series(out, dtype=object)

    # marked so that a plan never calls it once for each use of its result
    return docs.withColumn(ids, F.pandas_udf(run, "array<int>").asNondeterministic()(F.col(text)))


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`df` with the text of each id sequence (null: empty)."""
    with open(model_path, "rb") as f:
        proto = f.read()
    key = ("pieces", model_path, zlib.crc32(proto))

    def run(s: pd.Series) -> pd.Series:
        model = kept(key, lambda: PieceModel(proto))
        out = []
        for part in _chunks(list(s)):
            sizes = np.array([0 if x is None else len(x) for x in part], dtype=np.int64)
            out += model.decode(np.concatenate([np.zeros(0, dtype=np.int32), *[x for x in part if x is not None]]), sizes)
        return pd.Series(out, dtype=object)

    return df.withColumn(text, F.pandas_udf(run, "string").asNondeterministic()(F.col(ids)))


def transcode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", ends: bool = True) -> DataFrame:
    """Encode and decode in one pass: `docs` without its text, with `ids` as little-endian unsigned 32-bit integers and
    the text they decode to. A task holds one part of bounded size, or one text."""
    with open(model_path, "rb") as f:
        proto = f.read()
    rest = [c for c in docs.columns if c not in (text, ids, decoded)]
    key = ("pieces", model_path, zlib.crc32(proto))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = kept(key, lambda: PieceModel(proto))
        for pdf in batches:
            at = 0
            for part in _chunks(list(pdf[text])):
                flat, sizes = model.encode(part, ends)
                out = pdf.iloc[at : at + len(part)][rest].copy()
                out[ids] = [x.tobytes() for x in np.split(flat.astype("<u4"), np.cumsum(sizes)[:-1])]
                out[decoded] = model.decode(flat, sizes)
                at += len(part)
                yield out

    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])
    return docs.select(*rest, text).mapInPandas(tidy(run), schema)
