"""Personal data: spans by rules, and spans that a character tagger adds.

Rules find emails, IP addresses, card numbers and phone numbers. A character-level bidirectional LSTM with CRF transitions
(`tagger`) learns from spans that rules label in a bounded sample of the corpus, some of them rewritten in forms that
the rules do not know (other separators, no country prefix). It reads overlapping windows; each window is decoded by itself,
spans cut by a window's edge are left to its neighbour, and a document's spans are reconciled as the heaviest set
without overlaps. What the tagger adds must have the parts of its kind (an address's four numbers, a card's check
digit, 8 to 15 digits of a phone), does not touch a rule's span, and never replaces one.

Every one of these kinds holds a digit or an @, so windows lie around each of these and around nothing else; a document
without any of them has no spans. Windows cover all such places of the whole text.

Sample for training: at most `most` windows, those of smallest hash, over all documents; the same input gives the same tagger.

Defined results: null texts are empty; documents without spans have counts of 0 and empty lists; rows without an id are
scanned like others, repeated rows each for themselves; texts of any length are scanned whole, in time that grows
with their length; no documents, no rows; extra columns stay, but `spans` and `n_base_spans` are replaced.
"""

from __future__ import annotations

import random
import re
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy
from .tagger import FILL, Tagger, codes, train, unaries, viterbi

ship(__name__)

KINDS = ("email", "ip", "card", "phone")
#: Window of the tagger, half of which overlaps the next, and the context of a digit or @.
WINDOW, NEAR = 64, 24
MARK = re.compile(r"[0-9@]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A number that fails at the start of its digits fails at each of them, so matches need only begin there.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += (2 * x - 9 if x > 4 else 2 * x) if i % 2 else x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def emails(text: str) -> list[Span]:
    """Matches of local@host.host, each begun as far left as the last one and the last @ allow."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        free = host.end() if host else at + 1
        if host:
            out.append(Span("email", start, free))
        at = text.find("@", free)
    return out


def base_spans(text: str, checked: bool = True) -> list[Span]:
    """Spans of the rules by kind, then place; unchecked, cards and phones of any check digit and length count too."""
    out = emails(text)
    out += [Span("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and (not checked or luhn(d)):
            out.append(Span("card", *m.span()))
    out += [Span("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def plausible(kind: str, text: str) -> bool:
    """Whether a tagged text has the parts that its kind needs."""
    d = _digits(text)
    if kind == "email":
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]*\w", text) is not None
    if kind == "ip":
        parts = DIGITS.findall(text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d) and re.fullmatch(r"[0-9][0-9 ./_-]*[0-9]", text) is not None
    return 8 <= len(d) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ()./-]*[0-9]", text) is not None


# windows


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text that lie near a digit or @, in order and apart."""
    out: list[list[int]] = []
    for m in MARK.finditer(text):
        a, z = max(0, m.start() - NEAR), min(len(text), m.end() + NEAR)
        if out and a <= out[-1][1]:
            out[-1][1] = z
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def windows_of(text: str) -> list[int]:
    """Starts of the windows: each stretch is covered, with half a window of overlap."""
    out = []
    for a, z in stretches(text):
        out.append(a)
        while out[-1] + WINDOW < z:
            out.append(out[-1] + WINDOW // 2)
    return out


def coded(texts: list[str]) -> np.ndarray:
    out = np.full((len(texts), WINDOW), FILL, np.int64)
    for i, t in enumerate(texts):
        out[i, : len(t)] = codes(t)
    return out


def tags_of(spans: list[Span]) -> np.ndarray:
    """First and further characters of each kind's spans have tags of their own; 0 is outside."""
    out = np.zeros(WINDOW, np.int8)
    for s in spans:
        k = 1 + 2 * KINDS.index(s.kind)
        out[s.start : s.end] = k + 1
        out[s.start] = k
    return out


def tagged(m: Tagger, texts: list[str]) -> list[list[tuple[Span, float]]]:
    """Decoded spans of each window with their weights: how far the tags' scores exceed that of being outside."""
    scores = unaries(m, coded(texts))
    found = []
    for w, tags in enumerate(viterbi(m, scores)):
        spans, at = [], 0
        while at < len(texts[w]):
            tag = int(tags[at])
            if tag % 2 == 0:
                at += 1
                continue
            end = at + 1
            while end < len(texts[w]) and tags[end] == tag + 1:
                end += 1
            s = scores[at:end, w]
            spans.append((Span(KINDS[tag // 2], at, end), float((s[np.arange(end - at), tags[at:end]] - s[:, 0]).sum())))
            at = end
        found.append(spans)
    return found


def reconciled(spans: list[tuple[Span, float]]) -> list[Span]:
    """The spans without overlaps of the highest sum of weights; equal spans of two windows add up."""
    weights: dict[Span, float] = {}
    for s, w in spans:
        if w > 0:
            weights[s] = weights.get(s, 0.0) + w
    order = sorted(weights, key=lambda s: (s.end, s.start, s.kind))
    ends = [s.end for s in order]
    best, take = [0.0], []
    for s in order:
        before = int(np.searchsorted(ends, s.start, "right"))
        with_it = best[min(before, len(take))] + weights[s]
        take.append((with_it > best[-1], before))
        best.append(max(best[-1], with_it))
    out, i = [], len(order)
    while i:
        taken, before = take[i - 1]
        if taken:
            out.append(order[i - 1])
        i = min(before, i - 1) if taken else i - 1
    return out[::-1]


def added(text: str, base: list[Span], found: list[tuple[Span, float]]) -> list[Span]:
    """What the tagger adds to a document's rule spans."""
    held = sorted((s.start, s.end) for s in base)
    starts = [a for a, _ in held]
    furthest = np.maximum.accumulate([z for _, z in held]) if held else []
    out = []
    for s in reconciled([x for x in found if plausible(x[0].kind, text[x[0].start : x[0].end])]):
        i = int(np.searchsorted(starts, s.end, "left"))
        if not (i and furthest[i - 1] > s.start):
            out.append(s)
    return out


# training


def rewritten(kind: str, text: str, rng: random.Random) -> str:
    """Another span of the kind: new digits, and for numbers often a form that the rules do not know."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    if kind == "email":
        host = ".".join(word() for _ in range(rng.randint(1, 2)))
        return rng.choice([word(), word() + n(2), word() + "." + word(), word() + "_" + n(1), word() + "+" + word()]) + "@" + host + "." + rng.choice(["com", "org", "net", "de", "fr", "es"])
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        size = rng.choice([16, 16, 16, 16, 17, 18, 19])
        return rng.choice(["", "", " ", "-", ".", "/"]).join(n(4) for _ in range(4)) + n(size - 16)
    a, b, c, d = str(rng.randint(1, 99)), n(3), n(3), n(4)
    return rng.choice([f"+{a} ({b}) {c}-{d}", f"({b}) {c}-{d}", f"00{a} {b} {c} {d}", f"+{a} {b} {c} {d}", f"{b}-{c}-{d}", f"{b}.{c}.{d}", f"0{b}/{c}{d}", f"+{a}-{b}-{c}-{d}"])


def examples(text: str, seed: int) -> list[tuple[str, list[Span]]]:
    """Labelled windows of a document's windows as they are, and with their spans rewritten or one put in."""
    rng, out = random.Random(seed), []
    base = base_spans(text, checked=False)
    for start in windows_of(text):
        end = min(len(text), start + WINDOW)
        if any(s.start < start < s.end or s.start < end < s.end for s in base):
            continue
        inside = sorted((Span(s.kind, s.start - start, s.end - start) for s in base if start <= s.start and s.end <= end), key=lambda s: (s.start, -s.end))
        apart: list[Span] = []
        for s in inside:
            if not apart or s.start >= apart[-1].end:
                apart.append(s)
        piece = text[start:end]
        out.append((piece, apart))
        if not apart and " " in piece:
            at = piece.index(" ") + 1
            apart = [Span(rng.choice(KINDS), at, at)]
        new, spans, last = "", [], 0
        for s in apart:
            new += piece[last : s.start]
            other = rewritten(s.kind, piece[s.start : s.end], rng)
            spans.append(Span(s.kind, len(new), len(new) + len(other)))
            new, last = new + other + ("" if s.end > s.start else " "), s.end
        new = (new + piece[last:])[:WINDOW]
        if apart and spans[-1].end <= len(new):
            out.append((new, spans))
    return out


def _sampled(most: int):
    def run(batches):
        for b in batches:
            rows = []
            for text in b["text"]:
                seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                for piece, spans in examples(text, seed):
                    rank = zlib.crc32(piece.encode("utf-8", "surrogatepass"), seed)
                    rows.append((rank, piece, "".join(map(chr, 48 + tags_of(spans)))))
            rows.sort()
            yield pd.DataFrame(rows[:most], columns=["rank", "piece", "tags"])

    return run


def training_windows(docs: DataFrame, text: str = "text", most: int = 1500) -> pd.DataFrame:
    """At most `most` labelled windows over all documents: piece, tags (one digit a character)."""
    some = docs.select(F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]")).mapInPandas(_sampled(most), "rank long, piece string, tags string")
    return some.dropDuplicates(["rank", "piece"]).orderBy("rank", "piece").limit(most).toPandas()


def learned(docs: DataFrame, text: str = "text", most: int = 1500, steps: int = 600) -> Tagger | None:
    """The tagger of a corpus; None where nothing in it has a digit or @."""
    some = training_windows(docs, text, most)
    if not len(some):
        return None
    tags = np.array([[ord(c) - 48 for c in t] for t in some["tags"]], dtype=np.int64)
    return train(coded(some["piece"].tolist()), tags, 1 + 2 * len(KINDS), steps)


# scan


def _scanner(m: Tagger | None, text: str, block: int = 512):
    def run(batches):
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b[text]]
            base = [base_spans(t) if t else [] for t in texts]
            found: list[list[tuple[Span, float]]] = [[] for _ in texts]
            todo: list[tuple[int, int]] = []

            def read(some):
                for (i, start), spans in zip(some, tagged(m, [texts[i][a : a + WINDOW] for i, a in some]), strict=True):
                    edge = min(len(texts[i]), start + WINDOW) - start
                    for s, w in spans:
                        # cut off by the window, and whole in its neighbour
                        if (s.start or not start) and (s.end < edge or start + edge == len(texts[i])):
                            found[i].append((Span(s.kind, start + s.start, start + s.end), w))  # noqa: B023

            for i, t in enumerate(texts):
                for start in windows_of(t) if m is not None and t else ():
                    todo.append((i, start))
                    if len(todo) == block:
                        read(todo)
                        todo = []
            if todo:
                read(todo)
            spans = []
            for t, old, new in zip(texts, base, found, strict=True):
                rows = [(KINDS.index(s.kind), s, False) for s in old] + [(KINDS.index(s.kind), s, True) for s in added(t, old, new)]
                rows.sort(key=lambda r: (r[0], r[1].start))
                spans.append([{"kind": s.kind, "start": s.start, "end": s.end, "added": new_} for _, s, new_ in rows])
            yield b.drop(columns=text).assign(spans=spans)

    return tidy(run)


SPANS = "array<struct<kind: string, start: long, end: long, added: boolean>>"


def personal_data(docs: DataFrame, text: str = "text", model: Tagger | None = None, most: int = 1500) -> DataFrame:
    """The rows with `spans` (kind, start, end in code points, added: by the tagger) by kind and place, in place of the text column.

    Texts without a digit or @ do not leave the JVM. Without a model, one is trained on the documents.
    """
    m = model if model is not None else learned(docs, text, most)
    rest = [c for c in docs.columns if c not in (text, "spans")]
    rows = docs.select(*rest, F.when(F.col(text).rlike("[0-9@]"), F.col(text)).alias(text))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return rows.mapInPandas(_scanner(m, text), f"{kinds}, spans {SPANS}" if kinds else f"spans {SPANS}")
