"""License scans by template-markup matching.

A template is wording with markup: `<<optional>> ... <<end>>` may be absent, `<<any N>>` stands for up to N
arbitrary words, everything else is mandatory word for word. A template compiles into a token automaton; a text is
accepted where the automaton reaches its end, so any change of a mandatory word is a rejection. Beside templates,
short phrases name a license wherever their words stand one after another.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z: ASCII letters and digits, and everything
beyond ASCII. The scan runs per document inside tasks, without a shuffle; an automaton starts only where its
first words stand, and holds one bit per state, so long texts cost time in proportion to their words.

Defined results: null or empty text has no words and no labels; all places of a phrase
count, matches of one template do not overlap; equal rows give equal results; other columns, null ones too, pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

ship(__name__)

#: Phrases that name a license.
PHRASES: Mapping[str, str] = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Wording of widespread licenses and notices, with markup.
TEMPLATES: Sequence[tuple[str, str]] = (
    ("mit", """<<optional>> the mit license mit <<end>> permission is hereby granted free of charge to any person obtaining a copy of this
     software and associated documentation files the software to deal in the software without restriction including without limitation the
     rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
     software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
     <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software"""),
    ("apache-2", """licensed under the apache license version 2 0 <<optional>> the license <<end>> you may not use this file except in
     compliance with the license <<optional>> you may obtain a copy of the license at <<any 8>> <<end>>"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following
     conditions are met <<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of
     conditions and the following disclaimer"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
     that the above copyright notice and this permission notice appear in all copies"""),
    ("gpl", """<<optional>> this work is <<end>> licensed under the <<optional>> terms of the <<end>> gnu general public license
     <<optional>> as published by the free software foundation <<end>> <<optional>> either <<end>> version <<any 1>>"""),
    ("gpl", """free software you can redistribute it and or modify it under the terms of the gnu general public license"""),
    ("mit", """released under the <<optional>> terms of the <<end>> mit license"""),
    ("apache-2", """licensed under the apache license <<optional>> version <<end>> 2 <<optional>> 0 <<end>>"""),
    ("mpl-2", """subject to the terms of the mozilla public license <<optional>> v <<end>> <<optional>> version <<end>> 2 0"""),
    ("cc-by-nc", """creative commons attribution <<optional>> non commercial <<end>> <<optional>> noncommercial <<end>> nc"""),
    ("cc-by-nc", """creative commons attribution noncommercial <<any 2>> license"""),
    ("cc-by", """licensed under <<optional>> a <<end>> <<optional>> the <<end>> creative commons attribution <<any 2>> license"""),
    ("all-rights", """copyright <<any 6>> all rights reserved"""),
)

ANY = None
#: Everything but the words' ASCII characters becomes a blank, A-Z becomes a-z.
_PLAIN = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_PLAIN).split() if text else []


@dataclass(frozen=True)
class Automaton:
    """States 0..n in a row; state n accepts. `step[i]` is the word that leads from i to i + 1 (ANY: every word);
    `skip[i]` holds the states also reached whenever i is."""

    label: str
    step: tuple
    skip: tuple[int, ...]
    mandatory: int

    def starts(self) -> set:
        """Words that can come first."""
        return {self.step[i] for i in _bits(self.skip[0]) if i < len(self.step)}

    def ends(self, words: Sequence[bytes], at: int) -> int | None:
        """One past the last word of the longest match that begins at `at`."""
        n, now, best = len(self.step), self.skip[0], None
        for k in range(at, len(words) + 1):
            if now >> n & 1:
                best = k
            if k == len(words) or not now:
                break
            w, then = words[k], 0
            for i in _bits(now):
                if i < n and (self.step[i] is ANY or self.step[i] == w):
                    then |= self.skip[i + 1]
            now = then
        return best


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template. Raises ValueError for broken markup or wording without a mandatory word."""
    step: list = []
    jumps: list[tuple[int, int]] = []
    opened: list[int] = []
    mandatory = 0
    for piece in re.findall(r"<<[^<>]*>>|[^<>]+", template):
        if not piece.startswith("<<"):
            ws = words_of(piece)
            step += ws
            mandatory += 0 if opened else len(ws)
        elif piece == "<<optional>>":
            opened.append(len(step))
        elif piece == "<<end>>" and opened:
            jumps.append((opened.pop(), len(step)))
        elif m := re.fullmatch(r"<<any (\d+)>>", piece):
            jumps += [(len(step) + i, len(step) + int(m[1])) for i in range(int(m[1]))]
            step += [ANY] * int(m[1])
        else:
            raise ValueError(f"broken markup in the template for {label}: {piece}")
    if opened or not mandatory:
        raise ValueError(f"the template for {label} lacks {'an <<end>>' if opened else 'a mandatory word'}")
    skip = [1 << i for i in range(len(step) + 1)]
    for a, b in sorted(jumps, reverse=True):
        skip[a] |= skip[b]
    return Automaton(label, tuple(step), tuple(skip), mandatory)


def _literal(template: str) -> bytes:
    """The longest mandatory run of words: texts without it need no automaton."""
    depth, run, runs = 0, [], []
    for piece in re.findall(r"<<[^<>]*>>|[^<>]+", template):
        if piece.startswith("<<"):
            runs.append(run)
            run = []
            depth += (piece == "<<optional>>") - (piece == "<<end>>")
        elif not depth:
            run = run + words_of(piece)
    return b" " + b" ".join(max([*runs, run], key=lambda r: sum(map(len, r)))) + b" "


def _places(line: bytes, phrase: bytes) -> list[int]:
    """Word indexes at which the phrase's words stand; `line` and `phrase` have blanks at both ends."""
    out, at, seen, count = [], line.find(phrase), 0, 0
    while at >= 0:
        count += line.count(b" ", seen, at)
        seen = at
        out.append(count)
        at = line.find(phrase, at + 1)
    return out


class Scanner:
    def __init__(self, phrases: Mapping[str, str], templates: Sequence[tuple[str, str]]):
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items()]
        self.templates = [(_literal(t), compiled(label, t)) for label, t in templates]

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        base, named = [], set()
        for phrase, label in self.phrases:
            if found := _places(line, phrase):
                base += found
                named.add(label)
        labels, matches, covered = set(named), [], 0
        for literal, a in self.templates:
            if literal not in line:
                continue
            first = a.starts()
            hit = False
            at = 0
            while at < len(words):
                if (ANY in first or words[at] in first) and (end := a.ends(words, at)) is not None:
                    matches.append((a.label, at, end))
                    hit = True
                    at = max(at + 1, end)
                else:
                    at += 1
            if hit:
                labels.add(a.label)
                covered = max(covered, a.mandatory)
        score = max(min(1.0, covered / 20), 0.5 if base else 0.0)
        return (len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(named)), ",".join(sorted(labels)), score, matches)


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("matches", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def license_scan(docs: DataFrame, text: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """`docs` with n_words, the phrases' places (n_base, first_word, last_word, base_labels), the labels of both kinds,
    the templates' matches as word ranges, and a score: 1 for wording of 20 mandatory words or more, less for shorter
    ones, 0.5 at least where a phrase stands, else 0."""
    Scanner(phrases, templates)  # markup errors show here, not in a task
    held: list[Scanner] = []

    def scan(s: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Scanner(phrases, templates))
        rows = [held[0].scan(x) for x in s]
        out = pd.DataFrame(rows, columns=FOUND.names)
        for c in ("first_word", "last_word"):
            out[c] = out[c].astype("Int64")
        out["matches"] = [[{"label": a, "start": b, "end": c} for a, b, c in m] for m in out["matches"]]
        return out

    found = F.pandas_udf(scan, FOUND)(F.col(text))
    keep = [c for c in docs.columns if c not in FOUND.names]
    return docs.withColumn("_found", found).select(*keep, "_found.*")
