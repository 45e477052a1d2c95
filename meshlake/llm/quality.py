"""Quality rules: a table of thresholds compiled into column expressions, without user functions.

Counting and judging are one chain of projections over the documents: no shuffle, no Python. Words are
`[^\\x20\\x09-\\x0D]+`. A null or empty text has no words and fails the length rule; null languages, sources and
ids change nothing; repeated rows are judged one by one; very long texts are judged whole. Other columns pass
through, and names of the added columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, WORD, blank

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with his they at be this have from or had by"
    " der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden"
    " le la les de et des du un une est en que qui dans pour par sur pas plus avec au"
    " el los las y que en un una por con para es del se no su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """`numerator / denominator` (both count columns; no denominator: 1) must lie in [low, high]."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        """Compared by multiplication, so that a zero denominator needs no case of its own."""
        n = F.col(self.numerator).cast("double")
        d = F.lit(1.0) if self.denominator is None else F.col(self.denominator).cast("double")
        out = F.lit(False)
        if self.low is not None:
            out = out | (n < F.lit(float(self.low)) * d)
        if self.high is not None:
            out = out | (n > F.lit(float(self.high)) * d)
        return out


#: Thresholds in the manner of published heuristic filters (Gopher, C4); ratios are per word or per line.
RULES: tuple[Rule, ...] = (
    Rule("length", "n_words", low=50),
    Rule("word_length", "word_chars", "n_words", low=2, high=14),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.6),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.3),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.5),
)


def _repeat_words(words: Column, grams: Column) -> Column:
    """Words in 3-word windows found twice or more.

    Only texts with a repeated window hash sort their windows; there the words themselves decide, so a hash
    shared by different windows changes nothing.
    """
    def candidates(d: Column) -> Column:
        """Windows worth comparing: those with a repeated hash, or all where the hashes to look for are many."""
        at = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
        kept = F.when(F.size(d) <= few, F.filter(at, lambda x: F.array_contains(d, x["g"]))).otherwise(at)
        return F.transform(kept, lambda x: F.struct(
            x["g"].alias("g"), F.get(words, x["i"]).alias("a"), F.get(words, x["i"] + 1).alias("b"), F.get(words, x["i"] + 2).alias("c"), x["i"].alias("i")))

    few = 12
    repeated = F.transform(F.array(F.sort_array(grams)), lambda s: F.array_distinct(F.filter(s, lambda g, k: (k > 0) & (g == F.get(s, k - 1)))))
    at = F.element_at(F.transform(repeated, candidates), 1)
    ranked = F.array_sort(at)

    def same(x: Column, y: Column) -> Column:
        return (x["g"] == y["g"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def starts(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(s, lambda x, k: ((k > 0) & same(x, F.get(s, k - 1))) | ((k < n - 1) & same(x, F.get(s, k + 1))))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    # the lambda of a one-element array names the sorted windows once
    found = F.element_at(F.transform(F.array(ranked), starts), 1)
    covered = F.element_at(F.transform(F.array(found), lambda p: F.aggregate(
        p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")), lambda acc: acc["n"])), 1)
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), covered).otherwise(F.lit(0)).cast("long")


def counts(docs: DataFrame, text: str = "text", stop_words: Sequence[str] = STOP_WORDS, mark: str | None = None) -> DataFrame:
    """The count columns that rules refer to, beside the columns of `docs`, and a row number if `mark` names it."""
    stops = F.array(*[F.lit(w) for w in dict.fromkeys(stop_words)])
    t = blank(text)
    ends = F.trim(t, F.lit(" \t\n\x0b\f\r"))
    df = docs.withColumns({
        "_words": F.when(ends == "", F.array().cast("array<string>")).otherwise(F.split(ends, f"[{BLANK}]+")),
        "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)),
    })
    words, lines = F.col("_words"), F.col("_lines")
    n = F.size(words)
    hashed = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    df = df.withColumn("_grams", F.slice(hashed, 1, F.greatest(n - 2, F.lit(0))))
    return df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\r]*$"))).cast("long"),
        "n_stop_words": F.size(F.array_intersect(words, stops)).cast("long"),
        "n_repeat_words": _repeat_words(words, F.col("_grams")),
        **({mark: F.monotonically_increasing_id()} if mark else {}),
    }).drop("_words", "_lines", "_grams")


def judged(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`failed_rules` (names, in the table's order) and `passed` for a table that holds the counts."""
    names = F.array(*[F.when(r.failed(), F.lit(r.name)) for r in rules]) if rules else F.array().cast("array<string>")
    df = df.withColumn("failed_rules", F.array_compact(names))
    return df.withColumn("passed", F.size("failed_rules") == 0)


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Every document with its counts, the rules it fails and whether it passes."""
    return judged(counts(docs, text), rules)


def passing(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The documents that pass, with their columns.

    The filter also reads a row number from the projection of the counts. The optimizer moves no filter below one,
    so every count is evaluated once and not again for each use in a condition.
    """
    df = judged(counts(docs, text, mark="_mark"), rules)
    return df.filter(F.col("passed") & (F.col("_mark") >= 0)).select(*docs.columns)
