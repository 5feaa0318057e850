"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression over the whole text, so a scan, one
projection and no shuffle make the verdict. A null or empty text has no words:
all counts are 0 and it fails. Extra columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm.common import WORD, fresh, let, text_or_empty, words_of

SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = tuple(
    "the of and to in is that was for it with as on be at by this are from or "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine auch es "
    "le la les et des en un une du que est pour qui dans pas au sur par aux "
    "el los las y del se con por una su para al lo como más".split()
)


@dataclass(frozen=True)
class Threshold:
    """Keep a document while low <= measure <= high; null bounds are open."""

    rule: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Measures are the columns of ``measures`` and ``RATIOS``.
DEFAULT_THRESHOLDS = (
    Threshold("too_short", "n_words", low=20),
    Threshold("word_length", "mean_word_chars", low=2.0, high=20.0),
    Threshold("symbols", "symbol_ratio", high=0.30),
    Threshold("stop_words", "stop_word_ratio", low=0.02),
    Threshold("repeated_lines", "dup_line_ratio", high=0.40),
    Threshold("repeated_words", "repeat_word_ratio", high=0.30),
)

_WINDOW = 8
_LOW = (1 << 28) - 1  # positions: an array of more words than that can't be a value in Spark, at 8 bytes each and 2 GB a value


def _words_in_repeats(words: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more in the text.

    Windows are hashed; texts without two equal windows end there. For others the
    hashes are sorted. The first sort is of plain longs (36 bits
    of hash, 28 of position); the few that agree there are compared by 64 bits.
    """
    def neighbours(items: Column, key) -> Column:
        same = lambda x, k: F.coalesce(key(x) == key(F.get(items, k)), F.lit(False))
        return F.filter(items, lambda x, k: same(x, k - 1) | same(x, k + 1))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, k: F.least(F.lit(_WINDOW), F.coalesce(F.get(starts, k + 1) - x, F.lit(_WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)

    def exact(windows: Column, suspects: Column) -> Column:
        pairs = F.sort_array(F.transform(suspects, lambda i: F.struct(F.get(windows, i).alias("h"), i.alias("i"))))
        return let(pairs, lambda p: let(
            F.sort_array(F.transform(neighbours(p, lambda x: x["h"]), lambda x: x["i"])), covered))

    def suspects(windows: Column) -> Column:
        packed = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long"))))
        found = let(packed, lambda p: F.transform(
            neighbours(p, lambda x: F.shiftright(x, 28)), lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int")))
        return let(found, lambda s: F.when(F.size(s) == 0, F.lit(0).cast("long")).otherwise(exact(windows, s)))

    def doubled(hashes: Column, step: int, then) -> Column:
        pairs = F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + step)))
        return let(pairs, (lambda h: doubled(h, 2 * step, then)) if 2 * step < _WINDOW else (lambda h: then(h)))

    # hashes of 1, 2, 4, 8 words; the last 7 of them run over the end
    windows = let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: doubled(
        h, 1, lambda all_of: F.slice(all_of, F.lit(1), F.size(words) - (_WINDOW - 1))))
    return F.when(F.size(words) <= _WINDOW, F.lit(0).cast("long")).otherwise(
        let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(suspects(w))))


def _by_words(text: Column) -> Column:
    return let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _words_in_repeats(w).alias("n_repeat_words"),
    ))


def _by_lines(text: Column) -> Column:
    return let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ))


def _by_chars(text: Column) -> Column:
    return F.struct((F.size(F.split(text, SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"))


RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
}
_WORD_COUNTS = ("n_words", "n_stop_words", "word_chars", "n_repeat_words")
_LINE_COUNTS = ("n_lines", "n_dup_lines")
_CHAR_COUNTS = ("n_symbols",)


def quality_rules(docs: DataFrame, text_col: str = "text", thresholds=DEFAULT_THRESHOLDS, prefix: str = "_q_") -> DataFrame:
    """``docs`` with a struct column ``<prefix>quality`` of counts, base_failed, rule and kept.

    The base test (under 20 words, or over 30 percent of words in repeats) comes
    before the table. One struct column under a prefix can't clash with extra
    columns of the input.
    """
    def judge(words: Column, lines: Column, chars: Column) -> Column:
        c = {n: part[n] for part, names in ((words, _WORD_COUNTS), (lines, _LINE_COUNTS), (chars, _CHAR_COUNTS)) for n in names}
        failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
        broken = []
        for t in thresholds:
            part = RATIOS.get(t.measure)
            x = F.when(c[part[1]] > 0, c[part[0]] / c[part[1]]).otherwise(F.lit(0.0)) if part else c[t.measure]
            outside = F.lit(False)
            if t.low is not None:
                outside = outside | (x < F.lit(t.low))
            if t.high is not None:
                outside = outside | (x > F.lit(t.high))
            broken.append(F.when(outside, F.lit(t.rule)))
        rule = F.coalesce(*broken) if broken else F.lit(None).cast("string")
        return F.struct(*[c[n].alias(n) for n in c], failed.alias("base_failed"), rule.alias("rule"),
                        (~failed & rule.isNull()).alias("kept"))

    # lambda-bound, so that no optimizer rule can evaluate a measure once per use
    row = let(text_or_empty(F.col(text_col)), lambda t: let(_by_words(t), lambda w: let(_by_lines(t), lambda x: let(
        _by_chars(t), lambda c: judge(w, x, c)))))
    return docs.withColumn(f"{prefix}quality", row)


def quality_stage(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    prefix, columns = "_q_", docs.columns
    while fresh(columns, f"{prefix}quality") != f"{prefix}quality":
        prefix += "_"
    return quality_rules(docs, prefix=prefix).where(F.col(f"{prefix}quality.kept")).select(*[F.col(f"`{c}`") for c in columns])
