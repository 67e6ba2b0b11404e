"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression of the text column, so a text never leaves
its row and the JVM; the rules are rows of ``RULES`` and become one boolean
expression. Changing a threshold or adding a rule changes the table, not code.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, quoted

#: Java's and RE2's common spelling of the word separators.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du elle en est et la le les par pas pour que qui sur un une "
    "auf aus bei das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "al como con del el es esta las lo los más no para por que se su una y"
).split()


class Rule(NamedTuple):
    """A row of the threshold table: a text fails when its measure is outside [low, high]."""

    name: str
    measure: str
    low: float | None
    high: float | None


RULES = (
    Rule("too_short", "n_words", 20, None),
    Rule("word_length", "mean_word_chars", 1.5, 15.0),
    Rule("symbols", "symbol_word_ratio", None, 0.30),
    Rule("stop_words", "stop_word_ratio", 0.04, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.50),
    Rule("repeated_words", "repeat_word_ratio", None, 0.30),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def repeated_words(words: Column, n: Column, size: int) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in the array.

    Window hashes grow by doubling (size must be a power of two) from 64-bit word
    hashes. If all are distinct, nothing repeats. Otherwise (hash, place) pairs are
    sorted; a place whose hash also stands beside it in that order is marked, and
    the marked places in text order tell how many words they cover.
    """

    def hashes(level: Column, width: int) -> Column:
        if width == size:
            return counted(level)
        longer = F.transform(
            F.sequence(F.lit(0), F.size(level) - width - 1),
            lambda i: F.xxhash64(F.get(level, i), F.get(level, i + width)),
        )
        return let(longer, lambda x: hashes(x, 2 * width))

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), marked)
        )

    def marked(pairs: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            beside = lambda j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
            return beside(k + 1) | beside(k - 1)

        places = F.sort_array(F.transform(F.filter(pairs, twin), lambda x: x["i"]))
        return let(places, covered)

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(size)), F.lit(size)))
        return F.aggregate(gaps, F.lit(0), lambda total, g: total + g)

    return F.when(n < size, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: hashes(h, 1)))


def measures(text: Column, window: int = 8) -> Column:
    """A struct of the raw counts of one text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def from_words(words: Column) -> Column:
        n = F.size(words)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words, n, window).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    return let(words_of(text), from_words)


def ratios(m: Column) -> dict[str, Column]:
    """The measures that rules may name; a ratio of an empty text is null and fails no rule."""
    n = F.nullif(m["n_words"], F.lit(0))
    return {
        "n_words": m["n_words"],
        "mean_word_chars": m["word_chars"] / n,
        "symbol_word_ratio": m["n_symbols"] / n,
        # a few dozen words may hold no function word by chance: no verdict on them
        "stop_word_ratio": F.when(m["n_words"] >= 50, m["n_stop_words"] / n),
        "dup_line_ratio": m["n_dup_lines"] / F.nullif(m["n_lines"], F.lit(0)),
        "repeat_word_ratio": m["n_repeat_words"] / n,
    }


def failures(m: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Names of the rules that a text fails, in the table's order."""
    value = ratios(m)

    def outside(rule: Rule) -> Column:
        low = value[rule.measure] < rule.low if rule.low is not None else F.lit(False)
        high = value[rule.measure] > rule.high if rule.high is not None else F.lit(False)
        return F.coalesce(low | high, F.lit(False))

    return F.array_compact(F.array(*[F.when(outside(r), F.lit(r.name)) for r in rules]))


def assess(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", out: str = "quality") -> DataFrame:
    """Append a struct of the counts of each text and ``failed``, the rules it fails.

    A null or empty text has zero counts and fails ``too_short`` only. Rows are
    independent of each other; repeated rows give repeated results and an empty
    table an empty one. A very long text is measured whole. A column that already has the name ``out`` is replaced.
    """
    kept = [F.col(quoted(c)) for c in docs.columns if c != out]
    found = docs.select(*kept, measures(F.col(quoted(text))).alias("m" if "m" not in docs.columns else "m__spanloom"))
    m = F.col(found.columns[-1])
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")
    packed = F.struct(*[m[f].alias(f) for f in fields], failures(m, rules).alias("failed"))
    return found.select(*[F.col(quoted(c)) for c in docs.columns if c != out], packed.alias(out))
