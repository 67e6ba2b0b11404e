"""Cues around a span: what supports an assertion and what speaks against its absence.

Every set of cues is one alternation, so a text is matched once for each assertion.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .core import empty, let, piece, quote, regex_spans
from .text import folded, occurrences, strip

SUPPORT_BEFORE, SUPPORT_AFTER, CONFLICT_BEFORE, CONFLICT_GAP = 220, 26, 30, 18
#: What may not stand beside a cue.
EDGE = "[0-9a-zà-ỹ]"


def alternation(cues: Sequence[str]) -> str:
    return "|".join(re.escape(c).replace(r"\ ", " ") for c in vocab.listed(cues))


def clause_before(text: Column, at: Column, window: int, hard: bool) -> Column:
    """The folded text before an offset, from the last sentence (hard: also clause) separator on."""
    ends = r"\. |\n|! |\? " + ("|; |, |: " if hard else "")
    return F.regexp_replace(folded(piece(text, F.greatest(F.lit(0), at - window), at)), rf"(?s)\A.*(?:{ends})", "")


def cue_hit(chunk: Column, cues: Sequence[str], gap: int | None = None) -> Column:
    """A cue that is no part of a word, at most ``gap`` characters before the chunk's end."""
    tail = rf".{{0,{gap}}}\z" if gap is not None else ""
    return chunk.rlike(rf"(?s)(?<!{EDGE})(?:{alternation(cues)})(?!{EDGE}){tail}")


def support(text: Column, s: Column, e: Column, cues: Mapping[str, Sequence[str]] = vocab.SUPPORT_CUES) -> Column:
    """Assertions with a cue in the sentence before the span, or a negation just behind it."""
    before = clause_before(text, s, SUPPORT_BEFORE, hard=False)
    after = F.regexp_extract(folded(piece(text, e, e + SUPPORT_AFTER)), r"(?s)\A[^.!?\n]*", 0)

    def found(x: Column) -> Column:
        dated = x["before"].rlike(r"(?<![\p{L}\p{N}_])(?:19|20)\p{Nd}{2}(?![\p{L}\p{N}_])") | x["before"].contains(vocab.YEAR_WORD)
        out = []
        for name, listed in cues.items():
            hit = cue_hit(x["before"], listed)
            if name == "isNegated":
                hit |= cue_hit(x["after"], vocab.NEGATION_AFTER)
            if name == "isHistorical":
                hit |= dated
            out.append(F.when(hit, F.lit(name)))
        return F.array_compact(F.array(*out))

    return let(F.struct(before.alias("before"), after.alias("after")), found)


def conflict(text: Column, s: Column, cues: Mapping[str, Sequence[str]] = vocab.CONFLICT_CUES) -> Column:
    """C4: assertions whose cue stands in the clause right before the span.

    One cue also counts quantities; followed by such a word it is none.
    """

    def found(chunk: Column) -> Column:
        word = F.regexp_extract(chunk, rf"(?s)\A.*{vocab.QUANTITY_CUE}\s*([^ ]*)", 1)
        out = []
        for name, listed in cues.items():
            plain = [c for c in vocab.listed(listed) if c != vocab.QUANTITY_CUE]
            hit = cue_hit(chunk, plain, CONFLICT_GAP)
            if vocab.QUANTITY_CUE in vocab.listed(listed):
                hit |= cue_hit(chunk, [vocab.QUANTITY_CUE], CONFLICT_GAP) & ~word.isin(vocab.listed(vocab.QUANTITY_WORDS))
            out.append(F.when(hit, F.lit(name)))
        return F.array_compact(F.array(*out))

    return let(clause_before(text, s, CONFLICT_BEFORE, hard=True), found)


def cue_errors(text: Column, s: Column, e: Column, kind: Column, assertions: Column) -> Column:
    """Assertions without a cue, and cues without their assertion."""
    missing = F.transform(F.array_except(assertions, support(text, s, e)), lambda a: F.concat(F.lit("no_cue:"), a))
    ignored = F.when(kind == vocab.DRUG, F.array(F.lit("isHistorical"))).otherwise(empty("array<string>"))
    extra = F.transform(F.array_except(F.array_except(conflict(text, s), assertions), ignored), lambda a: F.concat(F.lit("no_assertion:"), a))
    return F.concat(missing, extra)


def repaired(text: Column, s: Column, e: Column, kind: Column, assertions: Column) -> Column:
    """Supported assertions stay, contradicted absences are filled, in that order.

    A drug never gains the historical assertion, and the family assertion keeps it out.
    """
    kept = F.array_intersect(assertions, support(text, s, e))
    gained = F.array_sort(F.array_except(conflict(text, s), kept))
    barred = (kind == vocab.DRUG) | F.array_contains(kept, "isFamily")
    gained = F.filter(gained, lambda a: ~((a == "isHistorical") & barred))
    return F.when(kind.isin(list(vocab.ASSERTION_TYPES)), F.array_union(kept, gained)).otherwise(empty("array<string>"))


def evidence_supports(text: Column, surface: Column, s: Column, evidence: Column) -> Column:
    """The quoted evidence, whole or one of its fragments, covers this occurrence.

    Fragments are parted by ellipses and semicolons. The bare surface proves nothing
    where the text has it more than once.
    """
    end = s + F.length(surface)
    fragments = F.array_union(F.array(strip(evidence)), F.split(strip(evidence), r"\s*(?:\.\.\.|…|;)\s*", -1))
    several = F.size(occurrences(text, surface)) > 1
    useful = F.filter(fragments, lambda f: (f != "") & f.contains(surface) & ~((f == surface) & several))
    covers = lambda f: F.exists(regex_spans(text, quote(f)), lambda h: (h["s"] <= s) & (end <= h["e"]))
    return F.exists(useful, covers)


def discourse_bias(case_id: Column, *fields: Column) -> Column:
    """The assertion that a document's kind leans to; family before historical, else null."""
    whole = folded(F.concat_ws(" ", case_id, *fields))
    family = case_id.startswith("assertion.family") | whole.rlike("gia đình|family_history")
    past = case_id.startswith("assertion.historical") | whole.rlike("tiền sử|past_medical_history|bệnh sử|hồ sơ cũ")
    return F.when(family, "isFamily").when(past, "isHistorical")
