"""Text scalars: exact offsets, occurrences, sentences, headings, layout.

Offsets count code points of the raw text, are 0-based and half-open. A word
character is a letter, a number or the underscore; combining marks are none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow
from .core import cut, empty, let, piece, quote, regex_spans, running_sums

W = r"\p{L}\p{N}_"
WS = r"\p{IsWhite_Space}\x1c-\x1f"
TOKENS = arrow.TOKENS


def tokens(text: Column) -> Column:
    """Words and single signs of the raw text with offsets; no shuffle, the text stays in its row."""
    return arrow.tokens(text)


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no such function; plain ASCII rows stay as they are."""
    compose = F.pandas_udf(lambda s: s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x)), "string")
    return F.when(text.rlike(r"[^\x00-\x7F]"), compose(text)).otherwise(text)


def nfc_tokens(text: Column) -> Column:
    """Tokens of the composed text."""
    return tokens(nfc(text))


def token_bounds(toks: Column) -> Column:
    """T4: the sets of token starts and ends."""
    return F.struct(F.transform(toks, lambda t: t["s"]).alias("starts"), F.transform(toks, lambda t: t["e"]).alias("ends"))


def shingles(text: Column, size: int = 12) -> Column:
    """T5: distinct runs of ``size`` lower-case white-space words, none if there are fewer words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"[^{WS}]+"), F.lit(0))

    def grams(w: Column) -> Column:
        run = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)])
        return F.when(F.size(w) >= size, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - size), run))).otherwise(empty("array<string>"))

    return let(words, grams)


def is_word_bounded(text: Column, s: Column, e: Column) -> Column:
    """Neither edge cuts through a run of word characters."""
    word = lambda at: F.substr(text, at + 1, F.lit(1)).rlike(f"[{W}]")
    left = (s > 0) & word(s - 1) & word(s)
    right = word(e - 1) & word(e)
    return ~left & ~right


def cuts_no_word(made: Column, s: Column, e: Column) -> Column:
    """``is_word_bounded`` of a span that is not empty, in the ``points`` of a text."""
    inside = lambda at: cut(made, at - 1, at + 1).rlike(rf"\A[{W}]{{2}}\z")
    return ~((s > 0) & inside(s)) & ~inside(e)


def occurrences(text: Column, surface: Column) -> Column:
    """Word-bounded starts of a literal; the search goes on behind every hit, also a rejected one."""
    hits = regex_spans(text, quote(surface))
    kept = F.filter(hits, lambda h: is_word_bounded(text, h["s"], h["e"]))
    return F.when(F.length(surface) > 0, F.transform(kept, lambda h: h["s"])).otherwise(empty("array<int>"))


def nth_occurrence(text: Column, surface: Column, index: Column) -> Column:
    """Start of the n-th (from 0) occurrence, null where there is none."""
    return F.get(occurrences(text, surface), index)


def sentence_breaks(text: Column) -> Column:
    """Where sentences end: behind ``[.!?…]`` with white space, and behind a line."""
    return F.transform(regex_spans(text, rf"[.!?…][{WS}]|\n"), lambda h: h["e"])


def sentence_index(breaks: Column, at: Column) -> Column:
    """Number of the sentence that holds an offset."""
    return F.size(F.filter(breaks, lambda x: x <= at))


def marked_context(text: Column, s: Column, e: Column, pad: int = 25) -> Column:
    """The span in ⟦⟧ between up to ``pad`` characters of context, lines joined by ⏎."""
    from_ = F.greatest(F.lit(0), s - pad)
    return F.translate(F.concat(piece(text, from_, s), F.lit("⟦"), piece(text, s, e), F.lit("⟧"), piece(text, e, e + pad)), "\n", "⏎")


def context(text: Column, s: Column, e: Column, chars: int = 400) -> Column:
    """Before, surface, after and where the window starts."""
    from_ = F.greatest(F.lit(0), s - chars)
    return F.struct(piece(text, from_, s).alias("before"), piece(text, s, e).alias("surface"), piece(text, e, e + chars).alias("after"), from_.alias("window_start"))


# A heading line is a short name with a colon at its end, or a line without lower-case letters.
HEADING = r"(?m)^[ \t]*(?:[^\n:]{3,45}:[ \t]*|[A-ZĐÀ-ỸÁÂĂÊÔƠƯ][^\na-zà-ỹáâăêôơư]{3,45})$"


def headings(text: Column) -> Column:
    """Heading lines with their offsets; only ``\\n`` ends a line."""
    return regex_spans(text, "(?d)" + HEADING)


def nearest_heading(found: Column, at: Column) -> Column:
    """The last heading that ends at or before an offset, without blanks and colon."""
    last = F.element_at(F.filter(found, lambda h: h["e"] <= at), -1)
    return F.when(F.exists(found, lambda h: h["e"] <= at), F.rtrim(F.btrim(last["hit"]), F.lit(": ")))


# Everything that ends a line for ``nearest_header``, and what opens a section or looks like a title.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
HEADER = rf"\A[{WS}]*(?:\p{{Nd}}+[{WS}]*[.)]|[A-ZÀ-Ỹ][^.!?]{{0,80}}:?[{WS}]*\z)"


def header_lines(text: Column) -> Column:
    """Struct of where lines begin and of the whole lines (end, line) that open a section or look like a title."""

    def cut(breaks: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(breaks, lambda b: b["e"]))

        def lines(at: Column) -> Column:
            made = F.transform(breaks, lambda b, i: F.struct(b["s"].alias("end"), piece(text, F.get(at, i), b["s"]).alias("line")))
            return F.struct(at.alias("begins"), F.filter(made, lambda x: x["line"].rlike(HEADER)).alias("titles"))

        return let(begins, lines)

    return let(regex_spans(text, LINE_BREAK), cut)


def nearest_header(text: Column, at: Column, lines: Column | None = None) -> Column:
    """The last line, cut at the offset, that opens a section or looks like a title; stripped.

    ``lines`` is ``header_lines`` of the text, for callers that ask for many offsets of one text.
    """
    if lines is None:
        return let(header_lines(text), lambda x: nearest_header(text, at, x))

    def found(own: Column) -> Column:
        before = F.filter(lines["titles"], lambda x: x["end"] < at)
        return F.when(own.rlike(HEADER), strip(own)).otherwise(strip(F.try_element_at(before, F.lit(-1))["line"]))

    return let(piece(text, F.array_max(F.filter(lines["begins"], lambda b: b <= at)), at), found)


def strip(text: Column, chars: str = WS) -> Column:
    return F.regexp_replace(text, rf"\A[{chars}]+|[{chars}]+\z", "")


#: Runs of this many characters without white space are cut to that many.
RUN, RUN_KEPT = 100, 30


def collapse_runs(text: Column) -> Column:
    """Every run of ``RUN`` or more characters without white space becomes its first ``RUN_KEPT``."""
    return F.regexp_replace(text, rf"([^{WS}]{{{RUN_KEPT}}})[^{WS}]{{{RUN - RUN_KEPT},}}+", "$1")


def collapse_plan(text: Column, spans: Column) -> Column:
    """Runs that may be cut, that is, runs that touch no span (struct with start and end)."""
    runs = regex_spans(text, rf"[^{WS}]{{{RUN},}}+")
    return F.filter(runs, lambda r: ~F.exists(spans, lambda x: (x["start"] < r["e"]) & (r["s"] < x["end"])))


def collapse_text(text: Column, runs: Column) -> Column:
    """The text without the tails of the planned runs."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, r: F.struct(F.concat(a["out"], piece(text, a["at"], r["s"] + RUN_KEPT)).alias("out"), r["e"].alias("at"))
    return F.aggregate(runs, start, step, lambda a: F.concat(a["out"], piece(text, a["at"], F.length(text))))


def collapse_shift(runs: Column, at: Column) -> Column:
    """An offset after the cuts."""
    return at - F.aggregate(runs, F.lit(0), lambda total, r: total + F.when(r["e"] <= at, r["e"] - r["s"] - RUN_KEPT).otherwise(F.lit(0)))


MARK = r"(?s)<E\s+id=\"([^\"]{1,64})\"\s*>(.*?)</E>"
MARK_LEFT = r"</?E\b|<E|</E>"


def strip_marks(marked: Column) -> Column:
    """The text without ``<E id="…">`` marks."""
    return F.regexp_replace(marked, MARK, "$2")


def parse_marks(marked: Column) -> Column:
    """Struct of raw text, marks (id, text, s, e) in the raw text, and errors."""

    def parsed(spans: Column) -> Column:
        ids = F.transform(spans, lambda h: F.regexp_extract(h["hit"], MARK, 1))
        inner = F.transform(spans, lambda h: F.regexp_extract(h["hit"], MARK, 2))

        def marks(x: Column) -> Column:
            extra = F.transform(x["inner"], lambda t, i: F.length(F.get(spans, i)["hit"]) - F.length(t))

            def placed(before: Column) -> Column:
                one = lambda t, i: F.struct(
                    F.get(x["ids"], i).alias("id"),
                    t.alias("text"),
                    (F.get(spans, i)["s"] - F.get(before, i)).alias("s"),
                    (F.get(spans, i)["s"] - F.get(before, i) + F.length(t)).alias("e"),
                )
                return F.transform(x["inner"], one)

            return let(let(extra, running_sums), placed)

        return let(F.struct(ids.alias("ids"), inner.alias("inner")), marks)

    raw = strip_marks(marked)
    found = let(regex_spans(marked, MARK), parsed)

    def checked(x: Column) -> Column:
        padded = F.transform(F.filter(x["marks"], lambda m: (m["text"] != strip(m["text"])) | (m["text"] == "")), lambda m: F.concat(F.lit("outer_whitespace:"), m["id"]))
        left = F.when(x["raw"].rlike(MARK_LEFT), F.array(F.lit("leftover_mark"))).otherwise(empty("array<string>"))
        return F.struct(x["raw"].alias("raw"), x["marks"].alias("marks"), F.concat(padded, left).alias("errors"))

    return let(F.struct(raw.alias("raw"), found.alias("marks")), checked)


def natural_heading(value: Column) -> Column:
    """Without blanks and final colons; capitals only become sentence case."""
    bare = strip(F.regexp_replace(strip(value), r":+\z", ""))
    shout = (F.upper(bare) == bare) & bare.rlike(r"\p{L}")
    sentence = F.concat(F.upper(F.substring(bare, 1, 1)), F.lower(F.substr(bare, F.lit(2), F.length(bare))))
    return F.when(shout, sentence).otherwise(bare)


def genre(text: Column) -> Column:
    """MIXED, ADVICE, RECORD or OTHER by question-and-answer words and numbered clinical sections."""
    asked = text.rlike("(?iu)Câu hỏi từ người dùng|Câu trả lời của bác sĩ")
    record = text.rlike(rf"(?m)^[{WS}]*\p{{Nd}}+[{WS}]*[.)][{WS}]*(?:Tiền sử|Bệnh sử|Lịch sử|Đánh giá|Khám)")
    return F.when(asked & record, "MIXED").when(asked, "ADVICE").when(record, "RECORD").otherwise("OTHER")


#: Signs that a span's edges lose.
EDGE_CHARS = r" \t\r\n,:;.·•()\[\]\"'…\-–—"


def trim_span(text: Column, s: Column, e: Column, chars: str = WS) -> Column:
    """Struct (text, start, end) of the span without the given characters at its edges, null if nothing is left."""
    return trim_piece(piece(text, s, e), s, chars)


def trim_piece(own: Column, s: Column, chars: str = WS) -> Column:
    """``trim_span`` of a span's own text and its start."""

    def made(x: Column) -> Column:
        start = s + F.length(x["lead"])
        return F.when(F.length(x["bare"]) > 0, F.struct(x["bare"].alias("text"), start.alias("start"), (start + F.length(x["bare"])).alias("end")))

    # bound, as the place of a piece is counted from the start of the text each time
    return let(own, lambda x: let(F.struct(F.regexp_extract(x, rf"\A[{chars}]*", 0).alias("lead"), strip(x, chars).alias("bare")), made))


LEADING_NEGATION = r"(?iu)\A\s*(?:không|chưa|phủ nhận|ko)\s+(?=\S)"


def leading_negation(surface: Column) -> Column:
    """The negation, with its blanks, that a surface starts with; "" if none."""
    return F.regexp_extract(surface, LEADING_NEGATION, 0)


MEASUREMENT = (
    rf"(?iu)(?<![{W}])\p{{Nd}}+(?:[.,]\p{{Nd}}+)?[{WS}]*"
    rf"(?:%|°[{WS}]*c|độ[{WS}]*c|mg|g|kg|ml|l|mmhg|mmol/l|µmol/l|u/l|l/phút|l/p)(?![{W}])"
)


def measurements(text: Column) -> Column:
    """Numbers with a unit that are not part of a word."""
    return regex_spans(text, MEASUREMENT)


def align_words(text: Column, words: Column) -> Column:
    """Words (word, s, e) found from left to right; else from the start; else placed at the cursor."""

    def step(state: Column, w: Column) -> Column:
        ahead, anywhere = _locate(w, text, state["at"] + 1), _locate(w, text, F.lit(1))
        s = F.when(ahead > 0, ahead - 1).when(anywhere > 0, anywhere - 1).otherwise(state["at"])
        item = F.struct(w.alias("word"), s.cast("int").alias("s"), (s + F.length(w)).cast("int").alias("e"))
        return F.struct((s + F.length(w)).cast("int").alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty("array<struct<word:string,s:int,e:int>>").alias("out"))
    return F.aggregate(words, start, step, lambda x: x["out"])


def _locate(word: Column, text: Column, at: Column) -> Column:
    return F.call_function("locate", word, text, at)


def segment(text: Column, segmenter: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """Words by a pluggable segmenter (a series of texts to a series of word lists); white space by default."""
    if segmenter is None:
        return F.regexp_extract_all(text, F.lit(rf"[^{WS}]+"), F.lit(0))
    return F.pandas_udf(segmenter, "array<string>")(text)


def word_count(surface: Column, most: int = 15) -> Column:
    """White-space words of a surface, at most ``most``."""
    return F.least(F.regexp_count(surface, F.lit(rf"[^{WS}]+")), F.lit(most))


def folded(text: Column) -> Column:
    """Lower case; differs from full case folding on a few hundred rare code points."""
    return F.lower(text)


#: Layout limits of a text of at least LAYOUT_FROM characters.
MIN_LINES, MIN_SHORT, MAX_SHORT, LAYOUT_FROM, SHORT_LINE = 18, 0.35, 0.66, 600, 40


def layout(text: Column) -> Column:
    """Struct of lines, short_lines, short_ratio and required lines."""

    def measured(lines: Column) -> Column:
        short = F.size(F.filter(lines, lambda x: F.length(x) <= SHORT_LINE))
        required = F.least(F.lit(MIN_LINES), F.greatest(F.lit(3), F.floor(F.length(text) / 90).cast("int")))
        return F.struct(
            F.size(lines).alias("lines"),
            short.alias("short_lines"),
            F.when(F.size(lines) > 0, short / F.size(lines)).otherwise(F.lit(0.0)).alias("short_ratio"),
            required.alias("required"),
        )

    return let(F.filter(F.transform(F.split(text, "\n", -1), lambda x: strip(x)), lambda x: x != ""), measured)


def has_table(text: Column) -> Column:
    """Rows of pipes or a rule of dashes."""
    return text.rlike(r"(?m)^\s*\|.*\|.*\|\s*$") | text.rlike(r"(?m)^\s*\|?\s*:?-{3,}")
