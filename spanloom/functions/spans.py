"""Span algebra on arrays of one record; every fold has a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow, vocab
from .core import cut, empty, let, piece, points
from .text import EDGE_CHARS, WS, is_word_bounded, occurrences, strip, trim_piece, trim_span


def overlaps(a: Column, b: Column) -> Column:
    """Whether two structs with start and end share a character."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def inside(a: Column, b: Column) -> Column:
    return (b["start"] <= a["start"]) & (a["end"] <= b["end"])


def keep_longest(spans: Column, kind: str) -> Column:
    """O1: struct of kept spans and the number dropped.

    In order of start, end and input, a span that begins inside the last kept one
    replaces it only when it is strictly longer; the loser counts as dropped.
    """
    keyed = F.array_sort(F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("i"), x.alias("x"))))
    start = F.struct(empty(f"array<{kind}>").alias("kept"), F.lit(0).alias("dropped"))

    def step(state: Column, item: Column) -> Column:
        x, kept = item["x"], state["kept"]
        last = F.get(kept, F.size(kept) - 1)
        clash = (F.size(kept) > 0) & F.coalesce(x["start"] < last["end"], F.lit(False))
        longer = (x["end"] - x["start"]) > (last["end"] - last["start"])
        head = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.struct(
            F.when(~clash, F.concat(kept, F.array(x))).when(longer, F.concat(head, F.array(x))).otherwise(kept).alias("kept"),
            (state["dropped"] + clash.cast("int")).alias("dropped"),
        )

    return F.aggregate(keyed, start, step)


def suppress(spans: Column, kind: str) -> Column:
    """One span for each (start, end, type), the first of the most confident; then greedy suppression.

    Spans are taken by falling confidence, falling length and rising start when
    they overlap none taken before; the result is sorted by place.
    """
    kin = F.array_sort(F.transform(spans, lambda x, i: F.struct(F.struct(x["start"], x["end"], x["type"]).alias("g"), (-x["confidence"]).alias("a"), i.alias("i"), x.alias("x"))))
    best = let(kin, lambda all_: F.filter(all_, lambda p, j: (j == 0) | ~F.get(all_, j - 1)["g"].eqNullSafe(p["g"])))
    order = F.array_sort(
        F.transform(best, lambda p: F.struct((-p["x"]["confidence"]).alias("a"), (p["x"]["start"] - p["x"]["end"]).alias("b"), p["x"]["start"].alias("c"), p["x"]["type"].alias("t"), p["x"].alias("x")))
    )
    step = lambda kept, o: F.when(F.exists(kept, lambda k: overlaps(k, o["x"])), kept).otherwise(F.concat(kept, F.array(o["x"])))
    taken = F.aggregate(order, empty(f"array<{kind}>"), step)
    placed = F.array_sort(F.transform(taken, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x.alias("x"))))
    return F.transform(placed, lambda p: p["x"])


def covered(starts: Column, length: Column, labelled: Column) -> Column:
    """Of the occurrences, those strictly inside a longer labelled span."""

    def hidden(s: Column) -> Column:
        return F.exists(labelled, lambda x: (x["start"] <= s) & (s + length <= x["end"]) & ((x["end"] - x["start"]) > length))

    return F.filter(starts, hidden)


def clean_entities(text: Column, entities: Column, mask: bool = False) -> Column:
    """struct of clean entities and drop reasons, in the order of the checks.

    Trim, known type, offsets, no line break, first of each (start, end, type), legal
    assertions (cleared where the type takes none), no overlap.
    """

    def judged(e: Column) -> Column:
        fits = (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length(text))
        trimmed = F.when(fits, trim_span(text, e["start"], e["end"]))
        surface = F.coalesce(trimmed["text"], strip(e["text"]))
        start, end = F.coalesce(trimmed["start"], e["start"]), F.coalesce(trimmed["end"], e["end"])
        reason = (
            F.when(~e["type"].isin(list(vocab.TYPES)) | e["type"].isNull(), "bad_type")
            .when(~F.coalesce(fits, F.lit(False)) | trimmed.isNull() | (strip(e["text"]) != surface), "bad_offset")
            .when(surface.contains("\n"), "line_break")
        )
        legal = F.filter(F.coalesce(e["assertions"], empty("array<string>")), lambda a: a.isin(list(vocab.ASSERTIONS)))
        allowed = e["type"].isin(list(vocab.ASSERTION_TYPES))
        marks = F.when(allowed & ~F.lit(mask), F.array_distinct(legal)).otherwise(empty("array<string>"))
        return F.struct(
            vocab.entity(surface, start, end, e["type"], marks, F.coalesce(e["candidates"], empty("array<string>")), F.coalesce(e["supervised"], F.lit(True)) & ~F.lit(mask)).alias("e"),
            reason.alias("reason"),
            (F.size(F.coalesce(e["assertions"], empty("array<string>"))) > F.size(F.when(allowed, legal).otherwise(empty("array<string>")))).alias("repaired"),
        )

    def deduped(items: Column) -> Column:
        same = lambda a, b: (a["e"]["start"] == b["e"]["start"]) & (a["e"]["end"] == b["e"]["end"]) & (a["e"]["type"] == b["e"]["type"])
        numbered = F.transform(items, lambda x, i: x.withField("i", i))
        twice = lambda x: x["reason"].isNull() & F.exists(numbered, lambda y: y["reason"].isNull() & same(x, y) & (y["i"] < x["i"]))
        return F.transform(numbered, lambda x: F.when(twice(x), x.withField("reason", F.lit("duplicate"))).otherwise(x))

    def resolved(items: Column) -> Column:
        good = F.transform(F.filter(items, lambda x: x["reason"].isNull()), lambda x: x["e"])

        def both(k: Column) -> Column:
            reasons = F.transform(F.filter(items, lambda x: x["reason"].isNotNull()), lambda x: x["reason"])
            fixed = F.transform(F.filter(items, lambda x: x["reason"].isNull() & x["repaired"]), lambda x: F.lit("assertion_repaired"))
            return F.struct(k["kept"].alias("entities"), F.concat(reasons, fixed, F.array_repeat(F.lit("overlap"), k["dropped"])).alias("reasons"))

        return let(keep_longest(good, vocab.ENTITY), both)

    return let(let(F.transform(entities, judged), deduped), resolved)


def lint_tags(text: Column, e: Column, starts: Column, ends: Column) -> Column:
    """V1: tags of one entity: offsets, surface, type, assertions, line breaks, token edges."""
    fits = F.coalesce((e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length(text)), F.lit(False))
    surface = piece(text, e["start"], e["end"])
    rows = [
        (~fits, "offset", "bad_position"),
        (fits & (strip(surface) == ""), "offset", "empty_span"),
        (fits & (surface != e["text"]), "offset", "text_mismatch"),
        (~e["type"].isin(list(vocab.TYPES)), "schema", "bad_type"),
        (F.size(F.array_except(e["assertions"], F.array(*[F.lit(a) for a in vocab.ASSERTIONS]))) > 0, "schema", "bad_assertion"),
        ((F.size(e["assertions"]) > 0) & ~e["type"].isin(list(vocab.ASSERTION_TYPES)), "schema", "assertion_on_forbidden_type"),
        (fits & surface.contains("\n"), "span", "line_break"),
        (fits & ~(F.array_contains(starts, e["start"]) & F.array_contains(ends, e["end"])), "span", "token_misaligned"),
    ]
    made = [F.when(cond, F.struct(F.lit(group).alias("grp"), F.lit(tag).alias("tag"))) for cond, group, tag in rows]
    return F.array_compact(F.array(*made))


def bio_spans(labels: Column, mode: str = "strict") -> Column:
    """Spans (first, last, type) of a sequence of BIO labels.

    strict: any label but ``O`` opens a span unless it is an ``I-`` of the type before
    it. lenient: ``B-`` opens, an ``I-`` of another type or after ``O`` opens as
    well, ``O``, ``0`` and unknown prefixes close.
    """
    return arrow.bio_spans(labels, mode)


def span_confidence(probs: Column, first: Column, last: Column) -> Column:
    """Mean probability of a span's tokens."""
    own = F.slice(probs, first + 1, last - first + 1)
    return F.aggregate(own, F.lit(0.0), lambda s, p: s + p, lambda s: s / F.size(own))


def any_flag(flags: Column, first: Column, last: Column, threshold: float = 0.5) -> Column:
    """Whether any token of a span reaches the threshold."""
    return F.exists(F.slice(flags, first + 1, last - first + 1), lambda p: p >= threshold)


def arbitrate(bio_type: Column, bio_conf: Column, head_type: Column, head_conf: Column, abstain: float = 0.60, disagree: float = 0.85) -> Column:
    """Struct (type, confidence) from the tagger and the span head, null if they drop the span."""
    none = head_type.isNull() & (head_conf >= abstain)
    agree = head_type.isNull() | (head_type == bio_type)
    mean = F.when(head_type.isNull(), bio_conf).otherwise((bio_conf + head_conf) / 2)
    best = F.greatest(bio_conf, head_conf)
    winner = F.when(bio_conf >= head_conf, bio_type).otherwise(head_type)
    made = lambda t, c: F.struct(t.alias("type"), c.alias("confidence"))
    return F.when(none, F.lit(None)).when(agree, made(bio_type, mean)).when(best >= disagree, made(winner, best))


def negative_spans(n_tokens: Column, positive: Column, seed: Column, longest: int = 5, ratio: float = 2.0) -> Column:
    """Token spans (first, last) that touch no positive one: max(2, ceil(ratio * positives)), drawn by hash."""
    return arrow.negative_spans(n_tokens, positive, seed, longest, ratio)


def surface_safe(surface: Column) -> Column:
    """long enough, not only a number, and free of unsafe prefixes and phrases."""
    low = F.lower(strip(surface))
    number = low.rlike(r"\A[\p{N}\s.,/%-]+\z")
    phrase = F.lit(False)
    for p in vocab.listed(vocab.UNSAFE_PHRASES):
        phrase |= low.contains(p)
    for p in vocab.listed(vocab.AMBIGUOUS_PREFIXES):
        phrase |= low.startswith(p)
    return (F.length(low) >= 2) & ~number & ~phrase


def surface_conflicts(surface: Column, existing: Column) -> Column:
    """equal to another surface, or one word-bounded inside the other."""
    low = F.lower(surface)
    within = lambda big, small: F.size(occurrences(big, small)) > 0
    return F.exists(existing, lambda x: (F.lower(x) == low) | within(F.lower(x), low) | within(low, F.lower(x)))


def high_precision(surface: Column, kind: Column) -> Column:
    """not a general noun, no ambiguous prefix, and two words or a type other than the symptom."""
    low = F.lower(strip(surface))
    vague = F.lit(False)
    for p in vocab.listed(vocab.AMBIGUOUS_PREFIXES):
        vague |= low.startswith(p)
    return ~low.isin(vocab.listed(vocab.META_NOUNS)) & ~vague & ((F.size(F.split(low, rf"[{WS}]+", -1)) >= 2) | (kind != vocab.SYMPTOM))


def lexicon_hits(text: Column, terms: Column, most: int = 12) -> Column:
    """Word-bounded terms of a lexicon, longest first, each outside what is taken; at most ``most``.

    terms: array of strings, sorted by falling length and then text.
    """
    return arrow.lexicon_hits(text, terms, most)


def strip_spans(text: Column, spans: Column) -> Column:
    """Spans without punctuation and blanks at their edges; those with nothing left go."""
    return let(points(text), lambda p: strip_in(p, spans))


def strip_in(made: Column, spans: Column) -> Column:
    """``strip_spans`` in the ``points`` of a text."""
    bare = F.transform(spans, lambda x: F.struct(trim_piece(cut(made, x["start"], x["end"]), x["start"], EDGE_CHARS).alias("t"), x["type"].alias("type")))
    kept = F.filter(bare, lambda m: m["t"].isNotNull())
    return F.transform(kept, lambda m: F.struct(m["t"]["text"].alias("text"), m["t"]["start"].alias("start"), m["t"]["end"].alias("end"), m["type"].alias("type")))


def drop_blocked(spans: Column, blocked: Sequence[str] = vocab.BLOCKED_SURFACES) -> Column:
    """spans whose folded, stripped text is not on the block list."""
    return F.filter(spans, lambda x: ~F.lower(strip(x["text"])).isin(list(blocked)))


def word_bounded_spans(text: Column, spans: Column) -> Column:
    """T7 for arrays: spans whose edges cut no word."""
    return F.filter(spans, lambda x: is_word_bounded(text, x["start"], x["end"]))
