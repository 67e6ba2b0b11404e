"""Windows over token sequences, training rows and token-span alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.arrow import line_tokens, training_windows
from ..functions.core import empty, let, piece
from ..functions.text import TOKENS, WS, header_lines, nearest_header, tokens

SIZE, OVERLAP, CONTEXT, LINE_SIZE = 180, 45, 32, 110
#: Words that the chunk packer folds at a time.
PACKED = 4096
HEADER_LINE = rf"\A[{WS}]*\p{{Nd}}+[{WS}]*[.)]"
SENTENCE_ENDS, SOFT_ENDS = (".", "!", "?", ";", "…"), (",", ":", "-", "–", "—")


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """First tokens of windows that advance by size - overlap and end with the first to reach the end."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * step)).otherwise(empty("array<int>"))


def sliding_windows(notes: DataFrame, size: int = SIZE, overlap: int = OVERLAP, context: int = CONTEXT, header: bool = True, id: str = "id", text: str = "text", bare: bool = False) -> DataFrame:
    """Id, w, word_start, char_start, char_end, prefix, content for every window.

    prefix: the ``context`` tokens before the window; with ``header`` the tokens of
    the nearest header line come first unless they stand in the prefix or window
    already. ``bare`` adds the prefix without header. Texts without tokens have no window.
    """
    rows = _window_rows(notes.withColumnsRenamed({id: "id", text: "text"}) if (id, text) != ("id", "text") else notes, size, overlap, context, header)
    return rows.select("id", "w", "word_start", "char_start", "char_end", "prefix", "content", *(["bare"] if bare else []))


def _window_rows(notes: DataFrame, size: int, overlap: int, context: int, header: bool) -> DataFrame:
    """``sliding_windows`` of (id, text) with ``bare``.

    Windows are cut in the row of their note: texts and tokens of the whole note are not repeated for each.
    """
    rows = notes.select("id", "text", tokens(F.coalesce(F.col("text"), F.lit(""))).alias("toks"))
    rows = rows.withColumn("lines", header_lines(F.col("text")) if header else F.lit(None))

    def window(start: Column) -> Column:
        from_ = F.greatest(F.lit(0), start - context)
        own = F.struct(start.alias("word_start"), F.slice("toks", from_ + 1, start - from_).alias("prefix"), F.slice("toks", start + 1, F.lit(size)).alias("content"))

        def placed(x: Column) -> Column:
            s, e = x["content"][0]["s"], F.element_at(x["content"], -1)["e"]
            more = [nearest_header(F.col("text"), s, F.col("lines")).alias("line")] if header else []
            return F.struct(*[x[c].alias(c) for c in ("word_start", "prefix", "content")], s.alias("char_start"), e.alias("char_end"), *more)

        return let(own, placed)

    # explode alone would have its input made once more, to filter out notes without windows
    made = F.posexplode_outer(F.transform(window_starts(F.size("toks"), size, overlap), window)).alias("w", "x")
    rows = rows.select("id", made).filter("w IS NOT NULL").select("id", "w", "x.*").withColumn("bare", F.col("prefix"))
    if not header:
        return rows
    words = lambda c: F.transform(c, lambda t: t["tok"])

    def shown(head: Column) -> Column:
        k = F.size(head)
        seen = F.concat(words(F.col("prefix")), words(F.col("content")))
        visible = let(
            F.struct(seen.alias("seen"), words(head).alias("head")),
            lambda x: (k > 0) & F.exists(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(x["seen"]) - k)), lambda i: F.slice(x["seen"], i + 1, k) == x["head"]),
        )
        return F.when((k == 0) | visible, F.col("prefix")).otherwise(F.concat(head, F.col("prefix")))

    rows = rows.withColumn("head", F.coalesce(tokens(F.col("line")), empty(TOKENS)))
    return rows.withColumn("prefix", shown(F.col("head"))).drop("head", "line")


def units(line: Column, most: int) -> Column:
    """A line's tokens as units of at most ``most``: packed sentences, else clauses, else hard cuts."""
    kind = f"array<{TOKENS}>"

    def split_after(toks: Column, signs: tuple[str, ...]) -> Column:
        def step(state: Column, t: Column) -> Column:
            cur = F.concat(state["cur"], F.array(t))
            closes = t["tok"].isin(list(signs))
            return F.struct(
                F.when(closes, F.concat(state["out"], F.array(cur))).otherwise(state["out"]).alias("out"),
                F.when(closes, empty(TOKENS)).otherwise(cur).alias("cur"),
            )

        start = F.struct(empty(kind).alias("out"), empty(TOKENS).alias("cur"))
        return F.aggregate(toks, start, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]))

    def hard(toks: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(toks) - 1) / most).cast("int"))
        return F.transform(cuts, lambda g: F.slice(toks, g * most + 1, F.lit(most)))

    def fitted(parts: Column, then) -> Column:
        return F.flatten(F.transform(parts, lambda p: F.when(F.size(p) <= most, F.array(p)).otherwise(then(p))))

    clauses = lambda p: let(pack(split_after(p, SOFT_ENDS), most), lambda x: fitted(x, hard))
    sentences = lambda p: let(pack(split_after(p, SENTENCE_ENDS), most), lambda x: fitted(x, clauses))
    return F.when(F.size(line) <= most, F.array(line)).otherwise(sentences(line))


def pack(parts: Column, most: int) -> Column:
    """Adjacent parts joined greedily while they fit."""
    kind = f"array<{TOKENS}>"

    def step(state: Column, p: Column) -> Column:
        full = (F.size(state["cur"]) > 0) & (F.size(state["cur"]) + F.size(p) > most)
        return F.struct(
            F.when(full, F.concat(state["out"], F.array(state["cur"]))).otherwise(state["out"]).alias("out"),
            F.when(full, p).otherwise(F.concat(state["cur"], p)).alias("cur"),
        )

    start = F.struct(empty(kind).alias("out"), empty(TOKENS).alias("cur"))
    return F.aggregate(parts, start, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]))


def section_windows(notes: DataFrame, most: int = LINE_SIZE, id: str = "id", text: str = "text") -> DataFrame:
    """Id, w, prefix, content; sections start at numbered lines, whole lines are packed.

    Later windows of a section carry its header's tokens as prefix, unless the header
    alone is longer than a window. Only lines meet in a shuffle by note.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # a token never holds a line break, so every line has its own
    per_line = F.zip_with(F.split(body, "\n", -1), line_tokens(body), lambda line, toks: F.struct(line.rlike(HEADER_LINE).alias("opens"), toks.alias("toks")))

    def sections(ls: Column) -> Column:
        kind = f"array<struct<opens:boolean,toks:{TOKENS}>>"

        def step(state: Column, line: Column) -> Column:
            new = line["opens"] & (F.size(state["cur"]) > 0)
            return F.struct(
                F.when(new, F.concat(state["out"], F.array(state["cur"]))).otherwise(state["out"]).alias("out"),
                F.when(new, F.array(line)).otherwise(F.concat(state["cur"], F.array(line))).alias("cur"),
            )

        start = F.struct(empty(f"array<{kind}>").alias("out"), empty(kind).alias("cur"))
        return F.aggregate(ls, start, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]))

    def windows(section: Column) -> Column:
        head = F.when(section[0]["opens"] & (F.size(section[0]["toks"]) <= most), section[0]["toks"]).otherwise(empty(TOKENS))
        parts = F.flatten(F.transform(F.filter(section, lambda x: F.size(x["toks"]) > 0), lambda x: units(x["toks"], most)))
        return F.transform(pack(parts, most), lambda c, i: F.struct(F.when(i == 0, empty(TOKENS)).otherwise(head).alias("prefix"), c.alias("content")))

    made = let(per_line, lambda ls: F.flatten(F.transform(sections(ls), windows)))
    rows = notes.select(F.col(id).alias("id"), F.posexplode(made).alias("w", "x"))
    return rows.select("id", "w", F.col("x.prefix").alias("prefix"), F.col("x.content").alias("content"))


def window_check(notes: DataFrame, windows: DataFrame, most: int, id: str = "id", text: str = "text") -> DataFrame:
    """Per note whether its windows joined are its tokens, and the largest window."""
    joined = windows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("w", F.transform("content", lambda t: t["tok"]).alias("c")))).alias("ws"), F.max(F.size("content")).alias("largest"))
    whole = notes.select(F.col(id).alias("id"), F.transform(tokens(F.coalesce(F.col(text), F.lit(""))), lambda t: t["tok"]).alias("toks"))
    both = whole.join(joined, "id", "left")
    same = F.flatten(F.transform(F.coalesce("ws", empty("array<struct<w:int,c:array<string>>>")), lambda x: x["c"])) == F.col("toks")
    return both.select("id", same.alias("complete"), F.coalesce("largest", F.lit(0)).alias("largest"), (F.coalesce("largest", F.lit(0)) > most).alias("oversize"))


def word_span(toks: Column, start: Column, end: Column) -> Column:
    """Struct (first, last) of the tokens whose edges are exactly the span's, else null."""

    def found(at: Column) -> Column:
        first, last = F.array_position(at["s"], start), F.array_position(at["e"], end)
        return F.when((first > 0) & (last >= first), F.struct((first - 1).cast("int").alias("first"), (last - 1).cast("int").alias("last")))

    return let(F.struct(F.transform(toks, lambda t: t["s"]).alias("s"), F.transform(toks, lambda t: t["e"]).alias("e")), found)


def uncovered(entities: DataFrame, windows: DataFrame, bin: int = 1024) -> DataFrame:
    """Entities (id, start, end) that no window's tokens hold exactly.

    An entity meets the windows that reach into its ``bin`` characters, not all of its note.
    """
    of = lambda c: F.floor(F.col(c) / bin)
    edges = windows.select("id", F.transform("content", lambda t: t["s"]).alias("ss"), F.transform("content", lambda t: t["e"]).alias("es"), F.explode(F.sequence(of("char_start"), of("char_end"))).alias("bin"))
    held = entities.withColumn("bin", of("start")).join(edges, ["id", "bin"]).filter(F.array_contains("ss", F.col("start")) & F.array_contains("es", F.col("end")))
    return entities.join(held.select("id", "start", "end").distinct(), ["id", "start", "end"], "left_anti")


def training_rows(records: DataFrame, seed: int = 7, o_keep: float = 0.35, header_dropout: float = 0.35, empty_keep: float = 0.5, size: int = SIZE, overlap: int = OVERLAP, context: int = CONTEXT, keep: tuple[str, ...] = (), words: bool = True) -> DataFrame:
    """D9 rows of records (id, text, entities, genre, source, record_kind), with the columns ``keep`` of their record.

    BIO tags and span list per window; loss 0 on the prefix, 1 on entity tokens and
    on a share ``o_keep`` of the others; headers go at ``header_dropout`` and windows
    without entity at 1 - ``empty_keep``. Draws are hashes of seed, record, window and place.
    Without ``words`` the columns tokens and char_offsets are not made.
    """
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    kept = ("genre", "source", "record_kind", *[c for c in keep if c not in ("genre", "source", "record_kind")])
    places = F.transform("entities", lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["type"].isNotNull().alias("named")))
    made = training_windows(F.coalesce("text", F.lit("")), places, F.col("id").cast("string"), seed, o_keep, header_dropout, empty_keep, size, overlap, context, words)
    rows = records.select("id", *kept, "entities", made.alias("made"))
    both = ["tokens", "char_offsets"] if words else []

    def window(x: Column) -> Column:
        """With its entities, which the record's row holds: they are not repeated for each window."""
        own = F.transform(x["own"], lambda o: F.struct(o["first"].alias("first"), o["last"].alias("last"), F.get("entities", o["k"]).alias("e")))
        return F.struct(own.alias("own"), *[x[c].alias(c) for c in ("w", "n_prefix", "tags", "mask", *both)])

    # explode alone would have its input made once more, to filter out notes without windows
    rows = rows.select("id", *kept, F.explode_outer(F.transform("made", window)).alias("x")).filter("x IS NOT NULL").select("id", *kept, "x.*")
    tags = F.transform("tags", lambda c: F.when(c == 0, "O").otherwise(F.concat(F.when(c % 2 == 1, "B-").otherwise("I-"), F.get("own", F.shiftright(c - 1, 1))["e"]["type"])))
    flags = lambda e: F.array(*[F.array_contains(e["assertions"], a).cast("int") for a in vocab.ASSERTIONS])
    spans = F.transform(
        "own",
        lambda x: F.struct(
            (x["first"] + F.col("n_prefix")).alias("start"),
            (x["last"] + F.col("n_prefix")).alias("end"),
            vocab.type_id(x["e"]["type"]).alias("type_id"),
            flags(x["e"]).alias("assertions"),
            (F.coalesce(x["e"]["supervised"], F.lit(True)) & x["e"]["type"].isin(list(vocab.ASSERTION_TYPES))).cast("int").alias("assertion_mask"),
        ),
    )
    return rows.select(
        F.concat_ws("#", "id", "w").alias("id"),
        F.col("id").alias("record_id"),
        *both,
        "n_prefix",
        F.concat(F.array_repeat(F.lit("O"), F.col("n_prefix")), tags).alias("ner_tags"),
        F.concat(F.array_repeat(F.lit(0), F.col("n_prefix")), F.col("mask")).alias("token_loss_mask"),
        spans.alias("spans"),
        *kept,
    )


def bio_encode(toks: Column, entities: Column) -> Column:
    """Struct of ner_tags, assert_mask, assert_tags for all tokens.

    Entities in order of start and falling length take the untagged tokens they
    contain, or, if there is none, the untagged tokens they touch.
    """
    order = F.array_sort(F.transform(entities, lambda e: F.struct(e["start"].alias("a"), (e["start"] - e["end"]).alias("b"), e["type"].alias("t"), e["end"].alias("e"), F.coalesce(e["assertions"], empty("array<string>")).alias("x"))))
    n = F.size(toks)
    blank = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda _: F.struct(F.lit("O").alias("tag"), F.lit(0).alias("mask"), F.array(*[F.lit(0)] * 3).alias("flags")))).otherwise(
        empty("array<struct<tag:string,mask:int,flags:array<int>>>")
    )

    def step(tags: Column, e: Column) -> Column:
        free = F.filter(F.transform(toks, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: F.get(tags, x["i"])["tag"] == "O")
        within = F.filter(free, lambda x: (x["t"]["s"] >= e["a"]) & (x["t"]["e"] <= e["e"]))
        touched = F.filter(free, lambda x: (x["t"]["s"] < e["e"]) & (e["a"] < x["t"]["e"]))
        own = F.transform(F.when(F.size(within) > 0, within).otherwise(touched), lambda x: x["i"])
        flags = F.array(*[F.array_contains(e["x"], a).cast("int") for a in vocab.ASSERTIONS])
        asks = e["t"].isin(list(vocab.ASSERTION_TYPES))

        def marked(mine: Column) -> Column:
            return F.transform(
                tags,
                lambda y, i: F.when(
                    F.array_contains(mine, i),
                    F.struct(
                        F.concat(F.when(i == mine[0], F.lit("B-")).otherwise(F.lit("I-")), e["t"]).alias("tag"),
                        asks.cast("int").alias("mask"),
                        F.when(asks, flags).otherwise(F.array(*[F.lit(0)] * 3)).alias("flags"),
                    ),
                ).otherwise(y),
            )

        return F.when(F.size(own) > 0, let(own, marked)).otherwise(tags)

    done = F.aggregate(order, blank, step)
    return let(done, lambda x: F.struct(F.transform(x, lambda y: y["tag"]).alias("ner_tags"), F.transform(x, lambda y: y["mask"]).alias("assert_mask"), F.transform(x, lambda y: y["flags"]).alias("assert_tags")))


def training_rows_v1(records: DataFrame, most: int = LINE_SIZE) -> DataFrame:
    """D8 rows: section windows of each record with its tags; the prefix carries none."""
    rows = section_windows(records, most).join(records.select("id", "entities"), "id")
    # an entity outside the window touches none of its tokens
    near = F.filter("entities", lambda e: (e["end"] > F.col("content")[0]["s"]) & (e["start"] < F.element_at("content", -1)["e"]))
    rows = rows.withColumn("enc", bio_encode(F.col("content"), near)).withColumn("n_prefix", F.size("prefix"))
    pad = lambda v: F.array_repeat(v, F.col("n_prefix"))
    return rows.select(
        "id",
        "w",
        F.transform(F.concat("prefix", "content"), lambda t: t["tok"]).alias("tokens"),
        F.concat(pad(F.lit("O")), "enc.ner_tags").alias("ner_tags"),
        F.concat(pad(F.lit(0)), "enc.assert_mask").alias("assert_mask"),
        F.concat(pad(F.array(*[F.lit(0)] * 3)), "enc.assert_tags").alias("assert_tags"),
        "n_prefix",
    )


def chunks_by_budget(costs: Column, budget: int) -> Column:
    """Words packed into chunks whose summed sub-token cost fits; struct (first, last) of each.

    A word that alone exceeds the budget is a chunk of its own. Runs of at most
    ``PACKED`` words are folded at a time, so that the chunks found so far are copied
    once for each run and not for each word.
    """
    kind = "array<struct<first:int,last:int>>"
    start = F.struct(empty(kind).alias("out"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"))

    def step(state: Column, x: Column) -> Column:
        full = (state["n"] > 0) & (state["sum"] + x["c"] > budget)
        done = F.struct((x["i"] - state["n"]).alias("first"), (x["i"] - 1).alias("last"))
        return F.struct(
            F.when(full, F.concat(state["out"], F.array(done))).otherwise(state["out"]).alias("out"),
            F.when(full, F.lit(1)).otherwise(state["n"] + 1).alias("n"),
            F.when(full, x["c"].cast("long")).otherwise(state["sum"] + x["c"]).alias("sum"),
        )

    def packed(all_: Column) -> Column:
        runs = F.when(F.size(all_) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PACKED).cast("int")), lambda g: F.slice(all_, g * PACKED + 1, F.lit(PACKED))))

        def run(state: Column, part: Column) -> Column:
            fresh = F.struct(empty(kind).alias("out"), state["n"].alias("n"), state["sum"].alias("sum"))
            return F.aggregate(part, fresh, step, lambda s: F.struct(F.concat(state["out"], s["out"]).alias("out"), s["n"].alias("n"), s["sum"].alias("sum")))

        last = lambda s: F.struct((F.size(all_) - s["n"]).alias("first"), (F.size(all_) - 1).alias("last"))
        return F.when(F.size(all_) == 0, empty(kind)).otherwise(F.aggregate(runs, start, run, lambda s: F.concat(s["out"], F.array(last(s)))))

    return let(F.transform(costs, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), packed)


def encoder_capacity(positions: int, pad_id: int | None, reserved: int = 1) -> int:
    """Tokens that fit an encoder whose positions start behind its padding id."""
    return positions - (pad_id + 1 if pad_id else 0) - (0 if pad_id else reserved)


def surface_at(text: Column, span: Column) -> Column:
    return piece(text, span["start"], span["end"])
