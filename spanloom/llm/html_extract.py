"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its block elements and its text nodes, each nested in
the elements that are open around it. The place of a token is the chain of the block
elements' names and the class names of the nearest one. Over all pages of a host:

1. Tokens with one occurrence vector, the same count on every page, form an equivalence
   class. Vectors are never gathered: each (host, token) keeps the sums of two halves of a
   hash of (page content, count), which agree for equal vectors.
2. A class is ordered: a token that follows the same token of its class wherever it
   stands is chained to it; where the order changes from page to page the class falls
   into several chains. Chains of ``LEAST_TOKENS`` or more tokens are kept.
3. Chains are nested: on every page a chain has to end inside the slot, between two tokens
   of another chain, in which it began. One that is cut on more than ``CROSSED`` of its
   pages is no part of the template.
4. What is left is the host's template. Its text tokens belong to it if they stand on a
   share of the pages that have their place: ``LAYOUT`` for any template text,
   ``SUPPORT`` for firm ones. What lies between template tokens are slots, and the text
   in slots is the page's own.

Pages are parsed once into token sequences, from which all of this is computed, and once
more to extract. Tokens are hashes, so a text node of any length is one. Copies of a page
count as one page. As a text stands on at least ``LAYOUT`` of the pages with its place, a
template has at most 1 / LAYOUT times the tokens of an average page of each place.

Where a page has several slots, the elements around them tell which is main text: slots
inside articles, else inside a main element, else inside what is named like one. If the
articles hold less than half of the text of the main element around them, they are parts
of it and the main element is taken. Slots of navigation, notices, adverts, forms,
comments and the like are left out. A word in the name of an element drops neither an
article, a main element or the body nor an element that holds the main element, and names
count for less where a page would have no text otherwise. Firm template text is
left out of all slots, on pages without an article or main element any template text.
Pages that are copies of each other share their text too: where the template would take
more than half of what an article, or a page by its not firm texts, holds, that is kept.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator, Sequence, Set
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import limit_batches, materialise, quoted, released, size_of

#: Least share of the pages with its place that a firm, and that any, template text stands on; least pages.
SUPPORT, LAYOUT, LEAST_PAGES = 0.5, 0.05, 3
#: Tokens of a valid chain, share of its pages on which other chains may cut it; bytes up to which templates are broadcast.
LEAST_TOKENS, CROSSED, BROADCAST = 2, 0.1, 8 << 20

# HTML elements by how they behave.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = "script|style|noscript|template|iframe|textarea|title|svg|object"
DROPPED = set("nav footer aside form button select option dialog menu head audio video canvas map".split())
# Roles and words of class and id attributes that name what is not main text.
DROPPED_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot sponsor sponsored sponsors promo promotion promoted banner "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars widget widgets footer foot masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations pagination pager "
    "copyright disclaimer search searchbox form skip".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus reply replies respond".split())
HEADER_WORDS = set("header siteheader pageheader".split())
MAIN_WORDS = set("article articlebody post postcontent entry entrycontent story storybody content maincontent main bodytext".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^<>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def name_words(attrs: dict[str, str]) -> set[str]:
    """Words of class and id, alone and without the separators inside one name."""
    out = set()
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        out.update(w.lower() for w in NAME.findall(name))
        out.add(re.sub(r"[^a-z0-9]", "", name.lower()))
    return out


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is text, open or close; raw elements and comments are skipped."""
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if m[3]:
            yield ("close" if m[2] else "open"), m[3].lower(), m[4] or ""
    if at < len(page):
        yield "text", "", page[at:]


def collapsed(text: str) -> str:
    return " ".join(html.unescape(text).split())


def hashed(place: int, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=place.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


#: The place outside all elements.
ROOT = 1


class Nest:
    """The block elements that are open, and the place that they make."""

    def __init__(self):
        self.stack: list[tuple[str, int, int]] = [("", 0, ROOT)]  # name, chain, place
        self.known: dict[tuple[int, str], int] = {}

    def short(self, place: int, text: str) -> int:
        if (place, text) not in self.known:
            self.known[place, text] = hashed(place, text)
        return self.known[place, text]

    @property
    def place(self) -> int:
        return self.stack[-1][2]

    def open(self, name: str, attrs: dict[str, str]) -> None:
        """Elements in an element of the same name, as of unclosed paragraphs, count as one."""
        last, chain, _ = self.stack[-1]
        chain = chain if last == name else self.short(chain, name)
        # names with digits differ from page to page
        words = sorted(w for w in attrs.get("class", "").split() if not any(c.isdigit() for c in w))
        self.stack.append((name, chain, self.short(chain, " ".join(words))))

    def close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == name:
                del self.stack[i:]
                break


def opens(name: str, rest: str) -> bool:
    """Whether a start tag opens an element."""
    return not (name in VOID or rest.rstrip().endswith("/") and name not in INLINE and name not in ("p", "div", "article", "section"))


def page_sequence(page: str) -> tuple[list[int], list[int]]:
    """The tokens of a page in order, and the place of each text; that of a place itself is 0."""
    tokens: list[int] = []
    places: list[int] = []
    nest = Nest()
    for kind, name, rest in events(page):
        if kind == "text":
            text = collapsed(rest)
            if not text:
                continue
            if nest.place == ROOT:
                tokens.append(ROOT)
                places.append(0)
            tokens.append(hashed(nest.place, "=" + text))
            places.append(nest.place)
        elif name in INLINE:
            continue
        elif kind == "close":
            nest.close(name)
        elif opens(name, rest):
            nest.open(name, attributes(rest))
            tokens.append(nest.place)
            places.append(0)
    return tokens, places


def page_tokens(page: str) -> dict[int, tuple[int, int]]:
    """Count and place of every text of a page, and of every place itself, whose place is 0."""
    out: dict[int, tuple[int, int]] = {}
    for token, place in zip(*page_sequence(page)):
        n = 1 if token == ROOT else out.get(token, (0, 0))[0] + 1
        out[token] = (n, place)
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def packed(values: Sequence[int]) -> bytes:
    return np.array(values, "<i8").tobytes()


def sequences(pages: DataFrame) -> DataFrame:
    """(host, own, tokens, places) of every page: a hash of its content and its packed token sequence; pages: url, html."""

    def run(batches):
        for batch in batches:
            rows = [(host_of(url), hashed(0, page or ""), *map(packed, page_sequence(page or ""))) for url, page in zip(*(batch.column(i).to_pylist() for i in range(2)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["host", "own", "tokens", "places"]
            )

    return pages.mapInArrow(released(run), "host string, own long, tokens binary, places binary")


SUMS = "host string, token long, place long, pages long, v1 long, v2 long, lo long, hi long"


def token_sums(found: DataFrame) -> DataFrame:
    """(host, token, place, pages, v1, v2, lo, hi) over all token sequences.

    v1 and v2 sum the halves of each page's hash, lo and hi are the least and the largest first half.
    """

    def run(batches):
        for batch in batches:
            sums: dict[tuple[str, int, int], list[int]] = {}
            for host, own, tokens, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
                tokens = np.frombuffer(tokens, "<i8")
                unique, at, counts = np.unique(tokens, return_index=True, return_counts=True)
                halves: dict[int, tuple[int, int]] = {}
                for token, n, place in zip(unique.tolist(), counts.tolist(), np.frombuffer(places, "<i8")[at].tolist()):
                    n = 1 if token == ROOT else n
                    if n not in halves:
                        h = hashed(own, str(n))
                        halves[n] = (h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF)
                    v1, v2 = halves[n]
                    s = sums.setdefault((host, token, place), [0, 0, 0, v1, v1])
                    s[0] += 1
                    s[1] += v1
                    s[2] += v2
                    s[3] = min(s[3], v1)
                    s[4] = max(s[4], v1)
            keys = list(sums)
            values = np.array(list(sums.values()), np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), *[pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2)], *[pa.array(values[:, i]) for i in range(5)]],
                names=["host", "token", "place", "pages", "v1", "v2", "lo", "hi"],
            )

    sent = found.mapInArrow(released(run), SUMS)
    return sent.groupBy("host", "token", "place").agg(*[F.sum(c).alias(c) for c in ("pages", "v1", "v2")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def beside_hosts(rows: DataFrame, of_host: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """Map batches of ``rows`` (host first) with what ``of_host`` (host, then packed binaries) has for each row's host.

    fn: batch, list of tuples of binaries or None -> batch. The hosts' side goes to every worker as it
    is while its size allows that; beyond that both sides are shuffled by host.
    """
    held = [c for c in of_host.columns if c != "host"]
    if size_of(of_host) <= BROADCAST:
        known = rows.sparkSession.sparkContext.broadcast({r["host"]: tuple(bytes(r[c]) for c in held) for r in of_host.toLocalIterator()})

        def run(batches):
            for batch in batches:
                yield fn(batch, [known.value.get(h) for h in batch.column(0).to_pylist()])

        return rows.mapInArrow(released(run), schema)
    n = len(rows.columns)

    def run_joined(batches):
        for batch in batches:
            sides = zip(*(batch.column(n + i).to_pylist() for i in range(len(held))))
            yield fn(batch, [None if x[0] is None else x for x in sides])

    joined = rows.join(of_host, "host", "left").select(*[rows.columns[0], *rows.columns[1:]], *held)
    return joined.mapInArrow(released(run_joined), schema)


def packed_by_host(rows: DataFrame, *columns: str) -> DataFrame:
    """(host, one packed binary for each of the long columns), in one order; a host's template is of bounded size."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1).to_pylist()
            made = [pa.array([packed([x[c] for x in items]) for items in lists], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["host", *columns])

    grouped = rows.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("items"))
    return materialise(grouped.mapInArrow(released(run), "host string, " + ", ".join(f"{c} binary" for c in columns)), "by_host")


class Latest(dict):
    """Lookup tables of a few packed columns, made once while the same binaries come again."""

    def of(self, sides: tuple[bytes, ...] | None) -> dict[int, tuple[int, ...]]:
        if sides is None:
            return {}
        if sides not in self:
            if len(self) > 64:
                self.clear()
            columns = [np.frombuffer(x, "<i8").tolist() for x in sides]
            self[sides] = dict(zip(columns[0], zip(*columns[1:])))
        return self[sides]


def followers(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, token, class, before): the token of its class that each token always follows, 0 where that differs.

    classes: host, token, class. The first of a class on a page follows none (1).
    """

    def of_batch(batch, sides):
        sums: dict[tuple[str, int], list[int]] = {}
        tables = Latest()
        for host, tokens, side in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sides):
            table, last = tables.of(side), {}
            if not table:
                continue
            for token in np.frombuffer(tokens, "<i8").tolist():
                if token in table:
                    own = table[token][0]
                    before = last.get(own, 1)
                    s = sums.setdefault((host, token), [before, before])
                    s[0], s[1] = min(s[0], before), max(s[1], before)
                    last[own] = token
        keys, values = list(sums), list(sums.values())
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *[pa.array(x, pa.int64()) for x in ([k[1] for k in keys], [v[0] for v in values], [v[1] for v in values])]], names=["host", "token", "lo", "hi"])

    sent = beside_hosts(found.select("host", "tokens"), packed_by_host(classes, "token", "class"), of_batch, "host string, token long, lo long, hi long")
    same = sent.groupBy("host", "token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    before = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(0))
    return classes.join(same.select("host", "token", before.alias("before")), ["host", "token"])


def chains(linked: DataFrame) -> DataFrame:
    """(host, token, chain, at, size): every class as chains of tokens, each always behind the one before; linked: of ``followers``."""

    def of_host(part: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(part["token"].tolist(), part["class"].tolist()))
        before = {t: b for t, b in zip(part["token"].tolist(), part["before"].tolist()) if b not in (0, 1, t) and own.get(b) == own[t]}
        next_: dict[int, list[int]] = {}
        for t, b in before.items():
            next_.setdefault(b, []).append(t)
        out = []
        for t in sorted(own):
            # a chain starts where no single token comes before, or where the one before has several behind it
            if t in before and len(next_[before[t]]) == 1:
                continue
            chain = [t]
            while len(next_.get(chain[-1], ())) == 1 and next_[chain[-1]][0] != t:
                chain.append(next_[chain[-1]][0])
            out += [(x, t, i + 1, len(chain)) for i, x in enumerate(chain)]
        made = pd.DataFrame(out, columns=["token", "chain", "at", "size"]).astype("int64")
        made.insert(0, "host", part["host"].iloc[0])
        return made

    made = linked.groupBy("host").applyInPandas(of_host, "host string, token long, chain long, at long, size long")
    return made.filter(F.col("size") >= LEAST_TOKENS)


def crossings(tokens: Sequence[int], table: dict[int, tuple[int, ...]]) -> dict[int, list[int]]:
    """For each chain of a page: times it was cut, and the slot (a hash of chain and place in it) that holds it."""
    out: dict[int, list[int]] = {}
    stack: list[list[int]] = []  # chain, tokens seen, size
    for token in tokens:
        if token not in table:
            continue
        chain, at, size = table[token]
        if at == 1:
            slot = hash(tuple(stack[-1][:2])) & 0x7FFFFFFFFFFFFFFF if stack else 0
            out.setdefault(chain, [0, slot])
            stack.append([chain, 1, size])
        else:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == chain and stack[i][1] == at - 1), None)
            if depth is None:
                out.setdefault(chain, [0, 0])[0] += 1
                continue
            for cut, _, _ in stack[depth + 1 :]:
                out[cut][0] += 1
            del stack[depth + 1 :]
            stack[-1][1] = at
        if stack and stack[-1][1] == stack[-1][2]:
            stack.pop()
    for cut, _, _ in stack:
        out[cut][0] += 1
    return out


def nested(found: DataFrame, ordered: DataFrame) -> DataFrame:
    """(host, token, chain, at, size, slots): the chains that others cut on few of their pages; slots: how many slots hold them (1: always the same)."""

    def of_batch(batch, sides):
        sums: dict[tuple[str, int], list[int]] = {}
        tables = Latest()
        for host, tokens, side in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sides):
            table = tables.of(side)
            if not table:
                continue
            for chain, (cuts, slot) in crossings(np.frombuffer(tokens, "<i8").tolist(), table).items():
                s = sums.setdefault((host, chain), [0, 0, slot, slot])
                s[0] += 1
                s[1] += cuts > 0
                s[2], s[3] = min(s[2], slot), max(s[3], slot)
        keys, values = list(sums), list(sums.values())
        names = ["host", "chain", "seen", "cut", "lo", "hi"]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *[pa.array([v[i] for v in values], pa.int64()) for i in range(4)]], names=names)

    schema = "host string, chain long, seen long, cut long, lo long, hi long"
    sent = beside_hosts(found.select("host", "tokens"), packed_by_host(ordered, "token", "chain", "at", "size"), of_batch, schema)
    sums = sent.groupBy("host", "chain").agg(F.sum("seen").alias("seen"), F.sum("cut").alias("cut"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    valid = sums.filter(F.col("cut") <= CROSSED * F.col("seen")).select("host", "chain", F.when(F.col("lo") == F.col("hi"), 1).otherwise(2).alias("slots"))
    return ordered.join(valid, ["host", "chain"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, token, place, chain, at, size, slots, pages, support) of each host's template; pages: url, html.

    support: the share of the pages with its place on which a text stands, null for a
    place. Equivalence classes are cut into ordered chains and those kept that nest.
    """
    found = materialise(sequences(pages), "sequences")
    # two different pages make no sum but those of n lo and n hi: three do
    differ = (F.col("hi") > F.col("lo")) & ((F.col("v1") - F.col("pages") * F.col("lo")) % F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) != 0)
    frequent = materialise(token_sums(found).filter(F.col("pages") >= LEAST_PAGES).filter(differ).drop("lo", "hi"), "frequent")
    vectors = frequent.groupBy("host", "pages", "v1", "v2").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= LEAST_TOKENS)
    # a text on few of the pages with its place cannot become template text
    place_pages = materialise(frequent.filter("place = 0").select("host", F.col("token").alias("place"), F.col("pages").alias("place_pages")), "places")
    held = frequent.join(materialise(vectors.drop("members"), "vectors"), ["host", "pages", "v1", "v2"]).join(place_pages, ["host", "place"], "left")
    held = held.withColumn("support", F.when(F.col("place") != 0, F.col("pages") / F.col("place_pages")))
    held = held.filter(f"place = 0 OR support >= {LAYOUT}")
    classes = materialise(held.select("host", "token", "place", "pages", "support", F.xxhash64("pages", "v1", "v2").alias("class")), "classes")
    linked = materialise(followers(found, classes.select("host", "token", "class")), "followers")
    kept = nested(found, materialise(chains(linked), "chains"))
    return classes.drop("class").join(kept, ["host", "token"]).select("host", "token", "place", "chain", "at", "size", "slots", "pages", "support")


def template_texts(template: DataFrame) -> DataFrame:
    """(host, tokens, firm): packed text tokens of each host's template, and 1 for the firm among them."""
    texts = template.filter("place <> 0")
    return packed_by_host(texts.withColumn("firm", (F.col("support") >= SUPPORT).cast("long")), "token", "firm")


def role_of(name: str, attrs: dict[str, str], inside: bool) -> str:
    """What an element says about the slots in it: drop, maybe or comment (by a word of its name), article, main, named, or nothing."""
    words = name_words(attrs) if attrs else set()
    role = attrs.get("role", "").lower()
    if name in DROPPED or role in DROPPED_ROLES:
        return "drop"
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return "drop"
    if name in ("html", "body"):
        return ""
    if name == "header" and not inside:
        return "drop"
    if name == "main" or role == "main":
        return "main"
    if name == "article":
        return "article"
    if words & COMMENT_WORDS:
        return "comment"
    if words & DROPPED_WORDS:
        return "maybe"
    if not inside and words & HEADER_WORDS:
        return "maybe"
    return "named" if words & MAIN_WORDS else ""


#: Slots by the best element around them, the most telling first.
RANKS = {"article": 3, "main": 2, "named": 1, "": 0}


class Open:
    """An open element: its name, the rank and drop around it, and, if a word of its name may drop it, where its text began."""

    __slots__ = ("name", "rank", "dropped", "held", "since", "keeps")

    def __init__(self, name: str, rank: int, dropped: bool, held: bool, since: int):
        self.name, self.rank, self.dropped, self.held, self.since = name, rank, dropped, held, since
        self.keeps = False


def slots(page: str, template: Set[int], firm: Set[int], trust: int = 2) -> tuple[list[tuple[str, int, int]], list[bool]]:
    """The texts of a page that no role drops, as (text, rank, 0 or 1 for template or 2 for firm template text), and the ranks seen.

    trust: what words of names may drop: 2, elements that hold no main element; 1, those
    that hold no main text of any rank, and comments; 0, nothing.
    """
    stack: list[Open] = []
    pieces: list[tuple[str, int, int]] = []
    seen = [False] * 4
    rank, dropped = 0, False
    nest = Nest()

    def close(element: Open) -> None:
        nonlocal rank, dropped
        rank, dropped = element.rank, element.dropped
        if element.held and not element.keeps:
            pieces[element.since :] = [(" ", 3, 0)]

    for kind, name, rest in events(page):
        if kind == "text":
            if dropped:
                continue
            mark = 0
            if template and (own := collapsed(rest)):
                token = hashed(nest.place, "=" + own)
                mark = (token in template) + (token in firm)
            pieces.append((html.unescape(rest) if "&" in rest else rest, rank, mark))
            continue
        if name not in INLINE:
            pieces.append((" ", 3, 0))
        if kind == "open":
            if not opens(name, rest):
                continue
            attrs = attributes(rest)
            if name not in INLINE and template:
                nest.open(name, attrs)
            role = "drop" if dropped else role_of(name, attrs, rank > 1)
            if role in ("maybe", "comment"):
                # inside an article, what is named like comments or an advert is none of its text
                role = "drop" if rank == 3 or (role == "comment" and trust == 1) else "maybe" if trust else ""
            stack.append(Open(name, rank, dropped, role == "maybe", len(pieces)))
            dropped = dropped or role == "drop"
            if not dropped and RANKS.get(role, 0) > rank:
                rank = RANKS[role]
                held = [x for x in stack if x.held]
                if role == "main" or trust == 1:
                    for x in held:
                        x.keeps = True
                if all(x.keeps for x in held):
                    seen[rank] = True
        else:
            nest.close(name)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    for element in reversed(stack[i:]):
                        close(element)
                    del stack[i:]
                    break
    for element in reversed(stack):
        close(element)
    return pieces, seen


def extract(page: str, template: Set[int], firm: Set[int] = frozenset()) -> str:
    """The main text of one page; firm: the tokens of the template that count in any slot."""
    pieces, seen = slots(page, template, firm)
    for trust in (1, 0):
        # a word in the name of a wrapper must not empty the page
        if any(seen) or any(text.strip() for text, _, _ in pieces):
            break
        pieces, seen = slots(page, template, firm, trust)
    best = next((r for r in (3, 2, 1) if seen[r]), 0)
    amount = [0] * 4
    for text, r, mark in pieces:
        amount[r] += len(text.strip()) if mark < 2 else 0
    if best == 3 and seen[2] and amount[3] < amount[2]:
        best = 2  # short articles in a main element with more text of its own
    sizes = [0, 0, 0]
    for text, r, mark in pieces:
        if r >= best:
            sizes[mark] += len(text.strip())
    # copies of a page share most of their text, a template does not
    if best:
        least = 2 if sizes[2] <= sizes[0] + sizes[1] else 3
    else:
        least = 1 if sizes[1] <= sizes[0] else 2
    return " ".join("".join(" " if mark >= least else text for text, r, mark in pieces if r >= best).split())


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", out: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Append the main text of each whole page; "" where there is none.

    Character references are decoded, white space inside a block becomes one space,
    blocks are joined in page order by one space. A null or empty page has no text;
    pages without a host share one template of their own. Repeated rows get the
    same text each; a very long page is read whole; an empty table gives an empty one. A
    column that already has the name ``out`` is replaced, others may have any name.
    """
    limit_batches(pages.sparkSession)
    found = template_texts(materialise(templates(pages.select(F.col(quoted(url)).alias("url"), F.col(quoted(page)).alias("html"))), "template"))
    keep = [c for c in (pages.columns if keep is None else keep) if c != out]
    schema = T.StructType([T.StructField(f"k{i}", pages.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField(out, T.StringType())])
    names, n = [f.name for f in schema], len(keep)
    host = F.arrow_udf(lambda u: pa.array([host_of(x) for x in u.to_pylist()], pa.string()), "string")
    rows = pages.select(host(F.col(quoted(url))).alias("host"), F.col(quoted(page)).alias("html"), *[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)])

    def of_batch(batch, sides):
        tables = Latest()
        text = []
        for h, side in zip(batch.column(1).to_pylist(), sides):
            table = tables.of(side)
            # the table's keys are its tokens; a set of the firm ones is made with it
            if side is not None and (side, "firm") not in tables:
                tables[side, "firm"] = frozenset(t for t, (x,) in table.items() if x)
            text.append(extract(h or "", table.keys(), tables[side, "firm"] if side is not None else frozenset()))
        return pa.RecordBatch.from_arrays([*[batch.column(2 + i) for i in range(n)], pa.array(text, pa.string())], names=names)

    made = beside_hosts(rows, found, of_batch, schema)
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], out)
