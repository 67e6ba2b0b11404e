"""Byte-level BPE by forced boundaries.

Two adjacent bytes that no token of the vocabulary holds side by side can never
end up in one token: every merge result is a token. A text may therefore be cut
between them and its fragments encoded independently; the concatenated ids equal
those of the whole text. A cut is only made where it also leaves the pre-tokeniser
unchanged: between whole characters and not after white space, whose split
depends on the character that follows. Most fragments are a word with its leading
space, so a bounded table of encoded fragments answers nearly all of them.

Special tokens of the vocabulary file that occur in a text are found before any
cut, as the tokenizers library does, and are fragments of their own.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import give_back, map_columns, worker_cache
from .vec import row_chunks, utf8_column, word_hashes

#: Bytes of encoded fragments that a worker remembers (in each of two halves), and the longest of them.
TABLE_BYTES, LONGEST = 16 << 20, 48
#: What an entry takes besides its own bytes, and bytes of text that are encoded together.
ENTRY_BYTES, PART_BYTES = 200, 1 << 19


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others follow from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Remembered:
    """Ids of fragments, in a young and an old half of bounded size.

    What is found in the old half becomes young again; once the young half is full
    it becomes the old one, so that frequent fragments stay.
    """

    def __init__(self):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def add(self, fragment: bytes, ids: bytes) -> None:
        if len(fragment) <= LONGEST:
            self.young[fragment] = ids
            self.size += len(fragment) + len(ids) + ENTRY_BYTES
            if self.size > TABLE_BYTES:
                self.young, self.old, self.size = {}, self.young, 0

    def look_up(self, fragments: list[bytes]) -> tuple[list[bytes | None], set[bytes]]:
        """The ids of each fragment, None where unknown, and the unknown fragments."""
        ids = list(map(self.young.get, fragments))
        missing = {fragments[i] for i, x in enumerate(ids) if x is None}
        again = {f: self.old[f] for f in missing if f in self.old}
        if again:
            ids = [again.get(f) if x is None else x for f, x in zip(fragments, ids)]
            for f, x in again.items():
                self.add(f, x)
        return ids, missing - again.keys()


def load_vocabulary(path: str) -> dict:
    """The tokenizer, the bytes of each id, the forced pairs and the special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    cache = worker_cache("bpe")
    if path not in cache:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        pieces = {i: bytes(alphabet[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        del spec
        joined = np.ones((256, 256), bool)
        for piece in pieces.values():
            row = np.frombuffer(piece, np.uint8)
            joined[row[:-1], row[1:]] = False
        pieces |= {i: text for text, i in special.items()}
        table = [pieces.get(i, b"") for i in range(max(pieces, default=-1) + 1)]
        cache[path] = {"tokenizer": tokenizer, "pieces": table, "forced": joined.ravel(), "special": special, "known": Remembered()}
        give_back()
    return cache[path]


def certain_cuts(data: np.ndarray, offsets: np.ndarray, forced: np.ndarray, special: Sequence[bytes]) -> np.ndarray:
    """Byte positions where the texts may be cut; the rows' own offsets are among them."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        left, right = data[:-1], data[1:]
        ok = forced[(left.astype(np.uint16) << np.uint16(8)) | right]
        ok &= (right & 0xC0) != 0x80
        ok &= ~(((left >= 0x09) & (left <= 0x0D)) | ((left >= 0x1C) & (left <= 0x20)))
        ok &= right != 0x27  # an apostrophe may belong to the signs before it
        # Every white-space character beyond ASCII starts with one of these four bytes.
        for lead, length in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
            after = np.flatnonzero(data == lead) + length
            ok[after[after < n] - 1] = False
        cut[1:n] = ok
    raw = data.tobytes() if special else b""
    for token in special:
        at = raw.find(token)
        while at >= 0:
            end = at + len(token)
            if np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, end - 1, side="right"):
                cut[at + 1 : end] = False
                cut[at] = cut[end] = True
                at = raw.find(token, end)
            else:
                at = raw.find(token, at + 1)
    cut[offsets] = True
    return np.flatnonzero(cut)


def distinct_fragments(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct fragment, and for each fragment which of them it is.

    Fragments are grouped by hash, and every one is compared with the first of its group.
    """
    _, place, which = np.unique(word_hashes(part, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    same = size == size[place][which]
    if same.all():
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        equal = part[at + np.repeat(starts, size)] == part[at + np.repeat(starts[place][which], size)]
        if equal.all():
            return place, which
        same = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    # hashes that fail: these fragments stand for themselves
    odd = np.flatnonzero(~same)
    which = which.copy()
    which[odd] = len(place) + np.arange(len(odd))
    return np.concatenate([place, odd]), which


def encode_column(data: np.ndarray, offsets: np.ndarray, vocabulary: dict) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows' texts, and the first id of each row (n + 1 long)."""
    known, tokenizer = vocabulary["known"], vocabulary["tokenizer"]
    special = list(vocabulary["special"])
    out, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
    for a, b in row_chunks(offsets, PART_BYTES):
        own = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        cuts = certain_cuts(part, own, vocabulary["forced"], special)
        if len(cuts) < 2:
            counts.append(np.zeros(b - a, np.int64))
            continue
        place, which = distinct_fragments(part, cuts[:-1], cuts[1:])
        raw = part.tobytes()
        fragments = [raw[i:j] for i, j in zip(cuts[place].tolist(), cuts[place + 1].tolist())]
        ids, missing = known.look_up(fragments)
        if missing:
            new = list(missing)
            coded = tokenizer.encode_batch_fast([x.decode() for x in new], add_special_tokens=False)
            fresh = {x: struct.pack(f"<{len(i)}I", *i) for x, i in zip(new, (e.ids for e in coded))}
            ids = [fresh[f] if x is None else x for f, x in zip(fragments, ids)]
            for f, x in fresh.items():
                known.add(f, x)
        flat = np.frombuffer(b"".join(ids), "<u4")
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(n) - n
        each = n[which]
        before = np.concatenate([[0], np.cumsum(each)])
        out.append(flat[np.arange(int(before[-1])) - np.repeat(before[:-1], each) + np.repeat(first[which], each)])
        counts.append(np.diff(before[np.searchsorted(cuts, own)]))
    return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def binary_rows(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each row's ids as little-endian unsigned 32-bit integers."""
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((4 * first).astype(np.int64).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
    return made.cast(pa.binary())


def encode_rows(data: np.ndarray, offsets: np.ndarray, vocabulary: dict) -> list[bytes]:
    """The ids of each row's text as little-endian unsigned 32-bit integers."""
    return binary_rows(*encode_column(data, offsets, vocabulary)).to_pylist()


def decode_ids(ids: bytes, pieces: list[bytes]) -> str:
    """The text of little-endian ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids", keep: Sequence[str] | None = None) -> DataFrame:
    """Append the token ids of each whole text as little-endian unsigned 32-bit integers.

    vocabulary: path of a byte-level BPE file of the tokenizers library, present on
    every executor. A null or empty text has no ids (an empty binary). Rows are
    independent: repeated rows give repeated results, an empty table an empty one. A very
    long text is encoded whole, as one part; others share parts of ``PART_BYTES``.
    A column that already has the name ``ids`` is replaced, others may have any name.
    """

    def run(column):
        return [binary_rows(*encode_column(*utf8_column(column), load_vocabulary(vocabulary)))]

    return map_columns(docs, run, [text], [T.StructField(ids, T.BinaryType())], docs.columns if keep is None else keep)


def decode(coded: DataFrame, vocabulary: str, ids: str = "token_ids", text: str = "decoded", keep: Sequence[str] | None = None) -> DataFrame:
    """Append the text of each row's token ids; null ids give the empty text."""

    def run(column):
        pieces = load_vocabulary(vocabulary)["pieces"]
        return [pa.array([decode_ids(x or b"", pieces) for x in column.to_pylist()], pa.string())]

    return map_columns(coded, run, [ids], [T.StructField(text, T.StringType())], coded.columns if keep is None else keep)


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``encode`` and then ``decode`` in one pass: appends token_ids and decoded."""

    def run(column):
        loaded = load_vocabulary(vocabulary)
        ids = binary_rows(*encode_column(*utf8_column(column), loaded))
        return [ids, pa.array([decode_ids(x, loaded["pieces"]) for x in ids.to_pylist()], pa.string())]

    fields = [T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return map_columns(docs, run, [text], fields, docs.columns if keep is None else keep)
