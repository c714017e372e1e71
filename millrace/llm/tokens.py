"""Byte-level BPE ids of whole batches of texts.

The ids are those of the ``tokenizers`` library.  It encodes every distinct
pretoken once per worker; array kernels cut texts into pretokens, look the
known ones up in a hash table, and lay out the ids.  That gives the same ids
because a byte-level BPE without normaliser encodes each pretoken by itself.
A text that holds an added token goes to the library whole, and so does every
text if the vocabulary file asks for another kind of pretokenisation.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

import numpy as np

from millrace.llm.kernels import SLICE, repeat_ranges, slices, span_hashes

#: Pretokens that a worker remembers, and the ids of all of them; beyond, it starts anew.
REMEMBERED, REMEMBERED_IDS = 1 << 21, 1 << 24
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point, as the byte-level pattern's \\s, \\p{L} and \\p{N} part them."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    #: The code points of White_Space.
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def _char_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of the character that each byte is of, and whether the byte is a character's first."""
    table = _classes()
    kind = table[data]
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        b0, b1, b2, b3 = (padded[at + i] for i in range(4))
        length = np.where(b0 >= 0xF0, 4, np.where(b0 >= 0xE0, 3, 2))
        code = np.where(
            length == 2, (b0 & 31) << 6 | b1 & 63,
            np.where(length == 3, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63),
        )
        k = table[np.minimum(code, sys.maxunicode)]
        kind[at] = k
        for i in (1, 2, 3):
            there = at[length > i] + i
            kind[there] = k[length > i]
    return kind, lead


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pretokens of all texts, ascending, and the index of each text's first one.

    The pattern: a contraction; runs of letters, of numbers or of others, each with at
    most one blank before; runs of white space, whose last character goes to the next run
    if it is a blank, and is a pretoken of its own otherwise.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    kind, lead = _char_classes(data)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    inner = offsets[offsets < n]
    new[inner] = True
    runs = np.flatnonzero(new)
    ends = np.append(runs[1:], n)
    kinds = kind[runs]
    opens_text = np.zeros(n + 1, bool)
    opens_text[offsets] = True

    spaces = np.flatnonzero(kinds == SPACE)
    s, e = runs[spaces], ends[spaces]
    before_text = ~opens_text[e]  # something of the same text follows
    last = e - 1  # first byte of the run's last character
    for _ in range(3):
        last = np.where(lead[last], last, last - 1)
    blank = before_text & (data[last] == 32)
    other = before_text & ~blank
    starts = np.zeros(n + 1, bool)
    starts[runs[kinds != SPACE]] = True
    starts[s] = True
    starts[last[other]] = True  # a last character that is no blank stands alone
    starts[last[blank]] = True
    starts[e[blank]] = False  # ... and a blank opens the next pretoken
    # contractions: a lone apostrophe that opens a pretoken, before s d m t ll ve re
    marks = runs[(kinds == OTHER) & (ends - runs == 1)]
    marks = marks[(data[marks] == 39) & starts[marks]]
    if len(marks):
        two = np.concatenate([data, np.zeros(3, np.uint8)])
        same = lambda i: ~opens_text[np.minimum(marks + i, n)]
        a, b = two[marks + 1], two[marks + 2]
        one = same(1) & np.isin(a, np.frombuffer(b"sdmt", np.uint8))
        pair = same(1) & same(2) & ~one & ((a == 108) & (b == 108) | ((a == 118) | (a == 114)) & (b == 101))
        for which, length in ((one, 2), (pair, 3)):
            m = marks[which]
            starts[m + 1] = False
            after = m + length
            inside = after[after < n]
            starts[inside] = True
    at = np.flatnonzero(starts[:n])
    return at, np.searchsorted(at, offsets)


class Encoder:
    """Ids of texts by one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre, model = kind["pre_tokenizer"] or {}, kind["model"]
        self.added = [t["content"].encode() for t in kind["added_tokens"]]
        self.by_pretoken = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and kind["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout")
            and all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in kind["added_tokens"])
        )
        self.alphabet = _byte_alphabet()
        self._clear()

    def _clear(self) -> None:
        self.table = np.zeros(REMEMBERED * 2, np.uint64)  # open addressing, linear probing
        self.slot = np.zeros(REMEMBERED * 2, np.int32)
        self.known = 0
        self.begin, self.size = np.zeros(REMEMBERED + SLICE, np.int64), np.zeros(REMEMBERED + SLICE, np.int32)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        mask = np.uint64(len(self.table) - 1)
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), (keys & mask).astype(np.int64)
        while len(left):
            there = self.table[at]
            hit = there == keys[left]
            out[left[hit]] = self.slot[at[hit]]
            go = ~hit & (there != 0)
            left, at = left[go], (at[go] + 1) & int(mask)
        return out

    def _store(self, keys: np.ndarray, entries: np.ndarray) -> None:
        mask = len(self.table) - 1
        left, at = np.arange(len(keys)), (keys & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = self.table[at] == 0
            self.table[at[free]] = keys[left[free]]  # of two that meet, the last stays
            won = self.table[at] == keys[left]
            self.slot[at[won]] = entries[left[won]]
            left, at = left[~won], (at[~won] + 1) & mask

    def _learn(self, keys: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray) -> None:
        if self.used + 8 * int((end - start).sum()) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), 8 * int((end - start).sum())), np.uint32)])
        tokenize, letters = self.library.model.tokenize, self.alphabet
        flat, sizes = [], []
        for a, b in zip(start.tolist(), end.tolist(), strict=True):
            got = [t.id for t in tokenize(data[a:b].decode("latin-1").translate(letters))]
            flat += got
            sizes.append(len(got))
        size = np.array(sizes, np.int32)
        k = self.known + len(keys)
        self.begin[self.known:k] = self.used + np.cumsum(size) - size
        self.size[self.known:k] = size
        self.ids[self.used:self.used + len(flat)] = flat
        self._store(keys, np.arange(self.known, k))
        self.known, self.used = k, self.used + len(flat)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the offsets of each text's."""
        parts, counts = [], []
        for _, _, piece, at in slices(data, offsets):
            ids, n = self._slice(piece, at)
            parts.append(ids)
            counts.append(n)
        count = np.concatenate(counts) if counts else np.empty(0, np.int64)
        ends = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=ends[1:])
        return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), ends

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if not self.by_pretoken or any(t in raw for t in self.added):
            each = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            odd = [not self.by_pretoken or any(t in x for t in self.added) for x in each]
            parts = []
            for x, whole in zip(each, odd, strict=True):
                parts.append(self._whole(x) if whole else self._slice(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0])
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        start, first = pretokens(data, offsets)
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        end = np.append(start[1:], len(data))
        keys = span_hashes(data, start, end) | np.uint64(1)
        entry = self._find(keys)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if self.known + len(new) > REMEMBERED or self.used > REMEMBERED_IDS:
                self._clear()
                new = np.arange(len(keys))
            order = new[np.argsort(keys[new], kind="stable")]
            distinct = order[np.append(True, keys[order][1:] != keys[order][:-1])]
            self._learn(keys[distinct], raw, start[distinct], end[distinct])
            entry[new] = self._find(keys[new])
        size = self.size[entry].astype(np.int64)
        ids = self.ids[repeat_ranges(self.begin[entry], size)]
        before = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        return ids, np.diff(before[first])


def _byte_alphabet() -> dict[int, int]:
    """Byte-level BPE writes bytes as printable characters: those that are printable as
    themselves, the others from U+0100 on."""
    #: The byte-level alphabet's ranges.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process, which keeps it from task to task."""
    return Encoder(path)
