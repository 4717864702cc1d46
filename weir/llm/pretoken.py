"""Byte-level BPE of whole batches, in which each distinct word is encoded once.

A byte-level pre-tokenizer splits a text into words of letters, of digits or of other signs, each with the space
before it, and never merges across these bounds. Two kinds of places are always such bounds, whatever stands around:

- before a space that follows a sign which is no white space: no word has a space but as its first character;
- between an ASCII letter or digit (or a letter of the Latin-1 block) and an ASCII sign other than an apostrophe.

The tokenizer's added tokens, such as an end-of-text mark written out in a text, come before all that: they are found
first, leftmost and then longest, and each is a piece of its own, as the library takes it.

Texts are cut there, with numpy, for a whole batch at once. The pieces are looked up by their 64-bit hashes in a
worker's cache, and the tokenizers library encodes those that it hasn't met: a piece of letters alone is one word, so
the model takes it without the pre-tokenizer's search; others go the whole way. Signs that end in a byte that could
end a white-space character are not cut at, which costs only some reuse.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd

from . import bytesops as B

#: Pieces that a worker remembers; beyond, it starts afresh.
REMEMBERED = 1_000_000

_printable = (B.BYTES > 0x20) & (B.BYTES < 0x7F)
_letter = (B.LOWER >= 0x61) & (B.LOWER <= 0x7A)
_alnum = ((B.LOWER >= 0x61) & (B.LOWER <= 0x7A)) | ((B.BYTES >= 0x30) & (B.BYTES <= 0x39))
#: ASCII signs that are neither letters, digits nor the apostrophe, which starts contractions.
_sign = _printable & ~_alnum & (B.BYTES != 0x27)
#: The first bytes of two-byte characters of which none is white space (0xC2 has two).
_two_byte = (B.BYTES >= 0xC3) & (B.BYTES <= 0xDF)


def vocabulary_size(path: str) -> int:
    return _tokenizer(path).get_vocab_size(with_added_tokens=True)


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    kinds = json.loads(found.to_str())
    if (kinds["pre_tokenizer"] or {}).get("type") != "ByteLevel" or kinds["normalizer"] or kinds["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("only byte-level tokenizers without normaliser and added prefix space can be cut into words")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in kinds["added_tokens"]):
        raise ValueError("only added tokens that match by their own characters alone can be cut out of texts")
    return found


@lru_cache(2)
def _added(path: str) -> re.Pattern[bytes] | None:
    """Matches the added tokens, at one place the longest."""
    found = sorted((t["content"].encode() for t in json.loads(_tokenizer(path).to_str())["added_tokens"]), key=len, reverse=True)
    return re.compile(b"|".join(map(re.escape, found))) if found else None


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte: itself where it is printable Latin-1 (but for the
    soft hyphen), and else, in ascending order, the signs from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_signs = _byte_signs()


def letters(data: np.ndarray) -> np.ndarray:
    """For each byte, whether it belongs to an ASCII letter or to one of the Latin-1 block."""
    out = _letter[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = True
    return out


def cuts(data: np.ndarray) -> np.ndarray:
    """For each byte, whether a piece starts there for certain."""
    out = np.zeros(len(data), bool)
    if len(data) < 2:
        return out
    if len(data) > 2 * B.STRETCH:  # each stretch with the two bytes before it
        for a in range(0, len(data), B.STRETCH):
            low = max(0, a - 2)
            out[a : a + B.STRETCH] = cuts(data[low : a + B.STRETCH])[a - low :]
        return out
    before, here = data[:-1], data[1:]
    pair = np.zeros(len(before), bool)  # ends a two-byte character that is no white space
    pair[1:] = _two_byte[before[:-1]]
    latin = np.zeros(len(before), bool)
    latin[1:] = (before[:-1] == 0xC3) & (before[1:] != 0x97) & (before[1:] != 0xB7)
    out[1:] = ((here == 0x20) & (_printable[before] | pair)) | (_sign[here] & (_alnum[before] | latin))
    return out


class Encoder:
    """Encodes batches; holds the pieces it has met."""

    def __init__(self, path: str):
        self.tokenizer, self.added = _tokenizer(path), _added(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[i + 1]: the end of piece i in ids

    def _learn(self, keys: list[int], pieces: list[bytes], one_word: list[bool]) -> None:
        first = len(self.known)
        others = iter(self.tokenizer.encode_batch_fast([x.decode() for x, w in zip(pieces, one_word, strict=True) if not w], add_special_tokens=False))
        tokenize = self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize(x.decode("latin-1").translate(_signs))] if w else next(others).ids for x, w in zip(pieces, one_word, strict=True)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        at = self.ends[first]
        while len(self.ends) < first + len(found) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ends[first + 1 : first + 1 + len(found)] = at + np.cumsum(lengths)
        n = int(lengths.sum())
        while len(self.ids) < at + n:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[at : at + n] = np.fromiter((x for ids in found for x in ids), np.uint32, n)
        self.known.update(zip(keys, range(first, first + len(found)), strict=True))

    def _cut_added(self, data: np.ndarray, offsets: np.ndarray, starts_here: np.ndarray) -> None:
        """Makes each added token in a text one piece."""
        raw = data.tobytes()
        if self.added is None or not self.added.search(raw):
            return
        for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            for m in self.added.finditer(raw, first, last):
                starts_here[m.start() : m.end()] = False
                starts_here[m.start()] = True
                if m.end() < len(raw):
                    starts_here[m.end()] = True

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """data: the bytes of several texts; offsets: their n + 1 bounds. Returns all ids, with end_id after each
        text, and for each text the number of ids up to and with it."""
        starts_here = cuts(data)
        self._cut_added(data, offsets, starts_here)
        starts_here[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(starts_here)
        if len(offsets) > 2 or len(data) <= 2 * B.STRETCH:
            return self._encode(data, offsets, end_id, starts)
        # One long text, in stretches that begin where a piece does.
        begins = [0]
        while begins[-1] < len(data):
            at = int(np.searchsorted(starts, begins[-1] + B.STRETCH))
            begins.append(int(starts[at]) if at < len(starts) else len(data))
        parts = []
        for a, b in zip(begins, begins[1:], strict=False):
            here = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a
            parts.append(self._encode(data[a:b], np.array([0, b - a]), end_id, here)[0][:-1])
        ids = np.append(np.concatenate(parts), np.uint32(end_id))
        return ids, np.array([len(ids)])

    def _encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        if len(starts):
            hashes = B.hashes(data, starts, ends, B.SYMBOL)
            codes, keys = pd.factorize(hashes)
            if len(self.known) + len(keys) > REMEMBERED:
                self._forget()
            number = self.known.get
            found = [number(k, -1) for k in keys.tolist()]
            entry = np.array(found, np.int64)
            if len(missing := np.flatnonzero(entry < 0)):
                first = np.zeros(len(keys), np.int64)
                first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
                raw, at = data.tobytes(), first[missing]
                pieces = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                n_letters = np.concatenate([np.zeros(1, np.int64), np.cumsum(letters(data))])
                n_letters = n_letters[ends[at]] - n_letters[starts[at]]
                one_word = (n_letters > 0) & (n_letters == ends[at] - starts[at] - (data[starts[at]] == 0x20))
                entry[missing] = np.arange(len(self.known), len(self.known) + len(missing))
                self._learn(keys[missing].tolist(), pieces, one_word.tolist())
            entry = entry[codes]
            lengths = self.ends[entry + 1] - self.ends[entry]
        else:
            entry = lengths = np.zeros(0, np.int64)
        done = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        # Ids before each text's end, without and with the end ids.
        upto = done[np.searchsorted(starts, offsets[1:])]
        total = int(done[-1])
        source = np.arange(total) + np.repeat(self.ends[entry] - done[:-1], lengths)
        out = np.full(total + n, end_id, np.uint32)
        gap = np.ones(total + n, bool)
        gap[upto + np.arange(n)] = False
        out[gap] = self.ids[source]
        return out, upto + np.arange(1, n + 1)
