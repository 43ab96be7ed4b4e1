"""Encode texts by their distinct pieces.

A byte-level vocabulary's pattern cuts a text into pieces that are encoded one by one. Texts of ASCII and Latin letters
are cut here by the classes of their bytes, for whole blocks at once; texts with any other byte, and
with an apostrophe that may start a contraction, are cut by the pattern itself. Equal pieces are encoded once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from .words import hashes, text_bytes

#: The pattern whose pieces the classes give: a contraction; letters, numerals or other signs, with a space before them; white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE, LETTER, NUMERAL, SIGN, OTHER = range(5)
CLASS = np.full(256, OTHER, np.int8)
CLASS[0x21:0x7F] = SIGN
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASS[0x30:0x3A] = NUMERAL
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
CLASS[0xC3:0xCA] = LETTER  # leads of U+00C0 to U+027F, which are letters but for the signs of multiplication and division
CLASS[0x80:0xC0] = LETTER  # what follows a lead; other leads are of class OTHER
AFTER_QUOTE = np.zeros(256, bool)
AFTER_QUOTE[list(b"stmrvld")] = True


#: New spans to encode, as bytes with starts and ends; out come ids, and where each span's ids start and how many they are.
Encoder = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def by_text(encode: Callable[[list[str]], list[list[int]]]) -> Encoder:
    """An encoder that gets sorted lists of texts."""

    def run(data, starts, ends):
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        order = sorted(range(len(texts)), key=texts.__getitem__)
        found = encode([texts[i] for i in order])
        start, length = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        n = np.fromiter(map(len, found), np.int64, len(found))
        start[order], length[order] = np.cumsum(n) - n, n
        return np.fromiter((i for f in found for i in f), np.int32, int(n.sum())), start, length

    return run


class SpanStore:
    """Token ids of distinct spans by their hash; `encode` gets the new ones of a block.

    At most `most` spans are held, in flat sorted arrays; beyond that the store starts anew, so memory stays bounded
    whatever the vocabulary of the texts.
    """

    def __init__(self, encode: Encoder, most: int = 2_000_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.start, self.length = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        hit[inside] = self.keys[at[inside]] == keys[inside]
        return at, hit

    def _add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        flat, start, length = self.encode(data, starts, ends)
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        at, start = np.searchsorted(self.keys, keys), start + self.used
        self.used += len(flat)
        self.keys, self.start, self.length = (np.insert(old, at, new) for old, new in ((self.keys, keys), (self.start, start), (self.length, length)))

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans one after another, number of ids of each); keys are the spans' hashes."""
        if not len(keys):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
        at, hit = self._find(keys)
        if not hit.all():
            new = ~hit
            if len(self.keys) + int(new.sum()) > self.most and len(self.keys):
                self._clear()
                new[:] = True
            self._add(keys[new], data, starts[first[new]], ends[first[new]])
            at, _ = self._find(keys)
        n, begin = self.length[at][which].astype(np.int64), self.start[at][which].astype(np.int64)
        ends = np.cumsum(n)
        return self.ids[np.arange(int(ends[-1])) + np.repeat(begin - (ends - n), n)], n


class TextEncoder:
    """Token ids of string columns by a byte-level vocabulary; special tokens in a text are tokens."""

    def __init__(self, encode: Encoder, special: dict[str, int], pattern: str = PATTERN):
        self.store, self.special, self.pattern, self.plain = SpanStore(encode), special, regex.compile(pattern), pattern == PATTERN

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, offsets of the rows in them)."""
        data, at = text_bytes(column)
        if self.special:
            raw = data.tobytes()
            if any(s.encode() in raw for s in self.special):
                return self._apart(column)
        return self._rows(data, at)

    def _apart(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows with special tokens: the texts between these are texts of their own."""
        parts, marks, row = [], [], []
        for i, text in enumerate(column.to_pylist()):
            rest = text or ""
            while rest:
                here, mark = min(((p, s) for s in self.special if (p := rest.find(s)) >= 0), default=(len(rest), None))
                parts.append(rest[:here])
                marks.append(-1 if mark is None else self.special[mark])
                row.append(i)
                rest = rest[here + len(mark or "") :]
        ids, at = self._rows(*text_bytes(pa.array(parts, pa.string())))
        marks, row = np.array(marks, np.int64), np.array(row, np.int64)
        out = np.insert(ids, at[1:][marks >= 0], marks[marks >= 0])
        ends = np.concatenate([[0], np.cumsum(np.diff(at) + (marks >= 0))])
        return out.astype(np.int32), ends[np.searchsorted(row, np.arange(len(column) + 1))]

    def _cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where pieces start."""
        kind = CLASS[data]
        sign = np.flatnonzero(data[:-1] == 0xC3)
        kind[sign[np.isin(data[sign + 1], (0x97, 0xB7))]] = OTHER
        quote = np.flatnonzero(data[:-1] == 0x27)
        kind[quote[AFTER_QUOTE[data[quote + 1]]]] = OTHER
        begin = at[:-1][np.diff(at) > 0]
        blank = kind == SPACE
        cut = np.ones(len(data), bool)
        # A change of class cuts, but not between a space and what it stands before.
        cut[1:] = (kind[1:] != kind[:-1]) & ((data[:-1] != 0x20) | blank[1:])
        # White space right before anything else is cut from the white space before it.
        last = blank.copy()
        last[:-1] &= ~blank[1:]
        last[begin[1:] - 1] = False
        last[-1] = False
        cut |= last
        cut[begin] = True
        odd = np.flatnonzero(kind == OTHER) if self.plain else begin
        for r in np.unique(np.searchsorted(at, odd, "right") - 1).tolist():
            a, b = int(at[r]), int(at[r + 1])
            sizes = [len(p.encode()) for p in self.pattern.findall(data[a:b].tobytes().decode())]
            cut[a:b] = False
            cut[a + np.cumsum(sizes) - sizes] = True
        return np.flatnonzero(cut)

    def _rows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(at), np.int64)
        starts = self._cuts(data, at)
        ends = np.append(starts[1:], len(data))
        ids, n = self.store.spans(data, starts, ends, hashes(data, starts, ends))
        return ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, at)]
