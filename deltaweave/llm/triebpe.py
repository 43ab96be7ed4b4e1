"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of every prefix of a word is known by its last token: what stands before that token
is the encoding of a shorter prefix. A token may be last where it ends the prefix and where it
and the last token of what precedes it stay two tokens when encoded together; exactly one token
does. So the distinct words go into a trie (as sorted words, of which each shares the path to its
longest common prefix with the word before), and one depth-first walk finds the last token at
every node; prefixes that words share are worked out once.

Nulls and empty texts have no tokens; rows are independent, so repeated rows, ties, empty
tables and other columns need no rule. Any length of text and of word works: the walk keeps one state for each byte of a word.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import TextEncoder, by_text
from .words import BLOCK, blocks

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, codes = spec["model"], byte_characters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(codes[c] for c in t) for t, i in model["vocab"].items() if i not in self.special.values()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        # Tokens by order of birth: the 256 bytes, then one for each merge.
        self.ids = [model["vocab"][c] for c, _ in sorted(codes.items(), key=lambda x: x[1])]
        self.born = {bytes([b]): b for b in range(256)}
        self.halves = [(b, b) for b in range(256)]
        self.merged: dict[int, int] = {}
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = bytes(codes[c] for c in a + b)
            left, right = (self.born[bytes(codes[c] for c in x)] for x in (a, b))
            if whole in self.born:
                raise ValueError(f"two merges make {whole!r}")
            self.merged[left << 20 | right] = self.born[whole] = len(self.ids)
            self.halves.append((left, right))
            self.ids.append(model["vocab"][a + b])
        self.width = [len(w) for w in self.born]
        self.pairs: dict[int, bool] = {}
        # Suffix steps, filled as they are met: states are the prefixes of tokens.
        self.states = {b"": 0} | {p: k + 1 for k, p in enumerate(dict.fromkeys(w[:n] for w in self.born for n in range(1, len(w) + 1)))}
        self.names = list(self.states)
        self.steps: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        size = max(self.bytes_of) + 1
        self.size = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens, encoded together, give these two tokens.

        They do unless some merge across the border comes before a merge that builds either side:
        take the border's tokens apart, the younger first, and look for a merge that is older than what was just taken apart.
        """
        limit = 1 << 30
        while True:
            if self.merged.get(a << 20 | b, limit) < limit:
                return False
            if a > b and a >= 256 or b < 256:
                if a < 256:
                    return True
                limit, a = a, self.halves[a][1]
            else:
                limit, b = b + 1, self.halves[b][0]

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """(longest prefix of a token that ends the text now, longest token that ends it)."""
        w = self.names[state] + bytes([byte])
        while w not in self.states:
            w = w[1:]
        out, t = self.states[w], w
        while t not in self.born:
            t = t[1:]
        self.steps[state << 8 | byte] = out, self.born[t]
        return out, self.born[t]

    def _shorter(self, token: int) -> int:
        """The next longest token that ends a token."""
        t = self._bytes(token)[1:]
        while t not in self.born:
            t = t[1:]
        self.shorter[token] = self.born[t]
        return self.born[t]

    def _bytes(self, token: int) -> bytes:
        return self.bytes_of[self.ids[token]]

    def walk(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of distinct words, sorted, by one depth-first walk of their trie."""
        out, pairs, ids, width, steps, shorter = [], self.pairs, self.ids, self.width, self.steps, self.shorter
        last, state, before = [-1], [0], b""
        for word in words:
            n, k = len(word), 0
            most = min(n, len(before))
            while k < most and word[k] == before[k]:
                k += 1
            del last[k + 1 :], state[k + 1 :]
            at = state[k]
            for end in range(k + 1, n + 1):
                byte = word[end - 1]
                at, token = steps.get(at << 8 | byte) or self._step(at, byte)
                while (length := width[token]) != end:
                    pair = last[end - length] << 20 | token
                    apart = pairs.get(pair)
                    if apart is None:
                        apart = pairs[pair] = self.stay_apart(pair >> 20, token)
                    if apart:
                        break
                    token = shorter.get(token) or self._shorter(token)
                last.append(token)
                state.append(at)
            found, end = [], n
            while end:
                token = last[end]
                found.append(ids[token])
                end -= width[token]
            found.reverse()
            out.append(found)
            before = word
        if len(pairs) > 2_000_000:
            pairs.clear()
        if len(steps) > 2_000_000:
            steps.clear()
        return out

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return self.walk([p.encode() for p in pieces])  # sorted: code point order is byte order in UTF-8

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids one after another, and where each id's bytes end."""
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[ids] - (ends - n), n)], ends


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> tuple[Vocabulary, TextEncoder]:
    v = Vocabulary(path)
    return v, TextEncoder(by_text(v.encode_pieces), v.special, pattern)


def encode_columns(column: pa.Array, path: str, pattern: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: (first row, end, ids, offsets of the rows in the ids)."""
    _, encoder = _coder(path, pattern)
    for i, j in blocks(column, 2 * BLOCK):
        yield i, j, *encoder.rows(column.slice(i, j - i))


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""

    def run(batches):
        for batch in batches:
            for i, j, ids, at in encode_columns(batch.column(1), path, pattern):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode the ids again: counts and digests of both. One pass, no shuffle."""

    def run(batches):
        for batch in batches:
            vocabulary, _ = _coder(path, pattern)
            for i, j, ids, at in encode_columns(batch.column(1), path, pattern):
                raw, ends = vocabulary.decode(ids)
                ends = np.concatenate([[0], ends])[at]
                little, raw = ids.astype("<u4").tobytes(), raw.tobytes()
                digests = [hashlib.sha256(little[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                decoded = [hashlib.sha256(raw[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, SCHEMA)
