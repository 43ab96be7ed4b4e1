"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into the bits of multiword Shift-And masks and run at once over each
canonical URL, which is "." + host + path: one shift, two ands and an or for each byte and word, whatever the
number of rules. In a glob, `*` stands for any bytes but `/` and `**` for any bytes; a glob fits where it covers the whole
URL. A position's bit says that the rule fits up to there; a wildcard is a bit that keeps itself on bytes it takes.

A host rule (host, path) is the glob `*.host` + path + `**`: the host itself and its subdomains,
and paths that start with the rule's. Of the host rules that fit, the longest wins; of equally long ones, the first. Where none
fits, the verdict is the method's: block if a block glob fits, else allow.

Null URLs and URLs without `://` have an empty host and path, and no rule; globs are tried on "." then.
Every URL is read to its end. Rows are independent; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, host string, path string, rule string, verdict string"
SPECIAL = "*?#/"


@dataclass(frozen=True)
class HostRule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


#: Paths and hosts that pages of boilerplate, adverts and machine endpoints have; fits go over the canonical URL.
BLOCK_GLOBS = ("**/wp-admin/**", "**/wp-login.php**", "**/cgi-bin/**", "**/login", "**/login/**", "**/signup/**", "**/cart/**", "**/checkout/**", "**/ads/**", "**/adserver/**", ".ads.*/**", ".adserver.*/**", "**.exe", "**.zip", "**.css", "**.js")


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: what is between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end. Both
    are empty where there is no `://`."""
    url = F.coalesce(url, F.lit(""))
    host, path = F.regexp_extract(url, "://([^/?#]*)", 1), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class Automaton:
    """Globs in one bit row: tables of the bits that take a byte, of the bits that stay on it, of starts and of ends."""

    def __init__(self, globs: Sequence[str]):
        steps: list[tuple[str, int]] = []  # ("byte", b), ("any", slash too) for each bit
        first, last = [], []
        for g in globs:
            raw, k = g.encode(), 0
            first.append(len(steps))
            while k < len(raw):
                if raw[k : k + 1] == b"*":
                    wide = raw[k + 1 : k + 2] == b"*"
                    steps.append(("any", int(wide)))
                    k += 2 if wide else 1
                else:
                    steps.append(("byte", raw[k]))
                    k += 1
            last.append(len(steps) - 1)
            if first[-1] > last[-1]:
                raise ValueError("an empty glob fits nothing")
        self.words = len(steps) // 64 + 1
        self.take, self.stay = (np.zeros((256, self.words), np.uint64) for _ in range(2))
        self.begin, self.stars = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.last = last
        for k, (kind, x) in enumerate(steps):
            bit, w = np.uint64(1) << np.uint64(k % 64), k // 64
            if kind == "byte":
                self.take[x, w] |= bit
            else:
                self.stars[w] |= bit
                takes = np.arange(256) if x else np.array([b for b in range(256) if b != 0x2F])
                self.stay[takes, w] |= bit
        for k in first:
            self.begin[k // 64] |= np.uint64(1) << np.uint64(k % 64)
        starts = np.zeros(len(steps) + 64, bool)
        starts[first] = True
        self.inner = ~self._pack(starts)  # where a shift may carry into: not a rule's first bit

    def _pack(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for k in np.flatnonzero(flags):
            out[k // 64] |= np.uint64(1) << np.uint64(k % 64)
        return out

    @staticmethod
    def _shift(state: np.ndarray) -> np.ndarray:
        out = state << np.uint64(1)
        out[:, 1:] |= state[:, :-1] >> np.uint64(63)
        return out

    def _open(self, state: np.ndarray, entered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A wildcard's bit is set as soon as what precedes it has fitted, since it may take nothing; then what follows it may begin.

        Returns the state with the bits that this sets, and the bits that the next byte may enter."""
        while True:
            new = entered & self.stars & ~state
            if not new.any():
                return state, entered
            state = state | new
            entered = entered | (self._shift(new) & self.inner)

    def run(self, texts: list[bytes]) -> np.ndarray:
        """fits[i, k]: whether glob k covers text i. Texts go in order of length, so that ended ones drop out."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        n = lengths[order]
        state = np.zeros((len(texts), self.words), np.uint64)
        state, entered = self._open(state, np.broadcast_to(self.begin, state.shape).copy())
        at = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        data = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        for k in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -k))  # texts longer than k
            byte = data[at[:live] + k]
            s = (entered[:live] & self.take[byte]) | (state[:live] & self.stay[byte])
            # A wildcard left on this byte may still have let what follows it begin before; that is in entered already.
            s, e = self._open(s, self._shift(s) & self.inner)
            state[:live], entered[:live] = s, e
        fits = np.empty((len(texts), len(self.last)), bool)
        for k, bit in enumerate(self.last):
            fits[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return fits


def judge_urls(df: DataFrame, rules: Sequence[HostRule], block_globs: Sequence[str] = BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, winning rule and verdict of every row; one pass without a shuffle."""
    ranked = sorted(rules, key=lambda r: -len(r.name))
    for r in ranked:
        if "*" in r.name:
            raise ValueError("host rules are plain texts")
    machine = Automaton([r.glob for r in ranked] + list(block_globs)) if ranked or block_globs else None
    names, actions = [r.name for r in ranked], [r.action for r in ranked]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                both = pa.compute.binary_join_element_wise(".", part.column(1), part.column(2), "").cast(pa.binary()).to_pylist()
                fits = machine.run(both) if machine else np.zeros((len(both), 0), bool)
                named, globbed = fits[:, : len(names)], fits[:, len(names) :].any(axis=1)
                found, which = named.any(axis=1).tolist(), (named.argmax(axis=1) if names else np.zeros(len(both), int)).tolist()
                rule = [names[w] if f else None for f, w in zip(found, which, strict=True)]
                verdict = [actions[w] if f else "block" if g else "allow" for f, w, g in zip(found, which, globbed.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *(pa.array(x, pa.string()) for x in (rule, verdict))], [c.split(" ")[0] for c in SCHEMA.split(", ")])

    host, path = canonical(df[url_col])
    return df.select(df[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path")).mapInArrow(run, SCHEMA)
