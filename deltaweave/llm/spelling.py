"""Spelling variants grouped by full neighbourhood generation.

Words are counted in DataFrame functions, summed before they are shuffled. For each word all distinct strings one edit away are made: every deletion,
every replacement and every insertion over the alphabet that the vocabulary has. A string that is itself a word is a near word, so the join
on equality with the vocabulary finds exactly the near pairs, and no distance is worked out.

A word of L letters has about (2L + 1) * |alphabet| such strings, nearly all of them no word. Each string's hash follows from the word's prefix sums
without the string being made, and a bit map of the vocabulary's hashes, of fixed size, lets few others through: only what passes is
made, shuffled and joined. A vocabulary beyond the bit map's size makes it less selective and never wrong.

A word's form is its near word of largest count (of equal ones the smallest by code point) if that has `ratio` times the word's count at least; counts grow by
that factor from word to form, so forms have no cycles and the chains that lead to a root are no longer than the logarithm of the largest count.

Null texts have no words and a null id counts as the empty string; rows that share an id are texts of their own, and repeated rows count each; an empty
table gives an empty result; texts of any length count in full; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop
from .words import mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "([A-Za-z\\u00C0-\\u00FF]+)"
#: Words whose neighbourhoods are made at once.
AT_ONCE = 512
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Spelling:
    """A word has `letters` code points and `occurrences` at least; a form has `ratio` times its word's count. Every `slip`-th (text, run) by hash loses
    a code point, 0 for none; the bit map has 2**map_bits bits."""

    letters: int = 6
    occurrences: int = 5
    ratio: int = 5
    slip: int = 199
    map_bits: int = 26


def word_counts(df: DataFrame, rules: Spelling = Spelling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the vocabulary."""
    docs = df.select(F.coalesce(df[id_col].cast("string"), F.lit("")).alias("id"), df[text_col].alias("text"))
    runs = docs.select("id", F.explode(F.regexp_extract_all("text", F.lit(RUN), 1)).alias("run")).where(F.char_length("run") >= rules.letters)
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if rules.slip:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        word = F.when(F.col("h") % rules.slip == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(word)
    words = runs.select(word.alias("word")).where(F.char_length("word") >= rules.letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= rules.occurrences)


def alphabet_of(words: DataFrame) -> list[str]:
    """Every code point that a word has: at most as many as RUN admits."""
    return sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect())


class Letters:
    """Hashes of words of one length from codes of letters: the sum of code * base**place, spread, with the length mixed in."""

    def __init__(self, alphabet: list[str]):
        self.points = np.array([ord(c) for c in alphabet], np.int64)
        self.code = mix(self.points.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

    @staticmethod
    def power(n: int) -> np.ndarray:
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))

    def spread(self, sums: np.ndarray, length: int) -> np.ndarray:
        return mix(sums + np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64)))

    def rows(self, words: list[str]) -> np.ndarray:
        """Words of one length as places in the alphabet."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64).reshape(len(words), -1)
        return np.searchsorted(self.points, points)

    def hashes(self, rows: np.ndarray) -> np.ndarray:
        return self.spread((self.code[rows] * self.power(rows.shape[1])[: rows.shape[1]]).sum(axis=1, dtype=np.uint64), rows.shape[1])

    def neighbours(self, rows: np.ndarray):
        """For deletions, replacements and insertions: (kind, hashes, which are distinct strings), with a row a word, a column a place and, for the
        last two, a layer a letter."""
        m, size = rows.shape
        power, own = self.power(size + 1), self.code[rows]
        terms = own * power[:size]
        before = np.zeros((m, size + 1), np.uint64)
        np.cumsum(terms, axis=1, dtype=np.uint64, out=before[:, 1:])
        total = before[:, -1:]
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        gone = before[:, :-1] + (total - before[:, 1:]) * inverse
        first = np.ones((m, size), bool)
        first[:, 1:] = rows[:, 1:] != rows[:, :-1]  # of a run of one letter, one deletion
        yield "delete", self.spread(gone, size - 1), first
        letters = np.arange(len(self.code))
        put = (total - terms)[:, :, None] + self.code * power[:size, None]
        yield "replace", self.spread(put, size), rows[:, :, None] != letters
        put = (before + (total - before) * _BASE)[:, :, None] + self.code * power[: size + 1, None]
        new = np.ones(put.shape, bool)
        new[:, 1:] = rows[:, :, None] != letters  # a letter before an equal one is the same as after it
        yield "insert", self.spread(put, size + 1), new


def _edited(word: str, kind: str, at: int, letter: str) -> str:
    return word[:at] + (letter if kind != "delete" else "") + word[at + (kind != "insert") :]


def _bitmap(words: DataFrame, letters: Letters, map_bits: int) -> np.ndarray:
    """One bit a word's hash; sent to the driver as one row for each 64 bits that has one, 2**(map_bits - 6) rows at most."""
    shift = np.uint64(64 - map_bits)

    def run(batches):
        for batch in batches:
            found = batch.column(0).to_pylist()
            for size in sorted({len(w) for w in found}):
                h = (letters.hashes(letters.rows([w for w in found if len(w) == size])) >> shift).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h >> 6), pa.array(np.left_shift(np.int64(1), h & 63))], ["w", "x"])

    out = np.zeros(1 << (map_bits - 6), np.int64)
    rows = words.select("word").mapInArrow(run, "w long, x long").groupBy("w").agg(F.bit_or("x").alias("x"))
    for part in rows.toArrow().to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out


def near_words(words: DataFrame, rules: Spelling = Spelling()) -> DataFrame:
    """(word, near, n) of all ordered pairs of near words, n the near one's count; words (word, n) are distinct."""
    alphabet = alphabet_of(words)
    letters = Letters(alphabet)
    shift = np.uint64(64 - rules.map_bits)
    shared = words.sparkSession.sparkContext.broadcast(_bitmap(words, letters, rules.map_bits))  # of fixed size

    def run(batches):
        bits = shared.value
        for batch in batches:
            by_size: dict[int, list[str]] = {}
            for w in batch.column(0).to_pylist():
                by_size.setdefault(len(w), []).append(w)
            for size, group in by_size.items():
                step = max(1, AT_ONCE * 10 // size)
                for k in range(0, len(group), step):
                    some, source, made = group[k : k + step], [], []
                    for kind, h, distinct in letters.neighbours(letters.rows(some)):
                        slot = (h >> shift).astype(np.int64)
                        for x in np.argwhere(distinct & (((bits[slot >> 6] >> (slot & 63)) & 1) == 1)).tolist():
                            source.append(some[x[0]])
                            made.append(_edited(some[x[0]], kind, x[1], alphabet[x[2]] if len(x) > 2 else ""))
                    yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(made, pa.string())], ["word", "near"])

    candidates = words.select("word").mapInArrow(run, "word string, near string")
    return candidates.join(words.select(F.col("word").alias("near"), "n"), "near").select("word", "near", "n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: what is reached so far is followed twice as far each time, until nothing moves."""
    at = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = cut(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = now.where("moved").take(1)
        drop(at)
        at = now.drop("moved")
        at.folder = now.folder
        if not moved:
            return at


def spelling_variants(df: DataFrame, rules: Spelling = Spelling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, form, root, n_near, form_n) of every word; roots and words are written tables of the shared folder."""
    words = cut(word_counts(df, rules, id_col, text_col), "words")
    near = near_words(words, rules).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    joined = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= rules.ratio * F.col("n")
    told = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "told")
    drop(words)
    roots = _roots(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
