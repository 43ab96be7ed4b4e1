"""Quality rules: simple counts of a text, and tokeniser fertility with rejection bands per script or language.

Fertility is what public vocabularies make of a text: code points per token, the share of tokens
that are single bytes for want of a piece (byte fallback), and the entropy of the tokens. Encoded data, mojibake, key mashing
and words with symbols glued on fall below in code points per token or above in byte share, filler below in entropy. The bands
of a language hold for its texts in Latin script and lie just below what labelled good text of that language measures (of sf0.1: FITTED);
other texts have the wider band of their script.

Words are encoded one by one, each distinct one once (both vocabularies split at white space). Null
and empty texts have no words and fail the base rules. Rows are independent of each other, so ties, repeated rows and
empty tables need no rule; other columns aren't read. Whole texts count, of any length.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import SpanStore, by_text
from .words import blocks, bounds, hashes, mix, text_bytes, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Scripts by the lead byte of their letters in UTF-8; the ASCII letters are Latin.
SCRIPTS = {"latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF], "cyrillic": [*range(0xD0, 0xD4)], "hebrew": [0xD6, 0xD7], "arabic": [*range(0xD8, 0xDC)], "indic": [0xE0], "cjk": [*range(0xE3, 0xEA)], "hangul": [*range(0xEA, 0xEE)]}
OTHER = len(SCRIPTS)
#: Distinct words whose tokens a worker holds: beyond that it starts anew, as junk gives ever new ones.
MOST_WORDS = 400_000
_SCRIPT_OF = np.full(256, OTHER, np.int8)
for _k, _leads in enumerate(SCRIPTS.values()):
    _SCRIPT_OF[_leads] = _k


@dataclass(frozen=True)
class Band:
    """What a text must lie within: code points per token, for both vocabularies; share of byte tokens; bits of entropy per token."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_bits: float
    least_byte_chars: float = 0.0  #: code points per byte-level token, where that limit is above least_chars


#: Code points per byte-level token: the least of labelled good texts of a language in sf0.1 (the first 5,000 documents), and the
#: limit, lower by a few hundredths. Median of those labelled bad: en 1.74, de 1.74, es 1.64, fr 1.60.
FITTED = {"en": (1.985, 1.93), "de": (2.171, 2.10), "es": (1.924, 1.87), "fr": (1.863, 1.81)}


@dataclass(frozen=True)
class Rules:
    piece_model: str
    byte_ranks: str
    pattern: str
    least_words: int = 50
    most_repeated: float = 0.5
    scripts: dict = field(
        default_factory=lambda: {
            "latin": Band(1.25, 9.0, 0.2, 3.0, 1.7),
            "greek": Band(0.6, 6.0, 0.5, 3.0),
            "cyrillic": Band(0.8, 7.0, 0.4, 3.0),
            "cjk": Band(0.25, 3.0, 0.9, 3.0),
            "hangul": Band(0.25, 3.0, 0.95, 3.0),
        }
    )
    #: Bands that go before the script's, by the language column, or by it and the script.
    languages: dict = field(default_factory=lambda: {(k, "latin"): Band(1.25, 9.0, 0.2, 3.0, least) for k, (_, least) in FITTED.items()})
    default: Band = Band(0.2, 12.0, 0.98, 2.5)


@lru_cache(maxsize=2)
def _vocabularies(piece_model: str, byte_ranks: str, pattern: str):
    import sentencepiece
    import tiktoken

    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    with open(byte_ranks, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    fallback = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])

    def encode(words: list[str]) -> list[list[int]]:
        # The number of byte-level tokens goes before the pieces.
        return [[len(b), *p] for b, p in zip(map(coder.encode_ordinary, (" " + w for w in words)), pieces.encode(words, num_threads=1), strict=True)]

    return SpanStore(by_text(encode), MOST_WORDS), fallback


def per_row(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask)])
    return c[at[1:]] - c[at[:-1]]


def _repeats(key: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order, found = np.argsort(key), np.zeros(len(key), bool)
    equal = key[order[1:]] == key[order[:-1]]
    found[order[1:][equal]] = found[order[:-1][equal]] = True
    return found


def _keyed(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def measure(column: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """All counts and measures of a block of texts."""
    encoder, fallback = _vocabularies(rules.piece_model, rules.byte_ranks, rules.pattern)
    data, at = text_bytes(column)
    rows = len(at) - 1
    starts, ends, before = bounds(data, at)
    chars = (data & 0xC0) != 0x80
    n_chars = per_row(chars, at)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    word_chars = per_row(chars & np.cumsum(inside[:-1]).astype(bool), at) if len(data) else np.zeros(rows, np.int64)
    h = hashes(data, starts, ends)

    # Lines: from a row's start or a newline to the next newline or the row's end.
    breaks = np.flatnonzero(data == 0x0A)
    first = np.sort(np.concatenate([at[:-1], breaks + 1]))
    last = np.sort(np.concatenate([breaks, at[1:]]))
    with_word = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last = first[with_word], last[with_word]
    row = np.searchsorted(at, first, "right") - 1
    _, new = np.unique(_keyed(hashes(data, first, last), row), return_index=True)
    dup_lines = np.bincount(row, minlength=rows) - np.bincount(row[new], minlength=rows)

    # Words in three-word windows that the text has more than once.
    n_words = np.diff(before)
    w, row = windows(h, before, 3)
    covered = np.zeros(len(h) + 2, bool)
    if len(w):
        inner = np.arange(len(h)) - np.repeat(before[:-1], n_words) < np.repeat(n_words - 2, n_words)
        place = np.flatnonzero(inner)[_repeats(_keyed(w, row))]
        covered[place] = covered[place + 1] = covered[place + 2] = True
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": per_row(SYMBOLS[data], at), "n_dup_lines": dup_lines, "n_repeat_words": per_row(covered[: len(h)], before)}

    # Fertility.
    ids, n = encoder.spans(data, starts, ends, h)
    heads = np.cumsum(n) - n
    byte_tokens = per_row(ids[heads], before) if len(n) else np.zeros(rows, np.int64)
    pieces = np.delete(ids, heads)
    at_piece = np.concatenate([[0], np.cumsum(n - 1)])[before]
    n_pieces = np.diff(at_piece)
    row = np.repeat(np.arange(rows), n_pieces)
    key = np.sort(row * len(fallback) + pieces)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.append(edge, len(key)))
    spread = np.bincount(key[edge] // len(fallback), weights=count * np.log2(np.maximum(count, 1)), minlength=rows)
    some = np.maximum(n_pieces, 1)
    out["chars_per_piece"] = word_chars / some
    out["chars_per_byte_token"] = word_chars / np.maximum(byte_tokens, 1)
    out["byte_share"] = per_row(fallback[pieces], at_piece) / some
    out["entropy"] = np.log2(some) - spread / some
    lead = _SCRIPT_OF[data]
    out["script"] = np.argmax(np.stack([per_row(lead == k, at) for k in range(OTHER)] + [np.zeros(rows, np.int64)]), axis=0)
    out["script"][n_chars == 0] = OTHER
    return out


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_piece double, chars_per_byte_token double, byte_share double, entropy double, script string"


def judge(m: dict[str, np.ndarray], langs: list, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    names = [*SCRIPTS, "other"]
    failed = (m["n_words"] < rules.least_words) | (m["n_repeat_words"] > rules.most_repeated * m["n_words"])
    own = [rules.languages.get(lang) or rules.languages.get((lang, names[s])) or rules.scripts.get(names[s], rules.default) for lang, s in zip(langs, m["script"].tolist(), strict=True)]
    least, most, share, bits, byte_chars = (np.array(x, float) for x in zip(*((b.least_chars, b.most_chars, b.most_bytes, b.least_bits, b.least_byte_chars) for b in own), strict=True)) if own else (np.empty(0),) * 5
    good = (m["byte_share"] <= share) & (m["entropy"] >= bits) & (m["chars_per_byte_token"] >= byte_chars)
    for k in ("chars_per_piece", "chars_per_byte_token"):
        good &= (m[k] >= least) & (m[k] <= most)
    return failed, ~failed & good


def measure_documents(df: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Counts, measures and verdict of every row; one pass without a shuffle."""

    def run(batches):
        for batch in batches:
            for i, j in blocks(batch.column(1)):
                m = measure(batch.column(1).slice(i, j - i), rules)
                failed, kept = judge(m, batch.column(2).slice(i, j - i).to_pylist(), rules)
                whole = [pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                parts = [pa.array(m[k].astype(float)) for k in ("chars_per_piece", "chars_per_byte_token", "byte_share", "entropy")]
                script = pa.array([[*SCRIPTS, "other"][s] for s in m["script"].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *whole, pa.array(failed), pa.array(kept), *parts, script], [c.split(" ")[0] for c in SCHEMA.split(", ")])

    lang = df[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"), lang.alias("lang")).mapInArrow(run, SCHEMA)


def keep_good(df: DataFrame, rules: Rules, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df that the rules keep, all columns as they are; no join, the verdict is formed where the row is."""
    place, lang = df.columns.index(text_col), df.columns.index(lang_col)

    def run(batches):
        for batch in batches:
            for i, j in blocks(batch.column(place)):
                part = batch.slice(i, j - i)
                _, kept = judge(measure(part.column(place), rules), part.column(lang).to_pylist(), rules)
                yield part.filter(pa.array(kept))

    return df.mapInArrow(run, df.schema)


def fit_bands(docs: DataFrame, labels: DataFrame, rules: Rules, margin: float = 0.055, bound: int = 20_000, least_texts: int = 30) -> dict[tuple[str, str], Band]:
    """Bands by language and script, to be Rules.languages: that of the script, with the limit of code points per byte-level token a margin below the least that a
    good text has. FITTED was made so from sf0.1's first 5,000 documents.

    Good texts are those labelled (doc_id, quality 1) that pass the base rules, the `bound` of smallest id hash at most; a language and script with
    fewer than least_texts of them gets no band. Rows without an id or a language aren't learned from; an id with several labels is good if all are.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    chosen = docs.join(F.broadcast(good), "doc_id", "left_semi").where("lang is not null")  # bound ids at most
    found = measure_documents(chosen, rules).where("not base_failed").join(chosen.select("doc_id", "lang"), "doc_id")
    limits = found.groupBy("lang", "script").agg(F.min("chars_per_byte_token").alias("least"), F.count("*").alias("n")).where(F.col("n") >= least_texts)
    return {(r["lang"], r["script"]): replace(rules.scripts.get(r["script"], rules.default), least_byte_chars=round(r["least"] - margin, 3)) for r in limits.collect()}  # a row a language and script
