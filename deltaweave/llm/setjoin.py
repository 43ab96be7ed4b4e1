"""Exact n-gram Jaccard join with skipping by the relations of sets.

A text's set is its distinct n-word shingles (64-bit hashes), A-Z lower-cased; a text of fewer words has one
shingle, all its words; a text without words has the empty set, which is linked with nothing. Two
texts link when den * |intersection| >= num * |union|.

1. A sketch of fixed size counts shingles over all texts; each set's elements are put in order of these
   counts, the rare ones first. Two sets that link share an element of their prefixes, the first
   n - ceil(num / den * n) + 1 elements.
2. Equal sets become one class, whose answers are those of its first document.
3. The index: for each prefix element, the list of (size, position) of the sets that have it. Entries that fit no other by these go.
4. Answers from similar sets: neighbours in the lists and then nearest sets by sketch, checked first and exactly, give
   components. A set's links within its component are settled by that, so only pairs across components remain.
5. Lists that lie within one component are skipped whole. The others are cut into blocks of equal
   size and position, and a block is skipped if what follows its position can't reach the overlap asked for. Within a list, a
   set's candidates are derived from those of the first set of its component: where a sketch of parities puts the first
   set more than the limit and their own difference apart from another set, that set is out for this one too. Long lists are
   dealt to tiles: the entries of the component that has most of them against the others, and the others against each other.
6. What is left is checked exactly. Where several sets of a component have the same candidate, the overlap of the component's first set
   with it is computed once, from whole sets; those of the others follow from it by the elements in which they differ from the first.

Only hashes of prefixes, sketches and the packed texts of candidate pairs are shuffled, and no pairs within a component are
formed. Null ids stand for themselves (component null unless a linked document has an id); rows that share an id are documents of
their own with the same label; ties don't arise; an empty table gives an empty result; a text of any length is a set like others; other
columns aren't read. Two different sets are taken for equal if their 64-bit hashes are. Tables on the way are deleted as soon as
what they are for is written; the labels stay in the shared folder, as the result reads them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components
from .shared import cut, drop
from .words import blocks, bounds, hashes, mix, text_bytes, windows

SKETCH_BITS, SLICE, FAN_IN = 20, 1 << 14, 512
PARITY_BITS = 512
FILTER_BITS = 1 << 23
#: Lists longer than this are cut by size class and into tiles of TILE entries a side.
LONG = 512
TILE = 256
SHORT, ROWS = 64, 64
#: An element that some task has this often is looked at as one whose list may be long.
OFTEN = 8
_EVEN_BYTES, _LANES = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001)
#: Pairs whose sketches are gathered at once.
AT_ONCE = 1 << 14
#: Bytes of packed texts that are unpacked at once.
PACKED = 1 << 18


@dataclass(frozen=True)
class Terms:
    """Words in a shingle, and the least similarity num / den."""

    n: int = 5
    num: int = 80
    den: int = 100

    def overlap(self, x, y):
        """The least intersection of linked sets of sizes x and y."""
        return -(-self.num * (x + y) // (self.num + self.den))

    def prefix(self, x: int) -> int:
        return x + (-self.num * x // self.den) + 1


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, at = text_bytes(column)
    starts, ends, before = bounds(data, at)
    h = hashes(data, starts, ends, lower=True)
    w, row = windows(h, before, n)
    cut_at = np.searchsorted(row, np.arange(len(at)))
    out = []
    for i, (a, b) in enumerate(zip(cut_at[:-1].tolist(), cut_at[1:].tolist(), strict=True)):
        if a < b:
            out.append(np.unique(w[a:b]))
        else:
            words = h[before[i] : before[i + 1]]
            one = np.full(1, len(words), np.uint64)
            for x in words:
                one = mix(one * np.uint64(0xC2B2AE3D27D4EB4F) + x)
            out.append(one if len(words) else words)
    return out


def set_hash(s: np.ndarray) -> int:
    """The same for equal sets; signed."""
    return int(mix(np.array([np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) + np.uint64(len(s))], np.uint64)).astype(np.int64)[0])


def _parity(s: np.ndarray, width: int) -> bytes:
    return np.packbits((np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(bool)).tobytes()


def parities(sets: list[np.ndarray]) -> list[bytes]:
    """PARITY_BITS bits a set: how many elements fall on each, odd or even. Each element that only one of two sets has flips
    one bit, so sketches differ in no more bits than sets in elements."""
    return [_parity(s, PARITY_BITS) for s in sets]


def wide_parities(sets: list[np.ndarray]) -> list[bytes | None]:
    """The same with as many bits as a set has elements, up to the next power of two; null where parities() has that many."""
    return [_parity(s, 1 << (len(s) - 1).bit_length()) if len(s) > PARITY_BITS else None for s in sets]


def _apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ; the wider one is folded, as its bits modulo the lesser width add up to those."""
    x, y = (np.frombuffer(z, np.uint8) for z in (x, y))
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


class Parities:
    """How the join looks at classes before it has their sets: lists by prefix elements, and sketches of parities."""

    column, ordered, thin, long, tile = "prefix", True, False, LONG, TILE

    def __init__(self, terms: Terms):
        self.terms = terms

    def meets(self, e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of the lists e, by sketches, are that list's to give out."""
        return np.ones(len(e), bool)

    def elements(self, column: pa.Array) -> list[np.ndarray]:
        """What lists each class is in, from the column that says so."""
        return [np.frombuffer(p, "<i8") for p in column.to_pylist()]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of sketches of PARITY_BITS, row by row; they obey the triangle inequality. The counts of a row's eight words are added up as lanes of one."""
        counts = np.bitwise_count(x ^ y).view(np.uint64)[..., 0]
        pairs = (counts & _EVEN_BYTES) + ((counts >> np.uint64(8)) & _EVEN_BYTES)
        return ((pairs * _LANES) >> np.uint64(48)).astype(np.int64)

    def sketch(self, bits: np.ndarray) -> np.ndarray:
        """The part of a class's bits that apart() looks at."""
        return bits

    def most(self, nx, ny):
        """The largest distance of linked sets of these sizes."""
        return nx + ny - 2 * self.terms.overlap(nx, ny)

    def near(self, nx, bits_x, wide_x, ny, bits_y, wide_y) -> tuple[np.ndarray, np.ndarray]:
        """(may link, distance) of pairs by all that classes hold."""
        far, most = self.apart(self.sketch(_rows(bits_x)), self.sketch(_rows(bits_y))), self.most(nx, ny)
        for k in np.flatnonzero((far <= most) & ((nx > PARITY_BITS) | (ny > PARITY_BITS))).tolist():
            far[k] = _apart(*(w[k].as_py() if w[k].is_valid else b[k].as_py()[: PARITY_BITS // 8] for b, w in ((bits_x, wide_x), (bits_y, wide_y))))
        return far <= most, far


def _rows(column) -> np.ndarray:
    """A column of sketches of one length, a whole number of 64-bit words, as a matrix of those."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _frequencies(rows: DataFrame, n: int) -> np.ndarray:
    """Counts of shingle hashes modulo 2**SKETCH_BITS over all rows; summed up in a tree of tasks, 4 MiB in the end."""
    size = 1 << SKETCH_BITS

    def count(batches):
        total, seen = np.zeros(size, np.int64), False
        for batch in batches:
            for i, j in blocks(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(i, j - i), n)
                total += np.bincount((np.concatenate(sets) & np.uint64(size - 1)).astype(np.int64), minlength=size)
                seen = True
        if seen:
            part = TaskContext.get().partitionId() // FAN_IN
            slices = [np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in total.reshape(-1, SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(slices)), pa.int32()), pa.array([part] * len(slices), pa.int32()), pa.array(slices, pa.binary())], ["slice", "part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), "<u4")
        one = np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()
        return pa.table({"slice": table.column("slice").slice(0, 1), "part": pa.array([0], pa.int32()), "counts": pa.array([one], pa.binary())})

    schema = "slice int, part int, counts binary"
    counted = rows.mapInArrow(count, schema)
    once = counted.groupBy("slice", "part").applyInArrow(add, schema)
    out = np.zeros((size // SLICE, SLICE), np.uint32)
    for r in once.groupBy("slice").applyInArrow(add, schema).collect():  # 64 rows of 64 KiB, whatever the input
        out[r["slice"]] = np.frombuffer(r["counts"], "<u4")
    return out.reshape(-1)


DOCS = "doc_id long, n long, sid long, prefix binary, bits binary, wide binary"


def _documents(rows: DataFrame, terms: Terms, counts) -> DataFrame:
    def run(batches):
        order = counts.value
        for batch in batches:
            for i, j in blocks(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(i, j - i), terms.n)
                prefix, sid = [], []
                for s in sets:
                    if not len(s):
                        prefix.append(None)
                        sid.append(None)
                        continue
                    k = terms.prefix(len(s))
                    c = order[(s & np.uint64(len(order) - 1)).astype(np.int64)]
                    prefix.append(s[np.lexsort((s, c))[:k]].astype("<u8").tobytes())
                    sid.append(set_hash(s))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(list(map(len, sets)), pa.int64()), pa.array(sid, pa.int64()), pa.array(prefix, pa.binary()), pa.array(parities(sets), pa.binary()), pa.array(wide_parities(sets), pa.binary())], ["doc_id", "n", "sid", "prefix", "bits", "wide"])

    return rows.mapInArrow(run, DOCS)


def _postings(classes: DataFrame, measure) -> DataFrame:
    """(e, n, sid, pos) of every element that classes are listed by; pos is 0 where their order says nothing."""

    def run(batches):
        for batch in batches:
            for i, j in blocks(batch.column(2)):
                b = batch.slice(i, j - i)
                parts = measure.elements(b.column(2))
                m = np.fromiter(map(len, parts), np.int64, len(parts))
                ends = np.cumsum(m)
                pos = (np.arange(ends[-1]) - np.repeat(ends - m, m)) * int(measure.ordered)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), *(pa.array(np.repeat(b.column(c).to_numpy(), m)) for c in (1, 0)), pa.array(pos)], ["e", "n", "sid", "pos"])

    return classes.select("sid", "n", measure.column).mapInArrow(run, "e long, n long, sid long, pos long")


def _may_link(terms: Terms, nx, px, ny, py):
    """Sizes and positions (from 0) of a shared element allow a link."""
    least = terms.overlap(nx, ny)
    return (np.minimum(nx, ny) * terms.den >= np.maximum(nx, ny) * terms.num) & (np.minimum(nx - px, ny - py) >= least)


def _often(classes: DataFrame, measure) -> DataFrame:
    """(e, length): elements that a task holds OFTEN times at least, and how often those tasks do. Longer lists than OFTEN times the
    number of tasks are all among them, and no more than one in OFTEN entries is counted, without a shuffle of the others."""

    def run(batches):
        held, total = [], 0

        def often():  # a piece of a task counts as a task
            e, n = np.unique(np.concatenate(held), return_counts=True)
            e, n = e[n >= OFTEN], n[n >= OFTEN]
            for k in range(0, len(e), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(e[k : k + 65536]), pa.array(n[k : k + 65536])], ["e", "n"])

        for batch in batches:
            for i, j in blocks(batch.column(0)):
                held.append(np.concatenate(measure.elements(batch.column(0).slice(i, j - i))))
                total += len(held[-1])
                if total > 1 << 20:
                    yield from often()
                    held, total = [], 0
        if held:
            yield from often()

    return classes.select(measure.column).mapInArrow(run, "e long, n long").groupBy("e").agg(F.sum("n").alias("length")).where(F.col("length") > LONG)


def _lists(postings: DataFrame, often: DataFrame, terms: Terms) -> DataFrame:
    """Postings that sizes and positions allow a link with some other of their list, each with the nearest such set before it.

    That is seen for all short lists of a batch at once; entries of long lists all stay, with the set right before them. Lists known
    to be long are dealt out in parts of about LONG entries, as nothing is decided on them."""

    def decide(c):
        e, salt, n, sid, pos = c
        new = np.concatenate([[True], (e[1:] != e[:-1]) | (salt[1:] != salt[:-1])])
        number = np.cumsum(new)
        size = np.diff(np.append(np.flatnonzero(new), len(e)))
        long = np.repeat(size > SHORT, size) | (salt >= 0)
        keep, before, near = long.copy(), np.zeros(len(e), np.int64), np.zeros(len(e), bool)
        for d in range(1, min(SHORT, int(size.max()))):
            x = np.flatnonzero((number[d:] == number[:-d]) & ~long[d:]) if d > 1 else np.flatnonzero(number[1:] == number[:-1])
            if not len(x):
                break
            y = x + d
            good = (sid[x] != sid[y]) & _may_link(terms, n[x], pos[x], n[y], pos[y])
            x, y = x[good], y[good]
            keep[x] = keep[y] = True
            first = ~near[y]
            before[y[first]], near[y[first]] = sid[x[first]], True
        return pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in (e, n, sid, pos)), pa.array(before[keep], mask=~near[keep])], ["e", "n", "sid", "pos", "before"])

    def run(batches):
        held = None  # the last list so far, which may go on; a very long one is given out in parts, as all of it stays
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [x.to_numpy() for x in batch.columns]
            c = [np.concatenate(x) for x in zip(held, c, strict=True)] if held is not None else c
            open_list = (c[0] == c[0][-1]) & (c[1] == c[1][-1])
            last = int(np.searchsorted(open_list, True)) if not open_list[0] else 0
            if last == 0 and len(c[0]) > 1 << 17:
                last = len(c[0]) - 2 * SHORT
            if last:
                yield decide([x[:last] for x in c])
            held = [x[last:] for x in c]
        if held is not None:
            yield decide(held)

    part = F.when(F.col("length").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("sid"), F.ceil(F.col("length") / LONG)))
    dealt = postings.join(often, "e", "left").select("e", part.alias("salt"), "n", "sid", "pos")
    ordered = dealt.repartition("e", "salt").sortWithinPartitions("e", "salt", "n", "sid")
    return ordered.mapInArrow(run, "e long, n long, sid long, pos long, before long")


def _close(pairs: DataFrame, classes: DataFrame, measure) -> DataFrame:
    """Of distinct pairs (a, b) those that what classes hold allows a link, and how far apart they are."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [batch.column(k) for k in range(8)]
            keep, far = measure.near(c[1].to_numpy(), c[2], c[3], c[5].to_numpy(), c[6], c[7])
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([c[0].filter(keep), c[4].filter(keep), pa.array(far.astype(np.int64)).filter(keep)], ["a", "b", "far"])

    side = lambda s: classes.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"), F.col("wide").alias(f"wide_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "n_a", "bits_a", "wide_a", "b", "n_b", "bits_b", "wide_b")
    return both.mapInArrow(run, "a long, b long, far long")


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, far) those that are the least apart for one of the two; of equal ones that with the smallest other."""
    ways = pairs.union(pairs.select("b", "a", "far"))
    best = ways.groupBy("a").agg(F.min(F.struct("far", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _packed(wanted: DataFrame, rows: DataFrame, terms: Terms) -> DataFrame:
    """(sid, packed) of the sets wanted (sid, first_id): the compressed text of each one's first document, as a set made again from
    its text takes a third of the room of its hashes.

    A bit map of fixed size keeps most other texts from being shuffled; the join that follows lets no other through."""
    bit = F.pmod(F.xxhash64(F.coalesce("first_id", F.lit(0))), F.lit(FILTER_BITS))
    words = wanted.select(F.floor(bit / 64).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("x")).groupBy("w").agg(F.bit_or("x").alias("x"))
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():  # at most FILTER_BITS / 64 rows
        bitmap[r["w"]] = r["x"]
    bitmap = rows.sparkSession.sparkContext.broadcast(bitmap)
    marked = rows.withColumn("bit", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(FILTER_BITS)))

    def run(batches):
        bits, pack = bitmap.value, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            b = batch.column(2).to_numpy()
            chosen = batch.filter(pa.array((bits[b >> 6] >> (b & 63)) & 1 == 1))
            for i, j in blocks(chosen.column(1)):
                texts = chosen.column(1).slice(i, j - i)
                sets = shingle_sets(texts, terms.n)
                packed = [pack.compress(t.encode()) if t else b"" for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([chosen.column(0).slice(i, j - i), pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "sid", "packed"])

    made = marked.mapInArrow(run, "doc_id long, sid long, packed binary").alias("m")
    w = wanted.alias("w")
    found = made.join(w, (F.col("m.sid") == F.col("w.sid")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    return cut(found.select("m.sid", "packed").groupBy("sid").agg(F.min("packed").alias("packed")), "sets")


def _unpacked(columns: list[pa.Array], n: int):
    """The sets of each row's packed texts, row by row; equal texts that follow each other are unpacked once."""
    sizes = np.zeros(len(columns[0]) + 1, np.int64)
    for c in columns:
        sizes[1:] += pa.compute.binary_length(c).to_numpy(zero_copy_only=False)
    before, i, total = np.cumsum(sizes), 0, len(columns[0])
    while i < total:
        j = max(i + 1, int(np.searchsorted(before, before[i] + PACKED, "right")) - 1)
        made = {}
        for c in columns:
            for p in c.slice(i, j - i).to_pylist():
                made.setdefault(p)
        unpack = zstandard.ZstdDecompressor()
        made = dict(zip(made, shingle_sets(pa.array([unpack.decompress(p).decode() for p in made], pa.large_string()), n), strict=True))
        for k in range(i, j):
            yield tuple(made[c[k].as_py()] for c in columns)
        i = j


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted sets have in common."""
    merged = np.sort(np.concatenate([x, y]), kind="stable")
    return int((merged[1:] == merged[:-1]).sum())


def _overlaps(pairs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """(a, b, n_a, n_b, overlap) of pairs (a, b), by whole sets."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = np.array([(len(x), len(y), _shared(x, y)) for x, y in _unpacked([batch.column(2), batch.column(3)], n)], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(got[:, k]) for k in range(3))], ["a", "b", "n_a", "n_b", "overlap"])

    side = lambda s: sets.select(F.col("sid").alias(s), F.col("packed").alias(f"packed_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "packed_a", "packed_b")
    return both.mapInArrow(run, "a long, b long, n_a long, n_b long, overlap long")


def _derived(members: DataFrame, answers: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """(a, b, n_a, n_b, overlap) of members (a, root, b), from answers of the root: each element that a has beyond its root
    and b has too adds one to the root's overlap with b, and each that a lacks and b has takes one away."""

    def differ(batches):
        for batch in batches:
            if batch.num_rows:
                more, less = [], []
                for x, y in _unpacked([batch.column(1), batch.column(2)], n):
                    more.append(np.setdiff1d(x, y, assume_unique=True).astype("<u8").tobytes())
                    less.append(np.setdiff1d(y, x, assume_unique=True).astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(more, pa.binary()), pa.array(less, pa.binary())], ["a", "more", "less"])

    side = lambda s: sets.select(F.col("sid").alias(s), F.col("packed").alias(f"packed_{s}"))
    whole = members.select("a", "root").distinct().join(side("a"), "a").join(side("root"), "root").select("a", "packed_a", "packed_root")
    diffs = cut(whole.mapInArrow(differ, "a long, more binary, less binary"), "diffs")

    def update(batches):
        for batch in batches:
            if batch.num_rows:
                n_a, n_b, out = [], [], []
                size, told = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                for k, (y,) in enumerate(_unpacked([batch.column(6)], n)):
                    more, less = (np.frombuffer(batch.column(c)[k].as_buffer(), "<u8") for c in (4, 5))
                    n_a.append(size[k] + len(more) - len(less))
                    n_b.append(len(y))
                    out.append(told[k] + _shared(more, y) - _shared(less, y))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n_a, n_b, out))], ["a", "b", "n_a", "n_b", "overlap"])

    known = answers.select(F.col("a").alias("root"), "b", F.col("n_a").alias("n_root"), F.col("overlap").alias("told"))
    rows = members.join(known, ["root", "b"]).join(diffs, "a").join(side("b"), "b").select("a", "b", "n_root", "told", "more", "less", "packed_b")
    out = cut(rows.mapInArrow(update, "a long, b long, n_a long, n_b long, overlap long"), "derived")
    drop(diffs)
    return out


def _verify(pairs: DataFrame, labels: DataFrame, rows: DataFrame, classes: DataFrame, terms: Terms) -> DataFrame:
    """The pairs (a, b) that do link. Where several sets of a component (labels: sid, root) have the same b, only the root is held
    against b whole, whether it is among them or not, and the others' overlaps are derived."""
    rooted = cut(pairs.join(labels.select(F.col("sid").alias("a"), "root"), "a"), "asked")
    several = rooted.groupBy("root", "b").agg(F.count("*").alias("members")).where("members > 1").select("root", "b")
    several = cut(several, "several")
    plain = rooted.join(several, ["root", "b"], "left_anti").select("a", "b").union(several.select(F.col("root").alias("a"), "b"))
    ids = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).union(several.select(F.col("root").alias("sid"))).distinct()
    wanted = cut(ids.join(classes, "sid").select("sid", "first_id"), "wanted")
    sets = _packed(wanted, rows, terms)
    answers = cut(_overlaps(plain, sets, terms.n), "answers")
    derived = _derived(rooted.join(several, ["root", "b"], "left_semi").where("a <> root").select("a", "root", "b"), answers, sets, terms.n)
    found = answers.union(derived).where(f"{terms.num + terms.den} * overlap >= {terms.num} * (n_a + n_b)").select("a", "b")
    links = cut(found, "links")
    drop(rooted, several, wanted, sets, answers, derived)
    return links


#: Sides of an entry in a tile: the two that are held against each other, or a tile within which all are.
LEFT, RIGHT, WITHIN = 0, 1, 2


class _List:
    """One list of the index: its sets by size and position, and what may link across components."""

    def __init__(self, terms: Terms, measure, n, pos, sid, root, side, bits):
        order = np.lexsort((pos, n))
        self.measure, self.order, self.terms, self.n, self.pos, self.sid, self.root, self.side, self.bits = measure, order, terms, n[order], pos[order], sid[order], root[order], side[order], measure.sketch(bits)[order]

    def pairs(self, nearest: bool):
        """(x, y, distance) of entries of different components that may link, x that of the lesser component. If nearest, of many such pairs those that are
        the least apart for one of the two."""
        by_root = np.argsort(self.root, kind="stable")
        size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], np.diff(self.root[by_root]) != 0])), len(by_root)))
        alone = np.repeat(size == 1, size)
        yield from self._singles(np.sort(by_root[alone]), nearest)
        if (size > 1).any():
            yield from self._several(np.split(by_root[~alone], np.cumsum(size[size > 1])[:-1]))

    def _singles(self, entries: np.ndarray, nearest: bool):
        """Of entries that are alone of their component in the list, ROWS at a time against what sizes allow."""
        n, pos, terms = self.n, self.pos, self.terms
        for k in range(0, len(entries), ROWS):
            xs = entries[k : k + ROWS]
            lo = np.searchsorted(n, -(-n[xs[0]] * terms.num // terms.den))
            ys = np.arange(lo, np.searchsorted(n, n[xs[-1]] * terms.den // terms.num, "right"))
            x, y = np.nonzero((self.root[ys] > self.root[xs, None]) & ((self.side[ys] != self.side[xs, None]) | (self.side[xs, None] == WITHIN)))
            x, y = xs[x], ys[y]
            good = _may_link(terms, n[x], pos[x], n[y], pos[y])
            x, y = x[good], y[good]
            far = self.measure.apart(self.bits[x], self.bits[y])
            near = far <= self.measure.most(n[x], n[y])
            x, y, far = x[near], y[near], far[near]
            if nearest and len(x) > len(xs) + len(ys):
                none = np.iinfo(np.int64).max
                grid = np.full((len(xs), len(ys)), none)
                grid[np.searchsorted(xs, x), y - lo] = far
                best = np.concatenate([np.stack([np.arange(len(xs)), grid.argmin(axis=1)]), np.stack([grid.argmin(axis=0), np.arange(len(ys))])], axis=1)
                i, j = best[:, grid[best[0], best[1]] < none]
                x, y, far = xs[i], ys[j], grid[i, j]
            yield x, y, far

    def _several(self, components: list[np.ndarray]):
        """Of components with more entries, each derived from the first one of it."""
        n, pos, terms = self.n, self.pos, self.terms
        new = np.concatenate([[True], (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])])
        begin, block = np.flatnonzero(new), np.cumsum(new) - 1
        alive = {}
        for members in components:
            first = members[0]
            apart = self.measure.apart(self.bits, self.bits[first])
            for x in members:
                k = block[x]
                if k not in alive:
                    alive[k] = np.flatnonzero(_may_link(terms, n[x], pos[x], n[begin], pos[begin])[block])
                y = alive[k]
                y = y[(self.root[y] > self.root[x]) & ((self.side[y] != self.side[x]) | (self.side[x] == WITHIN))]
                most = self.measure.most(n[x], n[y])
                y, most = (z[apart[y] <= most + apart[x]] for z in (y, most))
                far = self.measure.apart(self.bits[y], self.bits[x])
                y, far = y[far <= most], far[far <= most]
                if len(y):
                    yield np.full(len(y), x), y, far


def _across(live: DataFrame, terms: Terms, measure, nearest: bool) -> DataFrame:
    """Candidate pairs of different components, from postings (e, part, tile, n, sid, pos, root, side, bits) in order of the first three; if
    nearest, of each list only the pair that is least apart for each set."""

    def short(key, n, pos, root, side, sketch):
        """All short lists at once: entries that stand d apart, for each d."""
        for d in range(1, SHORT):
            same = np.flatnonzero(key[d:] == key[:-d])
            if not len(same):
                return
            x, y = same, same + d
            good = (root[x] != root[y]) & ((side[x] != side[y]) | (side[x] == WITHIN)) & _may_link(terms, n[x], pos[x], n[y], pos[y])
            x, y = x[good], y[good]
            far = measure.apart(sketch[x], sketch[y])
            near = far <= measure.most(n[x], n[y])
            yield x[near], y[near], far[near]

    def work(c):
        key, n, sid, pos, root, side, bits = c
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        size = np.diff(np.append(edge, len(key)))
        number = np.repeat(np.arange(len(edge)), size)
        small = np.flatnonzero(np.repeat(size <= SHORT, size))
        for x, y, far in short(number[small], n[small], pos[small], root[small], side[small], measure.sketch(bits)[small]):
            yield small[x], small[y], far
        for a, s in zip(edge[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
            z = slice(a, a + s)
            if (root[z] != root[a]).any():
                ordered = _List(terms, measure, n[z], pos[z], sid[z], root[z], side[z], bits[z])
                for x, y, far in ordered.pairs(nearest):
                    yield a + ordered.order[x], a + ordered.order[y], far

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            c = [key, *(batch.column(k).to_numpy() for k in range(3, 8)), np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint64).reshape(batch.num_rows, -1)]
            if held is not None:
                c = [np.concatenate(x) for x in zip(held, c, strict=True)]
            last = int(np.flatnonzero((c[0] != c[0][-1]).any(axis=1))[-1]) + 1 if (c[0][0] != c[0][-1]).any() else 0
            held = [x[last:] for x in c]
            if last:
                yield from out([x[:last] for x in c])
        if held is not None:
            yield from out(held)

    def out(c):
        found = list(work(c))
        if found:
            x, y, far = (np.concatenate([f[k] for f in found]) for k in range(3))
            if nearest:
                entry, other, far = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([far, far])
                order = np.lexsort((other, far, entry))
                first = order[np.concatenate([[True], np.diff(entry[order]) != 0])] if len(order) else order
                x, y = entry[first], other[first]
            else:
                own = [measure.meets(c[0][i, 0], c[6][i], c[6][j]) for i, j in ((x[k : k + AT_ONCE], y[k : k + AT_ONCE]) for k in range(0, len(x), AT_ONCE))]
                x, y = (z[np.concatenate(own)] if own else z for z in (x, y))
            a, b = c[2][x], c[2][y]
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            for k in range(0, len(both), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(both[k : k + 65536, 0]), pa.array(both[k : k + 65536, 1])], ["a", "b"])

    return live.mapInArrow(run, "a long, b long")


def similar_documents(df: DataFrame, terms: Terms = Terms(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest id that links reach."""
    return _labelled(df, terms, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _labelled(df: DataFrame, terms: Terms, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, sid, root, component_id) of every row: its set's hash, and a hash that all sets of its component share."""
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    counts = df.sparkSession.sparkContext.broadcast(_frequencies(rows, terms.n))
    docs = cut(_documents(rows, terms, counts), "docs")
    return grouped(rows, docs, terms, Parities(terms))


def grouped(rows: DataFrame, docs: DataFrame, terms: Terms, measure) -> DataFrame:
    """(doc_id, n, sid, root, component_id) of docs (doc_id, n, sid, bits, wide and what measure lists classes by), which cut() wrote from rows
    (doc_id, text): every link among the pairs that share an element of measure's and are no further apart than it allows, confirmed on
    whole sets. docs are dropped."""
    classes = cut(docs.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in docs.columns if c not in ("doc_id", "sid"))), "classes")
    often = cut(_often(classes, measure), "often")
    live = cut(_lists(_postings(classes, measure), often, terms), "lists")
    drop(often)

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        """labels (sid, root) after links (a, b) between roots' sets."""
        side = lambda k: labels.select(F.col("sid").alias(k), F.col("root").alias(f"root_{k}"))
        edges = links.join(side("a"), "a").join(side("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        forest = components(edges)
        found = forest.select(F.col("node").alias("root"), F.col("root").alias("now"))
        out = cut(labels.join(found, "root", "left").select("sid", F.coalesce("now", "root").alias("root")), "labels")
        drop(labels, links, forest)
        return out

    step = float(np.log(terms.den / terms.num))
    group = F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("long")

    def across(labels: DataFrame, nearest: bool) -> DataFrame:
        rooted = cut(live.drop("before").join(labels, "sid"), "rooted")
        each = rooted.groupBy("e", "root").agg(F.count("*").alias("members"))
        mixed = each.groupBy("e").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.sum("members").alias("length"), F.max(F.struct("members", "root")).alias("main")).where("r0 <> r1")
        mixed = cut(mixed.select("e", "length", F.col("main.root").alias("main"), F.ceil(F.col("main.members") / measure.tile).alias("m"), F.ceil((F.col("length") - F.col("main.members")) / measure.tile).alias("k")), "mixed")
        # A long list's entries of its main component go to m tiles, the others to k; a tile of one is held against each of the k.
        is_main, own = F.col("root") == F.col("main"), F.pmod(F.xxhash64("sid"), F.when(F.col("root") == F.col("main"), F.col("m")).otherwise(F.col("k")))
        others = F.sequence(F.lit(0).cast("long"), F.col("k") - 1)
        tile = lambda x, y, side: F.struct((x * (F.col("m") + F.col("k")) + y).alias("tile"), F.lit(side).alias("side"))
        mine = F.transform(others, lambda v: tile(own, F.col("m") + v, LEFT))
        theirs = F.concat(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda u: tile(u, F.col("m") + own, RIGHT)),
            F.transform(others, lambda v: F.when(v == own, tile(F.col("m") + own, F.col("m") + own, WITHIN)).when(v > own, tile(F.col("m") + own, F.col("m") + v, LEFT)).otherwise(tile(F.col("m") + v, F.col("m") + own, RIGHT))),
        )
        whole = F.array(F.struct(F.lit(-1).cast("long").alias("tile"), F.lit(WITHIN).alias("side")))
        is_long = F.col("length") > measure.long
        dealt = rooted.join(mixed, "e").withColumn("part", F.explode(F.when(is_long, F.array(group, group + 1)).otherwise(F.array(F.lit(-1).cast("long")))))
        dealt = dealt.withColumn("t", F.explode(F.when(~is_long, whole).when(is_main, mine).otherwise(theirs)))
        keyed = dealt.join(classes.select("sid", "bits"), "sid").select("e", "part", "t.tile", "n", "sid", "pos", "root", F.col("t.side").cast("long").alias("side"), "bits")
        pairs = _across(keyed.repartition("e", "part", "tile").sortWithinPartitions("e", "part", "tile", "n", "pos"), terms, measure, nearest)
        found = cut(pairs.distinct(), "across")
        close = _close(found, classes, measure)
        out = cut(_nearest(close) if nearest and measure.thin else close.select("a", "b"), "close")
        drop(rooted, mixed, found)
        return out

    def joined(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        out = merged(labels, _verify(pairs, labels, rows, classes, terms))
        drop(pairs)
        return out

    # Neighbours in lists come first, then for each set what is nearest to it in its lists, by sketch, of other components: as
    # many pairs as postings at most, and nearly every component is whole after them. Then every pair across components that is left.
    near = live.where("before is not null").select(F.least("sid", "before").alias("a"), F.greatest("sid", "before").alias("b")).distinct()
    near = _close(near, classes, measure)
    near = cut(_nearest(near) if measure.thin else near.select("a", "b"), "near")
    labels = joined(cut(classes.select("sid", F.col("sid").alias("root")), "labels"), near)
    for nearest in (True, False):
        labels = joined(labels, across(labels, nearest))
    labelled = cut(classes.select("sid", "first_id").join(labels, "sid"), "labelled")
    drop(classes, live, labels)
    ids = cut(labelled.groupBy("root").agg(F.min("first_id").alias("component_id")), "ids")
    by_set = labelled.join(ids, "root").select("sid", "root", "component_id")
    out = docs.select("doc_id", "n", "sid").join(by_set, "sid", "left").select("doc_id", "n", "sid", "root", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = cut(out, "found")
    drop(docs, labelled, ids)
    return out


def keep_one(df: DataFrame, terms: Terms = Terms(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without those that links join to a smaller id; of a component's rows with its smallest id, one. Rows without
    an id stay, and so do those without a word. Columns of any name go through."""
    found = _labelled(df, terms, id_col, text_col).select("doc_id", "sid", "root", "component_id")
    taken = {c.lower() for c in df.columns}

    def name(wanted: str) -> str:
        """A name that no column of df has."""
        while wanted in taken:
            wanted += "_"
        return wanted

    gone_id, stay_id, own_sid, own_row = map(name, ("gone_id", "stay_id", "own_sid", "own_row"))
    many = cut(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(gone_id)), "many")
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias(gone_id)).distinct()
    if many.isEmpty():
        return df.join(gone, df[id_col] == gone[gone_id], "left_anti")
    # An id of several rows doesn't say which of them goes: these are told by their sets.
    gone = gone.union(many).distinct()
    rest = df.join(gone, df[id_col] == gone[gone_id], "left_anti")
    stay = found.join(many, F.col("doc_id") == F.col(gone_id)).where("component_id = doc_id and sid is not null").groupBy("doc_id", "root").agg(F.min("sid").alias("sid")).select(F.col("doc_id").alias(stay_id), F.col("sid").alias(name("stay_sid")))
    place = df.columns.index(text_col)

    def hashed(batches):
        for batch in batches:
            for i, j in blocks(batch.column(place)):
                part = batch.slice(i, j - i)
                own = [set_hash(s) if len(s) else None for s in shingle_sets(part.column(place), terms.n)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.int64())], [*part.schema.names, own_sid])

    several = df.join(many, df[id_col] == many[gone_id], "left_semi").mapInArrow(hashed, StructType([*df.schema.fields, StructField(own_sid, LongType())]))
    several = cut(several, "several")
    equal = Window.partitionBy(id_col, own_sid).orderBy(F.lit(0))
    one = several.join(stay, (F.col(id_col) == F.col(stay_id)) & (F.col(own_sid) == F.col(name("stay_sid"))), "left_semi").withColumn(own_row, F.row_number().over(equal)).where(F.col(own_row) == 1).drop(own_row)
    return rest.union(one.drop(own_sid)).union(several.where(F.col(own_sid).isNull()).drop(own_sid))
