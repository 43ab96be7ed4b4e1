"""Approximate nearest neighbours by cosine: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Vectors are scaled to length 1. A coarse quantiser deals them to cells; what is left in a cell is quantised in subspaces of a
few dimensions with 16 centres each, by a loss that weighs the part of the error parallel to the vector more than the part across it,
since for a query that is near the vector only the parallel part changes the score. A query scans the cells whose
centres it is nearest to, by tables of its products with all centres; the best by table are scored again on
the original vectors in double precision.

Cells grow in number with the table. From MOST_CELLS on, each is split by centres of what is left in a cell, the same ones for all cells, up to
MOST_SPLITS; so a table of many more vectors has many more cells, while the centres still come from a bounded sample and are few.

How many cells a query scans and how many of a cell are scored again is measured on the table itself: for HELD queries that the centres
weren't fitted on, the true nearest are found among all vectors, then in which of the query's cells each lies and how many of that cell
are before it by table. The least numbers that find TARGET of them are taken, twice as many cells for good measure.

Centres are fitted on a bounded sample, the SAMPLE vectors of smallest id hash; every vector is indexed. Of
equal vectors only those with the k + 1 smallest ids can be among a query's k nearest, and only they
are kept, so a vector that a third of the rows share costs no more than another. Large cells are dealt
over several tasks, and so are many queries of one cell.

Vectors that are null, zero, of another length than the sample's most frequent one, or hold a null, NaN or infinite part take no
part, neither as queries nor as candidates; so do rows without an id. Rows that share an id are rows of their own: each is a query with
its own ranks, and a candidate of the others. An empty table, or one without a query, gives no rows. Ties go to the smaller id. Other
columns aren't read. Parts of any size count in full: vectors are multiplied by powers of two, which changes no digit of a cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .shared import cut, drop

SAMPLE = 20_000
#: Vectors a cell on average, coarse centres and splits of each at most, vectors and queries that one task takes from a cell.
PER_CELL, MOST_CELLS, MOST_SPLITS, TASK_ROWS, TASK_QUERIES = 1000, 4096, 64, 16_384, 8_192
#: What is scored again of a cell at least; queries held out to measure recall, and the share of their nearest to be found.
RERANK, HELD, TARGET = 100, 256, 0.97
SCHEMA = "query_id long, rank int, vec_id long, score double"


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision times the power of two that puts their largest part near 1, so that no square overflows or vanishes."""
    x = np.asarray(x, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if x.size else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for k in range(0, len(x), 8192):
        out[k : k + 8192] = np.argmax(x[k : k + 8192] @ centres.T, axis=1)
    return out


def _split(left: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """n centres of what is left in the cells; one is the origin, so that nothing is split."""
    if n == 1:
        return np.zeros((1, left.shape[1]))
    centres = left[rng.permutation(len(left))[:n]]
    for _ in range(rounds):
        at = _closest(left, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, left)
        count = np.bincount(at, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres


def _closest(left: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(left @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)


@dataclass
class Quantiser:
    """coarse: unit centres; splits: centres of what is left in a cell of them; books: (subspaces, 16, width); eta: how many times the parallel
    error counts. A cell's number is that of its coarse centre times the number of splits, plus that of its split."""

    coarse: np.ndarray
    splits: np.ndarray
    books: np.ndarray
    eta: float

    @property
    def n_cells(self) -> int:
        return len(self.coarse) * len(self.splits)

    def cell(self, x: np.ndarray) -> np.ndarray:
        at = _nearest(x, self.coarse)
        out = np.empty(len(x), np.int64)
        for k in range(0, len(x), 8192):
            z = slice(k, k + 8192)
            out[z] = at[z] * len(self.splits) + _closest(x[z] - self.coarse[at[z]], self.splits)
        return out

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.coarse[cell // len(self.splits)] + self.splits[cell % len(self.splits)]

    def cell_scores(self, q: np.ndarray) -> np.ndarray:
        """(queries, cells): products of unit queries with all cells' centres."""
        return ((q @ self.coarse.T)[:, :, None] + (q @ self.splits.T)[:, None, :]).reshape(len(q), -1)

    def rank(self, q: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells each unit query scans until it has scanned the given one."""
        out = np.empty(len(q), np.int64)
        for k, (one, c) in enumerate(zip(q, cell, strict=True)):
            s = self.cell_scores(one[None])[0]
            out[k] = 1 + (s > s[c]).sum() + (s[:c] == s[c]).sum()
        return out

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The cells that each unit query scans."""
        if probes >= self.n_cells:
            return np.tile(np.arange(self.n_cells), (len(q), 1))
        step = max(1, 2**21 // self.n_cells)
        near = [np.argpartition(-self.cell_scores(q[k : k + step]), probes - 1, axis=1)[:, :probes] for k in range(0, len(q), step)]
        return np.concatenate(near) if near else np.empty((0, probes), np.int64)

    @staticmethod
    def fit(x: np.ndarray, n_cells: int, n_splits: int = 1, width: int = 4, threshold: float = 0.2, rounds: int = 8, seed: int = 11) -> Quantiser:
        rng = np.random.default_rng(seed)
        x = unit(np.asarray(x, np.float64))
        dim = x.shape[1]
        cells = x[rng.permutation(len(x))[:n_cells]]
        for _ in range(rounds):  # spherical k-means; a cell without vectors keeps its centre
            at = _nearest(x, cells)
            sums = np.zeros_like(cells)
            np.add.at(sums, at, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            cells = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), cells)
        m = -(-dim // width)
        eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        splits = _split(x - cells[_nearest(x, cells)], n_splits, rounds, rng)
        q = Quantiser(cells, splits, np.empty(0), eta)
        left = np.pad(x - q.centre(q.cell(x)), ((0, 0), (0, m * width - dim))).reshape(len(x), m, width)
        pick = rng.integers(0, len(x), (m, 16))
        q.books = np.stack([left[pick[s], s] for s in range(m)])
        along = np.pad(x, ((0, 0), (0, m * width - dim))).reshape(left.shape)
        for _ in range(rounds):
            codes = q._codes(left, along)
            parallel = np.einsum("nmw,nmw->nm", along, left - q.books[np.arange(m), codes])
            total = parallel.sum(axis=1)
            for s in range(m):  # each centre minimises its members' loss, all other subspaces as they are
                v, r = along[:, s], left[:, s]
                other = total - parallel[:, s]
                a, b = np.zeros((16, width, width)), np.zeros((16, width))
                np.add.at(a, codes[:, s], (eta - 1) * v[:, :, None] * v[:, None, :] + np.eye(width))
                np.add.at(b, codes[:, s], r + (eta - 1) * v * (other + (v * r).sum(axis=1))[:, None])
                used = np.bincount(codes[:, s], minlength=16) > 0
                q.books[s, used] = np.linalg.solve(a[used], b[used][:, :, None])[:, :, 0]
                new = np.einsum("nw,nw->n", v, r - q.books[s, codes[:, s]])
                total, parallel[:, s] = other + new, new
        return q

    def _codes(self, left: np.ndarray, along: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes by coordinate descent: subspace after subspace takes the centre of least loss, given the others."""
        n, m, _ = left.shape
        error = ((left[:, :, None] - self.books) ** 2).sum(axis=3)
        share = np.einsum("nmw,nmw->nm", along, left)[:, :, None] - np.einsum("nmw,mkw->nmk", along, self.books)
        codes = error.argmin(axis=2)
        rows = np.arange(n)
        total = np.take_along_axis(share, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(rounds):
            for s in range(m):
                other = total - share[rows, s, codes[:, s]]
                codes[:, s] = (error[:, s] + (self.eta - 1) * (other[:, None] + share[:, s]) ** 2).argmin(axis=1)
                total = other + share[rows, s, codes[:, s]]
        return codes

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes packed two to a byte) of vectors."""
        x = unit(np.asarray(x, np.float64))
        at = self.cell(x)
        m, _, width = self.books.shape
        pad = ((0, 0), (0, m * width - x.shape[1]))
        packed = np.empty((len(x), -(-m // 2)), np.uint8)
        for k in range(0, len(x), 2048):
            z = slice(k, k + 2048)
            codes = self._codes(np.pad(x[z] - self.centre(at[z]), pad).reshape(-1, m, width), np.pad(x[z], pad).reshape(-1, m, width))
            codes = np.pad(codes, ((0, 0), (0, m % 2)))
            packed[z] = codes[:, 0::2] | codes[:, 1::2] << 4
        return at, packed

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, bytes of a code, 256): each query's products with every pair of centres."""
        m, _, width = self.books.shape
        q = np.pad(unit(queries), ((0, 0), (0, m * width - queries.shape[1]))).reshape(-1, m, width)
        t = np.einsum("nmw,mkw->nmk", q, self.books)
        t = np.pad(t, ((0, 0), (0, m % 2), (0, 0)))
        return (t[:, 0::2, None, :] + t[:, 1::2, :, None]).reshape(len(q), -1, 256).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(model: Quantiser, queries: pa.Table, vectors: pa.Table, k: int, depth: int) -> pa.Table:
    """The k nearest of a cell's part for each query that scans it."""
    out = ([], [], [])
    if queries.num_rows and vectors.num_rows:
        ids, own, raw = vectors.column("vec_id").to_numpy(), vectors.column("row").to_numpy(), scaled(_matrix(vectors.column("embedding").combine_chunks()))
        codes = np.frombuffer(b"".join(vectors.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        order = np.lexsort((own, ids))
        ids, own, raw, codes = ids[order], own[order], raw[order], codes[order]
        length = np.sqrt((raw * raw).sum(axis=1))
        names, q = queries.column("query_row").to_numpy(), scaled(_matrix(queries.column("embedding").combine_chunks()))
        most = min(len(ids), depth)
        for b in range(0, len(names), 64):
            part = q[b : b + 64]
            tables = model.tables(part)
            scores = _table_scores(tables, codes)
            best = np.argpartition(-scores, most - 1, axis=1)[:, :most] if most < len(ids) else np.tile(np.arange(len(ids)), (len(part), 1))
            for i, name in enumerate(names[b : b + 64].tolist()):
                c = np.sort(best[i])
                c = c[own[c] != name]
                exact = (raw[c] * part[i]).sum(axis=1) / (length[c] * np.sqrt((part[i] * part[i]).sum()))
                top = np.lexsort((ids[c], -exact))[:k]
                out[0].append(np.full(len(top), name))
                out[1].append(ids[c[top]])
                out[2].append(exact[top])
    flat = [np.concatenate(x) if x else np.empty(0) for x in out]
    return pa.table({"query_row": pa.array(flat[0].astype(np.int64)), "vec_id": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(float))})


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kind = df.schema[vector_col].dataType
    v = df[vector_col] if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else df[vector_col].cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(df[id_col].cast("long").alias("vec_id"), v.alias("embedding")).where("vec_id is not null and embedding is not null").where(finite & F.exists("embedding", lambda x: x != 0))


def _true_nearest(indexed: DataFrame, names: np.ndarray, held: np.ndarray, k: int) -> list:
    """(q, vec_id, score, cell, codes): the k nearest of each held query among all vectors; a task gives k of a query."""
    q = unit(held)

    def run(batches):
        best = None
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                ids = part.column(0).to_numpy()
                score = q @ unit(_matrix(part.column(1))).T
                score[names[:, None] == part.column(4).to_numpy()] = -2.0
                for n, row in enumerate(score):
                    top = np.lexsort((ids, -row))[:k] if len(ids) <= k else (t := np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]))[np.lexsort((ids[t], -row[t]))[:k]]
                    new = [(float(row[j]), int(ids[j]), part.column(2)[int(j)].as_py(), part.column(3)[int(j)].as_py()) for j in top if row[j] > -2.0 and (best is None or len(best[n]) < k or row[j] >= best[n][-1][0])]
                    best = best or [[] for _ in q]
                    if new:
                        best[n] = sorted(best[n] + new, key=lambda x: (-x[0], x[1]))[:k]
        rows = [(n, x[1], x[0], x[2], x[3]) for n, b in enumerate(best or []) for x in b]
        yield pa.RecordBatch.from_pylist([dict(zip(("q", "vec_id", "score", "cell", "codes"), r, strict=True)) for r in rows], pa.schema([("q", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64()), ("cell", pa.int32()), ("codes", pa.binary())]))

    found = indexed.select("vec_id", "embedding", "cell", "codes", "row").mapInArrow(run, "q int, vec_id long, score double, cell int, codes binary")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r").collect()  # HELD times k rows


def _table_scores(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    scores = np.zeros((len(tables), len(codes)), np.float32)
    for s in range(codes.shape[1]):
        scores += tables[:, s][:, codes[:, s]]
    return scores


def measured(model: Quantiser, indexed: DataFrame, names: np.ndarray, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each true neighbour of the held queries: how many cells its query has to scan, and how many of its cell to score again."""
    truth = _true_nearest(indexed, names, held, k)
    if not truth:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    tables, q, at = model.tables(held), np.array([r["q"] for r in truth]), np.array([r["cell"] for r in truth])
    cells = model.rank(unit(held)[q], at)
    own = np.array([_table_scores(tables[n : n + 1], np.frombuffer(r["codes"], np.uint8)[None])[0, 0] for n, r in zip(q, truth, strict=True)])

    def before(batches):
        total = np.zeros(len(q), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                cell = part.column(0).to_numpy()
                scores = _table_scores(tables, np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1))
                for j in range(len(q)):
                    inside = np.flatnonzero(cell == at[j])
                    total[j] += (scores[q[j], inside] >= own[j]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q)), pa.int32()), pa.array(total)], ["j", "n"])

    counts = indexed.select("cell", "codes").mapInArrow(before, "j int, n long").groupBy("j").agg(F.sum("n").alias("n")).collect()
    depth = np.zeros(len(q), np.int64)
    for r in counts:
        depth[r["j"]] = r["n"]
    return cells, depth


def enough(cells: np.ndarray, depth: np.ndarray, target: float) -> tuple[int, int]:
    """The least number of cells that leaves room for target, and the least depth that reaches it with them."""
    if not len(cells):
        return 0, 0
    least = int(np.sort(cells)[min(len(cells), int(np.ceil(len(cells) * (1 + target) / 2))) - 1])
    among = np.sort(depth[cells <= least])
    return least, int(among[min(len(among), int(np.ceil(len(cells) * target))) - 1])


def nearest(df: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """The k nearest of every row whose id is divisible by query_every, among all other rows."""
    spark = df.sparkSession
    # Each row gets a number of its own, once: the table is written with it.
    rows = cut(usable(df, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE + HELD).collect()
    if not sample:
        drop(rows)
        return spark.createDataFrame([], SCHEMA)
    sizes = [len(r["embedding"]) for r in sample]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n)) if len(set(sizes)) > 1 else sizes[0]
    sample = [r for r in sample if len(r["embedding"]) == dim]
    kept = len(sample) - min(HELD, len(sample) // 10)
    names, held = np.array([r["row"] for r in sample[kept:]], np.int64), np.array([r["embedding"] for r in sample[kept:]], np.float64).reshape(-1, dim)
    fit = rows.where(F.size("embedding") == dim)
    total = fit.count()
    wanted = max(1, total // PER_CELL)
    fitted = Quantiser.fit(np.array([r["embedding"] for r in sample[:kept]]), int(min(MOST_CELLS, wanted)), int(min(MOST_SPLITS, max(1, wanted // MOST_CELLS))))
    n_cells = fitted.n_cells
    model = spark.sparkContext.broadcast(fitted)  # MOST_CELLS and MOST_SPLITS vectors and 16 centres a subspace at most

    few = Window.partitionBy("embedding").orderBy("vec_id", "row")
    candidates = fit.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).select("vec_id", "embedding", "row")
    vector = f"embedding {rows.schema['embedding'].dataType.simpleString()}"

    def index(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                cell, codes = model.value.encode(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "embedding", "row", "cell", "codes"])

    def probe(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                near = model.value.probed(unit(_matrix(part.column(1))), probes)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * probes, pa.int32()), pa.array(near.reshape(-1), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, cells], ["query_row", "embedding", "cells"])

    indexed = cut(candidates.mapInArrow(index, f"vec_id long, {vector}, row long, cell int, codes binary"), "index")
    needed, depth = enough(*measured(fitted, indexed, names, held, k), TARGET)
    probes, depth = min(n_cells, probes or max(2 * needed, int(np.ceil(np.sqrt(n_cells))))), max(depth, RERANK)
    asking = fit.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    asked = cut(asking.select("row", "embedding").mapInArrow(probe, f"query_row long, {vector}, cells array<int>"), "queries")
    each = asked.withColumn("cell", F.explode("cells")).drop("cells")

    parts = indexed.groupBy("cell").agg(F.ceil(F.count("*") / TASK_ROWS).alias("parts"))
    turns = each.groupBy("cell").agg(F.ceil(F.count("*") / TASK_QUERIES).alias("turns"))
    plan = cut(parts.join(turns, "cell"), "plan")  # a row a cell: MOST_CELLS times MOST_SPLITS at most
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    vectors = indexed.join(F.broadcast(plan), "cell").withColumn("part", deal("vec_id", "parts")).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    queries = each.join(F.broadcast(plan), "cell").withColumn("turn", deal("query_row", "turns")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    keys = ["cell", "part", "turn"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(model.value, left, right, k, depth)

    found = queries.select(*keys, "query_row", "embedding").groupBy(*keys).cogroup(vectors.select(*keys, "vec_id", "row", "embedding", "codes").groupBy(*keys)).applyInArrow(search, "query_row long, vec_id long, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = cut(ranked.join(asking.select("row", F.col("vec_id").alias("query_id")), F.col("query_row") == F.col("row")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")
    drop(rows, indexed, asked, plan)
    return out
