"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the sum of a vector of its own (by hash) and the mean of the vectors of its character
n-grams (3 to 5 bytes of the word between marks, by hash), so unseen forms of a word are near the seen ones. The network reads windows of
WINDOW words that overlap by half; a text's score is that of its highest window, and every window of the whole text is scored.

It is trained on at most `bound` labelled rows of each class, those of smallest id hash that aren't held out. As a label is the
whole text's, each round takes a text's highest windows by the network so far (at first, by the log odds of its words).
Score and input know the text alone: labels, language, source and id go into neither.

Null texts and texts without words score 0. Rows without an id count as not held out and aren't trained on; labels that are null
or for unknown ids are left out; of a repeated label any row counts. Without labels of both classes every score is the share of label 1,
or 0. Repeated rows score alike. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import blocks, bounds, hashes, mix, text_bytes

WINDOW, STRIDE, HIDDEN, WIDTH = 32, 16, 8, 16
WORDS = GRAMS = 1 << 15
PART = 1 << 14
#: Rows of every matrix that scores come from. Products of one shape add up each row's terms in one order, so a text's score doesn't depend on what it is
#: worked on with.
ROWS = 512
NGRAMS = (3, 4, 5)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, span) of every character n-gram of spans; a mark stands before and after each span."""
    size = ends - starts
    at = np.cumsum(size + 1) - size  # where each span's bytes go: one mark before each, one after all
    flat = np.zeros(int(size.sum()) + len(size) + 1, np.uint8)
    source = np.repeat(starts - at, size) + (np.arange(int(size.sum())) + np.repeat(np.arange(len(size)) + 1, size))
    place = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)) + 1, size)
    flat[place] = _LOWER[data[source]]
    mark = np.zeros(len(flat), bool)
    mark[at - 1] = mark[-1] = True
    before = np.concatenate([[0], np.cumsum(mark)])
    buckets, spans = [], []
    for n in NGRAMS:
        if len(flat) < n:
            continue
        w = np.full(len(flat) - n + 1, n, np.uint64)
        for k in range(n):
            w = w * np.uint64(0x100000001B3) + flat[k : len(flat) - n + 1 + k]
        inner = before[n - 1 : len(flat)] == before[1 : len(flat) - n + 2]  # no mark but at the ends
        first = np.flatnonzero(inner)
        buckets.append((mix(w[first]) % np.uint64(GRAMS)).astype(np.int64))
        spans.append(before[first + 1] - 1)
    span = np.concatenate(spans)
    order = np.argsort(span, kind="stable")
    return np.concatenate(buckets)[order], span[order]


def window_words(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, row) of all windows; before as of bounds()."""
    n = np.diff(before)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    first = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return before[:-1][row] + first, np.minimum(WINDOW, n[row] - first), row


@dataclass
class Network:
    p: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda *s, k=None: (rng.standard_normal(s) * (k or 1 / np.sqrt(s[0]))).astype(np.float32)
        h = HIDDEN
        return Network({"words": f(WORDS, WIDTH, k=0.1), "grams": f(GRAMS, WIDTH, k=0.1), "w": f(WIDTH, 6 * h), "b": np.zeros(6 * h, np.float32), "u0": f(h, 3 * h), "u1": f(h, 3 * h), "wa": f(2 * h, h), "ba": np.zeros(h, np.float32), "va": f(h), "out": f(2 * h), "bias": np.zeros(1, np.float32)})

    def inputs(self, keys, gram, span) -> np.ndarray:
        """Vectors of distinct words."""
        n = np.bincount(span, minlength=len(keys)).astype(np.float32)
        first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        x = self.p["words"][(keys % np.uint64(WORDS)).astype(np.int64)]
        for k in range(0, len(keys), PART):  # n-grams of so many words at once
            a, b = first[k], first[k + PART] if k + PART < len(keys) else len(gram)
            some = np.flatnonzero(n[k : k + PART]) + k
            if len(some):
                x[some] += np.add.reduceat(self.p["grams"][gram[a:b]], first[some] - a, axis=0) / n[some, None]
        return x

    def project(self, x: np.ndarray) -> np.ndarray:
        out, block = np.empty((len(x), 6 * HIDDEN), np.float32), np.zeros((ROWS, WIDTH), np.float32)
        for k in range(0, len(x), ROWS):
            part = x[k : k + ROWS]
            block[: len(part)] = part
            out[k : k + len(part)] = (block @ self.p["w"] + self.p["b"])[: len(part)]
        return out

    def forward(self, x: np.ndarray, words: np.ndarray, mask: np.ndarray, keep: bool = False, projected: bool = False):
        """Logits of windows: x are vectors of distinct words (or what project() makes of them), words (windows, WINDOW) their numbers."""
        p, h, (n, steps) = self.p, HIDDEN, words.shape
        g = x if projected else self.project(x)
        states = np.zeros((steps, n, 2 * h), np.float32)
        saved: list = [[None] * steps, [None] * steps]
        whole = mask.all(axis=0)
        for d, u in enumerate((p["u0"], p["u1"])):
            gd, s = np.ascontiguousarray(g[:, 3 * h * d : 3 * h * (d + 1)]), np.zeros((n, h), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                a, su = gd[words[:, t]], s @ u
                gates = sigmoid32(a[:, : 2 * h] + su[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                c = np.tanh(a[:, 2 * h :] + r * su[:, 2 * h :])
                new = c + z * (s - c)
                if not whole[t]:
                    new = np.where(mask[:, t, None], new, s)
                if keep:
                    saved[d][t] = (s, z, r, c, su[:, 2 * h :])
                s = new
                states[t, :, h * d : h * (d + 1)] = s
        e = np.tanh(states @ p["wa"] + p["ba"])
        score = np.where(mask.T, e @ p["va"], np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (states, saved, e, weight, pooled)) if keep else logit

    def gradients(self, x, words, mask, target, weights):
        """Gradients of the weighted cross entropy, for the parameters and for x."""
        p, h, (n, steps) = self.p, HIDDEN, words.shape
        logit, (states, saved, e, weight, pooled) = self.forward(x, words, mask, keep=True)
        d = ((sigmoid(logit) - target) * weights / n).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["out"]
        dweight = np.einsum("nh,tnh->tn", dpool, states)
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        g["va"] = np.einsum("tn,tnh->h", dscore, e)
        de = dscore[:, :, None] * p["va"] * (1 - e * e)
        g["wa"] = np.einsum("tni,tnj->ij", states, de)
        g["ba"] = de.sum(axis=(0, 1))
        dstates = weight[:, :, None] * dpool + de @ p["wa"].T
        dg = np.zeros((len(x), 6 * h), np.float32)
        for k, name in enumerate(("u0", "u1")):
            u, ds, du = p[name], np.zeros((n, h), np.float32), np.zeros_like(p[name])
            for t in range(steps - 1, -1, -1) if k == 0 else range(steps):
                s, z, r, c, su = saved[k][t]
                ds = ds + dstates[t, :, h * k : h * (k + 1)]
                m = mask[:, t, None]
                dnew = np.where(m, ds, 0)
                dc = dnew * (1 - z) * (1 - c * c)
                dz = dnew * (s - c) * z * (1 - z)
                dr = dc * su * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                dsu = np.concatenate([dz, dr, dc * r], axis=1)
                du += s.T @ dsu
                np.add.at(dg[:, 3 * h * k : 3 * h * (k + 1)], words[:, t], da)
                ds = dnew * z + np.where(m, 0, ds) + dsu @ u.T
            g[name] = du
        g["w"], g["b"] = x.T @ dg, dg.sum(axis=0)
        return g, dg @ p["w"].T, logit


def sigmoid32(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)) by the hyperbolic tangent, which doesn't overflow."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


@dataclass
class Texts:
    """A block of texts as distinct words and windows."""

    keys: np.ndarray
    gram: np.ndarray
    span: np.ndarray
    words: np.ndarray
    mask: np.ndarray
    row: np.ndarray
    rows: int

    @staticmethod
    def of(column: pa.Array) -> Texts:
        data, at = text_bytes(column)
        starts, ends, before = bounds(data, at)
        keys, first, which = np.unique(hashes(data, starts, ends, lower=True), return_index=True, return_inverse=True)
        parts = [grams(data, starts[first[k : k + PART]], ends[first[k : k + PART]]) for k in range(0, len(keys), PART)]
        gram, span = (np.concatenate([p[c] + (k * PART if c else 0) for k, p in enumerate(parts)] or [np.empty(0, np.int64)]) for c in range(2))
        begin, size, row = window_words(before)
        step = np.arange(WINDOW)
        mask = step < size[:, None]
        words = which[np.minimum(begin[:, None] + step, len(which) - 1)] if len(which) else np.zeros((0, WINDOW), np.int64)
        return Texts(keys, gram, span, words, mask, row, len(at) - 1)

    def logits(self, net: Network) -> np.ndarray:
        """Of each window; the last ones are worked out along with empty ones, so that all products have one shape."""
        g, out = net.project(net.inputs(self.keys, self.gram, self.span)), np.empty(len(self.row), np.float32)
        for k in range(0, len(self.row), ROWS):
            n = min(ROWS, len(self.row) - k)
            words, mask = np.zeros((ROWS, WINDOW), np.int64), np.ones((ROWS, WINDOW), bool)
            words[:n], mask[:n] = self.words[k : k + n], self.mask[k : k + n]
            out[k : k + n] = net.forward(g, words, mask, projected=True)[:n]
        return out

    def highest(self, window_scores: np.ndarray) -> np.ndarray:
        out = np.full(self.rows, -np.inf)
        np.maximum.at(out, self.row, window_scores)
        return out


def train(texts: list[str], labels: np.ndarray, rounds: int = 8, batch: int = 128, rate: float = 0.02, seed: int = 5) -> Network:
    """Fit the network; of a toxic text its highest window counts, of a clean one its two highest and one at random."""
    rng, net = np.random.default_rng(seed), Network.new(seed)
    t = Texts.of(pa.array(texts, pa.string()))
    labels = np.asarray(labels)
    # First choice: windows by the largest log odds of a word's n-grams, from how many texts of each class have them.
    seen = [np.ones(GRAMS), np.ones(GRAMS)]
    n_grams = np.bincount(t.span, minlength=len(t.keys))
    gram_at = np.concatenate([[0], np.cumsum(n_grams)])
    own = [np.unique(t.words[t.row == r][t.mask[t.row == r]]) for r in range(t.rows)]
    for r, w in enumerate(own):
        got = np.unique(np.concatenate([t.gram[gram_at[i] : gram_at[i + 1]] for i in w])) if len(w) else []
        seen[int(labels[r])][got] += 1
    odds = np.log(seen[1] / (labels == 1).sum()) - np.log(seen[0] / (labels == 0).sum())
    word_odds = np.zeros(len(t.keys))
    some = n_grams > 0
    word_odds[some] = np.add.reduceat(odds[t.gram], gram_at[:-1][some]) / n_grams[some]
    score = np.where(t.mask, word_odds[t.words], -9).max(axis=1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for turn in range(rounds):
        if turn > 1:
            score = t.logits(net)
        order = np.lexsort((-score, t.row))
        start = np.searchsorted(t.row[order], np.arange(t.rows + 1))
        chosen = []
        for r, (a, b) in enumerate(zip(start[:-1], start[1:], strict=True)):
            if a < b:
                chosen += [order[a]] if labels[r] else [*order[a : min(b, a + 2)], order[rng.integers(a, b)]]
        chosen = rng.permutation(np.array(chosen))
        y = labels[t.row[chosen]].astype(np.float32)
        balance = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
        for k in range(0, len(chosen), batch):
            c = chosen[k : k + batch]
            used, words = np.unique(t.words[c], return_inverse=True)
            words = words.reshape(len(c), WINDOW)
            m = n_grams[used]
            span = np.repeat(np.arange(len(used)), m)
            gram = t.gram[np.repeat(gram_at[used] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
            x = net.inputs(t.keys[used], gram, span)
            g, dx, _ = net.gradients(x, words, t.mask[c], y[k : k + batch], balance[k : k + batch])
            step += 1
            now = rate * (1 - turn / rounds) + 0.002
            for name, grad in g.items():
                m1, m2 = moments[name]
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                net.p[name] -= (now * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            # Tables change only where this batch's words and n-grams are (lazy Adagrad).
            for name, at, grad in (("words", (t.keys[used] % np.uint64(WORDS)).astype(np.int64), dx), ("grams", gram, dx[span] / np.maximum(m, 1)[span, None])):
                rows, back = np.unique(at, return_inverse=True)
                total = np.zeros((len(rows), WIDTH), np.float32)
                np.add.at(total, back, grad)
                m2 = moments[name][1]
                m2[rows] += total * total
                net.p[name][rows] -= 0.1 * total / (np.sqrt(m2[rows]) + 1e-6)
    # Put the border between the classes of the training texts at 0: where most of both are on their side.
    best = t.highest(t.logits(net))
    cuts = np.unique(best[np.isfinite(best)])
    if len(cuts) > 1:
        mids = (cuts[1:] + cuts[:-1]) / 2
        wrong = [(labels[best > c] == 0).sum() / (labels == 0).sum() + (labels[best <= c] == 1).sum() / (labels == 1).sum() for c in mids]
        low = np.flatnonzero(np.array(wrong) <= min(wrong) + 1e-12)
        net.p["bias"] -= np.float32(0.3 * mids[low[0]] + 0.7 * mids[low[-1]])
    return net


def held_out(c):
    return (F.crc32(c.cast("string").cast("binary")) % 5 == 0) & c.isNotNull()


def training_rows(docs: DataFrame, labels: DataFrame, bound: int) -> list:
    """(doc_id, text, toxic) of at most `bound` labelled rows of each class that aren't held out. An id with several labels is toxic if one
    of them says so; of an id with several texts the first by code point counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    some = F.broadcast(pick(0).union(pick(1)))  # 2 * bound rows at most
    return docs.select("doc_id", "text").join(some, "doc_id").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()


def score_texts(df: DataFrame, labels: DataFrame, bound: int = 800, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score and prediction of every row; after training, one pass without a shuffle."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    rows = sorted(training_rows(docs, labels, bound), key=lambda r: r["doc_id"])
    truth = np.array([r["toxic"] for r in rows], np.int64)
    net, share = None, float(truth.mean()) if len(truth) else 0.0
    if 0 < share < 1:
        net = train([r["text"] for r in rows], truth)
    model = df.sparkSession.sparkContext.broadcast(net)  # of fixed size, 4 MB

    def run(batches):
        for batch in batches:
            for i, j in blocks(batch.column(1)):
                part = batch.slice(i, j - i)
                if model.value is None:
                    score = np.full(j - i, share)
                else:
                    t = Texts.of(part.column(1))
                    score = sigmoid(t.highest(t.logits(model.value)))
                    score[np.bincount(t.row, minlength=t.rows) == 0] = 0.0
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score.astype(float)), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False))).mapInArrow(run, SCHEMA)
