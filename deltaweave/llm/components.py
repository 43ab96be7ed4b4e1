"""Connected components of an edge table, without collecting edges or labels anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop

EDGE = "a long, b long"
#: Ids that a task holds at once while it shrinks its edges.
HELD = 1 << 18


class Forest:
    """Union-find over 64-bit ids; the smaller id is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, r = self.up, x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        lo, hi = (a, b) if a < b else (b, a)
        self.up.setdefault(lo, lo)
        self.up[hi] = lo


def _shrink(edges: DataFrame) -> DataFrame:
    """Spanning stars for the components of each task's edges, of so many ids at a time that they take some 50 MB: about an edge per id, whatever the chains."""

    def stars(forest):
        both = [(x, forest.root(x)) for x in forest.up]
        both = np.array([e for e in both if e[0] != e[1]], np.int64).reshape(-1, 2)
        for k in range(0, len(both), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(both[k : k + 65536, c]) for c in range(2)], ["a", "b"])

    def run(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            if len(forest.up) >= HELD:
                yield from stars(forest)
                forest = Forest()
        yield from stars(forest)

    return edges.mapInArrow(run, EDGE)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each id in edges (a, b): root is the smallest id that the edges reach.

    Each round joins every id to the smallest id next to it (large star), then what is left below it (small star), so the longest path shrinks by
    half or more. Before each round tasks shrink the edges they hold, as read from a written table, so that Spark packs few edges into few tasks.
    No step makes more edges than it gets, and each that changes one lessens the sum of their ids; a round that changes none is the last.
    What an id is joined with is a written table, so that Spark can split the edges of a hub over several tasks.

    Rows with a null, and edges from an id to itself, say nothing and are left out, so an id with no other edge has no row; repeated edges count
    once; an empty table gives no rows; other columns aren't read. The result is a written table, and the caller may drop it.
    """
    e = cut(edges.select("a", "b").where("a <> b"), "edges")
    while True:
        # From here on a > b, and so large star moves the edges of b to the smallest id next to b.
        e, old = cut(_shrink(e.select("a", "b")), "edges"), e
        least = cut(e.union(e.select("b", "a")).toDF("u", "v").groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "least")
        large = cut(e.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b"), (F.col("m") < F.col("u")).alias("moved")), "large")
        drop(old, e, least)
        # Small star: an id and its smaller neighbours go to the smallest of these.
        down = cut(large.groupBy("a").agg(F.min("b").alias("m")), "down")
        is_least = F.col("b") == F.col("m")
        e = cut(large.join(down, "a").select(F.when(is_least, F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"), (F.col("moved") | ~is_least).alias("moved")), "edges")
        drop(large, down)
        if not e.agg(F.bool_or("moved")).first()[0]:  # null if there are none
            break
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")))
    out = cut(nodes.distinct(), "roots")
    drop(e)
    return out
