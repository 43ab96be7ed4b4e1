"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents are put in a shuffled order (by a seeded hash) and their words cut into
blocks of equal size. Golden-ratio points, mapped through the cumulative target shares, give every
slot of the schedule a source; slots are ranked within their source, and the r-th slot of a source
takes its r-th block, starting over when the blocks are used up. The last slot of a source is cut, so that
the words it gives are its target, rounded.

Hot sources: running sums go over hash buckets within a source and then over bucket totals, and
ranks over chunks of slots and then over chunk counts, so no task holds a whole source.

Null text has size 0, null sources are one source (last in order), documents of size 0 are never
taken, repeated rows and equal ids are rows of their own, an empty table gives an empty mix, and other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

WORD = r"[^\x20\x09-\x0D]+"
#: 2**31 divided by the golden ratio, made odd: k times this, modulo 2**31, is the k-th point.
GOLDEN, UNIT = 1327217885, 1 << 31
CHUNK, CELLS, BUCKET_SHIFT = 1 << 16, 1 << 10, 52


@dataclass
class Mix:
    """sized: (doc_id, source, size, source_id, start, ...) per row; sources: targets; slots: (position, source_id, block, quota)
    in the order of the mix; pieces: (source_id, start, doc_id, block, at, words), what each document has in each block."""

    sized: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """Words taken of each document, by its place (source_id, start)."""
        both = self.slots.join(self.pieces, ["source_id", "block"])
        words = F.greatest(F.lit(0), F.least("words", F.col("quota") - F.col("at")))
        return both.groupBy("source_id", "start").agg(F.sum(words).alias("taken"))

    def order(self) -> DataFrame:
        """The mix itself: position, then which words of which document follow."""
        both = self.slots.join(self.pieces, ["source_id", "block"])
        part = both.withColumn("n_words", F.least("words", F.col("quota") - F.col("at"))).where("n_words > 0")
        return part.select("position", "at", "doc_id", (F.col("block") * F.col("block_words") + F.col("at") - F.col("start")).alias("first_word"), "n_words")


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size) to targets: weights go round by the order of the sources; what is above cap times a source's size is shared among the others.

    The level at which shares stop is found by going through the sources by cap / weight: the first one that the level
    of the rest does not fill sets it.
    """
    by_name, all_rows = Window.orderBy(F.asc_nulls_last("source")), Window.partitionBy()
    before = Window.orderBy("full_at", "source_id").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    out = sizes.withColumn("source_id", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_id") % len(weights) + 1).cast("int")))
    out = out.withColumn("most", cap * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    level = (F.sum("source_size").over(all_rows) - sum_before("most")) / (F.sum("weight").over(all_rows) - sum_before("weight"))
    out = out.withColumn("level", level)
    out = out.withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(all_rows))
    return out.select("source", "source_id", "source_size", F.least(F.col("level") * F.col("weight"), "most").alias("target"))


def mix(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, block: int = 1024, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """The schedule that takes total words in all, by weights; the table is read once, and only ids, sources and sizes move."""
    spark = df.sparkSession
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    sized = df.select(df[id_col].alias("doc_id"), df[source_col].alias("source"), F.coalesce(F.regexp_count(df[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = cut(sized.withColumn("h", order).withColumn("bucket", F.shiftright("h", BUCKET_SHIFT)), "sized")
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = cut(targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap), "sources")

    # Where each document begins in its source's shuffled order.
    totals = buckets.withColumn("offset", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
    within = F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    t = totals.select("source", "bucket", "offset").alias("t")
    s = sized.withColumn("within", within)
    placed = s.join(t, same(s, t, "source", "bucket")).select(s["*"], (F.col("within") + F.col("offset")).alias("start"))
    k = sources.select("source", "source_id", "source_size", "target")
    placed = cut(placed.join(k, same(placed, k, "source")).select("doc_id", placed["source"], "size", "source_id", "source_size", "target", "start"), "placed")

    # What each source owes the schedule: whole rounds through its blocks, then a part of one.
    owed = sources.where("source_size > 0").withColumn("words", F.round("target").cast("long"))
    blocks = F.ceil(F.col("source_size") / block)
    rest = F.col("words") % F.col("source_size")
    owed = owed.select("source_id", "source_size", "words", blocks.alias("blocks"), rest.alias("rest"), (F.floor(F.col("words") / F.col("source_size")) * blocks + F.ceil(rest / block)).alias("n"))
    all_rows = Window.partitionBy()
    cumulated = F.sum("n").over(Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0))
    share = lambda c: F.round(c / F.sum("n").over(all_rows) * UNIT).cast("long")
    owed = owed.withColumn("high", share(cumulated)).withColumn("low", share(cumulated - F.col("n")))
    owed = cut(owed.where("n > 0"), "owed")
    total = owed.agg(F.sum("n")).first()[0] or 0

    # Slots: points, their source by an equal join on cells of the unit interval, their rank.
    points = spark.range(total + 64 if total else 0).withColumnRenamed("id", "position").withColumn("point", F.col("position") % UNIT * GOLDEN % UNIT)
    cell = lambda c: F.floor(c / (UNIT // CELLS))
    spans = owed.where("high > low").select("source_id", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    drawn = points.withColumn("cell", cell(F.col("point"))).join(spans, "cell").where("point >= low and point < high")
    drawn = drawn.select("position", "source_id", F.floor(F.col("position") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("source_id", "chunk").agg(F.count("*").alias("c"))
    counts = counts.select("source_id", "chunk", (F.sum("c").over(Window.partitionBy("source_id").orderBy("chunk")) - F.col("c")).alias("ahead"))
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("source_id", "chunk").orderBy("position")) - 1).join(counts, ["source_id", "chunk"])
    ranked = ranked.select("position", "source_id", (F.col("ahead") + F.col("r")).alias("r"))
    got = drawn.groupBy("source_id").agg(F.count("*").alias("got"))
    # The points fall short of an exact count by a few slots a source at most; these close the schedule.
    short = owed.join(got, "source_id", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < n")
    short = short.select(F.lit(total + 64).cast("long").alias("position"), "source_id", F.explode(F.sequence(F.col("got"), F.col("n") - 1)).alias("r"))
    slots = ranked.unionByName(short).join(owed.select("source_id", "source_size", "words", "blocks", "rest", "n"), "source_id").where("r < n")
    number = F.col("r") % F.col("blocks")
    last: Column = (F.col("r") == F.col("n") - 1) & (F.col("rest") > 0)
    left = F.when(last, F.col("rest") - number * block).otherwise(F.col("source_size") - number * block)
    slots = slots.select("position", "source_id", number.alias("block"), F.least(F.lit(block), left).alias("quota"), F.lit(block).alias("block_words"))

    held = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    begin, end = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = held.select("source_id", "start", "doc_id", "block", (begin - F.col("block") * block).alias("at"), (end - begin).alias("words"))
    return Mix(placed, sources, slots, pieces)


def taken_by_document(m: Mix) -> DataFrame:
    """One row per document row: its size, its source's size and target, the words the mix takes of it."""
    t = m.taken()
    placed = m.sized.withColumn("place", F.when(F.col("size") > 0, F.col("start")))
    joined = placed.join(t.withColumnRenamed("start", "place"), ["source_id", "place"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source")


def repeated(df: DataFrame, m: Mix, id_col: str = "doc_id") -> DataFrame:
    """The rows of df, each as many times as the mix takes its words, rounded to whole texts; rows it takes less than half of once go.

    Rows that share an id are taken alike; rows without words go; columns of any name stay as they are; an empty table stays empty."""
    each = taken_by_document(m).groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken")).where("size > 0")
    copies = each.select(F.col("doc_id").alias("taken_id"), F.round(F.col("taken") / F.col("size")).cast("int").alias("copies")).where("copies > 0")
    rows = df.select(df[id_col].alias("own_id"), F.struct(*(df[c] for c in df.columns)).alias("own_row"))
    joined = rows.join(copies, F.col("own_id").eqNullSafe(F.col("taken_id"))).select("own_row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return joined.select(*(F.col("own_row").getField(c).alias(c) for c in df.columns))
