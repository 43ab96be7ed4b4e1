"""Category trees: ancestors, paths, canonical variants and automatic mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Bounds are below 2 to this power.
LEVELS = 31


def ancestors(leaves: DataFrame, tree: DataFrame) -> DataFrame:
    """(leaf_id, id_category) for every ancestor of a leaf, itself included, by nested-set bounds.

    A node whose bounds lie less than 2**k apart covers two blocks of 2**k numbers at most; a leaf lies in one block of each k. So the range join becomes an
    equal join on k and block, whatever the size of the tree.
    """
    width = F.col("p_right") - F.col("p_left") + 1
    nodes = tree.select(F.col("id_category"), F.col("nleft").cast("long").alias("p_left"), F.col("nright").cast("long").alias("p_right"))
    nodes = nodes.withColumn("k", F.ceil(F.log2(width.cast("double"))).cast("int"))
    block = lambda c, k: F.call_function("shiftright", c, k)
    nodes = nodes.withColumn("block", F.explode(F.array_distinct(F.array(block(F.col("p_left"), F.col("k")), block(F.col("p_right"), F.col("k"))))))
    leaf = leaves.join(tree.select(F.col("id_category").alias("leaf_id"), F.col("nleft").cast("long").alias("nleft")), "leaf_id")
    leaf = leaf.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("block", block(F.col("nleft"), F.col("k")))
    inside = (F.col("nleft") >= F.col("p_left")) & (F.col("nleft") <= F.col("p_right"))
    return leaf.join(nodes, ["k", "block"]).where(inside).select("leaf_id", "id_category")


def membership(leaves: DataFrame, tree: DataFrame, root_id: int) -> DataFrame:
    """Per leaf, the sorted ids of its ancestors without the root; error where the tree doesn't have the leaf."""
    found = ancestors(leaves.select("leaf_id").distinct(), tree).where(F.col("id_category") != root_id)
    ids = found.groupBy("leaf_id").agg(F.array_sort(F.collect_set("id_category")).alias("ids"))
    known = tree.select(F.col("id_category").alias("leaf_id"), F.lit(True).alias("known"))
    j = leaves.select("leaf_id").distinct().join(ids, "leaf_id", "left").join(known, "leaf_id", "left")
    return j.select("leaf_id", F.coalesce("ids", F.array().cast(ids.schema["ids"].dataType)).alias("ids"), F.when(F.col("known").isNull(), F.lit("no such category")).alias("error"))


def assembled_paths(rows: DataFrame) -> DataFrame:
    """(leaf_id, nleft, name) rows to one path per leaf, from the top down."""
    ordered = F.array_sort(F.collect_list(F.struct("nleft", "name")))
    return rows.groupBy("leaf_id").agg(F.array_join(F.transform(ordered, lambda r: r["name"]), " > ").alias("path"))


def canonical_variants(rows: DataFrame) -> DataFrame:
    """(key, name, path): per key the most frequent variant, ties by path and then name, and how many variants there are."""
    counted = rows.groupBy("key", "name", "path").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "path", "name")).alias("b")
    return counted.groupBy("key").agg(best, F.count("*").alias("n_variants")).select("key", "b.name", "b.path", (-F.col("b.n")).alias("n"), "n_variants")


def path_index(categories: DataFrame) -> DataFrame:
    """(id_category, path): normal form of each path to its id, or -1 where several ids have it."""
    keyed = categories.select(text.path_key(F.col("path")).alias("path_key"), "id_category")
    return keyed.groupBy("path_key").agg(F.when(F.count_distinct("id_category") == 1, F.min("id_category")).otherwise(F.lit(-1)).alias("id_category"))


def auto_map(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """(key, path, active, id_category): inactive rows are skipped, known ids that exist are kept, others go by their path."""
    ids = categories.select(F.col("id_category").alias("known_id")).distinct()
    index = path_index(categories).withColumnRenamed("id_category", "found_id")
    r = rows.withColumn("path_key", text.path_key(F.col("path"))).join(ids, F.col("id_category") == F.col("known_id"), "left").join(index, "path_key", "left")
    outcome = F.when(~F.col("active"), "skipped").when(F.col("known_id").isNotNull(), "kept").when(F.col("found_id") == -1, "ambiguous").when(F.col("found_id").isNotNull(), "mapped").otherwise("missing")
    new = F.when(outcome == "mapped", F.col("found_id")).when(outcome == "kept", F.col("id_category"))
    return r.select("key", "path", outcome.alias("outcome"), new.alias("id_category"))


def map_counts(mapped: DataFrame) -> DataFrame:
    """Rows of each outcome of auto_map, 0 where there is none."""
    return mapped.agg(*(F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("mapped", "kept", "skipped", "ambiguous", "missing")), F.count("*").alias("n"))


def missing_prefixes(paths: DataFrame, known: DataFrame) -> DataFrame:
    """Every prefix of the paths that no known path equals in normal form: what has to be created, parents first."""
    parts = F.split(text.path_key(F.col("path")), " > ")
    prefixes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), " > ").alias("path_key")))).alias("p")).select("p.depth", "p.path_key").where("path_key <> ''").distinct()
    return prefixes.join(known.select(text.path_key(F.col("path")).alias("path_key")).distinct(), "path_key", "left_anti").select("depth", "path_key")
