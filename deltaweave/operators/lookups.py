"""Joins that find rows by what else is known of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unqueued_new(snapshot: DataFrame, mapping: DataFrame, queue: DataFrame, run: int, keys: Sequence[str]) -> DataFrame:
    """New rows without a job, or with one of an older run."""
    new = snapshot.join(mapping, list(keys), "left_anti")
    jobs = queue.groupBy(*keys).agg(F.max("id_run").alias("queued_run"))
    return new.join(jobs, list(keys), "left").where(F.col("queued_run").isNull() | (F.col("queued_run") < run)).drop("queued_run")


def by_keys(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the wanted keys; a short list of keys is broadcast by its size."""
    return rows.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def manifest(snapshot: DataFrame, mapping: DataFrame, keys: Sequence[str], after: str | None = None) -> DataFrame:
    """The payload of each row of a snapshot that has a product, with that product; after: keys up to this one have been worked on."""
    rows = snapshot if after is None else snapshot.where(F.col(keys[-1]) > after)
    return rows.join(mapping.select(*keys, "id_product"), list(keys)).select(*keys, "payload", "id_product")


def live_state(state: DataFrame, images: DataFrame, image_shops: DataFrame) -> DataFrame:
    """State rows whose image exists and belongs to their shop."""
    return state.join(images, ["id_image", "id_product"]).join(image_shops, ["id_image", "id_shop"])


def stale_owners(state: DataFrame, mapping: DataFrame, unresolved: DataFrame, before: Column, keys: Sequence[str]) -> DataFrame:
    """State rows of active owners, untouched since a time, without an open job."""
    return state.where(F.col("updated_at") < before).join(mapping.where(~F.col("out_of_feed")), list(keys), "left_semi").join(unresolved, list(keys), "left_anti")


def exact_names(wanted: DataFrame, known: DataFrame, name: str, key: str) -> DataFrame:
    """Ids by exactly equal names; a name with several ids is ambiguous and has none."""
    ids = known.groupBy(name).agg(F.count_distinct(key).alias("n"), F.min(key).alias(key))
    j = wanted.join(ids, name, "left")
    return j.select(name, F.when(F.col("n") == 1, F.col(key)).alias(key), F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"))


def ids_by_name(wanted: DataFrame, known: DataFrame, name: str, key: str) -> DataFrame:
    """The smallest id of a name, whatever its case."""
    ids = known.groupBy(F.lower(name).alias("lowered")).agg(F.min(key).alias(key))
    return wanted.join(ids, F.lower(wanted[name]) == ids["lowered"], "left").select(wanted[name], key)


def interrupted(products: DataFrame, mapping: DataFrame, since: Column) -> DataFrame:
    """References made since a time that exactly one product without an owner has."""
    free = products.where(F.col("added_at") >= since).join(mapping, "id_product", "left_anti")
    return free.groupBy("reference").agg(F.count("*").alias("n"), F.min("id_product").alias("id_product")).where("n = 1").drop("n")


def recoverable(wanted: DataFrame, products: DataFrame, mapping: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Products that a create has left behind: wanted (reference, active, price, names, since), products (id_product, reference, active, price,
    names, added_at) in the shop.

    Of one reference, exactly one product without an owner that was added since then is recovered if it is as active, costs the same and bears one of the
    names (the reference, if there is none); else the outcome says none, ambiguous, or what differs.
    """
    free = products.join(mapping.select("id_product").distinct(), "id_product", "left_anti").select("id_product", "reference", *(F.col(c).alias(f"p_{c}") for c in ("active", "price", "names", "added_at")))
    named = F.filter(F.transform("names", lambda n: F.trim(n)), lambda n: n != "")
    j = wanted.where(F.trim("reference") != "").join(free, "reference", "left")
    fits = F.col("id_product").isNotNull() & (F.col("p_added_at") >= F.col("since"))
    found = j.groupBy("reference").agg(F.count_if(fits).alias("n"), F.min_by(F.struct("id_product", "active", "price", F.when(F.size(named) > 0, named).otherwise(F.array("reference")).alias("names"), "p_active", "p_price", "p_names"), F.when(fits, F.col("id_product"))).alias("c"))
    outcome = (
        F.when(F.col("n") == 0, "none").when(F.col("n") > 1, "ambiguous").when(F.col("c.active") != F.col("c.p_active"), "differs: active")
        .when(F.abs(F.col("c.price") - F.col("c.p_price")) > tolerance, "differs: price").when(~F.arrays_overlap("c.names", "c.p_names"), "differs: name").otherwise("recovered")
    )
    return found.select("reference", outcome.alias("outcome"), F.when(outcome == "recovered", F.col("c.id_product")).alias("id_product"))


def shops_per_variant(variants: DataFrame, links: DataFrame) -> DataFrame:
    """How many shops have each variant; one that a single shop has may be used again."""
    counts = links.groupBy("id_variant").agg(F.count_distinct("id_shop").alias("n_shops"))
    return variants.join(counts, "id_variant", "left").withColumn("n_shops", F.coalesce("n_shops", F.lit(0))).withColumn("reusable", F.col("n_shops") <= 1)


def owner_drift(jobs: DataFrame, mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Done jobs whose key has no owner now, or another product."""
    owners = mapping.select(*keys, F.col("id_product").alias("owner"))
    return jobs.where("status = 'done'").join(owners, list(keys), "left").where(F.col("owner").isNull() | (F.col("owner") != F.col("id_product"))).drop("owner")


def dangling(rows: DataFrame, target: DataFrame, key: str) -> DataFrame:
    return rows.join(target.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n_dangling"))


def resolved_pairs(features: DataFrame, values: DataFrame, in_shop: DataFrame, live_values: DataFrame) -> DataFrame:
    """(feature_key, value_key) pairs whose feature the shop has and whose value still belongs to it."""
    return features.join(values, ["id_shop", "feature_key"]).join(in_shop, ["id_shop", "id_feature"]).join(live_values, ["id_feature", "id_value"])


def reconcile_ready(stages_done: Column, is_latest: Column, n_unresolved: Column) -> Column:
    return stages_done & is_latest & (n_unresolved == 0)
