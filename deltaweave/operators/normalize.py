"""Raw feed records to products: one pass of column expressions that sorts rows into valid ones, rejects and warnings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Limits of collections, of keys and references in bytes, and of a product as JSON.
MOST_IMAGES, MOST_COMBINATIONS, MOST_KEY_BYTES, MOST_REFERENCE_BYTES, MOST_SIZE_BYTES = 1000, 5000, 191, 64, 128
MOST_PRODUCT_BYTES = 2 * 1024 * 1024
MOST_WARNING = 1000


@dataclass(frozen=True)
class Policy:
    """What the shop decides: language, whether features and attributes may be made, names of prefixes and of the size group."""

    language_id: int = 1
    features_auto_create: bool = True
    attributes_auto_create: bool = True
    size_group: str = "Size"
    reference_prefix: str = "MH-"
    key_prefix: str = "supplier"


def category_triple(key: Column, name: Column, path: Column) -> Column:
    """Name falls back to the key, the path to the name and then the key."""
    k, n = text.trim(key), F.nullif(text.trim(name), F.lit(""))
    return F.struct(k.alias("key"), F.coalesce(n, k).alias("name"), F.coalesce(F.nullif(text.path(path), F.lit("")), n, k).alias("path"))


def _features(color: Column, kind: Column) -> Column:
    rows = F.array(*(F.struct(F.lit(k).alias("key"), text.slug(c).alias("value_key"), F.lit(k.title()).alias("name"), text.trim(c).alias("value")) for k, c in (("color", color), ("type", kind))))
    return F.array_sort(F.filter(rows, lambda r: r["value"] != ""))


def _combinations(p: Policy) -> Column:
    def one(o: Column) -> Column:
        ean = text.trim(F.coalesce(o["ean"], F.lit("")))
        size = F.struct(
            F.lit(None).cast("long").alias("id"),
            F.lit(f"{p.key_prefix}:size").alias("group_key"),
            text.size_descriptor(o["name"], f"{p.key_prefix}:size").alias("value_key"),
            F.lit(p.size_group).alias("group_name"),
            F.regexp_replace(text.trim(o["name"]), r"\s+", " ").alias("value_name"),
        )
        return F.struct(
            F.concat(F.lit(p.reference_prefix), F.col("id"), F.lit("-"), text.trim(o["id"])).alias("reference"),
            F.array(size).alias("attributes"),
            text.stock(o["stock"]).alias("quantity"),
            *(F.lit(0.0).alias(n) for n in ("price_impact", "weight_impact", "wholesale_price")),
            F.lit(1).alias("minimal_quantity"),
            text.ean(ean).alias("ean13"),
            F.lit("").alias("upc"),
            F.lit("").alias("mpn"),
            text.trim(o["available_in"]).alias("available_in"),
        )

    return ordered_with_default(F.transform("options", one))


def ordered_with_default(rows: Column) -> Column:
    """Structs that begin with their reference: its byte order decides; the first is the default."""
    return F.transform(F.array_sort(rows), lambda c, i: c.withField("default", i == 0))


def warning_set(warnings: Column) -> Column:
    """Distinct, in byte order, each of bounded length."""
    return F.array_sort(F.array_distinct(F.transform(warnings, lambda w: F.substring(w, 1, MOST_WARNING))))


def _warnings() -> Column:
    options = F.coalesce(F.col("options"), F.array())
    say = lambda what: lambda o: F.concat(F.lit(f"option {what}: "), text.trim(o["id"]))
    ean = F.transform(F.filter(options, lambda o: (text.trim(F.coalesce(o["ean"], F.lit(""))) != "") & (text.ean(F.coalesce(o["ean"], F.lit(""))) == "")), say("has an invalid EAN"))
    low = F.transform(F.filter(options, lambda o: text.stock_was_negative(o["stock"])), say("has a negative stock"))
    flagged = F.transform(F.coalesce(F.col("images"), F.array()), lambda u, i: F.when(~text.url_is_sound(u), F.concat(F.lit("image "), (i + 1).cast("string"), F.lit(" is not a usable address"))))
    images = F.filter(flagged, lambda w: w.isNotNull())
    return warning_set(F.concat(F.coalesce(F.col("supplier_warnings"), F.array().cast("array<string>")), ean, low, images))


def reject_reason() -> Column:
    """The first rule that a record breaks; null if it is valid."""
    o = F.coalesce(F.col("options"), F.array())
    optional = lambda c, most: (F.coalesce(text.trim(F.col(c)), F.lit("")) != "") & ~text.bounded(F.col(c), most)
    sizes = F.transform(o, lambda x: text.size_descriptor(x["name"]))
    ids = F.transform(o, lambda x: text.trim(x["id"]))
    return (
        F.when(~F.coalesce(text.trim(F.col("id")), F.lit("")).rlike("^[0-9]+$"), "id")
        .when(F.octet_length(F.col("id")) > MOST_REFERENCE_BYTES - 3, "id length")
        .when(~text.bounded(F.col("name"), text.MAX_NAME), "name")
        .when(text.price(F.col("price")).isNull(), "price")
        .when(optional("brand", text.MAX_BRAND), "brand")
        .when(F.octet_length(F.concat(F.lit("supplier-category:"), text.trim(F.coalesce(F.col("category.id"), F.lit(""))))) > MOST_KEY_BYTES, "category id length")
        .when((F.coalesce(text.trim(F.col("category_path")), F.lit("")) != "") & ~text.path_is_sound(F.col("category_path")), "category path")
        .when(optional("color", text.MAX_FEATURE), "color")
        .when(optional("type", text.MAX_FEATURE), "type")
        .when(F.size(F.coalesce(F.col("images"), F.array())) > MOST_IMAGES, "images")
        .when(F.size(o) > MOST_COMBINATIONS, "options")
        .when(F.exists(o, lambda x: ~F.coalesce(text.trim(x["id"]), F.lit("")).rlike("^[0-9]+$")), "option id")
        .when(F.exists(o, lambda x: ~text.bounded(x["name"], text.MAX_CATEGORY) | (F.octet_length(text.size_descriptor(x["name"])) > MOST_SIZE_BYTES)), "option size")
        .when(F.exists(o, lambda x: text.stock(x["stock"]).isNull()), "stock")
        .when(F.size(ids) != F.size(F.array_distinct(ids)), "option id twice")
        .when(F.size(sizes) != F.size(F.array_distinct(sizes)), "size twice")
    )


def normalize(raw: DataFrame, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """(products, rejects). Rejects have the record, its id and a reason; skipped records (unreadable, id known) are marked as such and don't block."""
    judged = raw.withColumn("reason", F.when(F.col("skip"), F.coalesce("skip_reason", F.lit("unreadable"))).otherwise(reject_reason()))
    rejects = judged.where("reason is not null").select("source_record", "id", "reason", F.coalesce("skip", F.lit(False)).alias("skipped"))
    good = judged.where("reason is null").withColumn("id", text.trim(F.col("id")))
    images = F.filter(F.transform(F.array_distinct("images"), text.trim), text.url_is_sound)
    category = F.when(F.coalesce(text.trim(F.col("category.id")), F.lit("")) != "", F.array(category_triple(F.concat(F.lit(f"{policy.key_prefix}-category:"), F.col("category.id")), F.col("category.name"), F.col("category_path")))).otherwise(F.array())
    products = good.select(
        "source_record",
        F.col("id").alias("source_key"),
        F.concat(F.lit(policy.reference_prefix), "id").alias("reference"),
        F.create_map(F.lit("default"), text.trim(F.col("name"))).alias("name"),
        text.price(F.col("price")).alias("price"),
        F.lit(0).alias("quantity"),
        F.lit(True).alias("active"),
        images.alias("images"),
        text.sanitise_html()(F.col("description")).alias("description"),
        F.lit(policy.language_id).cast("long").alias("source_language_id"),
        text.trim(F.coalesce("creation_date", F.lit(""))).alias("creation_date"),
        text.trim(F.coalesce("brand", F.lit(""))).alias("manufacturer"),
        category.alias("categories"),
        _features(F.coalesce("color", F.lit("")), F.coalesce("type", F.lit(""))).alias("features"),
        F.lit(True).alias("features_authoritative"),
        F.lit(policy.features_auto_create).alias("features_auto_create"),
        F.coalesce(_combinations(policy), F.array()).alias("combinations"),
        F.lit(True).alias("combinations_authoritative"),
        F.lit(policy.attributes_auto_create).alias("combination_attributes_auto_create"),
        _warnings().alias("supplier_warnings"),
    )
    return products, rejects
