"""Fingerprints of normalised records: one per domain, and one of the payload.

What counts is which edits change which fingerprint. Maps become structs with a fixed order of fields, lists keep theirs
unless the domain says that order does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOMAINS = ("core", "price", "stock", "attribute", "feature", "category", "combination", "combination_stock", "specific_price", "image")
SCOPE = ("id_product_attribute", "id_currency", "id_country", "id_group", "id_customer", "from_quantity", "from", "to")


def digest(*cols: Column) -> Column:
    """SHA-256 of the columns as a JSON array; null fields count as null."""
    return F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(cols))), {"ignoreNullFields": "false"}), 256)


def joined_key(*cols: Column) -> Column:
    """SHA-256 of the columns' texts with bars between."""
    return F.sha2(F.concat_ws("|", *cols), 256)


def token(attribute: Column) -> Column:
    """`id:<n>` of a known attribute, else `supplier:<group>:<value>`."""
    return F.when(attribute["id"].isNotNull(), F.concat(F.lit("id:"), attribute["id"].cast("string"))).otherwise(F.concat(F.lit("supplier:"), F.trim(F.coalesce(attribute["group_key"], F.lit(""))), F.lit(":"), F.trim(F.coalesce(attribute["value_key"], F.lit("")))))


def semantic(tokens: Column) -> Column:
    """A combination's identity: its distinct tokens in byte order."""
    return F.array_join(F.array_sort(F.array_distinct(tokens)), "|")


def semantic_key(ids: Column) -> Column:
    """SHA-256 of the sorted distinct attribute ids."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(ids)).cast("array<string>"), ":"), 256)


def feature_rows(features: Column) -> Column:
    rows = F.transform(features, lambda r: F.struct(*(F.trim(F.coalesce(r[k], F.lit(""))).alias(k) for k in ("key", "value_key", "name", "value"))))
    return F.array_sort(rows)


def combination_rows(combinations: Column) -> Column:
    """Structure: neither quantity nor availability."""
    fields = ("reference", "price_impact", "weight_impact", "wholesale_price", "minimal_quantity", "ean13", "upc", "mpn", "default")
    return F.array_sort(F.transform(combinations, lambda r: F.struct(semantic(F.transform(r["attributes"], token)).alias("semantic"), *(r[f].alias(f) for f in fields))))


def combination_stock_rows(combinations: Column) -> Column:
    return F.array_sort(F.transform(combinations, lambda r: F.struct(semantic(F.transform(r["attributes"], token)).alias("semantic"), r["quantity"].alias("quantity"))))


def specific_price_rows(prices: Column) -> Column:
    amounts = ("price", "reduction", "reduction_tax", "reduction_type")
    return F.array_sort(F.transform(prices, lambda r: F.struct(*(r[k].alias(k) for k in (*SCOPE, *amounts)))))


def with_hashes(products: DataFrame) -> DataFrame:
    """Adds payload_hash and a hash of each domain; missing collections hash as empty ones."""
    have = set(products.columns)
    c = lambda name, other=None: F.col(name) if name in have else F.lit(other)
    empty = F.lit(None).cast("string")
    rows = lambda name, f: f(F.col(name)) if name in have else empty
    features, structure = rows("features", feature_rows), rows("combinations", combination_rows)
    amounts, prices = rows("combinations", combination_stock_rows), rows("specific_prices", specific_price_rows)
    core = [c("reference"), c("name"), c("active"), c("description"), c("manufacturer"), c("source_language_id")]
    hashes = {
        "core": digest(*core),
        "price": digest(c("price")),
        "stock": digest(c("quantity")),
        "attribute": digest(c("attributes")),
        "feature": digest(c("features_authoritative", False), c("features_auto_create", False), features),
        "category": digest(c("categories")),
        "combination": digest(c("combinations_authoritative", False), c("combination_attributes_auto_create", False), structure),
        "combination_stock": digest(amounts),
        "specific_price": digest(c("specific_prices_authoritative", False), c("specific_prices_adopt_existing", False), prices),
        "image": digest(c("images")),
    }
    payload = [c(n) for n in sorted(have - {"images", "id_run", "source_record", "byte_end"})]
    return products.withColumns({f"{k}_hash": v for k, v in hashes.items()} | {"payload_hash": digest(*payload)})
