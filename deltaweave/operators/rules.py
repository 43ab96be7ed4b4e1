"""Rules of child rows: features, combinations and specific prices in normal form, and the first rule that a product breaks.

Each function takes the array column of a product. What a row lacks gets its default; an error is a text, or null where there is none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import hashing, text

# Most items of each collection, most bytes of each field, and how a date that isn't set is written.
MOST = {"images": 1000, "categories": 256, "features": 1024, "combinations": 5000, "specific_prices": 5000}
MOST_COMBINATION_ATTRIBUTES = 64
FEATURE_BYTES = {"key": 191, "value_key": 191, "name": 128, "value": 255}
COMBINATION_BYTES = {"reference": 64, "ean13": 13, "upc": 12, "mpn": 40}
NO_DATE = "0000-00-00 00:00:00"
REDUCTIONS = ("amount", "percentage")


def first_error(*rules: tuple[Column, str]) -> Column:
    """The text of the first condition that holds."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in rules))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is made once a row, however often use names it: inside functions of arrays Spark makes it anew each time."""
    return F.transform(F.array(value), use)[0]


def _or_blank(c: Column) -> Column:
    return text.trim(F.coalesce(c.cast("string"), F.lit("")))


def _twice(values: Column) -> Column:
    return F.size(values) != F.size(F.array_distinct(values))


def _exceeds(rows: Column, field: str, most: int) -> Column:
    return F.exists(rows, lambda r: F.octet_length(r[field]) > most)


def collection_error(columns: dict[str, Column]) -> Column:
    """The first collection (by name) that holds more than it may; of combinations also the attributes of each."""
    rules = [(F.size(c) > MOST[name], f"too many {name}") for name, c in columns.items()]
    if "combinations" in columns:
        rules.append((F.exists(columns["combinations"], lambda r: F.size(r["attributes"]) > MOST_COMBINATION_ATTRIBUTES), "too many attributes of a combination"))
    return first_error(*rules)


def features(rows: Column) -> Column:
    """Trimmed and in order of key and value key."""
    return hashing.feature_rows(F.coalesce(rows, F.array().cast("array<struct<key:string,value_key:string,name:string,value:string>>")))


def feature_error(rows: Column) -> Column:
    def error(rows: Column) -> Column:
        blank = F.exists(rows, lambda r: (r["key"] == "") | (r["value_key"] == ""))
        pairs = F.transform(rows, lambda r: F.struct(r["key"], r["value_key"]))
        long = [(_exceeds(rows, f, n), f"feature {f} is too long") for f, n in FEATURE_BYTES.items()]
        return first_error((blank, "feature without a key"), (_once(pairs, _twice), "feature pair twice"), *long)

    return _once(features(rows), error)


def _normal_combinations(rows: Column) -> Column:
    """attribute_ids sorted and distinct, defaults and the semantic key; in order of it."""

    def ids(r: Column) -> Column:
        return F.array_sort(F.array_distinct(F.coalesce(r["attribute_ids"], F.array().cast("array<bigint>"))))

    def normal(r: Column, ids: Column) -> Column:
        words = [_or_blank(r[f]) for f in COMBINATION_BYTES]
        amounts = [F.coalesce(r[f].cast("double"), F.lit(0.0)) for f in ("price_impact", "weight_impact", "wholesale_price")]
        least, quantity = F.coalesce(r["minimal_quantity"].cast("long"), F.lit(1)), F.coalesce(r["quantity"].cast("long"), F.lit(0))
        named = dict(zip((*COMBINATION_BYTES, "price_impact", "weight_impact", "wholesale_price"), [*words, *amounts], strict=True))
        return F.struct(hashing.semantic_key(ids).alias("semantic_key"), ids.alias("attribute_ids"), *(c.alias(n) for n, c in named.items()), least.alias("minimal_quantity"), quantity.alias("quantity"), F.coalesce(r["default"], F.lit(False)).alias("default"))

    return F.array_sort(F.transform(rows, lambda r: _once(ids(r), lambda i: normal(r, i))))


def combinations(rows: Column) -> Column:
    """attribute_ids sorted and distinct, defaults, the semantic key, a hash of the structure and one of the stock; in order of the semantic key."""

    def hashed(r: Column) -> Column:
        named = [r[f] for f in (*COMBINATION_BYTES, "price_impact", "weight_impact", "wholesale_price")]
        structure = hashing.digest(r["semantic_key"], r["attribute_ids"], *named, r["minimal_quantity"])
        return r.withField("structure_hash", structure).withField("stock_hash", hashing.digest(r["semantic_key"], r["quantity"]))

    return F.transform(_normal_combinations(rows), hashed)


def combination_error(rows: Column) -> Column:
    def error(normal: Column) -> Column:
        bare = F.exists(normal, lambda r: (F.size(r["attribute_ids"]) == 0) | F.exists(r["attribute_ids"], lambda i: i.isNull() | (i <= 0)))
        long = [(_exceeds(normal, f, n), f"combination {f} is too long") for f, n in COMBINATION_BYTES.items()]
        few = F.exists(normal, lambda r: r["minimal_quantity"] < 1)
        keys = F.transform(normal, lambda r: r["semantic_key"])
        return first_error((bare, "combination without attributes"), (_once(keys, _twice), "combination twice"), *long, (few, "minimal quantity below 1"))

    return _once(_normal_combinations(rows), error)


def date(value: Column) -> Column:
    """A date, or a date and time, as a time of the day's first second if none is given; NO_DATE where it isn't set; null where there is no such day."""
    t = _or_blank(value)
    whole = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit(" 00:00:00"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), t)
    return F.when(t.isin("", "0000-00-00", NO_DATE), F.lit(NO_DATE)).when(whole.try_cast("timestamp_ntz").isNotNull(), whole)


def scope_key(shop: Column, r: Column) -> Column:
    """What may have one specific price only: the shop, the ids, the least quantity and both dates, as SHA-256 of a JSON list."""
    numbers = F.concat_ws(",", shop.cast("string"), *(r[f].cast("string") for f in hashing.SCOPE[:6]))
    return F.sha2(F.concat(F.lit("["), numbers, F.lit(',"'), r["from"], F.lit('","'), r["to"], F.lit('"]')), 256)


def specific_prices(rows: Column, shop: Column) -> Column:
    """Ids of at least 0, quantities of at least 1, canonical dates, and the scope key; in order of it."""

    def one(r: Column) -> Column:
        at_least = lambda f, n: F.greatest(F.coalesce(r[f].cast("long"), F.lit(n)), F.lit(n)).cast("long").alias(f)
        kind = F.lower(text.trim(F.coalesce(r["reduction_type"], F.lit("amount"))))
        amounts = [F.coalesce(r["price"].cast("double"), F.lit(-1.0)).alias("price"), F.coalesce(r["reduction"].cast("double"), F.lit(0.0)).alias("reduction")]
        taxed = F.when(F.coalesce(r["reduction_tax"].cast("int"), F.lit(0)) != 0, 1).otherwise(0)
        return F.struct(*(at_least(f, 0) for f in hashing.SCOPE[:5]), at_least("from_quantity", 1), date(r["from"]).alias("from"), date(r["to"]).alias("to"), *amounts, taxed.alias("reduction_tax"), kind.alias("reduction_type"))

    normal = F.transform(rows, one)
    return F.array_sort(F.transform(normal, lambda r: F.struct(scope_key(shop, r).alias("scope"), *(r[f].alias(f) for f in (*hashing.SCOPE, "price", "reduction", "reduction_tax", "reduction_type")))))


def specific_price_error(rows: Column, shop: Column, own_variants: Column | None = None) -> Column:
    """own_variants: the ids of the product's variants in the shop, where prices that name another are to be refused."""

    def error(normal: Column) -> Column:
        amount = F.exists(normal, lambda r: (r["price"] < -1) | (r["reduction"] < 0) | ((r["reduction_type"] == "percentage") & (r["reduction"] > 1)))
        foreign = F.lit(False) if own_variants is None else F.exists(normal, lambda r: (r["id_product_attribute"] > 0) & ~F.array_contains(own_variants, r["id_product_attribute"]))
        return first_error(
            (F.exists(normal, lambda r: ~r["reduction_type"].isin(*REDUCTIONS)), "reduction type"),
            (amount, "amount"),
            (F.exists(normal, lambda r: r["from"].isNull() | r["to"].isNull()), "date"),
            (foreign, "variant of another product"),
            (_once(F.transform(normal, lambda r: r["scope"]), _twice), "scope twice"),
        )

    return _once(specific_prices(rows, shop), error)
