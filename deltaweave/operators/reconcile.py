"""Desired, owned and actual child rows set against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def features(desired: DataFrame, owned: DataFrame, actual: DataFrame, authoritative: bool = True) -> DataFrame:
    """Per product and feature: the value that stays (null: removed) and whether it is ours.

    What is owned and no longer desired goes if the feed is authoritative and the value is still as it was set. A value set
    by hand that equals the desired one isn't adopted.
    """
    keys = ["id_product", "feature"]
    side = lambda df, name: df.select(*keys, F.col("value").alias(name))
    j = side(desired, "desired").join(side(owned, "owned"), keys, "full_outer").join(side(actual, "actual"), keys, "full_outer")
    want = F.col("desired").isNotNull()
    stale = ~want & F.col("owned").isNotNull() & F.lit(authoritative) & F.col("owned").eqNullSafe(F.col("actual"))
    final = F.when(want, F.col("desired")).when(stale, F.lit(None)).otherwise(F.col("actual"))
    ours = want & (F.col("owned").eqNullSafe(F.col("desired")) | F.col("actual").isNull() | ~F.col("actual").eqNullSafe(F.col("desired")))
    action = F.when(stale, "remove").when(want & F.col("actual").isNull(), "add").when(want & (F.col("actual") != F.col("desired")), "change").otherwise("keep")
    return j.select(*keys, final.alias("value"), ours.alias("owned"), action.alias("action"))


def variants(desired: DataFrame, owned: DataFrame, actual: DataFrame, authoritative: bool = True) -> DataFrame:
    """Matches desired combinations (id_product, semantic, hash, stock_hash) to variants.

    owned: (id_product, semantic, id_variant, hash, stock_hash); actual: (id_product, semantic, id_variant, reusable).
    The mapped variant is used if it is reusable, else the reusable one of smallest id, else one is created. Owned ones that
    were not chosen go if their combination is chosen anew, or not desired and the feed is authoritative.
    """
    keys = ["id_product", "semantic"]
    free = actual.where("reusable").groupBy(*keys).agg(F.min("id_variant").alias("least_id"), F.array_sort(F.collect_set("id_variant")).alias("free_ids"))
    mine = owned.select(*keys, F.col("id_variant").alias("own_id"), F.col("hash").alias("own_hash"), F.col("stock_hash").alias("own_stock_hash"))
    j = desired.join(mine, keys, "left").join(free, keys, "left")
    chosen = F.when(F.coalesce(F.array_contains("free_ids", F.col("own_id")), F.lit(False)), F.col("own_id")).otherwise(F.col("least_id"))
    plan = j.withColumn("id_variant", chosen)
    created = F.col("id_variant").isNull()
    moved = ~F.col("own_id").eqNullSafe(F.col("id_variant"))
    kept = plan.select(*keys, "id_variant", F.when(created, "create").otherwise("use").alias("action"), (created | moved | ~F.col("own_hash").eqNullSafe(F.col("hash"))).alias("structure_changed"), (~created & (moved | ~F.col("own_stock_hash").eqNullSafe(F.col("stock_hash")))).alias("write_stock"))
    gone = mine.join(plan.select(*keys, "id_variant"), keys, "left").where(F.col("id_variant").isNotNull() & (F.col("own_id") != F.col("id_variant")))
    dropped = gone.select(*keys, F.col("own_id").alias("id_variant"))
    if authoritative:
        dropped = dropped.union(mine.join(desired, keys, "left_anti").select(*keys, F.col("own_id").alias("id_variant")))
    return kept.unionByName(dropped.select(*keys, "id_variant", F.lit("remove").alias("action"), F.lit(True).alias("structure_changed"), F.lit(False).alias("write_stock")))


def fields_differ(a: Column, b: Column) -> Column:
    """Numbers that differ by more than the tolerance."""
    return F.abs(a - b) > TOLERANCE


#: Fields of a variant that are compared as numbers.
FIELDS = ("price_impact", "weight_impact", "wholesale_price", "minimal_quantity")


def variants_by_fields(desired: DataFrame, owned: DataFrame, actual: DataFrame, authoritative: bool = True) -> DataFrame:
    """As variants(), and by what the shop's variants really are: desired and actual have FIELDS too, and a variant whose fields differ from the desired ones by
    more than the tolerance is changed even where its hash says nothing. A missing amount is 0, a missing quantity 1.

    One pass: the rows of all three meet by (id_product, semantic), one group for each, in which there is one desired row, one owned row and the few
    variants of that combination. fields_changed says that a used variant's fields differ.
    """
    keys = ["id_product", "semantic"]
    numbers = [F.coalesce(F.col(f).cast("double"), F.lit(1.0 if f == "minimal_quantity" else 0.0)).alias(f) for f in FIELDS]
    none = lambda kind: F.lit(None).cast(kind)
    want_type, own_type = "struct<hash:string,stock_hash:string,fields:array<double>>", "struct<id_variant:bigint,hash:string,stock_hash:string>"
    has_type = "struct<id_variant:bigint,fields:array<double>>"
    want = desired.select(*keys, F.struct("hash", "stock_hash", F.array(*numbers).alias("fields")).alias("want"), none(own_type).alias("own"), none(has_type).alias("has"))
    own = owned.select(*keys, none(want_type).alias("want"), F.struct(F.col("id_variant").cast("long").alias("id_variant"), "hash", "stock_hash").alias("own"), none(has_type).alias("has"))
    has = actual.where("reusable and id_variant is not null").select(*keys, none(want_type).alias("want"), none(own_type).alias("own"), F.struct(F.col("id_variant").cast("long").alias("id_variant"), F.array(*numbers).alias("fields")).alias("has"))
    met = want.unionByName(own).unionByName(has).groupBy(*keys).agg(F.min("want").alias("want"), F.min("own").alias("own"), F.array_sort(F.collect_set("has")).alias("free"))
    mine = F.filter("free", lambda v: v["id_variant"] == F.col("own.id_variant"))
    met = met.withColumn("chosen", F.when(F.size(mine) > 0, mine[0]).otherwise(F.get("free", F.lit(0))))
    id_variant = F.col("chosen.id_variant")
    created = id_variant.isNull()
    moved = ~F.col("own.id_variant").eqNullSafe(id_variant)
    fields = F.coalesce(F.exists(F.zip_with("want.fields", "chosen.fields", fields_differ), lambda x: x), F.lit(False))
    row = lambda i, action, structure, stock, by_fields: F.struct(i.alias("id_variant"), F.lit(action).alias("action") if isinstance(action, str) else action.alias("action"), structure.alias("structure_changed"), stock.alias("write_stock"), by_fields.alias("fields_changed"))
    kept = row(id_variant, F.when(created, "create").otherwise("use"), created | moved | ~F.col("own.hash").eqNullSafe(F.col("want.hash")) | fields, ~created & (moved | ~F.col("own.stock_hash").eqNullSafe(F.col("want.stock_hash"))), fields)
    gone = row(F.col("own.id_variant"), "remove", F.lit(True), F.lit(False), F.lit(False))
    wanted = F.col("want").isNotNull()
    drop = F.col("own").isNotNull() & F.when(wanted, id_variant.isNotNull() & moved).otherwise(F.lit(authoritative))
    rows = F.filter(F.array(F.when(wanted, kept), F.when(drop, gone)), lambda r: r.isNotNull())
    return met.select(*keys, F.inline(rows))


def healed_default(rows: DataFrame) -> DataFrame:
    """(id_product, default_id, error): which of a product's surviving variants is the default afterwards, or why it can't be.

    rows: (id_product, id_variant, survivor, wanted, is_default, in_shop), a row a variant of the shop or of the survivors. The wanted survivor is it, of several
    or of none the one of smallest id; it has to be in the shop, and no variant of somebody else's may be the default. Without a survivor the
    default stays what it is: the smallest that is one now.
    """
    least = lambda c: F.min(F.when(c, F.col("id_variant")))
    s = F.col("survivor")
    met = rows.groupBy("id_product").agg(least(s & F.col("wanted")).alias("wanted"), least(s).alias("first"), least(~s & F.col("is_default") & F.col("in_shop")).alias("outside"), least(F.col("is_default") & F.col("in_shop")).alias("now"), F.array_sort(F.collect_set(F.when(s & F.col("in_shop"), F.col("id_variant")))).alias("there"))
    chosen = F.coalesce("wanted", "first")
    error = F.when(chosen.isNull(), None).when(~F.array_contains("there", chosen), F.lit("the default isn't in the shop")).when(F.col("outside").isNotNull(), F.lit("another's variant is the default"))
    return met.select("id_product", F.when(error.isNull(), F.coalesce(chosen, F.col("now"))).alias("default_id"), error.alias("error"))


def default_variant(rows: DataFrame) -> DataFrame:
    """(id_product, id_variant, is_default): the default of each product, or the smallest id; two defaults are an error."""
    flagged = F.when(F.col("is_default"), F.col("id_variant"))
    return rows.groupBy("id_product").agg(F.coalesce(F.max(flagged), F.min("id_variant")).alias("default_id"), (F.count(flagged) > 1).alias("is_error"))


def specific_prices(desired: DataFrame, owned: DataFrame, live: DataFrame, adopt: bool = False, authoritative: bool = True) -> DataFrame:
    """By scope key: owned rules that are live are updated, a single live match is adopted if allowed, several are an error,
    else one is created; what is owned and not desired goes only while it is as it was applied."""
    matches = live.groupBy("scope").agg(F.count("*").alias("n_live"), F.min("id_rule").alias("least_rule"))
    by_id = live.select(F.col("id_rule").alias("live_id"), F.col("hash").alias("live_hash"))
    o = owned.select("scope", F.col("id_rule").alias("own_id"), F.col("hash").alias("applied_hash")).join(by_id, F.col("own_id") == F.col("live_id"), "left")
    j = desired.select("scope", F.lit(True).alias("wanted")).join(o, "scope", "full_outer").join(matches, "scope", "left")
    n = F.coalesce("n_live", F.lit(0))
    action = (
        F.when(F.col("wanted") & F.col("live_id").isNotNull(), "update")
        .when(F.col("wanted") & (n > 1), "error")
        .when(F.col("wanted") & (n == 1) & F.lit(adopt), "adopt")
        .when(F.col("wanted"), "create")
        .when(F.lit(authoritative) & (F.col("live_hash") == F.col("applied_hash")), "delete")
        .otherwise("release")
    )
    return j.select("scope", F.coalesce("live_id", F.when(action == "adopt", F.col("least_rule"))).alias("id_rule"), action.alias("action"))


def image_manifest(products: DataFrame) -> DataFrame:
    """(id_product, urls) to one row per distinct trimmed URL in order: position from 0, the first is the cover."""
    urls = F.array_distinct(F.filter(F.transform("urls", lambda u: F.trim(u)), lambda u: u != ""))
    rows = products.select("id_product", F.posexplode(urls).alias("position", "url"))
    return rows.withColumn("is_cover", F.col("position") == 0)


def images(desired: DataFrame, state: DataFrame) -> DataFrame:
    """(id_product, url) of both: missing (desired without state), keep, or remove."""
    keys = ["id_product", "url"]
    j = desired.select(*keys, "position", F.lit(True).alias("wanted")).join(state.select(*keys, "id_image"), keys, "full_outer")
    return j.select(*keys, "position", "id_image", F.when(F.col("wanted").isNull(), "remove").when(F.col("id_image").isNull(), "missing").otherwise("keep").alias("action"))


def image_removal(removed: DataFrame, references: DataFrame, image_shops: DataFrame) -> DataFrame:
    """removed: (id_image, id_shop, url). delete: no other reference and no other shop has it; detach: no other reference of
    this shop; else only the state goes."""
    all_refs = references.groupBy("id_image").agg(F.count("*").alias("n_refs"))
    own_refs = references.groupBy("id_image", "id_shop").agg(F.count("*").alias("n_own"))
    shops = image_shops.groupBy("id_image").agg(F.count_distinct("id_shop").alias("n_shops"))
    j = removed.join(all_refs, "id_image", "left").join(own_refs, ["id_image", "id_shop"], "left").join(shops, "id_image", "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(0)) <= 1
    return j.select("id_image", "id_shop", "url", F.when(one("n_refs") & one("n_shops"), "delete").when(one("n_own"), "detach").otherwise("drop state").alias("action"))


def placement(rows: DataFrame) -> DataFrame:
    """(id_product, id_image, position, is_cover): one row per image, positions from 1, one cover."""
    merged = rows.groupBy("id_product", "id_image").agg(F.min("position").alias("least"), F.bool_or("is_cover").alias("flag"))
    w = Window.partitionBy("id_product").orderBy("least", "id_image")
    first_flag = Window.partitionBy("id_product").orderBy(F.desc("flag"), "least", "id_image")
    return merged.select("id_product", "id_image", F.row_number().over(w).alias("position"), (F.row_number().over(first_flag) == 1).alias("is_cover"))


def reusable_content(state: DataFrame, keys: tuple[str, ...] = ("id_shop", "source", "id_product", "content_hash")) -> DataFrame:
    """The newest image of each content; ties by id."""
    return state.groupBy(*keys).agg(F.max(F.struct("updated_at", "id_image"))["id_image"].alias("id_image"))


def exclusive_to_shop(links: DataFrame, item: str, shop: str) -> DataFrame:
    """Items that one shop alone has, with that shop."""
    return links.groupBy(item).agg(F.min(shop).alias(shop), F.max(shop).alias("last_shop")).where(F.col(shop) == F.col("last_shop")).drop("last_shop")


def detachable(links: DataFrame, item: str, shop: str, from_shop: int) -> DataFrame:
    """Items of a shop that some other shop still has."""
    others = links.where(F.col(shop) != from_shop).select(item).distinct()
    return links.where(F.col(shop) == from_shop).select(item, shop).distinct().join(others, item, "left_semi")


def resolve_attributes(references: DataFrame, mapping: DataFrame, available: DataFrame) -> DataFrame:
    """(id_product, combination, group_key, value_key) to sorted distinct attribute ids, or what is unresolved."""
    known = mapping.join(available, "id_attribute", "left_semi")
    j = references.join(known, ["group_key", "value_key"], "left")
    return j.groupBy("id_product", "combination").agg(F.array_sort(F.collect_set("id_attribute")).alias("ids"), F.count_if(F.col("id_attribute").isNull()).alias("n_unresolved"))


def repair_rows(have: DataFrame, targets: list, key: str, target: str, preference: str) -> DataFrame:
    """For each key and target without a row, the source it is copied from: the present one of lowest preference."""
    best = have.groupBy(key).agg(F.min(F.struct(preference, target))[target].alias("copy_from"))
    wanted = best.select(key, "copy_from", F.explode(F.array(*(F.lit(t) for t in targets))).alias(target))
    return wanted.join(have.select(key, target), [key, target], "left_anti")
