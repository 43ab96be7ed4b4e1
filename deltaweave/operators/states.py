"""Writers of the state: each takes the state and rows to save, and returns the next state and the rows that it refuses, with a reason.

A refused row changes nothing. All conditions see the state as it was. Rows that a batch has twice by key are refused, both of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OWNER = ("id_shop", "source", "source_key")
# Most characters of what is kept of a key, a message, a reason, and the wait before an orphan is looked at.
MOST_KEY, MOST_MESSAGE, MOST_REASON, MOST_LAST_ERROR, FIRST_ORPHAN_MINUTES = 191, 8000, 64, 4000, 30


def _equal(a: str, b: str, names: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names))


def refused(rows: DataFrame, others: DataFrame, on: Sequence[str], wrong: Column, reason: str) -> DataFrame:
    """Rows r for which some other row o of equal `on` is wrong."""
    return rows.alias("r").join(others.alias("o"), _equal("r", "o", on) & wrong, "left_semi").withColumn("reason", F.lit(reason))


def repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the batch has more than once."""
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return refused(rows, twice, keys, F.lit(True), "given twice")


def accepted(rows: DataFrame, rejects: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.alias("r").join(rejects.alias("o"), _equal("r", "o", keys), "left_anti")


def upsert(state: DataFrame, rows: DataFrame, keys: Sequence[str], values: Sequence[str] | None = None, insert: bool = True) -> DataFrame:
    """State with `values` (all, if not named) of rows of equal key put in; without insert, only known keys change."""
    names = [c for c in state.columns if c not in keys]
    put = names if values is None else values
    joined = state.withColumn("known", F.lit(True)).alias("s").join(rows.withColumn("hit", F.lit(True)).alias("r"), _equal("s", "r", keys), "full_outer" if insert else "left")
    new, old = F.col("r.hit").isNotNull(), F.col("s.known").isNotNull()

    def pick(c: str) -> Column:
        if c not in rows.columns:
            return F.col(f"s.{c}")
        return F.when(new if c in put else new & ~old, F.col(f"r.{c}")).otherwise(F.col(f"s.{c}"))

    return joined.select(*(F.when(new, F.col(f"r.{k}")).otherwise(F.col(f"s.{k}")).alias(k) for k in keys), *(pick(c).alias(c) for c in names)).select(*state.columns)


def union(first: DataFrame, *rest: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rest, first)


def monotonic_save(state: DataFrame, rows: DataFrame, keys: Sequence[str], same: Sequence[str] = (), version: str = "id_run") -> tuple[DataFrame, DataFrame]:
    """Rows replace those of equal key. Refused: a row of an older run than the state's, and one whose `same` columns (the product, the rule) differ."""
    bad = [repeated(rows, keys), refused(rows, state, keys, F.col(f"o.{version}") > F.col(f"r.{version}"), "older run")]
    if same:
        differs = reduce(lambda a, b: a | b, (~F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}")) for c in same))
        bad.append(refused(rows, state, keys, differs & (F.col(f"o.{version}") <= F.col(f"r.{version}")), f"another {' or '.join(same)}"))
    rejects = union(*bad).dropDuplicates([*keys, version])
    return upsert(state, accepted(rows, rejects, keys), keys), rejects


def save_combinations(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By owner and semantic key. A variant that another identity of the shop owns (source, key, semantic key or product) can't be taken, nor can
    two rows name one variant."""
    keys, variant = [*OWNER, "semantic_key"], ["id_shop", "id_product_attribute"]
    other = ~reduce(lambda a, b: a & b, (F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("source", "source_key", "semantic_key", "id_product")))
    blank = F.exists(F.array(*(F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("source", "source_key", "semantic_key"))), lambda x: x == "")
    low = F.exists(F.array(*(F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("id_shop", "id_product", "id_product_attribute", "id_run"))), lambda x: x <= 0)
    partial = rows.where(blank | low).withColumn("reason", F.lit("identity is not whole"))
    rejects = union(partial, repeated(rows, keys), repeated(rows, variant), refused(rows, state, variant, other, "variant has another owner")).dropDuplicates([*keys, "id_product_attribute"])
    return upsert(state, accepted(rows, rejects, [*keys, "id_product_attribute"]), keys), rejects


def delete_exactly(state: DataFrame, rows: DataFrame, identity: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The state without the rows of these identities; refused is an identity that doesn't hit exactly one row, and it deletes nothing."""
    hits = state.groupBy(*identity).agg(F.count("*").alias("n"))
    wanted = rows.select(*identity).distinct()
    j = wanted.alias("r").join(hits.alias("o"), _equal("r", "o", identity), "left").select("r.*", F.coalesce("n", F.lit(0)).alias("n"))
    rejects = j.where("n <> 1").select(*identity, F.lit("owner has changed").alias("reason"))
    return state.alias("s").join(j.where("n = 1").alias("r"), _equal("s", "r", identity), "left_anti"), rejects


def owned(rows: DataFrame, mapping: DataFrame, active: bool = False) -> DataFrame:
    """Rows (owner, id_product) whose key maps to this very product; if active, to one that is in the feed."""
    live = mapping.where(~F.col("out_of_feed")) if active else mapping
    return rows.join(live.select(*OWNER, "id_product").distinct(), [*OWNER, "id_product"], "left_semi")


def assign_categories(state: DataFrame, rows: DataFrame, in_shop: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id_shop, supplier_key) to id_category and active, updated_at; a null id takes the category away. Refused: a category that isn't in the
    shop, and a key that the state doesn't know."""
    keys = ["id_shop", "supplier_key"]
    known = state.select(*keys).distinct()
    strange = rows.alias("r").join(known.alias("o"), _equal("r", "o", keys), "left_anti").withColumn("reason", F.lit("unknown key"))
    elsewhere = rows.where("id_category is not null").join(in_shop.select("id_shop", "id_category").distinct(), ["id_shop", "id_category"], "left_anti").select(*rows.columns).withColumn("reason", F.lit("category is not in the shop"))
    rejects = union(repeated(rows, keys), strange, elsewhere).dropDuplicates(keys)
    return upsert(state, accepted(rows, rejects, keys), keys, ("id_category", "active", "updated_at"), insert=False), rejects


IMAGE_KEYS = [*OWNER, "url_hash"]


def save_images(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a download has measured replaces all that the state has of the key."""
    rejects = repeated(rows, IMAGE_KEYS)
    return upsert(state, accepted(rows, rejects, IMAGE_KEYS), IMAGE_KEYS), rejects


def touch_images(state: DataFrame, rows: DataFrame, images: DataFrame, image_shops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (key, id_product, id_image, position, is_cover, last_seen_run_id, updated_at) of content that hasn't changed: only place, cover, run
    and time change, and only while the state's image is that of the product and in the shop. Others are refused."""
    identity = [*IMAGE_KEYS, "id_product", "id_image"]
    live = state.join(images.select("id_image", "id_product").distinct(), ["id_image", "id_product"], "left_semi").join(image_shops.select("id_image", "id_shop").distinct(), ["id_image", "id_shop"], "left_semi")
    lost = rows.alias("r").join(live.alias("o"), _equal("r", "o", identity), "left_anti").withColumn("reason", F.lit("image is no longer live"))
    rejects = union(lost, repeated(rows, IMAGE_KEYS)).dropDuplicates(IMAGE_KEYS)
    return upsert(state, accepted(rows, rejects, IMAGE_KEYS), IMAGE_KEYS, ("position", "is_cover", "last_seen_run_id", "updated_at"), insert=False), rejects


def verified_pairs(parents: DataFrame, values: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose parent and value the tables now have with the very ids that the rows name."""
    keys = ["id_shop", "source", "key"]
    both = parents.select(*keys, F.col("id_parent").alias("parent_has")).join(values.select(*keys, "value_key", F.col("id_parent").alias("value_has"), F.col("id_value").alias("value_id")), keys)
    return rows.join(both, [*keys, "value_key"]).where("parent_has = id_parent and value_has = id_parent and value_id = id_value").select(*rows.columns)


def save_pairs(parents: DataFrame, values: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features or attribute groups (id_shop, source, key, name, id_parent) and their values (.., value_key, value, id_parent, id_value).

    A key that is known by a label that differs in more than case and outer spaces is refused, and so is a row that the tables
    don't confirm after the write: where rows of a batch disagree on a parent's id, the smallest is written.
    """
    keys = ["id_shop", "source", "key"]
    plain = lambda c: F.lower(F.trim(F.col(c)))
    other_name = refused(rows, parents, keys, plain("o.name") != plain("r.name"), "key has another label")
    other_value = refused(rows, values, [*keys, "value_key"], plain("o.value") != plain("r.value"), "value key has another label")
    bad = union(other_name, other_value, rows.where("id_shop <= 0 or id_parent <= 0 or id_value <= 0").withColumn("reason", F.lit("identity is not whole")), repeated(rows, [*keys, "value_key"])).dropDuplicates([*keys, "value_key"])
    good = accepted(rows, bad, [*keys, "value_key"])
    next_parents = upsert(parents, good.groupBy(*keys).agg(F.min_by("name", "id_parent").alias("name"), F.min("id_parent").alias("id_parent")), keys)
    next_values = upsert(values, good.select(*keys, "value_key", "value", "id_parent", "id_value"), [*keys, "value_key"])
    unconfirmed = accepted(good, verified_pairs(next_parents, next_values, good), [*keys, "value_key"]).withColumn("reason", F.lit("not confirmed after the write"))
    return next_parents, next_values, union(bad, unconfirmed)


def record_orphans(orphans: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Images that nothing may need any more, by (id_shop, id_product, id_image): due after FIRST_ORPHAN_MINUTES; a known one keeps its attempts
    and its time of creation."""
    keys = ["id_shop", "id_product", "id_image"]
    last = F.nullif(F.trim(F.coalesce("last_error", F.lit(""))), F.lit(""))
    new = rows.where("id_image > 0").withColumns({"reason": F.substring(F.trim("reason"), 1, MOST_REASON), "last_error": F.substring(last, 1, MOST_LAST_ERROR), "available_at": now + F.expr(f"INTERVAL {FIRST_ORPHAN_MINUTES} MINUTES"), "attempts": F.lit(0), "created_at": now, "updated_at": now})
    return upsert(orphans, new, keys, [c for c in orphans.columns if c not in (*keys, "attempts", "created_at")])


def error_rows(rows: DataFrame, run: int, stage: str, now: Column) -> DataFrame:
    """(source_key, message) as rows of the error table: keys and messages cut, blank keys null."""
    key = F.substring(F.nullif(F.col("source_key"), F.lit("")), 1, MOST_KEY)
    return rows.select(F.lit(run).cast("long").alias("id_run"), F.lit(stage).alias("stage"), key.alias("source_key"), F.substring("message", 1, MOST_MESSAGE).alias("message"), now.alias("created_at"))


def next_position(rows: DataFrame, *by: str) -> DataFrame:
    """The place after the last one, 0 where there is none; per group, if named."""
    after = (F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("next_position")
    return rows.groupBy(*by).agg(after) if by else rows.agg(after)
