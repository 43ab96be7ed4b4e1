"""Attributes of combinations: from references, by id or by the supplier's keys, to ids of the shop, and what has to be made for those without one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .states import next_position

# References that a product may have, bytes of a group's name and of a value's.
MOST_REFERENCES = 20_000
MOST_GROUP_BYTES = 64
MOST_VALUE_BYTES = 128


@dataclass
class Resolved:
    """combinations: (id_product, combination, ids), ids sorted; groups, attributes: new rows of the shop's tables; pairs: keys that now have an id by
    their names, to be saved; rejects: (id_product, reason) of the products that are refused whole, for which nothing is made."""

    combinations: DataFrame
    groups: DataFrame
    attributes: DataFrame
    pairs: DataFrame
    rejects: DataFrame


def _judged(references: DataFrame, mapping: DataFrame, available: DataFrame, groups: DataFrame, attributes: DataFrame, auto_create: bool, most: int) -> DataFrame:
    """References with the id they have (found) or why they can't have one (reason); with neither, theirs has to be made."""
    plain = references.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("group_key", "value_key", "group_name", "value")})
    live = available.select("id_attribute").distinct()
    mapped = mapping.join(live, "id_attribute", "left_semi").groupBy("group_key", "value_key").agg(F.min("id_attribute").alias("mapped_id"))
    by_group = groups.groupBy(F.col("name").alias("group_name")).agg(F.count("*").alias("n_groups"), F.min("id_group").alias("id_group"))
    by_value = attributes.groupBy("id_group", F.col("name").alias("value")).agg(F.count("*").alias("n_values"), F.min("id_attribute").alias("named_id"))
    large = references.groupBy("id_product").agg(F.count("*").alias("n")).where(F.col("n") > most).select("id_product", F.lit(True).alias("large"))
    j = plain.join(mapped, ["group_key", "value_key"], "left").join(live.withColumnRenamed("id_attribute", "live_id"), F.col("id_attribute") == F.col("live_id"), "left")
    j = j.join(by_group, "group_name", "left").join(by_value, ["id_group", "value"], "left").join(large, "id_product", "left")
    reason = F.when(F.col("large"), "too many attribute references").when(F.col("id_attribute").isNotNull(), F.when(F.col("live_id").isNull(), "attribute is not in the shop"))
    reason = reason.when((F.col("group_key") == "") | (F.col("value_key") == ""), "a key is blank").when(F.col("mapped_id").isNotNull(), F.lit(None))
    reason = reason.when(F.lit(not auto_create), "no attribute for the keys").when((F.col("group_name") == "") | (F.col("value") == ""), "a name is blank")
    reason = reason.when((F.octet_length("group_name") > MOST_GROUP_BYTES) | (F.octet_length("value") > MOST_VALUE_BYTES), "a name is too long")
    reason = reason.when((F.col("n_groups") > 1) | (F.col("n_values") > 1), "a name has several ids")
    return j.withColumn("reason", reason).withColumn("found", F.coalesce("id_attribute", "mapped_id", "named_id"))


def resolve(references: DataFrame, mapping: DataFrame, available: DataFrame, groups: DataFrame, attributes: DataFrame, auto_create: bool = False, most: int = MOST_REFERENCES) -> Resolved:
    """References (id_product, combination, id_attribute or null, group_key, value_key, group_name, value) to ids.

    An id must be in the shop (available); keys have an id by the mapping, if that one is in the shop; else, with auto_create, by exactly equal names among
    groups (id_group, name, position) and attributes (id_attribute, id_group, name, position), and where these have none it is made: new ids and positions go on from
    the largest, in order of names. One bad reference refuses its product. New groups are numbered in one task, new values in one a group: they are
    distinct names of a shop's sizes and colours, not rows of products.
    """
    judged = _judged(references, mapping, available, groups, attributes, auto_create, most)
    rejects = judged.where("reason is not null").groupBy("id_product").agg(F.min("reason").alias("reason"))
    good = judged.join(rejects.select("id_product"), "id_product", "left_anti")
    wanted = good.where("found is null").select("group_name", "value", "id_group").distinct()

    last = groups.agg(F.coalesce(F.max("id_group"), F.lit(0)).alias("last"), (F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("next_position"))  # one row, as is start
    row = F.row_number().over(Window.orderBy("group_name"))
    made = wanted.where("id_group is null").select("group_name").distinct().withColumn("row", row).crossJoin(F.broadcast(last))
    new_groups = made.select((F.col("last") + F.col("row")).alias("id_group"), F.col("group_name").alias("name"), (F.col("next_position") + F.col("row") - 1).alias("position"))

    own = new_groups.select(F.col("name").alias("group_name"), F.col("id_group").alias("made_group"))
    placed = wanted.join(own, "group_name", "left").select(F.coalesce("id_group", "made_group").alias("id_group"), "group_name", "value")
    sizes = placed.groupBy("id_group").agg(F.count("*").alias("n"))
    offsets = sizes.select("id_group", (F.sum("n").over(Window.orderBy("id_group")) - F.col("n")).alias("offset"))  # a row a group
    start = attributes.agg(F.coalesce(F.max("id_attribute"), F.lit(0)).alias("start"))
    row = F.row_number().over(Window.partitionBy("id_group").orderBy("value"))
    numbered = placed.withColumn("row", row).join(offsets, "id_group").join(next_position(attributes, "id_group"), "id_group", "left").crossJoin(F.broadcast(start))
    numbered = numbered.select((F.col("start") + F.col("offset") + F.col("row")).alias("made_id"), "id_group", "group_name", "value", (F.coalesce("next_position", F.lit(0)) + F.col("row") - 1).alias("position"))
    new_attributes = numbered.select(F.col("made_id").alias("id_attribute"), "id_group", F.col("value").alias("name"), "position")

    ids = numbered.select("group_name", "value", "made_id", F.col("id_group").alias("made_group"))
    whole = good.join(ids, ["group_name", "value"], "left").withColumn("id", F.coalesce("found", "made_id"))
    combinations = whole.groupBy("id_product", "combination").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    named = whole.where("id_attribute is null and mapped_id is null")
    pairs = named.select("group_key", "group_name", "value_key", "value", F.coalesce("id_group", "made_group").alias("id_group"), F.col("id").alias("id_attribute")).distinct()
    return Resolved(combinations, new_groups, new_attributes, pairs, rejects)
