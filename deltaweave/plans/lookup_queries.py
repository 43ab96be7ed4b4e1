"""Lookups over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import lookups
from .delta_queries import MAP, SNAP, mapping, snapshot
from .registry import query


@query(f"WITH {SNAP}, {MAP}, q AS (SELECT p_partkey AS source_key, p_partkey % 3 AS id_run FROM part WHERE p_partkey % 2 = 0) SELECT s.source_key FROM snap s LEFT JOIN q USING (source_key) WHERE NOT EXISTS (SELECT 1 FROM map m WHERE m.source_key = s.source_key) AND (q.id_run IS NULL OR q.id_run < 2)")
def unqueued_new(t):
    queue = t("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("source_key"), (F.col("p_partkey") % 3).alias("id_run"))
    return lookups.unqueued_new(snapshot(t), mapping(t), queue, 2, ["source_key"]).select("source_key")


@query("SELECT l_orderkey, l_linenumber, p_brand, s_nationkey FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size < 25 JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 1000")
def live_state(t):
    state = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id_image"), F.lit(1).alias("id_product"), F.col("l_suppkey").alias("id_shop"))
    images = t("part").where("p_size < 25").select(F.col("p_partkey").alias("id_image"), F.lit(1).alias("id_product"), "p_brand")
    shops = t("supplier").where("s_acctbal > 1000").select(F.col("s_suppkey").alias("id_shop"), "s_nationkey")
    linked = state.select("id_image", "id_shop").distinct().join(shops, "id_shop")
    return lookups.live_state(state, images, linked).select("l_orderkey", "l_linenumber", "p_brand", "s_nationkey")


@query("SELECT event_id FROM events e WHERE ts < TIMESTAMP '2024-01-10 00:00:00' AND user_id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.event_id % 500 = 0)")
def stale_owners(t):
    state = t("events").select("event_id", "user_id", F.col("ts").alias("updated_at"))
    owners = state.select("user_id", (F.col("user_id") % 4 == 0).alias("out_of_feed")).distinct()
    jobs = state.where("event_id % 500 = 0").select("user_id").distinct()
    return lookups.stale_owners(state, owners, jobs, F.lit(datetime(2024, 1, 10)).cast("timestamp_ntz"), ["user_id"]).select("event_id")


@query("SELECT w.p_name, CASE WHEN k.n = 1 THEN k.id END AS p_partkey, coalesce(k.n > 1, false) AS ambiguous FROM (SELECT DISTINCT p_name FROM part) w LEFT JOIN (SELECT p_name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS id FROM part WHERE p_size > 20 GROUP BY 1) k USING (p_name)")
def exact_names(t):
    p = t("part").select("p_name", "p_partkey", "p_size")
    return lookups.exact_names(p.select("p_name").distinct(), p.where("p_size > 20"), "p_name", "p_partkey")


@query("SELECT DISTINCT upper(p_brand) AS p_brand, min(p_partkey) OVER (PARTITION BY lower(p_brand)) AS p_partkey FROM part")
def manufacturer_lookup(t):
    p = t("part").select("p_brand", "p_partkey")
    return lookups.ids_by_name(p.select(F.upper("p_brand").alias("p_brand")).distinct(), p, "p_brand", "p_partkey")


@query("SELECT o_custkey AS reference, min(o_orderkey) AS id_product FROM orders o WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderkey % 3 <> 0 GROUP BY 1 HAVING count(*) = 1")
def interrupted_creates(t):
    products = t("orders").select(F.col("o_orderkey").alias("id_product"), F.col("o_custkey").alias("reference"), F.col("o_orderdate").alias("added_at"))
    owned = products.where("id_product % 3 = 0").select("id_product")
    return lookups.interrupted(products, owned, F.lit(datetime(1996, 1, 1)).cast("timestamp_ntz"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0)")
def owner_drift(t):
    k = F.col("o_orderkey")
    jobs = t("orders").select(k, k.alias("id_product"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"))
    owners = t("orders").where(k % 5 != 0).select(k, F.when(k % 7 == 0, k + 1).otherwise(k).alias("id_product"))
    return lookups.owner_drift(jobs, owners, ["o_orderkey"]).select("o_orderkey")


@query("SELECT count(*) AS n_dangling FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)")
def dangling_mappings(t):
    parts = t("part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return lookups.dangling(t("lineitem").select("l_partkey"), parts, "l_partkey")


@query("SELECT n_nationkey AS feature_key, s_suppkey AS value_key, r_name FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_acctbal > 0")
def feature_pairs(t):
    one = F.lit(1).alias("id_shop")
    features = t("nation").select(one, F.col("n_nationkey").alias("feature_key"), F.col("n_regionkey").alias("id_feature"))
    values = t("supplier").select(one, F.col("s_nationkey").alias("feature_key"), F.col("s_suppkey").alias("value_key"), F.col("s_suppkey").alias("id_value"))
    in_shop = t("region").select(one, F.col("r_regionkey").alias("id_feature"), "r_name")
    live = t("supplier").where("s_acctbal > 0").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("id_feature"), F.col("s_suppkey").alias("id_value"))
    return lookups.resolved_pairs(features, values, in_shop, live).select("feature_key", "value_key", "r_name")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS source_key, o_orderpriority AS payload, o_custkey AS id_product FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 AND CAST(o_orderkey AS VARCHAR) > '2'")
def manifest(t):
    key = F.col("o_orderkey").cast("string").alias("source_key")
    mapping = t("orders").join(t("customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select(key, F.col("o_custkey").alias("id_product"))
    return lookups.manifest(t("orders").select(key, F.col("o_orderpriority").alias("payload")), mapping, ["source_key"], "2")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def manifest_by_keys(t):
    keys = t("lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return lookups.by_keys(t("part"), keys, ["p_partkey"]).select("p_partkey")


@query("SELECT event_id, event_id % 2 = 0 AND event_id % 3 = 0 AND event_id % 5 = 0 AS ready FROM events")
def reconcile_ready(t):
    e = F.col("event_id")
    return t("events").select("event_id", lookups.reconcile_ready(e % 2 == 0, e % 3 == 0, e % 5).alias("ready"))
