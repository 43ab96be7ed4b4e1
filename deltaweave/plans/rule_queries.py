"""Rules of child rows, writers of the state, recovery and reports, on the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import delta, hierarchy, lookups, paging, reconcile, retention, rules, states, work
from .record_queries import _categories, tree
from .registry import ORACLES, query

NOW = datetime(2024, 1, 15)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


# Child rows.


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'feature without a key' WHEN p_partkey % 3 = 0 THEN 'feature pair twice' WHEN p_partkey % 7 = 0 AND strlen(repeat(p_type, 20)) > 255 THEN 'feature value is too long' END AS error,
CASE WHEN p_partkey % 3 = 0 THEN 'brand,brand,type' ELSE 'brand,type' END AS keys FROM part""")
def feature_rules(t):
    k = F.col("p_partkey")
    row = lambda key, value_key, value: F.struct(F.lit(f" {key}").alias("key"), value_key.alias("value_key"), F.lit(key.title()).alias("name"), value.alias("value"))
    brand = row("brand", F.col("p_brand"), F.col("p_brand"))
    kind = row("type", F.when(k % 5 == 0, " ").otherwise(F.col("p_type")), F.when(k % 7 == 0, F.repeat("p_type", 20)).otherwise(F.col("p_type")))
    rows = F.when(k % 3 == 0, F.array(kind, brand, brand)).otherwise(F.array(kind, brand))
    return t("part").select("p_partkey", rules.feature_error(rows).alias("error"), F.array_join(F.transform(rules.features(rows), lambda r: r["key"]), ",").alias("keys"))


@query("""WITH c AS (SELECT o_orderkey AS k, sha256(array_to_string(list_sort(list_distinct([o_orderkey % 7 + 1, o_orderkey % 3 + 1])), ':')) AS a, CASE WHEN o_orderkey % 5 = 0 THEN sha256(array_to_string(list_sort(list_distinct([o_orderkey % 7 + 1, o_orderkey % 3 + 1])), ':')) ELSE sha256('100') END AS b FROM orders)
SELECT k AS o_orderkey, least(a, b) AS first_key, CASE WHEN k % 5 = 0 THEN 'combination twice' WHEN k % 13 = 0 THEN 'combination ean13 is too long' WHEN k % 11 = 0 THEN 'minimal quantity below 1' END AS error FROM c""")
def combination_rules(t):
    k = F.col("o_orderkey")

    def row(ids, ean):
        return F.struct(
            ids.cast("array<bigint>").alias("attribute_ids"), F.lit(" R").alias("reference"), ean.alias("ean13"), F.lit(None).cast("string").alias("upc"), F.lit("").alias("mpn"), F.lit(3).alias("quantity"),
            F.when(k % 11 == 0, 0).alias("minimal_quantity"), *(F.lit(None).cast("double").alias(n) for n in ("price_impact", "weight_impact", "wholesale_price")), F.lit(False).alias("default"),
        )

    own = [k % 7 + 1, k % 3 + 1]
    first = row(F.array(own[0], own[1], own[0]), F.when(k % 13 == 0, "12345678901234").otherwise(" "))
    second = row(F.when(k % 5 == 0, F.array(own[1], own[0])).otherwise(F.array(F.lit(100).cast("long"))), F.lit(""))
    rows = F.array(first, second)
    return t("orders").select("o_orderkey", rules.combinations(rows)[0]["semantic_key"].alias("first_key"), rules.combination_error(rows).alias("error"))


@query("""WITH p AS (SELECT o_orderkey AS k, greatest(o_orderkey % 4 - 1, 0) AS currency, greatest(o_orderkey % 3, 1) AS quantity, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '0000-00-00 00:00:00' ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' END AS start FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 9 = 0 THEN 'reduction type' WHEN k % 7 = 0 OR k % 10 = 0 THEN 'amount' WHEN start IS NULL THEN 'date' END AS error,
sha256('[1,0,' || currency || ',0,0,0,' || quantity || ',"' || start || '","0000-00-00 00:00:00"]') AS scope FROM p""")
def specific_price_rules(t):
    k, none = F.col("o_orderkey"), F.lit(None).cast("int")
    start = F.when(k % 6 == 0, "2024-02-31").when(k % 5 == 1, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    row = F.struct(
        F.lit(-4).alias("id_product_attribute"), (k % 4 - 1).alias("id_currency"), none.alias("id_country"), none.alias("id_group"), none.alias("id_customer"), (k % 3).alias("from_quantity"), start.alias("from"), F.lit("0000-00-00").alias("to"),
        F.when(k % 7 == 0, -2.0).alias("price"), F.when(k % 10 == 0, 1.5).otherwise(0.5).alias("reduction"), none.alias("reduction_tax"), F.when(k % 9 == 0, "gift").otherwise("Percentage ").alias("reduction_type"),
    )
    rows = F.array(row)
    return t("orders").select("o_orderkey", rules.specific_price_error(rows, F.lit(1)).alias("error"), rules.specific_prices(rows, F.lit(1))[0]["scope"].alias("scope"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'too many images' WHEN p_partkey % 5 = 4 THEN 'too many features' END AS error FROM part")
def collection_bounds(t):
    k = F.col("p_partkey")
    held = lambda n: F.array_repeat(F.lit(0), n.cast("int"))
    return t("part").select("p_partkey", rules.collection_error({"images": held(k % 3 * 600), "features": held(k % 5 * 300)}).alias("error"))


# Writers of the state: what the state then has, and what was refused.


def _orders(t, keep):
    k = F.col("o_orderkey")
    return t("orders").where(keep).select(F.lit(1).cast("long").alias("id_shop"), F.lit("s").alias("source"), F.col("o_custkey").cast("string").alias("source_key"), k.cast("string").alias("semantic_key"), (F.col("o_custkey") + 1).alias("id_product"), k.alias("id_product_attribute"), F.lit(1).cast("long").alias("id_run"))


@query("""WITH s AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS a FROM orders WHERE o_orderkey % 2 = 1)
SELECT CAST(k AS VARCHAR) AS semantic_key, k AS id_product_attribute, CAST(NULL AS VARCHAR) AS reason FROM s UNION ALL SELECT CAST(k AS VARCHAR), a, CASE WHEN a IN (SELECT k FROM s) THEN 'variant has another owner' END FROM r""")
def combination_save(t):
    k = F.col("o_orderkey")
    rows = _orders(t, k % 2 == 1).withColumn("id_product_attribute", F.col("id_product_attribute") + F.when(F.col("id_product_attribute") % 5 == 0, 1).otherwise(0))
    state, bad = states.save_combinations(_orders(t, k % 2 == 0), rows)
    show = ["semantic_key", "id_product_attribute"]
    return state.select(*show, F.lit(None).cast("string").alias("reason")).union(bad.select(*show, "reason"))


@query("""SELECT o_orderkey AS k, 'stays' AS outcome FROM orders WHERE o_orderkey % 2 = 0 AND NOT (o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0)
UNION ALL SELECT o_orderkey, 'owner has changed' FROM orders WHERE o_orderkey % 4 = 1 OR (o_orderkey % 4 = 0 AND o_orderkey % 3 = 0)""")
def exact_delete(t):
    k = F.col("o_orderkey")
    identity = ["id_shop", "source", "source_key", "semantic_key", "id_product", "id_product_attribute"]
    wanted = _orders(t, (k % 4 == 0) | (k % 4 == 1)).withColumn("id_product", F.col("id_product") + F.when(F.col("id_product_attribute") % 3 == 0, 1).otherwise(0))
    state, bad = states.delete_exactly(_orders(t, k % 2 == 0), wanted, identity)
    return state.select(F.col("id_product_attribute").alias("k"), F.lit("stays").alias("outcome")).union(bad.select("id_product_attribute", "reason"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def owned_active(t):
    k = F.col("c_custkey")
    owner = [F.lit(1).alias("id_shop"), F.lit("s").alias("source"), k.cast("string").alias("source_key")]
    mapping = t("customer").select(*owner, (k + 10).alias("id_product"), (k % 3 == 0).alias("out_of_feed"))
    rows = t("customer").select(*owner, (k + 10 + k % 2).alias("id_product"), "c_custkey")
    return states.owned(rows, mapping, active=True).select("c_custkey")


@query("""WITH r AS (SELECT n_name AS k, n_regionkey + 100 * (n_nationkey % 3) AS c FROM nation WHERE n_nationkey % 2 = 0)
SELECT n_name AS supplier_key, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 THEN n_regionkey END AS id_category, NOT (n_nationkey % 2 = 0 AND n_nationkey % 3 = 0) AS active, CAST(NULL AS VARCHAR) AS reason FROM nation
UNION ALL SELECT k, c, false, 'category is not in the shop' FROM r WHERE c >= 100 UNION ALL SELECT r_name || '?', r_regionkey, false, 'unknown key' FROM region""")
def category_assignment(t):
    n, at = F.col("n_nationkey"), F.lit(NOW).cast("timestamp_ntz").alias("updated_at")
    shop = F.lit(1).alias("id_shop")
    state = t("nation").select(shop, F.col("n_name").alias("supplier_key"), F.lit(None).cast("int").alias("id_category"), F.lit(True).alias("active"), at)
    given = t("nation").where(n % 2 == 0).select(shop, F.col("n_name").alias("supplier_key"), (F.col("n_regionkey") + 100 * (n % 3)).cast("int").alias("id_category"), F.lit(False).alias("active"), at)
    given = given.union(t("region").select(shop, F.concat("r_name", F.lit("?")), F.col("r_regionkey").cast("int"), F.lit(False), at))
    out, bad = states.assign_categories(state, given, t("region").select(shop, F.col("r_regionkey").cast("int").alias("id_category")))
    show = ["supplier_key", "id_category", "active"]
    return out.select(*show, F.lit(None).cast("string").alias("reason")).union(bad.select(*show, "reason"))


@query("""SELECT o_orderkey AS id_image, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN o_orderkey % 7 ELSE -1 END AS position, CAST(NULL AS VARCHAR) AS reason FROM orders
UNION ALL SELECT o_orderkey, o_orderkey % 7, 'image is no longer live' FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0)""")
def image_touch(t):
    k = F.col("o_orderkey")
    key = [F.lit(1).alias("id_shop"), F.lit("s").alias("source"), F.col("o_custkey").cast("string").alias("source_key"), k.cast("string").alias("url_hash"), F.col("o_custkey").alias("id_product"), k.alias("id_image")]
    row = lambda position, run: [*key, position.alias("position"), F.lit(False).alias("is_cover"), F.lit(run).alias("last_seen_run_id"), now().alias("updated_at")]
    state, rows = t("orders").select(*row(F.lit(-1).cast("long"), 1)), t("orders").where(k % 2 == 0).select(*row(k % 7, 2))
    images, shops = t("orders").where(k % 3 != 0).select(k.alias("id_image"), F.col("o_custkey").alias("id_product")), t("orders").where(k % 5 != 0).select(k.alias("id_image"), F.lit(1).alias("id_shop"))
    out, bad = states.touch_images(state, rows, images, shops)
    show = ["id_image", "position"]
    return out.select(*show, F.lit(None).cast("string").alias("reason")).union(bad.select(*show, "reason"))


@query("""SELECT o_orderkey AS id_image, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS content_hash, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS last_seen_run_id FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def image_save(t):
    k = F.col("o_orderkey")
    row = lambda content, run: [F.lit(1).alias("id_shop"), F.lit("s").alias("source"), F.col("o_custkey").cast("string").alias("source_key"), k.cast("string").alias("url_hash"), F.col("o_custkey").alias("id_product"), k.alias("id_image"), F.lit(content).alias("content_hash"), F.lit(run).alias("last_seen_run_id")]
    out, _ = states.save_images(t("orders").where(k % 3 == 0).select(*row("old", 1)), t("orders").where(k % 2 == 0).select(*row("new", 2)))
    return out.select("id_image", "content_hash", "last_seen_run_id")


@query("""WITH r AS (SELECT lower(r_name) AS key, r_name, n_nationkey AS n, n_name, r_regionkey + 1 + 50 * CAST(n_nationkey % 3 = 1 AS INTEGER) AS id FROM nation JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT key, min(id) AS least FROM r WHERE n % 4 <> 0 GROUP BY 1)
SELECT 'parent' AS kind, lower(r_name) AS key, CAST(coalesce(least, r_regionkey + 900) AS BIGINT) AS id FROM region LEFT JOIN m ON m.key = lower(r_name)
UNION ALL SELECT 'value', lower(n_name), CAST(id AS BIGINT) FROM r WHERE n % 4 <> 0
UNION ALL SELECT CASE WHEN n % 4 = 0 THEN 'key has another label' ELSE 'not confirmed after the write' END, lower(n_name), CAST(id AS BIGINT) FROM r LEFT JOIN m USING (key) WHERE n % 4 = 0 OR id <> least""")
def pair_save(t):
    n = F.col("n_nationkey")
    scope = [F.lit(1).alias("id_shop"), F.lit("s").alias("source"), F.lower("r_name").alias("key")]
    parents = t("region").select(*scope, F.col("r_name").alias("name"), (F.col("r_regionkey") + 900).cast("long").alias("id_parent"))
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = j.select(*scope, F.when(n % 4 == 0, "Other").otherwise(F.concat(F.lit(" "), F.lower("r_name"))).alias("name"), F.lower("n_name").alias("value_key"), F.col("n_name").alias("value"), (F.col("r_regionkey") + 1 + F.when(n % 3 == 1, 50).otherwise(0)).cast("long").alias("id_parent"), (n + 1).cast("long").alias("id_value"))
    a, b, bad = states.save_pairs(parents, rows.limit(0).drop("name"), rows)
    return a.select(F.lit("parent").alias("kind"), "key", F.col("id_parent").alias("id")).union(b.select(F.lit("value"), "value_key", "id_parent")).union(bad.select("reason", "value_key", "id_parent"))


@query("""SELECT c_custkey AS source_key, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 <> 3 AND c_custkey % 5 <> 0 THEN 2 ELSE c_custkey % 4 END AS id_run, CAST(NULL AS VARCHAR) AS reason FROM customer
UNION ALL SELECT c_custkey, 2, CASE WHEN c_custkey % 4 = 3 THEN 'older run' ELSE 'another id_product' END FROM customer WHERE c_custkey % 3 <> 0 AND (c_custkey % 4 = 3 OR c_custkey % 5 = 0)""")
def monotonic_rejects(t):
    k = F.col("c_custkey")
    state = t("customer").select(k.alias("source_key"), k.alias("id_product"), (k % 4).alias("id_run"))
    rows = t("customer").where(k % 3 != 0).select(k.alias("source_key"), (k + F.when(k % 5 == 0, 1).otherwise(0)).alias("id_product"), F.lit(2).cast("long").alias("id_run"))
    out, bad = states.monotonic_save(state, rows, ["source_key"], same=["id_product"])
    return out.select("source_key", "id_run", F.lit(None).cast("string").alias("reason")).union(bad.select("source_key", "id_run", "reason"))


@query("""SELECT o_orderkey + 1 AS id_image, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END AS attempts, CASE WHEN o_orderkey % 3 = 0 THEN 'replaced' ELSE 'old' END AS reason, CASE WHEN o_orderkey % 3 = 0 THEN 1705278600 ELSE 0 END AS due FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def orphan_record(t):
    k, time = F.col("o_orderkey"), lambda s: F.lit(datetime.fromisoformat(s)).cast("timestamp_ntz")
    key = [F.lit(1).alias("id_shop"), F.col("o_custkey").alias("id_product"), (k + 1).alias("id_image")]
    old = t("orders").where(k % 2 == 0).select(*key, F.lit("old").alias("reason"), F.lit("x").alias("last_error"), F.lit(3).alias("attempts"), time("1970-01-01").alias("available_at"), time("1970-01-01").alias("created_at"), time("1970-01-01").alias("updated_at"))
    new = t("orders").where(k % 3 == 0).select(*key, F.lit(" replaced ").alias("reason"), F.lit(" ").alias("last_error"))
    out = states.record_orphans(old, new, now())
    return out.select("id_image", "attempts", "reason", F.unix_seconds(F.col("available_at").cast("timestamp")).alias("due"))


@query("""SELECT event_id AS id_queue, CASE WHEN event_id % 2 = 1 THEN 'processing' WHEN event_id % 3 = 0 THEN 'pending' ELSE 'done' END AS status, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 0 ELSE 2 END AS attempts, CASE WHEN event_id % 2 = 1 THEN 'other' END AS locked_by FROM events""")
def product_finish(t):
    k = F.col("event_id")
    q = t("events").select(k.alias("id_queue"), F.lit("processing").alias("status"), F.lit(2).alias("attempts"), now().alias("available_at"), F.when(k % 2 == 0, "me").otherwise("other").alias("locked_by"), (now() + F.expr("INTERVAL 1 MINUTE")).alias("locked_until"), now().alias("updated_at"), F.lit(None).cast("long").alias("id_product"), (k % 3 == 0).cast("long").alias("id_run"))
    done = t("events").select(k.alias("id_queue"), F.lit(0).cast("long").alias("expected_run"), k.alias("id_product"))
    return work.finish_product_jobs(q, done, "me", now()).select("id_queue", "status", "attempts", "locked_by")


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 0 ELSE least(length(source) * 100, 191) END AS key_chars, least(length(coalesce(text, '')), 8000) AS message_chars, count(*) AS n FROM documents GROUP BY 1, 2")
def error_table(t):
    rows = t("documents").select(F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.repeat("source", 100)).alias("source_key"), F.coalesce("text", F.lit("")).alias("message"))
    e = states.error_rows(rows, 7, "read", now())
    return e.groupBy(F.coalesce(F.char_length("source_key"), F.lit(0)).alias("key_chars"), F.char_length("message").alias("message_chars")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, max(l_linenumber) + 1 AS next_position FROM lineitem GROUP BY 1")
def next_positions(t):
    return states.next_position(t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("position")), "l_orderkey")


# Lookups.


@query("""WITH p AS (SELECT 'C' || o_custkey AS ref, o_orderkey AS id, o_orderstatus <> 'F' AS active, CASE WHEN o_orderkey % 3 = 0 THEN 2.0 ELSE 1.0 END AS price, o_orderpriority AS name FROM orders WHERE o_orderkey % 4 = 1 AND o_orderdate >= TIMESTAMP '1996-01-01'),
c AS (SELECT ref, count(*) AS n, min(id) AS id, min(active) AS active, min(price) AS price, min(name) AS name FROM p GROUP BY 1)
SELECT 'C' || c_custkey AS reference, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' WHEN NOT active THEN 'differs: active' WHEN price <> 1.0 THEN 'differs: price' WHEN name NOT IN ('1-URGENT', '2-HIGH') THEN 'differs: name' ELSE 'recovered' END AS outcome,
CASE WHEN n = 1 AND active AND price = 1.0 AND name IN ('1-URGENT', '2-HIGH') THEN id END AS id_product FROM customer LEFT JOIN c ON ref = 'C' || c_custkey""")
def create_recovery(t):
    o, k = t("orders"), F.col("o_orderkey")
    products = o.select(k.alias("id_product"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("reference"), (F.col("o_orderstatus") != "F").alias("active"), F.when(k % 3 == 0, 2.0).otherwise(1.0).alias("price"), F.array("o_orderpriority").alias("names"), F.col("o_orderdate").alias("added_at"))
    wanted = t("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("reference"), F.lit(True).alias("active"), F.lit(1.0000001).alias("price"), F.array(F.lit("1-URGENT "), F.lit("2-HIGH"), F.lit("")).alias("names"), F.lit(datetime(1996, 1, 1)).cast("timestamp_ntz").alias("since"))
    return lookups.recoverable(wanted, products, o.where(k % 4 != 1).select(k.alias("id_product")))


@query("SELECT p_partkey AS id_variant, count(DISTINCT l_suppkey % 5) AS n_shops, count(DISTINCT l_suppkey % 5) <= 1 AS reusable FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def variant_shops(t):
    links = t("lineitem").select(F.col("l_partkey").alias("id_variant"), (F.col("l_suppkey") % 5).alias("id_shop"))
    return lookups.shops_per_variant(t("part").select(F.col("p_partkey").alias("id_variant")), links)


@query("SELECT l_orderkey, min(l_suppkey % 5) AS shop FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 5) = 1")
def exclusive_orders(t):
    return reconcile.exclusive_to_shop(t("lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("shop")), "l_orderkey", "shop")


@query("SELECT l_orderkey, l_linenumber, l_partkey % 3 = 2 AS differs FROM lineitem")
def fields_changed(t):
    step = F.when(F.col("l_partkey") % 3 == 0, 0.0).when(F.col("l_partkey") % 3 == 1, 5e-7).otherwise(2e-6)
    return t("lineitem").select("l_orderkey", "l_linenumber", reconcile.fields_differ(F.col("l_discount"), F.col("l_discount") + step).alias("differs"))


@query("SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name || n_name END, n_nationkey LIMIT 9")
def label_order(t):
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.concat("r_name", "n_name"))
    return paging.by_label(j.withColumn("path", path), "path", "n_name", "n_nationkey").limit(9).select("n_nationkey", "n_name")


@query("SELECT 1000 + n_nationkey AS leaf_id, (100 + n_regionkey) || ',' || (1000 + n_nationkey) AS ids, CAST(NULL AS VARCHAR) AS error FROM nation UNION ALL SELECT -1 - r_regionkey, '', 'no such category' FROM region")
def membership_errors(t):
    leaves = t("nation").select((F.col("n_nationkey") + 1000).alias("leaf_id")).union(t("region").select(-1 - F.col("r_regionkey")))
    m = hierarchy.membership(leaves, tree(t), 1)
    return m.select("leaf_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "error")


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS n_{o}" for o in ("mapped", "kept", "skipped", "ambiguous", "missing")) + f", count(*) AS n FROM ({ORACLES['category_auto_map']})")
def map_outcomes(t):
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = F.col("n_nationkey")
    name = F.when(n % 5 == 0, "SHARED").when(n % 7 == 1, "nowhere").otherwise(F.col("n_name"))
    rows = j.select(n.alias("key"), F.concat("r_name", F.lit(" > "), name).alias("path"), (n % 4 != 3).alias("active"), F.when(n % 6 == 2, 3).when(n % 6 == 4, 999).alias("id_category"))
    return hierarchy.map_counts(hierarchy.auto_map(rows, _categories(t)))


@query("SELECT c_custkey AS id_product, action, CAST(0 AS INTEGER) AS value FROM customer, (SELECT unnest(['active', 'stock', 'variant_stock']) AS action) a WHERE c_custkey % 3 = 0")
def out_of_feed(t):
    return delta.out_of_feed_actions(t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id_product")))


# Retention and reports.


@query("SELECT event_id, ts FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 200)")
def delete_in_bounds(t):
    e = t("events").select("event_id", "ts")
    return retention.bounded_delete(e, t("events").where("event_type = 'click'").select("event_id"), "event_id", 200)[0]


_J = "j AS (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' ELSE 'lost' END AS status, event_id % 7 AS attempts FROM events)"


def _jobs(t):
    k = F.col("event_id")
    status = F.when(k % 5 == 0, "pending").when(k % 5 == 1, "processing").when(k % 5 == 2, "done").when(k % 5 == 3, "failed").otherwise("lost")
    return t("events").select(F.lit(1).alias("id_shop"), F.lit("s").alias("source"), k.alias("id_queue"), F.col("user_id").alias("id_product"), F.col("user_id").cast("string").alias("source_key"), k.cast("string").alias("url_hash"), status.alias("status"), (k % 7).alias("attempts"), F.when(k % 2 == 0, now() + F.expr("INTERVAL 1 DAY")).alias("locked_until"), (k % 3).alias("id_run"))


@query(f"""WITH {_J}, m AS (SELECT c_custkey % 100 AS k, c_custkey AS p FROM customer), x AS (
SELECT 'mapping: one row a id_shop/source/source_key' AS name, 'error' AS bad, (SELECT count(*) FROM (SELECT k FROM m GROUP BY 1 HAVING count(*) > 1)) AS n
UNION ALL SELECT 'mapping: one row a id_shop/id_product', 'error', 0 UNION ALL SELECT 'image_queue: one row a id_shop/id_product/url_hash', 'error', 0
UNION ALL SELECT 'image_queue: has an owner', 'error', (SELECT count(*) FROM j WHERE NOT EXISTS (SELECT 1 FROM m WHERE k = user_id AND p = user_id))
UNION ALL SELECT 'mapping: product exists', 'error', (SELECT count(*) FROM m WHERE p % 9 = 0)
UNION ALL SELECT 'image_queue: leases hold', 'warning', (SELECT count(*) FROM j WHERE status = 'processing' AND event_id % 2 = 1)
UNION ALL SELECT 'image_queue: no failed job', 'warning', (SELECT count(*) FROM j WHERE status = 'failed')
UNION ALL SELECT 'image_queue: known states', 'error', (SELECT count(*) FROM j WHERE status = 'lost')
UNION ALL SELECT 'image_queue: attempts are left', 'warning', (SELECT count(*) FROM j WHERE status = 'pending' AND attempts >= 5)
UNION ALL SELECT 'mapping: core_hash is there', 'warning', (SELECT count(*) FROM m WHERE p % 8 = 0))
SELECT name, CASE WHEN n = 0 THEN 'ok' ELSE bad END AS status, n FROM x""")
def doctor_checks(t):
    k = F.col("c_custkey")
    mapping = t("customer").select(F.lit(1).alias("id_shop"), F.lit("s").alias("source"), (k % 100).cast("string").alias("source_key"), k.alias("id_product"), F.when(k % 8 == 0, "").otherwise("h").alias("core_hash"))
    products = t("customer").where(k % 9 != 0).select(k.alias("id_product"))
    return retention.doctor({"mapping": mapping, "image_queue": _jobs(t), "products": products}, now())


@query(f"""WITH {_J} SELECT 2 AS id_run, (SELECT count(*) FROM events WHERE event_id % 3 = 2) AS issues, (SELECT count(*) FROM events WHERE event_id % 3 = 2 AND event_id % 4 <> 0) AS errors, (SELECT count(*) FROM events WHERE event_id % 3 = 2 AND event_id % 4 = 0) AS warnings,
(SELECT count(*) FROM j WHERE status = 'pending') AS pending, (SELECT count(*) FROM j WHERE status = 'failed') AS failed, 0 AS orphans, 9 AS page""")
def status_json(t):
    jobs, k = _jobs(t), F.col("event_id")
    runs = t("region").select(F.when(F.col("r_regionkey") < 4, 1).otherwise(2).alias("id_shop"), F.lit("s").alias("source"), (F.col("r_regionkey") - 1).alias("id_run"))
    errors = t("events").select((k % 3).alias("id_run"), F.when(k % 4 == 0, "WARNING: x").otherwise("price").alias("message"))
    report = retention.status_report(1, "s", {"page": 9}, runs, errors, jobs, jobs, jobs.where("id_shop = 3"))
    at = lambda path, name: F.get_json_object("report", f"$.{path}").cast("long").alias(name)
    return report.select(at("run.id_run", "id_run"), at("issues_total", "issues"), at("errors_total", "errors"), at("warnings_total", "warnings"), at("images.pending", "pending"), at("new_products.failed", "failed"), at("image_orphans", "orphans"), at("effective_settings.page", "page"))


@query("""SELECT p_partkey, 'no change' AS edit, true AS feature_same, true AS price_same FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'order', true, true FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 'value', false, false FROM part WHERE p_partkey % 3 = 2""")
def child_hashes(t):
    """Which edits change the fingerprints of features and specific prices."""
    k, n = F.col("p_partkey"), F.col("p_partkey") % 3
    feature = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value_key"), F.lit("n").alias("name"), value.alias("value"))
    whole = lambda x: F.struct(*(F.lit(0).alias(c) if c not in ("from", "to") else F.lit("").alias(c) for c in hashing.SCOPE), x.alias("price"), F.lit(0.0).alias("reduction"), F.lit(0).alias("reduction_tax"), F.lit("amount").alias("reduction_type"))
    a, b, x, y = feature("a", F.col("p_brand")), feature("b", F.col("p_type")), whole(F.col("p_retailprice")), whole(F.lit(1.0))
    base = t("part").select("p_partkey", F.array(a, b).alias("features"), F.array(x, y).alias("specific_prices"))
    other = t("part").select("p_partkey", F.when(n == 0, F.array(a, b)).when(n == 1, F.array(b, a)).otherwise(F.array(a, feature("b", F.lit("else")))).alias("features"), F.when(n == 0, F.array(x, y)).when(n == 1, F.array(y, x)).otherwise(F.array(x, whole(F.lit(2.5)))).alias("specific_prices"))
    j = hashing.with_hashes(base).alias("m").join(hashing.with_hashes(other).alias("s"), "p_partkey")
    same = lambda d: (~delta.differs(d)).alias(f"{d}_same")
    out = j.select("p_partkey", F.when(n == 0, "no change").when(n == 1, "order").otherwise("value").alias("edit"), same("feature"), same("specific_price"))
    return out.withColumnRenamed("specific_price_same", "price_same")
