"""Snapshot, state and their difference, derived from `part`: run 2 against what run 1 left."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import delta
from .registry import query

RUN = 2
DOMAINS = ("core", "price", "stock", "category")
KEY = "source_key"


def _hashes(brand, cents):
    md5 = lambda *c: F.md5(F.concat_ws("|", *c).cast("binary"))
    return {"core_hash": md5(F.col("p_name"), brand), "price_hash": md5(cents.cast("string")), "stock_hash": md5(F.col("p_size").cast("string")), "category_hash": md5(F.col("p_type"))}


def snapshot(t):
    k, cents = F.col("p_partkey"), F.round(F.col("p_retailprice") * 100).cast("long")
    new_cents = cents + F.when(k % 5 == 0, 100).otherwise(0)
    brand = F.when(k % 17 == 0, F.concat(F.lit("X-"), "p_brand")).otherwise(F.col("p_brand"))
    rows = t("part").where(k % 10 != 3).withColumns(_hashes(brand, new_cents))
    return rows.select(k.alias(KEY), (k + 1000).alias("id_product"), *(f"{d}_hash" for d in DOMAINS))


def mapping(t):
    k, cents = F.col("p_partkey"), F.round(F.col("p_retailprice") * 100).cast("long")
    rows = t("part").where(k % 7 != 0).withColumns(_hashes(F.col("p_brand"), cents))
    return rows.select(k.alias(KEY), (k + 1000).alias("id_product"), *(f"{d}_hash" for d in DOMAINS), (k % 11 == 0).alias("out_of_feed"), F.when(k % 13 == 0, 2).otherwise(1).cast("long").alias("last_seen_run_id"))


SNAP = """snap AS (SELECT p_partkey AS source_key, p_partkey + 1000 AS id_product,
  md5(concat_ws('|', p_name, CASE WHEN p_partkey % 17 = 0 THEN 'X-' || p_brand ELSE p_brand END)) AS core_hash,
  md5(CAST(CAST(round(p_retailprice * 100) AS BIGINT) + CASE WHEN p_partkey % 5 = 0 THEN 100 ELSE 0 END AS VARCHAR)) AS price_hash,
  md5(CAST(p_size AS VARCHAR)) AS stock_hash, md5(p_type) AS category_hash FROM part WHERE p_partkey % 10 <> 3)"""
MAP = """map AS (SELECT p_partkey AS source_key, p_partkey + 1000 AS id_product, md5(concat_ws('|', p_name, p_brand)) AS core_hash,
  md5(CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR)) AS price_hash, md5(CAST(p_size AS VARCHAR)) AS stock_hash, md5(p_type) AS category_hash,
  p_partkey % 11 = 0 AS out_of_feed, CAST(CASE WHEN p_partkey % 13 = 0 THEN 2 ELSE 1 END AS BIGINT) AS last_seen_run_id FROM part WHERE p_partkey % 7 <> 0)"""
BOTH = f"WITH {SNAP}, {MAP}"
DIFF = " OR ".join(f"s.{d}_hash IS DISTINCT FROM m.{d}_hash" for d in DOMAINS)
LIST = "concat_ws(','," + ", ".join(f"CASE WHEN m.out_of_feed OR s.{d}_hash IS DISTINCT FROM m.{d}_hash THEN '{d}' END" for d in DOMAINS) + ")"
NEW = "SELECT s.source_key FROM snap s WHERE NOT EXISTS (SELECT 1 FROM map m WHERE m.source_key = s.source_key)"
GONE = "SELECT m.source_key, m.id_product FROM map m WHERE NOT m.out_of_feed AND coalesce(m.last_seen_run_id, 0) <> 2 AND NOT EXISTS (SELECT 1 FROM snap s WHERE s.source_key = m.source_key)"
CHANGED = f"SELECT s.source_key, m.id_product, {LIST} AS domains FROM snap s JOIN map m USING (source_key) WHERE m.out_of_feed OR {DIFF}"


def _changed(t):
    return delta.changed_rows(snapshot(t), mapping(t), domains=DOMAINS)


@query(f"{BOTH} {NEW}")
def delta_new(t):
    return delta.new_rows(snapshot(t), mapping(t)).select(KEY)


@query(f"{BOTH} {GONE}")
def delta_removed(t):
    return delta.removed_rows(mapping(t), snapshot(t), RUN).select(KEY, "id_product")


@query(f"{BOTH} SELECT source_key, id_product FROM ({CHANGED})")
def delta_changed(t):
    return _changed(t).select(KEY, "id_product")


@query(f"{BOTH} {CHANGED}")
def delta_domains(t):
    return _changed(t).select(KEY, "id_product", F.array_join("domains", ",").alias("domains"))


@query(f"{BOTH} SELECT action, count(*) AS n FROM (SELECT 'new' AS action FROM ({NEW}) UNION ALL SELECT 'removed' FROM ({GONE}) UNION ALL SELECT 'changed' FROM ({CHANGED}) UNION ALL SELECT 'same' FROM snap s JOIN map m USING (source_key) WHERE NOT (m.out_of_feed OR {DIFF})) GROUP BY action")
def delta_summary(t):
    """The flagship: what a run has to do, by kind."""
    return delta_actions(t).groupBy("action").agg(F.count("*").alias("n"))


def delta_actions(t):
    s, m = snapshot(t), mapping(t)
    # One pass over both sides: presence on each tells new, gone and common rows apart.
    a, b = s.alias("s"), m.alias("m")
    both = a.join(b, F.col("s.source_key") == F.col("m.source_key"), "full_outer")
    here, there = F.col("s.source_key").isNotNull(), F.col("m.source_key").isNotNull()
    touched = F.col("m.out_of_feed")
    for d in DOMAINS:
        touched = touched | delta.differs(d)
    gone = ~F.col("m.out_of_feed") & (F.coalesce("m.last_seen_run_id", F.lit(0)) != RUN)
    action = F.when(here & ~there, "new").when(here & touched, "changed").when(here, "same").when(gone, "removed")
    domains = F.when(action == "changed", F.array_join(delta.changed_domains(DOMAINS), ",")).otherwise("")
    return both.select(F.coalesce("s.source_key", "m.source_key").alias(KEY), action.alias("action"), domains.alias("changed_domains")).where("action is not null")


@query(f"""{BOTH} SELECT s.source_key, m.id_product, CASE WHEN m.id_product % 19 = 0 THEN 'recreate' WHEN m.id_product % 23 = 0 THEN 'relink' ELSE 'update' END AS action,
CASE WHEN m.id_product % 19 = 0 OR m.id_product % 23 = 0 THEN 'core,price,stock,category' ELSE {LIST} END AS domains, m.id_product % 19 = 0 OR m.id_product % 23 = 0 AS image_changed
FROM snap s JOIN map m USING (source_key) WHERE m.out_of_feed OR m.id_product % 19 = 0 OR m.id_product % 23 = 0 OR {DIFF}""")
def delta_relink(t):
    """Products (or their links to the shop) that are gone are made again with all domains."""
    m = mapping(t)
    found = delta.changed_rows(snapshot(t), m, m.where("id_product % 19 <> 0"), m.where("id_product % 23 <> 0"), DOMAINS)
    return found.select(KEY, "id_product", "action", F.array_join("domains", ",").alias("domains"), "image_changed")


@query(f"{BOTH} SELECT n_candidates, n_mapped, CASE WHEN n_candidates * 100 > n_mapped * 25 THEN 'blocked' ELSE 'ok' END AS gate, n_candidates * 100 // n_mapped AS percent FROM (SELECT (SELECT count(*) FROM ({GONE})) AS n_candidates, (SELECT count(*) FROM map WHERE NOT out_of_feed) AS n_mapped)")
def remove_plan(t):
    actions = delta_actions(t).agg(F.count_if(F.col("action") == "removed").alias("n_candidates"))
    live = mapping(t).where("not out_of_feed").agg(F.count("*").alias("n_mapped"))
    both = actions.withColumn("k", F.lit(1)).join(live.withColumn("k", F.lit(1)), "k")
    return both.select("n_candidates", "n_mapped", delta.remove_gate(F.col("n_candidates"), F.col("n_mapped")).alias("gate"), F.floor(F.col("n_candidates") * 100 / F.col("n_mapped")).alias("percent"))


@query("""WITH r AS (SELECT id_run, n_valid, CASE WHEN id_run = 3 THEN 1 ELSE 0 END AS n_invalid, CASE WHEN id_run = 4 THEN 2 ELSE 0 END AS n_duplicates, lag(n_valid) OVER (ORDER BY id_run) AS n_before FROM
 (SELECT o_custkey % 6 + 1 AS id_run, count(*) FILTER (WHERE o_custkey % 6 <> 4) AS n_valid FROM orders GROUP BY 1))
SELECT id_run, CASE WHEN n_invalid > 0 THEN 'invalid rows' WHEN n_duplicates > 0 THEN 'duplicate keys' WHEN n_valid = 0 THEN 'no valid row' WHEN coalesce(n_before, 0) >= 1000 AND n_valid < floor(0.8 * n_before) THEN 'volume drop' ELSE 'ok' END AS gate FROM r""")
def read_gates(t):
    from pyspark.sql import Window

    runs = t("orders").groupBy((F.col("o_custkey") % 6 + 1).alias("id_run")).agg(F.count_if(F.col("o_custkey") % 6 != 4).alias("n_valid"))
    before = F.coalesce(F.lag("n_valid").over(Window.orderBy("id_run")), F.lit(0))
    at = lambda run, n: F.when(F.col("id_run") == run, n).otherwise(0)
    return runs.select("id_run", delta.read_gate(F.col("n_valid"), at(3, 1), at(4, 2), before).alias("gate"))


_DELTA_SQL = "d AS (SELECT source_key, id_product, core_hash, price_hash, stock_hash, category_hash FROM snap)"


@query(f"""{BOTH}, {_DELTA_SQL} SELECT coalesce(m.source_key, d.source_key) AS source_key, CASE WHEN d.source_key IS NOT NULL THEN d.id_product ELSE m.id_product END AS id_product,
CASE WHEN d.source_key IS NOT NULL THEN d.price_hash ELSE m.price_hash END AS price_hash, CASE WHEN d.source_key IS NOT NULL THEN false ELSE m.out_of_feed END AS out_of_feed, CASE WHEN d.source_key IS NOT NULL THEN 2 ELSE m.last_seen_run_id END AS last_seen_run_id
FROM map m FULL JOIN d ON m.source_key = d.source_key""")
def mapping_merge(t):
    return delta.merge_mapping(mapping(t), snapshot(t), RUN).select(KEY, "id_product", "price_hash", "out_of_feed", "last_seen_run_id")


@query(f"{BOTH} SELECT source_key, out_of_feed, CASE WHEN source_key % 3 = 0 AND last_seen_run_id <= 2 THEN 2 ELSE last_seen_run_id END AS last_seen_run_id FROM map")
def seen_touch(t):
    m = mapping(t)
    return delta.touch_seen(m, m.where("source_key % 3 = 0"), RUN).select(KEY, "out_of_feed", "last_seen_run_id")


@query(f"{BOTH}, g AS ({GONE}) SELECT m.source_key, m.out_of_feed OR g.source_key IS NOT NULL AS out_of_feed, CASE WHEN g.source_key IS NOT NULL THEN 2 ELSE m.last_seen_run_id END AS last_seen_run_id FROM map m LEFT JOIN g USING (source_key)")
def mark_removed(t):
    m = mapping(t)
    return delta.mark_removed(m, delta.removed_rows(m, snapshot(t), RUN), RUN).select(KEY, "out_of_feed", "last_seen_run_id")


@query(f"""{BOTH}, d AS (SELECT source_key, CASE WHEN source_key % 29 = 0 THEN id_product + 1 ELSE id_product END AS id_product FROM snap)
SELECT d.source_key, d.id_product, 'key has another product' AS reason FROM d JOIN map m USING (source_key) WHERE d.id_product <> m.id_product
UNION ALL SELECT d.source_key, d.id_product, 'product has another key' FROM d JOIN map m USING (id_product) WHERE d.source_key <> m.source_key""")
def owner_conflicts(t):
    moved = snapshot(t).withColumn("id_product", F.when(F.col(KEY) % 29 == 0, F.col("id_product") + 1).otherwise(F.col("id_product")))
    return delta.merge_conflicts(mapping(t), moved)


@query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, count(*) - count(DISTINCT l_orderkey) AS n_duplicates FROM lineitem")
def duplicate_keys(t):
    return delta.duplicate_summary(t("lineitem"), "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM (SELECT l_orderkey, l_linenumber % 2 AS l_linenumber FROM lineitem) GROUP BY 1, 2 HAVING count(*) > 1")
def uniqueness_conflicts(t):
    return delta.conflicts(t("lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("l_linenumber")), "l_orderkey", "l_linenumber")


@query("""WITH r AS (SELECT o_orderkey AS id_run, o_custkey AS id_shop, o_orderpriority AS source, o_orderstatus = 'F' AS read_completed FROM orders)
SELECT r.id_run, n.newest FROM r JOIN (SELECT id_shop, source, max(id_run) AS newest FROM r WHERE read_completed GROUP BY 1, 2) n USING (id_shop, source) WHERE r.id_run < n.newest""")
def generation_fence(t):
    runs = t("orders").select(F.col("o_orderkey").alias("id_run"), F.col("o_custkey").alias("id_shop"), F.col("o_orderpriority").alias("source"), (F.col("o_orderstatus") == "F").alias("read_completed"))
    return delta.blocked_runs(runs)


# Fingerprints: what counts is which edits change which of them, so the queries compare two editions of the same records.


def _edition(t, edit: bool):
    p = t("part")
    k = F.col("p_partkey")
    e = lambda n, new, old: F.when((k % 8 == n) & F.lit(edit), new).otherwise(old)
    combos = lambda q: F.array(*(F.struct(F.array(F.struct(F.lit(None).cast("long").alias("id"), F.lit("size").alias("group_key"), F.concat(F.lit(v), F.col("p_size").cast("string")).alias("value_key"))).alias("attributes"), F.lit(v).alias("reference"), F.lit(0.0).alias("price_impact"), F.lit(0.0).alias("weight_impact"), F.lit(0.0).alias("wholesale_price"), F.lit(1).alias("minimal_quantity"), e(5, F.lit("9"), F.lit("")).alias("ean13"), F.lit("").alias("upc"), F.lit("").alias("mpn"), F.lit(v == "a").alias("default"), q.alias("quantity")) for v in ("a", "b")))
    combined = combos(e(4, F.lit(7), F.lit(2)))
    images = F.array(F.concat("p_name", F.lit("/1")), F.concat("p_name", F.lit("/2")))
    return p.select(
        k.alias("source_key"),
        F.concat(F.lit("R-"), k.cast("string")).alias("reference"),
        e(0, F.concat("p_name", F.lit("!")), F.col("p_name")).alias("name"),
        F.lit(True).alias("active"),
        e(1, F.col("p_retailprice") + 1, F.col("p_retailprice")).alias("price"),
        e(2, F.col("p_size") + 1, F.col("p_size")).alias("quantity"),
        F.array(e(3, F.concat("p_type", F.lit("!")), F.col("p_type"))).alias("categories"),
        # Order of combinations doesn't count; that of images does.
        e(6, F.reverse(combined), combined).alias("combinations"),
        e(7, F.reverse(images), images).alias("images"),
    )


_HASHED = ("core", "price", "stock", "category", "combination", "combination_stock", "image", "payload")
_EDITED = {0: "core,payload", 1: "price,payload", 2: "stock,payload", 3: "category,payload", 4: "combination_stock,payload", 5: "combination,payload", 6: "payload", 7: "image"}


@query("SELECT p_partkey AS source_key, CASE p_partkey % 8 " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in _EDITED.items()) + " END AS changed FROM part")
def domain_hashes(t):
    """Eight kinds of edit, and which fingerprints each changes."""
    a, b = hashing.with_hashes(_edition(t, False)).alias("m"), hashing.with_hashes(_edition(t, True)).alias("s")
    changed = F.array(*(F.when(delta.differs(d), F.lit(d)) for d in _HASHED))
    return a.join(b, F.col("m.source_key") == F.col("s.source_key")).select("m.source_key", F.array_join(changed, ",").alias("changed"))


@query("SELECT sha256(array_to_string(list_sort(list_distinct(list(l_suppkey))), ':')) AS semantic_key, l_orderkey FROM lineitem GROUP BY l_orderkey")
def semantic_key(t):
    ids = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("ids"))
    return ids.select("l_orderkey", hashing.semantic_key(F.col("ids")).alias("semantic_key"))


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(CASE WHEN l_linenumber % 2 = 0 THEN 'id:' || l_suppkey ELSE 'supplier:' || l_returnflag || ':' || l_linestatus END))), '|') AS semantic FROM lineitem GROUP BY l_orderkey")
def variant_semantics(t):
    a = F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).alias("id"), F.col("l_returnflag").alias("group_key"), F.col("l_linestatus").alias("value_key"))
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(a).alias("attributes"))
    return rows.select("l_orderkey", hashing.semantic(F.transform("attributes", hashing.token)).alias("semantic"))


@query("SELECT sha256(url) AS url_hash, count(*) AS n FROM pages GROUP BY 1")
def url_hash(t):
    return t("pages").groupBy(F.sha2("url", 256).alias("url_hash")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, lower(trim(p_brand)) <> lower(trim(p_type)) AS collides FROM part WHERE p_partkey % 4 = 0 AND lower(trim(p_brand)) <> lower(trim(p_type))")
def label_collisions(t):
    """Every part comes in: by key with another label, one changed in case and outer spaces, or its own."""
    state = t("part").select("p_partkey", F.col("p_brand").alias("label"))
    n = F.col("p_partkey") % 4
    rows = t("part").select("p_partkey", F.when(n == 0, F.col("p_type")).when(n == 1, F.upper(F.concat(F.lit(" "), "p_brand"))).otherwise(F.col("p_brand")).alias("label"))
    return delta.label_collisions(state, rows, ["p_partkey"]).select("p_partkey", F.lit(True).alias("collides"))


@query("""SELECT coalesce(s.k, r.k) AS k, CASE WHEN r.k IS NOT NULL AND (s.k IS NULL OR s.id_run <= r.id_run) THEN r.id_run ELSE s.id_run END AS id_run, CASE WHEN r.k IS NOT NULL AND (s.k IS NULL OR s.id_run <= r.id_run) THEN r.v ELSE s.v END AS v
FROM (SELECT o_orderkey AS k, o_orderkey % 5 AS id_run, 'old' AS v FROM orders WHERE o_orderkey % 3 <> 0) s FULL JOIN (SELECT o_orderkey AS k, CAST(2 AS BIGINT) AS id_run, 'new' AS v FROM orders WHERE o_orderkey % 2 = 0) r ON s.k = r.k""")
def monotonic_state(t):
    o, k = t("orders"), F.col("o_orderkey")
    state = o.where(k % 3 != 0).select(k.alias("k"), (k % 5).alias("id_run"), F.lit("old").alias("v"))
    rows = o.where(k % 2 == 0).select(k.alias("k"), F.lit(2).cast("long").alias("id_run"), F.lit("new").alias("v"))
    return delta.monotonic_upsert(state, rows, ["k"])


@query("""SELECT coalesce(s.n_nationkey, r.n_nationkey) AS n_nationkey, coalesce(r.path, s.path) AS path, coalesce(s.id_category, r.id_category) AS id_category FROM
(SELECT n_nationkey, n_name AS path, n_regionkey AS id_category FROM nation WHERE n_nationkey < 20) s FULL JOIN (SELECT n_nationkey, lower(n_name) AS path, n_regionkey + 100 AS id_category FROM nation WHERE n_nationkey > 10) r ON s.n_nationkey = r.n_nationkey""")
def category_metadata_upsert(t):
    n = t("nation")
    state = n.where("n_nationkey < 20").select("n_nationkey", F.col("n_name").alias("path"), F.col("n_regionkey").alias("id_category"))
    rows = n.where("n_nationkey > 10").select("n_nationkey", F.lower("n_name").alias("path"), (F.col("n_regionkey") + 100).alias("id_category"))
    return delta.upsert_keeping(state, rows, ["n_nationkey"], ["id_category"])


