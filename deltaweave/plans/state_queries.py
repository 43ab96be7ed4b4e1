"""Child rows, queues, pages, retention and status, derived from the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import attributes, paging, reconcile, retention, work
from .registry import query

NOW = "2024-01-15 00:00:00"


def now():
    return F.lit(datetime(2024, 1, 15)).cast("timestamp_ntz")


# Reconciliation.

_FEAT = """d AS (SELECT p_partkey AS id_product, 'brand' AS feature, p_brand AS value FROM part WHERE p_partkey % 5 <> 0),
o AS (SELECT p_partkey AS id_product, 'brand' AS feature, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS value FROM part WHERE p_partkey % 4 <> 0),
a AS (SELECT p_partkey AS id_product, 'brand' AS feature, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS value FROM part WHERE p_partkey % 7 <> 0)"""


@query(f"""WITH {_FEAT}, j AS (SELECT id_product, feature, d.value AS dv, o.value AS ov, a.value AS av FROM d FULL JOIN o USING (id_product, feature) FULL JOIN a USING (id_product, feature))
SELECT id_product, feature, CASE WHEN dv IS NOT NULL THEN dv WHEN ov IS NOT NULL AND ov IS NOT DISTINCT FROM av THEN NULL ELSE av END AS value,
dv IS NOT NULL AND (ov IS NOT DISTINCT FROM dv OR av IS NULL OR av IS DISTINCT FROM dv) AS owned,
CASE WHEN dv IS NULL AND ov IS NOT NULL AND ov IS NOT DISTINCT FROM av THEN 'remove' WHEN dv IS NOT NULL AND av IS NULL THEN 'add' WHEN dv IS NOT NULL AND av <> dv THEN 'change' ELSE 'keep' END AS action FROM j""")
def feature_reconcile(t):
    p, k = t("part"), F.col("p_partkey")
    rows = lambda keep, v: p.where(keep).select(k.alias("id_product"), F.lit("brand").alias("feature"), v.alias("value"))
    either = lambda c: F.when(c, F.col("p_brand")).otherwise(F.col("p_type"))
    return reconcile.features(rows(k % 5 != 0, F.col("p_brand")), rows(k % 4 != 0, either(k % 3 == 0)), rows(k % 7 != 0, either(k % 2 == 0)))


_VAR = """v AS (SELECT l_orderkey AS id_product, 's' || l_linenumber AS semantic, l_partkey AS id_variant, l_suppkey AS sk FROM lineitem),
l AS (SELECT l_orderkey AS id_product, 's' || l_linenumber AS semantic, min(l_partkey) AS id_variant, min(l_suppkey) AS sk, l_linenumber AS n FROM lineitem GROUP BY 1, 2, 5),
d AS (SELECT id_product, semantic, CAST(sk % 3 AS VARCHAR) AS hash, CAST(sk % 2 AS VARCHAR) AS stock_hash FROM l WHERE n % 4 <> 3),
o AS (SELECT id_product, semantic, id_variant, CAST(sk % 2 AS VARCHAR) AS hash, '0' AS stock_hash FROM l WHERE n % 3 <> 2),
f AS (SELECT id_product, semantic, min(id_variant) AS least_id, list(id_variant) AS ids FROM v WHERE sk % 4 <> 0 GROUP BY 1, 2)"""


@query(f"""WITH {_VAR}, j AS (SELECT d.*, o.id_variant AS own_id, o.hash AS own_hash, o.stock_hash AS own_stock, CASE WHEN list_contains(f.ids, o.id_variant) THEN o.id_variant ELSE f.least_id END AS id_variant FROM d LEFT JOIN o USING (id_product, semantic) LEFT JOIN f USING (id_product, semantic))
SELECT id_product, semantic, id_variant, CASE WHEN id_variant IS NULL THEN 'create' ELSE 'use' END AS action, id_variant IS NULL OR own_id IS DISTINCT FROM id_variant OR own_hash IS DISTINCT FROM hash AS structure_changed,
id_variant IS NOT NULL AND (own_id IS DISTINCT FROM id_variant OR own_stock IS DISTINCT FROM stock_hash) AS write_stock FROM j
UNION ALL SELECT id_product, semantic, own_id, 'remove', true, false FROM j WHERE id_variant IS NOT NULL AND own_id <> id_variant
UNION ALL SELECT o.id_product, o.semantic, o.id_variant, 'remove', true, false FROM o WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.id_product = o.id_product AND d.semantic = o.semantic)""")
def variant_reconcile(t):
    n = F.col("n")
    named = [F.col("l_orderkey").alias("id_product"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("semantic")]
    actual = t("lineitem").select(*named, F.col("l_partkey").alias("id_variant"), (F.col("l_suppkey") % 4 != 0).alias("reusable"))
    rows = t("lineitem").groupBy(*named, F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("id_variant"), F.min("l_suppkey").alias("sk"))
    text = lambda c: c.cast("string")
    desired = rows.where(n % 4 != 3).select("id_product", "semantic", text(F.col("sk") % 3).alias("hash"), text(F.col("sk") % 2).alias("stock_hash"))
    owned = rows.where(n % 3 != 2).select("id_product", "semantic", "id_variant", text(F.col("sk") % 2).alias("hash"), F.lit("0").alias("stock_hash"))
    return reconcile.variants(desired, owned, actual)


@query("SELECT l_orderkey AS id_product, coalesce(max(CASE WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN l_linenumber END), min(l_linenumber)) AS default_id, count(CASE WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN 1 END) > 1 AS is_error FROM lineitem GROUP BY 1")
def default_heal(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("id_product"), F.col("l_linenumber").alias("id_variant"), ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 2)).alias("is_default"))
    return reconcile.default_variant(rows)


@query("SELECT sha256(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'))) AS scope, count(*) AS n FROM lineitem GROUP BY 1")
def price_scope_key(t):
    scope = hashing.joined_key(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    return t("lineitem").groupBy(scope.alias("scope")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 0), o AS (SELECT o_orderkey AS k, o_custkey AS own_id FROM orders WHERE o_orderkey % 3 = 0), lv AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(d.k, o.k) AS scope, CASE WHEN d.k IS NOT NULL AND o.k IS NOT NULL AND lv.k IS NOT NULL THEN 'update' WHEN d.k IS NOT NULL AND lv.k IS NOT NULL THEN 'adopt' WHEN d.k IS NOT NULL THEN 'create' WHEN lv.k IS NOT NULL AND o.k % 6 = 0 THEN 'delete' ELSE 'release' END AS action
FROM d FULL JOIN o ON d.k = o.k LEFT JOIN lv ON lv.k = coalesce(d.k, o.k)""")
def price_reconcile(t):
    o, k = t("orders"), F.col("o_orderkey")
    desired = o.where(k % 4 != 0).select(k.alias("scope"))
    owned = o.where(k % 3 == 0).select(k.alias("scope"), k.alias("id_rule"), F.lit("h").alias("hash"))
    live = o.where(k % 2 == 0).select(k.alias("scope"), k.alias("id_rule"), F.when(k % 6 == 0, "h").otherwise("x").alias("hash"))
    return reconcile.specific_prices(desired, owned, live, adopt=True).select("scope", "action")


@query("""WITH r AS (SELECT conv_id AS id_product, trim(text) AS url, min(turn) AS first_turn FROM conversations WHERE trim(text) <> '' GROUP BY 1, 2)
SELECT id_product, url, CAST(row_number() OVER (PARTITION BY id_product ORDER BY first_turn) - 1 AS INTEGER) AS position, row_number() OVER (PARTITION BY id_product ORDER BY first_turn) = 1 AS is_cover FROM r""")
def image_manifest(t):
    urls = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"])
    return reconcile.image_manifest(t("conversations").groupBy(F.col("conv_id").alias("id_product")).agg(urls.alias("urls")))


@query("SELECT page_id AS id_product, url, CASE WHEN page_id % 3 = 0 THEN 'remove' WHEN page_id % 5 = 0 THEN 'missing' ELSE 'keep' END AS action FROM pages")
def image_reconcile(t):
    p, k = t("pages"), F.col("page_id")
    desired = p.where(k % 3 != 0).select(k.alias("id_product"), "url", F.lit(0).alias("position"))
    state = p.where((k % 3 == 0) | (k % 5 != 0)).select(k.alias("id_product"), "url", k.alias("id_image"))
    return reconcile.images(desired, state).select("id_product", "url", "action")


@query("""WITH i AS (SELECT l_partkey AS id_image, l_suppkey % 3 AS id_shop, l_orderkey, l_linenumber FROM lineitem), a AS (SELECT id_image, count(*) AS n_refs FROM i GROUP BY 1), w AS (SELECT id_image, id_shop, count(*) AS n_own FROM i GROUP BY 1, 2), s AS (SELECT id_image, count(DISTINCT id_shop) AS n_shops FROM i GROUP BY 1)
SELECT i.l_orderkey, i.l_linenumber, CASE WHEN n_refs <= 1 AND n_shops <= 1 THEN 'delete' WHEN n_own <= 1 THEN 'detach' ELSE 'drop state' END AS action FROM i JOIN a USING (id_image) JOIN w USING (id_image, id_shop) JOIN s USING (id_image)""")
def image_removal(t):
    rows = t("lineitem").select(F.col("l_partkey").alias("id_image"), (F.col("l_suppkey") % 3).alias("id_shop"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("url"))
    out = reconcile.image_removal(rows, rows, rows)
    at = F.split("url", "/")
    return out.select(at[0].cast("long").alias("l_orderkey"), at[1].cast("int").alias("l_linenumber"), "action")


@query("""WITH m AS (SELECT l_orderkey AS id_product, l_partkey AS id_image, min(l_linenumber) AS least, bool_or(l_returnflag = 'R') AS flag FROM lineitem GROUP BY 1, 2)
SELECT id_product, id_image, CAST(row_number() OVER (PARTITION BY id_product ORDER BY least, id_image) AS INTEGER) AS position, row_number() OVER (PARTITION BY id_product ORDER BY flag DESC, least, id_image) = 1 AS is_cover FROM m""")
def placement_merge(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("id_product"), F.col("l_partkey").alias("id_image"), F.col("l_linenumber").alias("position"), (F.col("l_returnflag") == "R").alias("is_cover"))
    return reconcile.placement(rows)


@query("SELECT id_shop, content_hash, max_by(id_image, (n_chars, id_image)) AS id_image FROM (SELECT lang AS id_shop, md5(text) AS content_hash, n_chars, doc_id AS id_image FROM documents) GROUP BY 1, 2")
def content_dedupe(t):
    rows = t("documents").select(F.col("lang").alias("id_shop"), F.md5(F.col("text").cast("binary")).alias("content_hash"), F.col("n_chars").alias("updated_at"), F.col("doc_id").alias("id_image"))
    return reconcile.reusable_content(rows, ("id_shop", "content_hash"))


@query("SELECT l_orderkey, min(l_suppkey % 5) AS shop FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 5) = 1")
def shop_exclusive(t):
    return reconcile.exclusive_to_shop(t("lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("shop")), "l_orderkey", "shop")


@query("SELECT DISTINCT l_partkey, l_suppkey % 5 AS shop FROM lineitem a WHERE l_suppkey % 5 = 1 AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey % 5 <> 1)")
def detach_guard(t):
    return reconcile.detachable(t("lineitem").select("l_partkey", (F.col("l_suppkey") % 5).alias("shop")), "l_partkey", "shop", 1)


@query("""WITH m AS (SELECT DISTINCT l_returnflag AS g, l_linestatus AS v, ascii(l_returnflag) * 100 + ascii(l_linestatus) AS id FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_orderkey AS id_product, l_linenumber % 2 AS combination, coalesce(array_to_string(list_sort(list(DISTINCT id) FILTER (WHERE id IS NOT NULL)), ','), '') AS ids, count(*) FILTER (WHERE id IS NULL) AS n_unresolved FROM lineitem LEFT JOIN m ON g = l_returnflag AND v = l_linestatus GROUP BY 1, 2""")
def attribute_resolution(t):
    li = t("lineitem")
    refs = li.select(F.col("l_orderkey").alias("id_product"), (F.col("l_linenumber") % 2).alias("combination"), F.col("l_returnflag").alias("group_key"), F.col("l_linestatus").alias("value_key"))
    mapping = refs.select("group_key", "value_key").distinct().withColumn("id_attribute", F.ascii("group_key") * 100 + F.ascii("value_key"))
    out = reconcile.resolve_attributes(refs, mapping, mapping.where("group_key <> 'R'").select("id_attribute"))
    return out.select("id_product", "combination", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n_unresolved")


#: Pairs of a flag and a ship mode: those of flag A are mapped, and of these modes of four letters are not in the shop; the shop has group 'flag A' with all modes but MAIL.
_ATTRIBUTES = """r AS (SELECT l_orderkey AS id_product, l_linenumber % 2 AS combination, l_returnflag AS g, (['AIR', 'FOB', 'MAIL', 'RAIL', 'REG AIR', 'SHIP', 'TRUCK'])[1 + l_partkey % 7] AS v, CASE WHEN l_orderkey % 97 = 0 THEN '' ELSE 'flag ' || l_returnflag END AS gn FROM lineitem),
m AS (SELECT DISTINCT v, ascii(v) * 100 + length(v) AS id FROM r), e AS (SELECT v, id, row_number() OVER (ORDER BY v) - 1 AS position FROM m WHERE v <> 'MAIL'),
j AS (SELECT r.*, CASE WHEN g = 'A' AND length(r.v) <> 4 THEN ascii(r.v) * 100 + length(r.v) WHEN g = 'A' AND gn <> '' THEN e.id END AS found FROM r LEFT JOIN e ON e.v = r.v),
ok AS (SELECT * FROM j WHERE id_product NOT IN (SELECT id_product FROM j WHERE found IS NULL AND gn = '') AND id_product NOT IN (SELECT id_product FROM j WHERE gn = '' AND g = 'A' AND length(v) = 4)),
gr AS (SELECT gn, CASE WHEN gn = 'flag A' THEN 1 ELSE 1 + row_number() OVER (PARTITION BY gn = 'flag A' ORDER BY gn) END AS id_group FROM (SELECT DISTINCT gn FROM ok WHERE found IS NULL)),
n AS (SELECT gn, id_group, v, (SELECT max(id) FROM e) + row_number() OVER (ORDER BY id_group, v) AS id, row_number() OVER (PARTITION BY id_group ORDER BY v) - 1 + CASE WHEN id_group = 1 THEN (SELECT max(position) + 1 FROM e) ELSE 0 END AS position FROM (SELECT DISTINCT gn, v FROM ok WHERE found IS NULL) JOIN gr USING (gn))"""


def _attributes(t):
    li = t("lineitem")
    flag, mode = F.col("l_returnflag"), F.element_at(F.split(F.lit("AIR,FOB,MAIL,RAIL,REG AIR,SHIP,TRUCK"), ","), (F.col("l_partkey") % 7 + 1).cast("int"))
    refs = li.select(F.col("l_orderkey").alias("id_product"), (F.col("l_linenumber") % 2).alias("combination"), F.lit(None).cast("int").alias("id_attribute"), flag.alias("group_key"), mode.alias("value_key"), F.when(F.col("l_orderkey") % 97 == 0, "").otherwise(F.concat(F.lit("flag "), flag)).alias("group_name"), mode.alias("value"))
    modes = refs.select("value").distinct().withColumn("id_attribute", F.ascii("value") * 100 + F.char_length("value"))
    mapping = modes.select(F.lit("A").alias("group_key"), F.col("value").alias("value_key"), "id_attribute")
    groups = li.sparkSession.createDataFrame([(1, "flag A", 0)], "id_group int, name string, position int")
    place = (F.row_number().over(Window.orderBy("value")) - 1).alias("position")  # seven rows
    has = modes.where("value <> 'MAIL'").select("id_attribute", F.lit(1).alias("id_group"), F.col("value").alias("name"), place)
    return attributes.resolve(refs, mapping, modes.where(F.char_length("value") != 4), groups, has, auto_create=True)


@query(f"WITH {_ATTRIBUTES} SELECT id_product, combination, array_to_string(list_sort(list(DISTINCT coalesce(found, n.id))), ',') AS ids FROM ok LEFT JOIN n ON n.gn = ok.gn AND n.v = ok.v GROUP BY 1, 2")
def combination_attributes(t):
    return _attributes(t).combinations.select("id_product", "combination", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"WITH {_ATTRIBUTES} SELECT CAST(id AS BIGINT) AS id_attribute, CAST(id_group AS BIGINT) AS id_group, v AS name, CAST(position AS BIGINT) AS position FROM n")
def attributes_made(t):
    return _attributes(t).attributes.select(F.col("id_attribute").cast("long"), F.col("id_group").cast("long"), "name", F.col("position").cast("long"))


@query("""WITH h AS (SELECT DISTINCT l_partkey, l_suppkey % 4 AS shop FROM lineitem), b AS (SELECT l_partkey, min(shop) AS copy_from FROM h GROUP BY 1)
SELECT b.l_partkey, b.copy_from, s.shop FROM b, (SELECT unnest([0, 1, 2, 3]) AS shop) s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.l_partkey = b.l_partkey AND h.shop = s.shop)""")
def row_repair(t):
    have = t("lineitem").select("l_partkey", (F.col("l_suppkey") % 4).cast("int").alias("shop")).distinct().withColumn("rank", F.col("shop"))
    return reconcile.repair_rows(have, [0, 1, 2, 3], "l_partkey", "shop", "rank").select("l_partkey", "copy_from", "shop")


# Queues: events are jobs.

_Q = f"""q AS (SELECT event_id AS id_queue, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'failed' END AS status, CAST(event_id % 6 AS INTEGER) AS attempts, ts AS available_at, ts + INTERVAL 15 MINUTE AS locked_until, ts AS updated_at,
user_id % 50 AS id_product, event_type AS source, CAST(event_id % 9 AS BIGINT) AS id_run, CASE event_id % 5 WHEN 0 THEN 'Image HTTP failure 404' WHEN 1 THEN 'image http failure 503' WHEN 2 THEN 'Unsupported image MIME x' WHEN 3 THEN 'timeout' ELSE 'image HTTP failure 429' END AS last_error, TIMESTAMP '{NOW}' AS now FROM events)"""
_ELIGIBLE = "((status = 'pending' AND available_at <= now) OR (status = 'processing' AND locked_until < now)) AND attempts < 5"


def queue(t):
    e = F.col("event_id")
    pick = lambda n, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (e % n + 1).cast("int"))
    return t("events").select(
        e.alias("id_queue"),
        pick(4, "pending", "processing", "done", "failed").alias("status"),
        (e % 6).cast("int").alias("attempts"),
        F.col("ts").alias("available_at"),
        (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("locked_until"),
        F.col("ts").alias("updated_at"),
        (F.col("user_id") % 50).alias("id_product"),
        F.col("event_type").alias("source"),
        (e % 9).alias("id_run"),
        pick(5, "Image HTTP failure 404", "image http failure 503", "Unsupported image MIME x", "timeout", "image HTTP failure 429").alias("last_error"),
        F.lit(None).cast("string").alias("locked_by"),
    )


@query(f"WITH {_Q} SELECT id_queue, 'processing' AS status, attempts + 1 AS attempts FROM q WHERE {_ELIGIBLE} ORDER BY id_queue LIMIT 200")
def queue_claim(t):
    return work.claim(queue(t), now(), 200, "w1").select("id_queue", "status", "attempts")


@query(f"WITH {_Q} SELECT id_queue, attempts + 1 AS attempts FROM q WHERE {_ELIGIBLE} AND id_product % 7 = 3 ORDER BY id_queue LIMIT 100")
def queue_active_first(t):
    owners = queue(t).where("id_product % 7 = 3").select("id_product").distinct()
    return work.claim_active_first(queue(t), owners, now(), 100, "w1", ["id_product"]).select("id_queue", "attempts")


_RETRY = "CASE WHEN lower(last_error) LIKE '%unsupported image mime%' THEN false WHEN last_error ILIKE '%404' THEN false ELSE true END"


@query(f"WITH {_Q} SELECT id_queue, {_RETRY} AS retryable FROM q")
def failure_classifier(t):
    return queue(t).select("id_queue", work.is_retryable(F.col("last_error")).alias("retryable"))


@query("SELECT event_id, event_id % 3 = 0 OR event_id % 5 = 0 AS transient FROM events")
def transient_failures(t):
    e = F.col("event_id")
    message = F.when(e % 5 == 0, "Deadlock found when trying to get lock").otherwise("syntax error")
    return t("events").select(e, work.is_transient(F.when(e % 3 == 0, "1213").otherwise("42000"), message).alias("transient"))


@query(f"WITH {_Q} SELECT id_queue, CASE WHEN NOT ({_RETRY}) OR attempts >= 5 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN NOT (NOT ({_RETRY}) OR attempts >= 5) THEN epoch(now) + CASE WHEN attempts <= 1 THEN 15 WHEN attempts = 2 THEN 30 WHEN attempts = 3 THEN 60 WHEN attempts = 4 THEN 120 ELSE 300 END END::BIGINT AS due FROM q WHERE status = 'processing'".replace("END END::BIGINT AS due", "END END AS due").replace("epoch(now) +", "CAST(epoch(now) AS BIGINT) +"))
def queue_fail_backoff(t):
    rows = work.fail(queue(t).where("status = 'processing'"), now(), work.is_retryable(F.col("last_error")))
    due = F.unix_seconds(F.col("available_at").cast("timestamp"))
    return rows.select("id_queue", "status", due.alias("due"))


_ENQ_SQL = """q AS (SELECT user_id AS id_product, min(event_id) AS h, min(event_id) % 4 AS id_run, 'a' AS source, CAST(min(event_id) % 3 AS VARCHAR) AS source_key, CASE min(event_id) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'failed' END AS status, CAST(min(event_id) % 6 AS INTEGER) AS attempts FROM events WHERE user_id % 3 <> 0 GROUP BY 1),
r AS (SELECT user_id AS id_product, CAST(2 AS BIGINT) AS id_run, 'a' AS source, CAST(min(event_id) % 2 AS VARCHAR) AS source_key FROM events WHERE user_id % 2 = 0 GROUP BY 1)"""


@query(f"""WITH {_ENQ_SQL}, j AS (SELECT coalesce(q.id_product, r.id_product) AS id_product, q.id_run AS qr, r.id_run AS rr, q.source_key AS qk, r.source_key AS rk, q.status, q.attempts, r.id_run IS NOT NULL AND (q.id_run IS NULL OR r.id_run > q.id_run OR (r.id_run = q.id_run AND r.source_key = q.source_key)) AS accept, q.status = 'processing' AND q.source_key = r.source_key AS leased FROM q FULL JOIN r ON q.id_product = r.id_product)
SELECT id_product, greatest(coalesce(qr, rr), coalesce(rr, qr)) AS id_run, CASE WHEN accept THEN rk ELSE qk END AS source_key, CASE WHEN accept AND NOT coalesce(leased, false) THEN 'pending' ELSE status END AS status, CASE WHEN accept AND NOT coalesce(leased, false) THEN 0 ELSE attempts END AS attempts FROM j""")
def queue_enqueue_merge(t):
    e, none = F.min("event_id"), F.lit(None)
    pick = F.element_at(F.array(*(F.lit(x) for x in ("pending", "processing", "done", "failed"))), (e % 4 + 1).cast("int"))
    shared = [F.lit(1).alias("id_shop"), F.lit("u").alias("url_hash")]
    nulls = [none.cast(k).alias(n) for k, n in (("timestamp_ntz", "available_at"), ("string", "locked_by"), ("timestamp_ntz", "locked_until"), ("string", "last_error"), ("timestamp_ntz", "updated_at"), ("string", "url"))]
    flat = [F.lit(0).alias("position"), F.lit(False).alias("is_cover"), F.lit("a").alias("source")]
    by = F.col("user_id").alias("id_product")
    q = t("events").where("user_id % 3 <> 0").groupBy(by).agg((e % 4).alias("id_run"), (e % 3).cast("string").alias("source_key"), pick.alias("status"), (e % 6).cast("int").alias("attempts")).select("*", *shared, *nulls, *flat)
    r = t("events").where("user_id % 2 = 0").groupBy(by).agg(F.lit(2).cast("long").alias("id_run"), (e % 2).cast("string").alias("source_key")).select("*", *shared, *flat, none.cast("string").alias("url"))
    return work.enqueue_images(q, r, now()).select("id_product", "id_run", "source_key", "status", "attempts")


@query(f"""WITH {_ENQ_SQL} SELECT coalesce(q.id_product, r.id_product) AS id_product, greatest(coalesce(q.id_run, r.id_run), coalesce(r.id_run, q.id_run)) AS id_run, CASE WHEN r.id_run IS NOT NULL AND (q.id_run IS NULL OR r.id_run >= q.id_run) THEN 'new' ELSE 'old' END AS payload,
CASE WHEN r.id_run IS NOT NULL AND (q.id_run IS NULL OR (r.id_run > q.id_run AND q.status <> 'processing')) THEN 'pending' ELSE q.status END AS status FROM q FULL JOIN r ON q.id_product = r.id_product""")
def product_enqueue_merge(t):
    e = F.min("event_id")
    pick = F.element_at(F.array(*(F.lit(x) for x in ("pending", "processing", "done", "failed"))), (e % 4 + 1).cast("int"))
    keys = [F.lit(1).alias("id_shop"), F.lit("a").alias("source"), F.col("id_product").alias("source_key")]
    q = t("events").where("user_id % 3 <> 0").groupBy(F.col("user_id").alias("id_product")).agg((e % 4).alias("id_run"), pick.alias("status"), F.lit(1).alias("attempts")).select(*keys, "id_run", "status", "attempts", F.lit("old").alias("payload"))
    r = t("events").where("user_id % 2 = 0").select(F.col("user_id").alias("id_product")).distinct().select(*keys, F.lit(2).cast("long").alias("id_run"), F.lit("new").alias("payload"))
    return work.enqueue_products(q, r).select(F.col("source_key").alias("id_product"), "id_run", "payload", "status")


@query(f"WITH {_Q}, m AS (SELECT id_product, source, max(id_run) AS r FROM q WHERE id_run > 5 GROUP BY 1, 2) SELECT id_queue, r IS NOT NULL AND id_run < r AND status IN ('pending', 'processing', 'failed') AS superseded FROM q LEFT JOIN m USING (id_product, source)")
def queue_supersede(t):
    q = queue(t)
    out = work.supersede_older(q, q.where("id_run > 5"), ["id_product", "source"])
    return out.select("id_queue", F.coalesce("superseded", F.lit(False)).alias("superseded"))


@query(f"WITH {_Q} SELECT id_queue, 'pending' AS status, 0 AS attempts FROM q WHERE status = 'failed' ORDER BY id_queue LIMIT 150")
def queue_retry(t):
    return work.retry_failed(queue(t), 150).select("id_queue", "status", "attempts")


@query(f"WITH {_Q} SELECT id_queue FROM q WHERE status = 'failed' AND (last_error LIKE 'timeout%' OR last_error LIKE 'Unsupported%') AND id_product % 2 = 0 ORDER BY id_queue LIMIT 100")
def queue_requeue_errors(t):
    q = queue(t)
    return work.requeue_errors(q, q.where("id_product % 2 = 0").select("id_product").distinct(), ["timeout", "Unsupported"], ["id_product"], 100).select("id_queue")


@query(f"WITH {_Q} SELECT s.status, count(q.status) AS n FROM (SELECT unnest(['pending', 'processing', 'done', 'failed', 'unknown']) AS status) s LEFT JOIN q ON q.status = s.status GROUP BY 1")
def queue_histogram(t):
    return work.histogram(queue(t), (*work.STATES, "unknown"))


@query(f"WITH {_Q} SELECT source, count(*) FILTER (WHERE status = 'processing') AS n_processing, count(*) FILTER (WHERE status = 'processing' AND locked_until < now) AS n_lapsed FROM q GROUP BY 1")
def expired_leases(t):
    return work.lease_counts(queue(t), now(), "source")


@query(f"WITH {_Q} SELECT id_run, count(*) AS n FROM q WHERE status IN ('pending', 'processing') AND id_product % 5 <> 0 GROUP BY 1")
def active_unresolved(t):
    q = queue(t)
    mapping = q.select("id_product", (F.col("id_product") % 5 == 0).alias("out_of_feed")).distinct()
    return work.active_unresolved(q, mapping, ["id_product"])


@query(f"WITH {_Q} SELECT id_queue, attempts + 1 AS attempts, CAST(epoch(now) AS BIGINT) + 60 * CASE WHEN attempts + 1 <= 1 THEN 15 WHEN attempts + 1 <= 3 THEN 60 WHEN attempts + 1 <= 6 THEN 360 ELSE 1440 END AS due FROM q")
def orphan_defer(t):
    rows = work.defer_orphan(queue(t), now())
    return rows.select("id_queue", "attempts", F.unix_seconds(F.col("available_at").cast("timestamp")).alias("due"))


@query("""WITH e AS (SELECT user_id % 7 AS id_run, CASE event_id % 4 WHEN 0 THEN 'WARNING: x' WHEN 1 THEN 'SKIPPED: y' ELSE 'price' END AS m FROM events)
SELECT id_run, count(*) FILTER (WHERE m LIKE 'WARNING:%') AS n_warnings, count(*) FILTER (WHERE m LIKE 'SKIPPED:%') AS n_skipped, count(*) FILTER (WHERE m NOT LIKE 'WARNING:%') AS n_errors, count(*) FILTER (WHERE m = 'price') AS n_blocking FROM e GROUP BY 1""")
def error_counts(t):
    e = F.col("event_id") % 4
    return retention.error_counts(t("events").select((F.col("user_id") % 7).alias("id_run"), F.when(e == 0, "WARNING: x").when(e == 1, "SKIPPED: y").otherwise("price").alias("message")))


@query("""WITH s AS (SELECT user_id, event_id, row_number() OVER (ORDER BY ts, event_id) AS rk FROM events WHERE event_type <> 'click' ORDER BY ts, event_id LIMIT 400) SELECT user_id, min(rk) AS rank FROM s GROUP BY 1 ORDER BY rank LIMIT 40""")
def stale_keys(t):
    rows = t("events").where("event_type <> 'click'").select("ts", "event_id", "user_id")
    return paging.distinct_first_seen(rows, ["ts", "event_id"], ["user_id"], 40).select("user_id", F.col("rank").cast("long").alias("rank"))


# Pages.


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_page(t):
    return paging.keyset_page(t("documents").select("doc_id", "n_chars"), "doc_id", 100, 50)


@query("WITH c AS (SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS running, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, n_chars, running FROM c WHERE rn = 1 OR (running <= 1000000 AND running - n_chars < 1000000)")
def byte_budget_page(t):
    return paging.byte_budget_page(t("documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 1_000_000)


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 1")
def latest_run(t):
    return paging.latest(t("events").select("event_id", "user_id"), "event_id")


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 25")
def recent_runs(t):
    return paging.recent(t("events").select("event_id", "user_id"), "event_id", 25)


# Retention and status.


@query(f"WITH {_Q} SELECT id_queue FROM q WHERE status = 'done' AND updated_at < now AND id_product % 10 <> 0 AND id_product % 3 <> 1")
def gc_jobs(t):
    q = queue(t)
    ids = q.select("id_product").distinct()
    return retention.old_done_jobs(q, now(), ids.where("id_product % 10 = 0"), ["id_product"], ids.where("id_product % 3 <> 1"), ["id_product"]).select("id_queue")


@query("""WITH r AS (SELECT user_id % 3 AS id_shop, event_type AS source, event_id AS id_run, event_id % 50 = 0 AS reconciled FROM events)
SELECT r.id_run FROM r JOIN (SELECT id_shop, source, max(id_run) AS newest FROM r WHERE reconciled GROUP BY 1, 2) n USING (id_shop, source) WHERE r.id_run < 500 AND newest > r.id_run""")
def gc_snapshots(t):
    runs = t("events").select((F.col("user_id") % 3).alias("id_shop"), F.col("event_type").alias("source"), F.col("event_id").alias("id_run"), (F.col("event_id") % 50 == 0).alias("reconciled"))
    return retention.old_snapshots(runs, 500).select("id_run")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10) OR NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)")
def broken_refs(t):
    parts = t("part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    suppliers = t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return retention.broken(rows, (parts, ["l_partkey"]), (suppliers, ["l_suppkey"])).select("l_orderkey", "l_linenumber")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'defer' WHEN event_id % 3 = 0 THEN 'resolved' WHEN event_id % 5 = 0 THEN 'resolved' WHEN event_id % 7 = 0 THEN 'delete' ELSE 'defer' END AS decision FROM events")
def orphan_decision(t):
    e = F.col("event_id")
    return t("events").select("event_id", retention.orphan_decision(e % 2 == 0, e % 3 == 0, e % 5 != 0, e % 7 == 0).alias("decision"))


@query(f"WITH {_Q} SELECT 'failed jobs' AS name, CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warning' END AS status, count(*) AS n FROM q WHERE status = 'failed' UNION ALL SELECT 'jobs without a product', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'error' END, count(*) FROM q WHERE id_product IS NULL")
def status_report(t):
    q = queue(t)
    return retention.checks(("failed jobs", q.where("status = 'failed'"), "warning"), ("jobs without a product", q.where("id_product is null"), "error"))


@query("SELECT event_id, CAST(floor((event_id % 5) * 100 / 4) AS BIGINT) AS percent, CASE WHEN event_id % 3 > 0 THEN 'downloading' WHEN event_id % 2 = 0 AND event_id % 5 = 0 THEN 'reconciling' WHEN event_id % 5 > 0 THEN 'failed' ELSE 'completed' END AS stage FROM events")
def run_progress(t):
    e = F.col("event_id")
    return t("events").select("event_id", retention.progress(e % 5).alias("percent"), retention.image_stage(e % 3, e % 5, e % 2 != 0).alias("stage"))
