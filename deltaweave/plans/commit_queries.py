"""Three-way comparisons, constraints, folded logs, differences, and tables kept in a store by scope, from the shop's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import delta, reconcile, retention, work, workers
from ..operators.constraints import Holds, Reference, Unique, examine
from ..sources.store import Store, scratch
from .feed_run import GRANULAR, by_domain
from .registry import query
from .state_queries import _Q, queue

# What is desired and owned is a line of each number; what there is, every line. Amounts differ by nothing, by less and by more than the tolerance.
_LINES = """g AS (SELECT sale_id AS id_product, line_no AS semantic, min(item_id) AS id_variant, min(amount) AS amount, min(discount) AS discount, min(quantity) AS quantity FROM sale_lines GROUP BY 1, 2),
d AS (SELECT id_product, semantic, CAST(id_variant % 3 AS VARCHAR) AS hash, CAST(id_variant % 2 AS VARCHAR) AS stock_hash, coalesce(amount, 0) + CASE id_product % 3 WHEN 0 THEN 0 WHEN 1 THEN 5e-7 ELSE 2e-6 END AS p, coalesce(discount, 0) AS w, CAST(coalesce(quantity, 1) AS DOUBLE) AS m FROM g WHERE semantic % 5 <> 4),
o AS (SELECT id_product, semantic, id_variant, CASE WHEN id_product % 7 = 0 THEN 'x' ELSE CAST(id_variant % 3 AS VARCHAR) END AS hash, '0' AS stock_hash, true AS own FROM g WHERE semantic % 4 <> 3),
f AS (SELECT sale_id AS id_product, line_no AS semantic, list_sort(list_distinct(list({'id': item_id, 'p': coalesce(amount, 0), 'w': coalesce(discount, 0), 'm': CAST(coalesce(quantity, 1) AS DOUBLE)}))) AS free FROM sale_lines WHERE flag <> 'returned' AND item_id IS NOT NULL GROUP BY 1, 2),
j AS (SELECT d.*, coalesce(o.own, false) AS owned, o.id_variant AS own_id, o.hash AS own_hash, o.stock_hash AS own_stock, coalesce(list_filter(free, lambda v: v.id = o.id_variant)[1], free[1]) AS c FROM d LEFT JOIN o ON o.id_product IS NOT DISTINCT FROM d.id_product AND o.semantic IS NOT DISTINCT FROM d.semantic LEFT JOIN f ON f.id_product IS NOT DISTINCT FROM d.id_product AND f.semantic IS NOT DISTINCT FROM d.semantic),
k AS (SELECT *, c.id AS id_variant, coalesce(abs(p - c.p) > 1e-6 OR abs(w - c.w) > 1e-6 OR abs(m - c.m) > 1e-6, false) AS by_fields FROM j)"""


@query(f"""WITH {_LINES} SELECT id_product, semantic, id_variant, CASE WHEN id_variant IS NULL THEN 'create' ELSE 'use' END AS action, id_variant IS NULL OR own_id IS DISTINCT FROM id_variant OR own_hash IS DISTINCT FROM hash OR by_fields AS structure_changed,
id_variant IS NOT NULL AND (own_id IS DISTINCT FROM id_variant OR own_stock IS DISTINCT FROM stock_hash) AS write_stock, by_fields AS fields_changed FROM k
UNION ALL SELECT id_product, semantic, own_id, 'remove', true, false, false FROM k WHERE owned AND id_variant IS NOT NULL AND own_id IS DISTINCT FROM id_variant
UNION ALL SELECT o.id_product, o.semantic, o.id_variant, 'remove', true, false, false FROM o WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.id_product IS NOT DISTINCT FROM o.id_product AND d.semantic IS NOT DISTINCT FROM o.semantic)""")
def variants_three_way(t):
    """Rows of no product or number are of one of their own."""
    named = [F.col("sale_id").alias("id_product"), F.col("line_no").alias("semantic")]
    rows = t("sale_lines").groupBy(*named).agg(F.min("item_id").alias("id_variant"), *(F.min(c).alias(c) for c in ("amount", "discount", "quantity")))
    step = F.when(F.col("id_product") % 3 == 0, 0.0).when(F.col("id_product") % 3 == 1, 5e-7).otherwise(2e-6)
    text = lambda c: c.cast("string")
    nothing = F.lit(None).cast("double").alias("wholesale_price")
    desired = rows.where("semantic % 5 <> 4").select("id_product", "semantic", text(F.col("id_variant") % 3).alias("hash"), text(F.col("id_variant") % 2).alias("stock_hash"), (F.coalesce("amount", F.lit(0.0)) + step).alias("price_impact"), F.col("discount").alias("weight_impact"), nothing, F.col("quantity").alias("minimal_quantity"))
    owned = rows.where("semantic % 4 <> 3").select("id_product", "semantic", "id_variant", F.when(F.col("id_product") % 7 == 0, "x").otherwise(text(F.col("id_variant") % 3)).alias("hash"), F.lit("0").alias("stock_hash"))
    actual = t("sale_lines").select(*named, F.col("item_id").alias("id_variant"), (F.col("flag") != "returned").alias("reusable"), F.col("amount").alias("price_impact"), F.col("discount").alias("weight_impact"), nothing, F.col("quantity").alias("minimal_quantity"))
    return reconcile.variants_by_fields(desired, owned, actual)


@query("""WITH v AS (SELECT sale_id, item_id, min(line_no) AS n FROM sale_lines WHERE item_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT sale_id AS id_product, item_id AS id_variant, n % 3 <> 0 AS s, n % 2 = 1 AS wanted, n = 3 AS d, n % 5 <> 4 AS here FROM v),
p AS (SELECT id_product, coalesce(min(id_variant) FILTER (WHERE s AND wanted), min(id_variant) FILTER (WHERE s)) AS chosen, min(id_variant) FILTER (WHERE NOT s AND d AND here) AS outside, min(id_variant) FILTER (WHERE d AND here) AS now_id, list(id_variant) FILTER (WHERE s AND here) AS there FROM r GROUP BY 1),
e AS (SELECT *, CASE WHEN chosen IS NULL THEN NULL WHEN NOT coalesce(list_contains(there, chosen), false) THEN 'the default isn''t in the shop' WHEN outside IS NOT NULL THEN 'another''s variant is the default' END AS error FROM p)
SELECT id_product, CASE WHEN error IS NULL THEN coalesce(chosen, now_id) END AS default_id, error FROM e""")
def default_outside(t):
    v = t("sale_lines").where("item_id is not null").groupBy(F.col("sale_id").alias("id_product"), F.col("item_id").alias("id_variant")).agg(F.min("line_no").alias("n"))
    n = F.col("n")
    return reconcile.healed_default(v.select("id_product", "id_variant", (n % 3 != 0).alias("survivor"), (n % 2 == 1).alias("wanted"), (n == 3).alias("is_default"), (n % 5 != 4).alias("in_shop")))


def _missing(table: str, keys: str, other: str, others: str) -> str:
    return f"(SELECT count(*) FROM {table} WHERE {keys} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {other} WHERE {other}.{others} = {table}.{keys}))"


@query(f"""WITH x(name, bad, n) AS (SELECT 'clients: one row a client', 'error', (SELECT count(*) FROM (SELECT client_id FROM clients GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'clients: one row an address', 'warning', (SELECT count(*) FROM (SELECT email FROM clients GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'clients: nation exists', 'error', {_missing("clients", "nation_id", "nation", "n_nationkey")}
UNION ALL SELECT 'clients: master exists', 'error', {_missing("clients", "master_id", "clients AS c", "client_id").replace("clients AS c.client_id", "c.client_id")}
UNION ALL SELECT 'clients: not overdrawn', 'warning', (SELECT count(*) FROM clients WHERE balance < 0)
UNION ALL SELECT 'clients: updated this year', 'warning', (SELECT count(*) FROM clients WHERE updated_at < TIMESTAMP '2024-01-01')
UNION ALL SELECT 'sale_lines: one row a line', 'error', (SELECT count(*) FROM (SELECT sale_id, line_no FROM sale_lines GROUP BY 1, 2 HAVING count(*) > 1))
UNION ALL SELECT 'sale_lines: sale is known', 'error', (SELECT count(*) FROM sale_lines WHERE NOT EXISTS (SELECT 1 FROM sales WHERE sales.sale_id = sale_lines.sale_id))
UNION ALL SELECT 'sale_lines: item is known', 'error', (SELECT count(*) FROM sale_lines WHERE NOT EXISTS (SELECT 1 FROM items WHERE items.item_id = sale_lines.item_id))
UNION ALL SELECT 'sale_lines: vendor exists', 'error', {_missing("sale_lines", "vendor_id", "vendors", "vendor_id")}
UNION ALL SELECT 'sale_lines: known flags', 'error', (SELECT count(*) FROM sale_lines WHERE flag NOT IN ('kept', 'swapped', 'returned'))
UNION ALL SELECT 'sale_lines: quantities are positive', 'warning', (SELECT count(*) FROM sale_lines WHERE quantity <= 0 OR quantity IS NULL)
UNION ALL SELECT 'vendors: one row a vendor', 'error', (SELECT count(*) FROM (SELECT vendor_id FROM vendors GROUP BY 1 HAVING count(*) > 1)))
SELECT name, CASE WHEN n = 0 THEN 'ok' ELSE bad END AS status, n FROM x""")
def shop_constraints(t):
    tables = {n: t(n) for n in ("clients", "nation", "sale_lines", "sales", "items", "vendors")}
    return examine(
        tables,
        [
            Unique("clients", "clients: one row a client", keys=("client_id",)),
            Unique("clients", "clients: one row an address", "warning", keys=("email",)),
            Reference("clients", "clients: nation exists", "error", ("nation_id",), "nation", ("n_nationkey",), optional=True),
            Reference("clients", "clients: master exists", "error", ("master_id",), "clients", ("client_id",), optional=True),
            Holds("clients", "clients: not overdrawn", "warning", F.col("balance") < 0),
            Holds("clients", "clients: updated this year", "warning", F.col("updated_at") < F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")),
            Unique("sale_lines", "sale_lines: one row a line", keys=("sale_id", "line_no")),
            Reference("sale_lines", "sale_lines: sale is known", "error", ("sale_id",), "sales", ("sale_id",)),
            Reference("sale_lines", "sale_lines: item is known", "error", ("item_id",), "items", ("item_id",)),
            Reference("sale_lines", "sale_lines: vendor exists", "error", ("vendor_id",), "vendors", ("vendor_id",), optional=True),
            Holds("sale_lines", "sale_lines: known flags", "error", ~F.col("flag").isin("kept", "swapped", "returned")),
            Holds("sale_lines", "sale_lines: quantities are positive", "warning", (F.col("quantity") <= 0) | F.col("quantity").isNull()),
            Unique("vendors", "vendors: one row a vendor", keys=("vendor_id",)),
        ],
    )


@query("""WITH l AS (SELECT client_id, op, segment, city, balance FROM client_changes WHERE client_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC) = 1)
SELECT client_id AS id_queue, 'put' AS status, segment, city, balance FROM clients WHERE client_id NOT IN (SELECT client_id FROM l) UNION ALL SELECT client_id, op, segment, city, balance FROM l""")
def log_folded(t):
    """Of places in the log that are equal the one of larger id comes later."""
    base = t("clients").select(F.col("client_id").alias("id_queue"), F.lit("put").alias("status"), "segment", "city", "balance")
    log = t("client_changes").where("client_id is not null").select(F.col("client_id").alias("id_queue"), F.col("op").alias("status"), "segment", "city", "balance", F.struct("seq", "change_id").alias("seq"))
    return work.folded(base, log)


@query(f"WITH {_Q} SELECT id_queue, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status, CASE WHEN status <> 'processing' THEN locked_until END AS locked_until FROM q")
def jobs_released(t):
    return work.released(queue(t)).select("id_queue", "status", "locked_until")


_DIFF = """s AS (SELECT CAST(item_id AS VARCHAR) AS k, item_id AS n, coalesce(brand, '') AS h FROM items WHERE item_id % 6 <> 0), m AS (SELECT CAST(item_id AS VARCHAR) AS k, item_id AS n, CASE WHEN item_id % 5 = 0 THEN 'old' ELSE coalesce(brand, '') END AS h, item_id % 11 = 0 AS gone FROM items WHERE item_id % 7 <> 0),
x AS (SELECT coalesce(s.k, m.k) AS source_key, CASE WHEN m.k IS NULL THEN 'new' WHEN s.k IS NOT NULL AND (m.gone OR s.h <> m.h) THEN 'changed' WHEN s.k IS NULL AND NOT m.gone AND m.n % 12 <> 0 THEN 'gone' END AS kind, m.gone AS gone, m.n AS id_product FROM s FULL JOIN m USING (k)),
y AS (SELECT source_key, kind, CASE kind WHEN 'new' THEN 'create' WHEN 'changed' THEN 'update' ELSE 'disable' END AS action, id_product FROM x WHERE kind IS NOT NULL)"""


def _difference(t):
    n, key = F.col("item_id"), F.col("item_id").cast("string").alias("source_key")
    brand = F.coalesce("brand", F.lit(""))
    snapshot = t("items").where(n % 6 != 0).select(key, brand.alias("core_hash"))
    state = t("items").where(n % 7 != 0).select(key, n.alias("id_product"), F.when(n % 5 == 0, "old").otherwise(brand).alias("core_hash"), (n % 11 == 0).alias("out_of_feed"), F.lit(1).cast("long").alias("last_seen_run_id"))
    return delta.difference(snapshot, state, t("items").where(n % 12 == 0).select(key), 2, domains=("core",))


@query(f"WITH {_DIFF} SELECT *, kind = 'new' AS image_changed, CASE WHEN kind = 'changed' THEN 'core' ELSE '' END AS domains FROM y")
def difference_rows(t):
    """New, changed and gone rows in one pass; a key that the feed has in no readable form isn't gone."""
    return _difference(t).withColumn("domains", F.array_join("domains", ","))


_MADE = ", ".join(f"'{d}'" for d in GRANULAR if d not in ("image", "availability"))


@query(f"WITH {_DIFF} SELECT source_key, action, unnest(CASE action WHEN 'create' THEN [{_MADE}, 'image'] WHEN 'disable' THEN ['availability'] ELSE ['core'] END) AS domain FROM y")
def actions_by_domain(t):
    return by_domain(_difference(t))


@query("SELECT client_id, source, segment, CASE WHEN client_id % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE balance END AS balance FROM clients WHERE client_id % 9 <> 0")
def scopes_in_a_store(t):
    """Each source's clients are a scope of one stored table, written one after the other; then the buckets with a client of the tenth are written anew, by
    somebody who has read before the others wrote, and every ninth client is deleted by its key."""
    rows = t("clients").select("client_id", F.coalesce("source", F.lit("")).alias("scope"), "source", "segment", "balance")
    store = Store(rows.sparkSession, scratch(rows.sparkSession))
    scopes = [r[0] for r in rows.select("scope").distinct().orderBy("scope").collect()]  # one for each source
    parts = {}
    for s in scopes:
        store.write("clients", rows.where(F.col("scope") == s), part=f"scope-{s}", buckets=range(store.buckets), key="client_id", expect={})
        parts[s] = store.parts("clients", f"scope-{s}")
    for s in reversed(scopes):
        own = store.read_bucketed("clients", f"scope-{s}", "client_id long, scope string, source string, segment string, balance double", "client_id")
        hit = F.col("client_id") % 10 == 0
        buckets = sorted(r[0] for r in own.where(hit).select("bucket").distinct().collect())  # at most the number of buckets
        anew = own.where(F.col("bucket").isin(buckets)).withColumn("balance", F.when(hit, 0.0).otherwise(F.col("balance"))).drop("bucket")
        store.write("clients", anew, part=f"scope-{s}", buckets=buckets, key="client_id", expect=parts[s])
    store.delete("clients", rows.where("client_id % 9 = 0").select("client_id"))
    return store.read("clients").select("client_id", "source", "segment", "balance")


@query("""WITH h AS (SELECT sale_id FROM sales WHERE status = 'held' ORDER BY sale_id LIMIT 300)
SELECT 'sales' AS name, sale_id AS id FROM sales WHERE sale_id NOT IN (SELECT sale_id FROM h) UNION ALL SELECT 'vendors', vendor_id FROM vendors WHERE vendor_id NOT IN (SELECT vendor_id FROM vendors WHERE vendor_id % 2 = 0 ORDER BY vendor_id LIMIT (SELECT 300 - count(*) FROM h))""")
def garbage_in_order(t):
    """Held sales go first and then vendors of even id, 300 rows in all by the call's budget; of each table only the keys that go are written."""
    spark = t("sales").sparkSession
    store = Store(spark, scratch(spark))
    store.write("sales", t("sales").select(F.col("sale_id").alias("id"), "status"))
    store.write("vendors", t("vendors").select(F.col("vendor_id").alias("id")))
    retention.collect_garbage(store, [("sales", "id", lambda df: df.where("status = 'held'")), ("vendors", "id", lambda df: df.where("id % 2 = 0"))], retention.Budget(rows=300), chunk=100)
    return store.read("sales").select(F.lit("sales").alias("name"), "id").unionByName(store.read("vendors").select(F.lit("vendors").alias("name"), "id"))


_OWNER = "EXISTS (SELECT 1 FROM clients WHERE client_id = k)"


@query(f"""WITH c AS (SELECT sale_id AS q, client_id AS k, sale_id % 6 + 1 AS r, sale_id % 1000 AS ref FROM sales WHERE client_id IS NOT NULL),
free AS (SELECT item_id % 1500 AS ref, min(item_id) AS p FROM items WHERE NOT EXISTS (SELECT 1 FROM clients WHERE client_id = item_id AND client_id % 3 = 0) GROUP BY 1 HAVING count(*) = 1),
o AS (SELECT c.*, p, k % 3 = 0 AND {_OWNER} AS owned, k % 11 = 0 AND {_OWNER} AS busy FROM c LEFT JOIN free USING (ref))
SELECT q AS id_queue, CASE WHEN busy THEN 'defer' WHEN r < 4 THEN 'supersede' WHEN owned THEN 'update' WHEN p IS NOT NULL THEN 'recover' ELSE 'create' END AS action, CASE WHEN owned THEN k ELSE p END AS id_product, r AS id_run FROM o""")
def product_jobs(t):
    """What a worker of new products does with each job: every sale is one, its client the owner, items the products without one."""
    k, n = F.col("client_id"), F.col("n_nationkey") + 1
    scope = [F.lit(1).alias("id_shop"), F.lit("s").alias("source")]
    key = k.cast("string").alias("source_key")
    claimed = t("sales").where("client_id is not null").select(F.col("sale_id").alias("id_queue"), *scope, key, (F.col("sale_id") % 6 + 1).alias("id_run"), (F.col("sale_id") % 1000).cast("string").alias("reference"))
    mapping = t("clients").where(k % 3 == 0).select(*scope, key, k.alias("id_product"))
    runs = t("nation").where(n <= 6).select(*scope, n.cast("long").alias("id_run"), (n <= 4).alias("read_completed"), (n == 2).alias("import_completed"))
    products = t("items").select(F.col("item_id").alias("id_product"), (F.col("item_id") % 1500).cast("string").alias("reference"))
    return workers.product_step(claimed, mapping, runs, products, t("clients").where(k % 11 == 0).select(*scope, key))


@query("""WITH due AS (SELECT client_id, min(ts) AS oldest FROM clicks WHERE ts < TIMESTAMP '2024-03-01' AND client_id IN (SELECT client_id FROM clients WHERE client_id % 4 <> 0) AND client_id NOT IN (SELECT client_id FROM clients WHERE client_id % 7 = 0) GROUP BY 1),
n AS (SELECT count(*) AS n_due, least(count(*), 50) AS n FROM due)
SELECT 5 AS id_run, 'scheduled' AS status, n AS n_candidates, n AS n_products, 2 * n AS n_images, n_due - n AS n_deferred FROM n""")
def revalidation_counts(t):
    """How many owners' images are looked at again, 50 at most a call, and how many wait: owners are clients, what was looked at their clicks."""
    k = F.col("client_id")
    owner = [F.lit(1).alias("id_shop"), F.lit("s").alias("source"), k.cast("string").alias("source_key"), k.alias("id_product")]
    runs = t("region").select((F.col("r_regionkey") + 1).cast("long").alias("id_run"), F.lit(True).alias("completed"), (F.col("r_regionkey") % 2 == 0).alias("reconciled"))
    state = t("clicks").where("client_id is not null").select(*owner, F.col("ts").alias("updated_at"))
    mapping = t("clients").select(*owner, (k % 4 == 0).alias("out_of_feed"))
    manifest = t("clients").select(*owner, F.array(F.lit("u"), F.lit("v")).alias("urls"))
    before = F.lit(datetime(2024, 3, 1)).cast("timestamp_ntz")
    return workers.revalidate(runs, state, mapping, t("clients").where(k % 7 == 0).select(*owner), manifest, before, 50)[1]
