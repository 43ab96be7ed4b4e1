"""Rules of single records, and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import hierarchy
from ..operators.normalize import ordered_with_default, warning_set
from .registry import query

_SLUG = "trim(regexp_replace(lower(trim({c})), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')"


def _sql_slug(c: str) -> str:
    s = _SLUG.format(c=c)
    d = f"substr(sha256(trim({c})), 1, 32)"
    return f"CASE WHEN {s} = '' THEN 'hash-' || {d} WHEN length({s}) > 160 THEN substr({s}, 1, 120) || '-' || {d} ELSE {s} END"


@query(f"SELECT p_partkey, {_sql_slug('p_type')} AS slug, {_sql_slug(chr(39) + '***' + chr(39) + ' || repeat(p_name, p_size)')} AS long_slug FROM part")
def slug_identity(t):
    return t("part").select("p_partkey", text.slug(F.col("p_type")).alias("slug"), text.slug(F.concat(F.lit("***"), F.expr("repeat(p_name, p_size)"))).alias("long_slug"))


_PATH = "p_type || ' // ' || p_brand || '/ /' || p_name || '/'"


@query(f"SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array({_PATH}, '/+'), lambda x: trim(x)), lambda x: x <> ''), ' > ') AS path, true AS sound FROM part")
def path_normalize(t):
    raw = F.concat("p_type", F.lit(" // "), "p_brand", F.lit("/ /"), "p_name", F.lit("/"))
    return t("part").select("p_partkey", text.path(raw).alias("path"), text.path_is_sound(raw).alias("sound"))


@query("SELECT p_partkey, 'size:' || lower(regexp_replace(trim('  ' || p_type || '   ' || p_size), '\\s+', ' ', 'g')) AS size_key FROM part")
def size_descriptor(t):
    return t("part").select("p_partkey", text.size_descriptor(F.concat(F.lit("  "), "p_type", F.lit("   "), F.col("p_size").cast("string"))).alias("size_key"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' & ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS segment FROM part")
def segment_normalize(t):
    return t("part").select("p_partkey", text.segment(F.concat(F.lit(" @@ "), "p_brand", F.lit(" & "), "p_type")).alias("segment"))


_BARE = "trim(coalesce({0}, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(13))"
_BOUNDED = f"{_BARE} <> '' AND length({_BARE}) <= 128 AND NOT regexp_matches({_BARE}, '[<>{{{{}}}}]')"


@query(f"SELECT page_id, {_BOUNDED.format('html')} AS html_ok, {_BOUNDED.format('url')} AS url_ok, NOT regexp_matches(url, '[<>{{}}]') AS url_text_ok FROM pages")
def whole_text_bounds(t):
    """Whole pages and addresses as names; texts just below and above the limit are among the unit tests."""
    return t("pages").select("page_id", text.bounded(F.col("html"), text.MAX_NAME).alias("html_ok"), text.bounded(F.col("url"), text.MAX_NAME).alias("url_ok"), text.catalog_text(F.col("url")).alias("url_text_ok"))


_STOCK = "CASE event_id % 7 WHEN 0 THEN '00' || user_id WHEN 1 THEN '-' || user_id WHEN 2 THEN '+0' || user_id WHEN 3 THEN user_id || '.0' WHEN 4 THEN '99999' || (100000 + user_id) WHEN 5 THEN ' ' || user_id || ' ' ELSE user_id || 'x' END"


@query(f"SELECT event_id, CASE WHEN regexp_full_match(trim(s), '[+-]?[0-9]+') AND try_cast(trim(s) AS HUGEINT) IS NOT NULL AND abs(CAST(trim(s) AS HUGEINT)) <= 2147483647 THEN CAST(greatest(CAST(trim(s) AS HUGEINT), 0) AS INTEGER) END AS stock, regexp_full_match(trim(s), '-0*[1-9][0-9]*') AS negative FROM (SELECT event_id, {_STOCK} AS s FROM events)".replace("AND abs(CAST(trim(s) AS HUGEINT))", "AND abs(try_cast(trim(s) AS HUGEINT))").replace("greatest(CAST(trim(s) AS HUGEINT), 0)", "greatest(try_cast(trim(s) AS HUGEINT), 0)"))
def stock_parse(t):
    u, n = F.col("user_id").cast("string"), F.col("event_id") % 7
    s = F.when(n == 0, F.concat(F.lit("00"), u)).when(n == 1, F.concat(F.lit("-"), u)).when(n == 2, F.concat(F.lit("+0"), u)).when(n == 3, F.concat(u, F.lit(".0"))).when(n == 4, F.concat(F.lit("99999"), (F.col("user_id") + 100000).cast("string"))).when(n == 5, F.concat(F.lit(" "), u, F.lit(" "))).otherwise(F.concat(u, F.lit("x")))
    return t("events").select("event_id", text.stock(s).alias("stock"), text.stock_was_negative(s).alias("negative"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS price FROM part")
def price_parse(t):
    """Cents as text are prices; a unit after them, and eleven digits, aren't."""
    cents = F.format_string("%.2f", "p_retailprice")
    n = F.col("p_partkey") % 3
    return t("part").select("p_partkey", text.price(F.when(n == 0, cents).when(n == 1, F.concat(cents, F.lit("d"))).otherwise(F.concat(F.lit("10000000"), cents))).alias("price"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN lpad(CAST(event_id AS VARCHAR), 13, '4') ELSE '' END AS ean FROM events")
def ean_check(t):
    e = F.col("event_id").cast("string")
    return t("events").select("event_id", text.ean(F.when(F.col("event_id") % 2 == 0, F.lpad(e, 13, "4")).otherwise(F.concat(e, F.lit("-")))).alias("ean"))


@query("SELECT page_id, page_id % 4 IN (0, 3) AS sound FROM pages")
def url_filter(t):
    n, u = F.col("page_id") % 4, F.col("url")
    made = F.when(n == 1, F.regexp_replace(u, "://", "://user:pw@")).when(n == 2, F.regexp_replace(u, "^https?", "ftp")).when(n == 3, F.concat(F.lit("  "), u)).otherwise(u)
    return t("pages").select("page_id", text.url_is_sound(made).alias("sound"))


@query("SELECT page_id, page_id % 3 <> 1 AS sound FROM pages")
def location_check(t):
    n, u = F.col("page_id") % 3, F.col("url")
    made = F.when(n == 1, F.regexp_replace(u, "://", "://user@")).when(n == 2, F.concat(F.lit("/feeds/"), F.col("page_id").cast("string"))).otherwise(u)
    return t("pages").select("page_id", text.location_is_sound(made).alias("sound"))


@query("SELECT event_id, array_to_string(list_sort(list_distinct([event_type, 'w' || (user_id % 3), event_type])), ';') AS warnings FROM events")
def warnings_set(t):
    a = F.array("event_type", F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")), "event_type")
    return t("events").select("event_id", F.array_join(warning_set(a), ";").alias("warnings"))


@query("SELECT event_id, 'failed at https://***:***@host/x password=*** after ' || event_type AS message FROM events")
def redact_text(t):
    m = F.concat(F.lit("failed  at https://me:pw"), F.col("user_id").cast("string"), F.lit("@host/x password: s3cret"), F.col("event_id").cast("string"), F.lit("\n after "), F.col("event_type"))
    return t("events").select("event_id", text.redact(m).alias("message"))


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END, ''), CAST(p_partkey AS VARCHAR)) AS name, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END, ''), nullif(CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END, ''), CAST(p_partkey AS VARCHAR)) AS path FROM part")
def category_triple(t):
    from ..operators.normalize import category_triple as triple

    k = F.col("p_partkey")
    c = triple(k.cast("string"), F.when(k % 2 == 0, F.col("p_type")).otherwise(" "), F.when(k % 3 == 0, F.col("p_brand")).otherwise(""))
    return t("part").select("p_partkey", c["name"].alias("name"), c["path"].alias("path"))


@query()
def html_sanitize(t):
    return t("pages").select("page_id", text.sanitise_html()(F.col("html")).alias("html"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT 'R' || l_partkey)), ',') AS refs, min('R' || l_partkey) AS default_ref FROM lineitem GROUP BY l_orderkey")
def option_order_default(t):
    """Options in byte order of their reference; the first is the default."""
    refs = F.collect_set(F.struct(F.concat(F.lit("R"), F.col("l_partkey").cast("string")).alias("reference")))
    options = t("lineitem").groupBy("l_orderkey").agg(ordered_with_default(refs).alias("o"))
    return options.select("l_orderkey", F.array_join(F.transform("o", lambda o: o["reference"]), ",").alias("refs"), F.filter("o", lambda o: o["default"])[0]["reference"].alias("default_ref"))


# Categories: lang stands for the key, source for name and path; region and nation are a tree.

TREE = """tree AS (SELECT 1 AS id_category, 1 AS nleft, 1000 AS nright, 'home' AS name UNION ALL SELECT 100 + r_regionkey, 2 + r_regionkey * 100, 101 + r_regionkey * 100, r_name FROM region
UNION ALL SELECT 1000 + n_nationkey, 3 + n_regionkey * 100 + n_nationkey * 2, 4 + n_regionkey * 100 + n_nationkey * 2, n_name FROM nation)"""


def tree(t):
    root = t("region").limit(1).select(F.lit(1).alias("id_category"), F.lit(1).alias("nleft"), F.lit(1000).alias("nright"), F.lit("home").alias("name"))
    r, n = F.col("r_regionkey"), F.col("n_regionkey") * 100 + F.col("n_nationkey") * 2
    regions = t("region").select((r + 100).alias("id_category"), (r * 100 + 2).alias("nleft"), (r * 100 + 101).alias("nright"), F.col("r_name").alias("name"))
    nations = t("nation").select((F.col("n_nationkey") + 1000).alias("id_category"), (n + 3).alias("nleft"), (n + 4).alias("nright"), F.col("n_name").alias("name"))
    return root.union(regions).union(nations)


_ANC = "anc AS (SELECT l.id_category AS leaf_id, p.id_category, p.nleft, p.name FROM tree l JOIN tree p ON l.nleft BETWEEN p.nleft AND p.nright WHERE l.id_category >= 1000)"


def _leaves(t):
    return tree(t).where("id_category >= 1000").select(F.col("id_category").alias("leaf_id"))


@query(f"WITH {TREE}, {_ANC} SELECT leaf_id, id_category FROM anc")
def ancestors(t):
    return hierarchy.ancestors(_leaves(t), tree(t))


@query(f"WITH {TREE}, {_ANC} SELECT leaf_id, id_category FROM anc")
def ancestors_by_cells(t):
    """The same with leaves that come twice and one that the tree doesn't have: neither changes a row of the others."""
    leaves = _leaves(t).union(_leaves(t)).union(t("region").limit(1).select(F.lit(-1).alias("leaf_id")))
    return hierarchy.ancestors(leaves, tree(t)).distinct()


@query(f"WITH {TREE}, {_ANC} SELECT leaf_id, array_to_string(list_sort(list(DISTINCT id_category)), ',') AS ids FROM anc WHERE id_category <> 1 GROUP BY leaf_id")
def category_membership(t):
    m = hierarchy.membership(_leaves(t), tree(t), 1)
    return m.select("leaf_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"WITH {TREE}, {_ANC} SELECT leaf_id, string_agg(name, ' > ' ORDER BY nleft) AS path FROM anc GROUP BY leaf_id")
def path_assembly(t):
    rows = hierarchy.ancestors(_leaves(t), tree(t)).join(tree(t), "id_category")
    return hierarchy.assembled_paths(rows)


@query("""WITH c AS (SELECT lang AS key, source AS name, source || '/' || (n_chars % 3) AS path, count(*) AS n FROM documents GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, path, name) AS rn, count(*) OVER (PARTITION BY key) AS n_variants FROM c)
SELECT key, name, path, n, n_variants FROM b WHERE rn = 1""")
def canonical_variant(t):
    rows = t("documents").select(F.col("lang").alias("key"), F.col("source").alias("name"), F.concat("source", F.lit("/"), (F.col("n_chars") % 3).cast("string")).alias("path"))
    return hierarchy.canonical_variants(rows)


@query("SELECT lower(r_name) || ' > x ' || (n_nationkey % 3) AS path_key, CASE WHEN count(DISTINCT n_nationkey) = 1 THEN min(n_nationkey) ELSE -1 END AS id_category FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def path_ambiguity(t):
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = j.select(F.col("n_nationkey").alias("id_category"), F.concat(F.lit("@"), "r_name", F.lit("  >  X--"), (F.col("n_nationkey") % 3).cast("string")).alias("path"))
    return hierarchy.path_index(rows)


_CATS = "cats AS (SELECT n_nationkey AS id_category, lower(r_name) || ' > ' || (CASE WHEN n_nationkey % 5 = 0 THEN 'shared' ELSE lower(n_name) END) AS path_key FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _categories(t):
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.when(F.col("n_nationkey") % 5 == 0, "Shared").otherwise(F.col("n_name"))
    return j.select(F.col("n_nationkey").cast("int").alias("id_category"), F.concat("r_name", F.lit(" > "), name).alias("path"))


@query(f"""WITH {_CATS}, idx AS (SELECT path_key, CASE WHEN count(DISTINCT id_category) = 1 THEN min(id_category) ELSE -1 END AS found FROM cats GROUP BY 1),
r AS (SELECT n_nationkey AS key, lower(r_name) || ' > ' || (CASE WHEN n_nationkey % 5 = 0 THEN 'shared' WHEN n_nationkey % 7 = 1 THEN 'nowhere' ELSE lower(n_name) END) AS path_key, n_nationkey % 4 <> 3 AS active, CASE WHEN n_nationkey % 6 = 2 THEN 3 WHEN n_nationkey % 6 = 4 THEN 999 END AS id_category FROM nation JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT r.key, CASE WHEN NOT active THEN 'skipped' WHEN r.id_category IN (SELECT id_category FROM cats) THEN 'kept' WHEN found = -1 THEN 'ambiguous' WHEN found IS NOT NULL THEN 'mapped' ELSE 'missing' END AS outcome, found, r.id_category FROM r LEFT JOIN idx USING (path_key))
SELECT key, outcome, CASE outcome WHEN 'mapped' THEN found WHEN 'kept' THEN id_category END AS id_category FROM o""")
def category_auto_map(t):
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = F.col("n_nationkey")
    name = F.when(n % 5 == 0, "SHARED").when(n % 7 == 1, "nowhere").otherwise(F.col("n_name"))
    rows = j.select(n.alias("key"), F.concat("r_name", F.lit(" > "), name).alias("path"), (n % 4 != 3).alias("active"), F.when(n % 6 == 2, 3).when(n % 6 == 4, 999).alias("id_category"))
    return hierarchy.auto_map(rows, _categories(t)).select("key", "outcome", "id_category")


@query("SELECT 2 AS depth, lower(r_name) || ' > ' || replace(lower(n_name), '_', ' ') AS path_key FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 UNION ALL SELECT 1, lower(r_name) FROM region WHERE r_regionkey > 2")
def path_creation_plan(t):
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat("r_name", F.lit(" > "), "n_name")
    known = j.where("n_nationkey % 2 <> 0").select(path.alias("path")).union(t("region").where("r_regionkey <= 2").select(F.col("r_name")))
    return hierarchy.missing_prefixes(j.select(path.alias("path")), known)
