"""Differences between a run's snapshot and the state, and what becomes of the state."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import DOMAINS

KEYS = ("source_key",)
#: Domains that an update applies: seven by their own hash, and combinations by structure or stock. Images go another way.
APPLIED = ("core", "price", "stock", "attribute", "feature", "category", "specific_price")


def new_rows(snapshot: DataFrame, mapping: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return snapshot.join(mapping, list(keys), "left_anti")


def removed_rows(mapping: DataFrame, snapshot: DataFrame, run: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """In the state and active, not in the snapshot, and not seen by this run in another way."""
    live = mapping.where(~F.col("out_of_feed") & (F.coalesce("last_seen_run_id", F.lit(0)) != run))
    return live.join(snapshot, list(keys), "left_anti")


def differs(name: str, new: str = "s", old: str = "m") -> Column:
    return ~F.col(f"{new}.{name}_hash").eqNullSafe(F.col(f"{old}.{name}_hash"))


def changed_domains(domains: Sequence[str], new: str = "s", old: str = "m") -> Column:
    """Array of the domains to apply: all of them for a row that comes back, none where only the payload differs."""
    parts = [d for d in APPLIED if d in domains]
    kinds = [(d, differs(d, new, old)) for d in parts]
    combined = [d for d in ("combination", "combination_stock") if d in domains]
    if combined:
        kinds.append(("combination", reduce(lambda a, b: a | b, (differs(d, new, old) for d in combined))))
    every = F.array(*(F.lit(d) for d, _ in kinds))
    some = F.filter(F.array(*(F.when(c, F.lit(d)) for d, c in kinds)), lambda d: d.isNotNull())
    return F.when(F.col(f"{old}.out_of_feed"), every).otherwise(some)


def changed_rows(snapshot: DataFrame, mapping: DataFrame, products: DataFrame | None = None, linked: DataFrame | None = None, domains: Sequence[str] = DOMAINS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows in both whose hashes differ, or that come back, or whose product (or its link to the shop) is gone.

    Returns keys, id_product, action (recreate, relink, update), domains and image_changed. Only keys and hashes take part.
    """
    s, m = snapshot.alias("s"), mapping.alias("m")
    both = s.join(m, [F.col(f"s.{k}") == F.col(f"m.{k}") for k in keys])
    here = lambda df, name: df.select(F.col("id_product").alias(f"{name}_id")).distinct().withColumn(name, F.lit(True))
    for df, name in ((products, "exists"), (linked, "in_shop")):
        if df is None:
            both = both.withColumn(name, F.lit(True))
        else:
            both = both.join(here(df, name), F.col("m.id_product") == F.col(f"{name}_id"), "left").withColumn(name, F.coalesce(name, F.lit(False)))
    hashes = [*(d for d in domains), *(["payload"] if "payload_hash" in snapshot.columns and "payload_hash" in mapping.columns else [])]
    touched = reduce(lambda a, b: a | b, (differs(d) for d in hashes))
    moved = ~F.col("exists") | ~F.col("in_shop")
    found = both.where(F.col("m.out_of_feed") | moved | touched)
    action = F.when(~F.col("exists"), "recreate").when(~F.col("in_shop"), "relink").otherwise("update")
    every = F.array(*(F.lit(d) for d in APPLIED if d in domains), *([F.lit("combination")] if "combination" in domains else []))
    image = (differs("image") if "image" in domains else F.lit(False)) | moved
    return found.select(*(F.col(f"s.{k}") for k in keys), "m.id_product", action.alias("action"), F.when(moved, every).otherwise(changed_domains(domains)).alias("domains"), image.alias("image_changed"))


def difference(snapshot: DataFrame, mapping: DataFrame, skipped: DataFrame, run: int, products: DataFrame | None = None, linked: DataFrame | None = None, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """Every key that isn't the same in both: (source_key, kind, action, domains, image_changed, id_product), kind new, changed or gone, in one full outer
    join of keys and hashes. Sides that lie in buckets by the key aren't exchanged.

    skipped: keys that the feed has in a form that can't be read, which keeps them from being gone. products, linked: as of changed_rows().
    """
    hashes = [*domains, *(["payload"] if "payload_hash" in snapshot.columns and "payload_hash" in mapping.columns else [])]
    columns = [f"{h}_hash" for h in hashes]
    s = snapshot.select("source_key", *columns).alias("s")
    held = mapping.join(skipped.select("source_key", F.lit(True).alias("skipped")), "source_key", "left").select("source_key", "id_product", "out_of_feed", "last_seen_run_id", "skipped", *columns)
    both = s.join(held.alias("m"), F.col("s.source_key") == F.col("m.source_key"), "full_outer")
    here = lambda df, name: df.select(F.col("id_product").alias(f"{name}_id")).distinct().withColumn(name, F.lit(True))
    for df, name in ((products, "exists"), (linked, "in_shop")):
        both = both.withColumn(name, F.lit(True)) if df is None else both.join(here(df, name), F.col("m.id_product") == F.col(f"{name}_id"), "left").withColumn(name, F.coalesce(name, F.lit(False)))
    old, new = F.col("m.source_key").isNotNull(), F.col("s.source_key").isNotNull()
    moved = ~F.col("exists") | ~F.col("in_shop")
    touched = reduce(lambda a, b: a | b, (differs(h) for h in hashes))
    lost = ~F.col("m.out_of_feed") & (F.coalesce("m.last_seen_run_id", F.lit(0)) != run) & F.col("skipped").isNull()
    kind = F.when(new & ~old, "new").when(new & (F.col("m.out_of_feed") | moved | touched), "changed").when(~new & lost, "gone")
    action = F.when(~old, "create").when(~new, "disable").when(~F.col("exists"), "recreate").when(~F.col("in_shop"), "relink").otherwise("update")
    none = F.array().cast("array<string>")
    every = F.array(*(F.lit(d) for d in APPLIED if d in domains), *([F.lit("combination")] if "combination" in domains else []))
    told = F.when(~(old & new), none).when(moved, every).otherwise(changed_domains(domains))
    image = F.when(~old, True).when(~new, False).otherwise((differs("image") if "image" in domains else F.lit(False)) | moved)
    return both.withColumn("kind", kind).where("kind is not null").select(F.coalesce("s.source_key", "m.source_key").alias("source_key"), "kind", action.alias("action"), told.alias("domains"), image.alias("image_changed"), "m.id_product")


def unchanged_rows(snapshot: DataFrame, mapping: DataFrame, changed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return snapshot.join(mapping, list(keys), "left_semi").join(changed, list(keys), "left_anti")


# The state.


def merge_mapping(mapping: DataFrame, delta: DataFrame, run: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """A new version of the state: rows of delta (keys, id_product, hashes) update their owner or are inserted; all others stay."""
    hashes = [c for c in mapping.columns if c.endswith("_hash")]
    m, d = mapping.alias("m"), delta.alias("d")
    both = m.join(d, [F.col(f"m.{k}") == F.col(f"d.{k}") for k in keys], "full_outer")
    hit = F.col(f"d.{keys[0]}").isNotNull()
    pick = lambda c: F.when(hit, F.col(f"d.{c}")).otherwise(F.col(f"m.{c}")).alias(c)
    return both.select(*(F.coalesce(f"m.{k}", f"d.{k}").alias(k) for k in keys), pick("id_product"), *(pick(h) for h in hashes), F.when(hit, False).otherwise(F.col("m.out_of_feed")).alias("out_of_feed"), F.when(hit, run).otherwise(F.col("m.last_seen_run_id")).cast("long").alias("last_seen_run_id"))


def merge_conflicts(mapping: DataFrame, delta: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of delta that may not be merged: their key has another product, or their product another key."""
    m = mapping.select(*(F.col(k).alias(f"m_{k}") for k in keys), F.col("id_product").alias("m_id"))
    same_key = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"m_{k}") for k in keys))
    moved = delta.join(m, same_key).where("id_product <> m_id").withColumn("reason", F.lit("key has another product"))
    taken = delta.join(m, F.col("id_product") == F.col("m_id")).where(~same_key).withColumn("reason", F.lit("product has another key"))
    return moved.select(*keys, "id_product", "reason").union(taken.select(*keys, "id_product", "reason"))


def conflicts(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has; each uniqueness rule is that this is empty."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def touch_seen(mapping: DataFrame, seen: DataFrame, run: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """last_seen rises to the run, never falls, for keys in seen; nothing else changes."""
    marked = mapping.join(seen.select(*keys).distinct().withColumn("hit", F.lit(True)), list(keys), "left")
    rises = F.col("hit") & (F.coalesce("last_seen_run_id", F.lit(0)) <= run)
    return marked.withColumn("last_seen_run_id", F.when(rises, run).otherwise(F.col("last_seen_run_id")).cast("long")).drop("hit")


def mark_removed(mapping: DataFrame, gone: DataFrame, run: int, keys: Sequence[str] = KEYS) -> DataFrame:
    marked = mapping.join(gone.select(*keys).distinct().withColumn("hit", F.lit(True)), list(keys), "left")
    return marked.withColumn("out_of_feed", F.coalesce("hit", F.lit(False)) | F.col("out_of_feed")).withColumn("last_seen_run_id", F.when(F.col("hit"), run).otherwise(F.col("last_seen_run_id")).cast("long")).drop("hit")


def out_of_feed_actions(gone: DataFrame) -> DataFrame:
    """What the shop has to do: the product goes inactive, its stock and that of its variants to 0."""
    actions = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(v).alias("value")) for a, v in (("active", 0), ("stock", 0), ("variant_stock", 0))))
    return gone.withColumn("a", F.explode(actions)).select("id_product", "a.action", "a.value")


def monotonic_upsert(state: DataFrame, rows: DataFrame, keys: Sequence[str], version: str = "id_run") -> DataFrame:
    """Rows replace the state's of equal key unless these are of a later version."""
    values = [c for c in state.columns if c not in keys]
    s, r = state.alias("s"), rows.alias("r")
    both = s.join(r, [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "full_outer")
    new = F.col(f"r.{version}").isNotNull() & (F.col(f"s.{version}").isNull() | (F.col(f"s.{version}") <= F.col(f"r.{version}")))
    return both.select(*(F.coalesce(f"s.{k}", f"r.{k}").alias(k) for k in keys), *(F.when(new, F.col(f"r.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in values))


def upsert_keeping(state: DataFrame, rows: DataFrame, keys: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Rows refresh the state's other columns; the kept ones stay as the state has them."""
    values = [c for c in state.columns if c not in keys]
    s, r = state.alias("s"), rows.alias("r")
    both = s.join(r, [F.col(f"s.{k}") == F.col(f"r.{k}") for k in keys], "full_outer")
    hit = reduce(lambda a, b: a & b, (F.col(f"r.{k}").isNotNull() for k in keys))
    old = reduce(lambda a, b: a & b, (F.col(f"s.{k}").isNotNull() for k in keys))
    pick = lambda c: F.when(hit & ~(old & F.lit(c in kept)), F.col(f"r.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    return both.select(*(F.coalesce(f"s.{k}", f"r.{k}").alias(k) for k in keys), *(pick(c) for c in values))


def label_collisions(state: DataFrame, rows: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Keys that both know by labels that differ in more than case and outer spaces."""
    s, r = state.alias("s"), rows.alias("r")
    plain = lambda c: F.lower(F.trim(F.col(c)))
    return r.join(s, [F.col(f"s.{k}") == F.col(f"r.{k}") for k in keys]).where(plain(f"s.{label}") != plain(f"r.{label}")).select(*(F.col(f"r.{k}") for k in keys), F.col(f"s.{label}").alias("known"), F.col(f"r.{label}").alias("given"))


# Gates.


def duplicate_summary(rows: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, and what an upsert would hide."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def read_gate(n_valid: Column, n_invalid: Column, n_duplicates: Column, n_before: Column) -> Column:
    """The first reason to refuse a read, in order; 'ok' if there is none."""
    floor = F.floor(0.8 * n_before)
    return F.when(n_invalid > 0, "invalid rows").when(n_duplicates > 0, "duplicate keys").when(n_valid == 0, "no valid row").when((n_before >= 1000) & (n_valid < floor), "volume drop").otherwise("ok")


def remove_gate(n_candidates: Column, n_mapped: Column, most_percent: int = 25) -> Column:
    most = max(1, min(100, most_percent))
    return F.when(n_candidates * 100 > n_mapped * most, "blocked").otherwise("ok")


def blocked_runs(runs: DataFrame) -> DataFrame:
    """Runs behind a newer run of their scope that has completed reading."""
    read = runs.where("read_completed").groupBy("id_shop", "source").agg(F.max("id_run").alias("newest"))
    return runs.join(read, ["id_shop", "source"]).where("id_run < newest").select("id_run", "newest")


def newest_per(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(by))
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
