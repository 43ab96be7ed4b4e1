"""A full run: read a feed, take its snapshot, compare it with the state, guard, merge, and say what the shop has to do.

The table of runs has a run's stages, the input and policy it began with, and the parts of the mapping that its scope (shop and source) had when it was
read. A run that broke off goes on by its id: ranges of the feed that it has read aren't read again, and nor is anything once reading is complete.

The mapping lies in parts by scope and bucket of the key. A run reads its own scope's buckets next to the snapshot's, without an exchange of either; what
differs is written once, and only the buckets that it falls in are written anew. The commit fails if the own scope isn't as it was read, and
takes the other scopes as they are by then, so runs of different scopes may be at work at once, break off and go on in any order. Numbers of new products
are reserved before they are used, so no two runs give out the same.

That a product was seen isn't written to each row: a scope's note says which run has completed last, and its active rows were seen by it (see mapping()).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.hashing import with_hashes
from ..operators import delta, rules, states
from ..operators.normalize import MOST_PRODUCT_BYTES, Policy, normalize
from ..operators.runs import RUNS, Run, RunError, policy_hash, resolve_language, setting
from ..schemas import HASHES, MAPPING, RAW_RECORD
from ..sources import feed
from ..sources.store import BUCKET, Store, scope_key

EXTENSIONS = ("source", "mapper", "size_resolver", "writer", "policy")
#: Ranges of a feed that one job reads: what a broken READ reads again at most.
WAVE = 2048
#: Fan-out of actions: the domains whose tables have writers of their own.
GRANULAR = (*delta.APPLIED, "combination", "image", "availability")


@dataclass
class Outcome:
    actions: DataFrame
    rejects: DataFrame
    n_new: int
    n_changed: int
    n_removed: int


def extend(name: str, function=None, _registry: dict = {}):  # noqa: B006
    """Register or look up a step of the caller's own; False takes it away.

    source: (spark, path) to raw records; mapper: raw records to (products, rejects); size_resolver: products to products, before they are
    hashed; policy: (source_key, id_product) of products out of the feed to their (id_product, action, value) rows; writer: (actions, run id), called
    when a run's actions are written.
    """
    if name not in EXTENSIONS:
        raise ValueError(f"no step {name}")
    if function is not None:
        _registry[name] = function
    return _registry.get(name) or None


def place(id_run: int, id_shop: int, source: str) -> str:
    """Where a run's own rows are: all three say whose they are."""
    return f"{id_run}/id_shop={id_shop}/source={scope_key(source)}"


def mapping(store: Store, prefix: str = "") -> DataFrame:
    """The state with what its notes say: an active row was last seen by its scope's last complete run, or later."""
    rows = store.read("mapping", prefix=prefix)
    seen = [tuple(x) for x in store.manifest("mapping")["notes"].get("seen", {}).values()]  # (shop, source, run), a row a scope
    notes = store.spark.createDataFrame(seen, "id_shop long, source string, seen_run long")
    joined = rows.join(F.broadcast(notes), ["id_shop", "source"], "left")  # a row a scope
    late = F.when(F.col("out_of_feed"), F.col("last_seen_run_id")).otherwise(F.greatest("last_seen_run_id", "seen_run"))
    return joined.withColumn("last_seen_run_id", late).select(*rows.columns)


# Settings.

#: Most bytes of a size group's name.
MOST_GROUP_BYTES = 64


def configured(policy: Policy, settings: dict, of_shop: set[int], shop_default: int | None = None, global_default: int | None = None) -> tuple[Policy, int]:
    """(the policy that settings make, how many of a hundred products a run may remove). The language is the one that is set if the shop has it, else the shop's, else the
    global one; numbers out of bounds count as not set; the size group's name has a bound."""
    group = str(settings.get("size_group", policy.size_group)).strip()
    if len(group.encode()) > MOST_GROUP_BYTES:
        raise RunError(f"the size group's name exceeds {MOST_GROUP_BYTES} bytes")
    language = resolve_language(setting(settings.get("language"), 0, 1, 2**31 - 1), of_shop, shop_default, global_default)
    return replace(policy, language_id=language, size_group=group), setting(settings.get("most_removed"), 25, 1, 100)


# Reading.


def ledger(store: Store, at: str) -> DataFrame:
    """(start, end, record, wave, done): a row for each range of the run's input, and whether it has been read."""
    rows = store.partition("ranges", "id_run", at)
    waves = [r["wave"] for r in rows.select("wave").distinct().collect()]  # one for each WAVE ranges
    done = [w for w in waves if store.has_partition("raw", "id_run", f"{at}/wave={w}")]
    return rows.withColumn("done", F.col("wave").isin(done) if done else F.lit(False))


def read_ranges(spark: SparkSession, path: str, store: Store, at: str, wave: int = WAVE) -> DataFrame:
    """Raw records of the input. What its ranges are is written first, then each wave of them by itself: a wave that is whole isn't read again."""
    if not store.has_partition("ranges", "id_run", at):
        found = [(*r, k // wave) for k, r in enumerate(feed.plan(spark, path))]
        store.append_partition("ranges", spark.createDataFrame(found, "start long, end long, record long, wave long").coalesce(1), "id_run", at)
    open_waves: dict[int, list] = {}
    for r in ledger(store, at).where("not done").orderBy("start").collect():  # a row a range
        open_waves.setdefault(r["wave"], []).append((r["start"], r["end"], r["record"]))
    for w, ranges in open_waves.items():
        store.append_partition("raw", feed.load_ranges(spark, path, ranges), "id_run", f"{at}/wave={w}")
    waves = [f"{store.folder}/raw/id_run={at}/wave={r['wave']}" for r in store.partition("ranges", "id_run", at).select("wave").distinct().collect()]
    return spark.read.schema(RAW_RECORD).parquet(*waves) if waves else spark.createDataFrame([], RAW_RECORD)


def child_error(products: DataFrame, id_shop: int) -> Column:
    """The first rule of child rows that a product breaks, of those whose columns it has; null if there is none."""
    fields = {f.name: f.dataType for f in products.schema if isinstance(f.dataType, ArrayType)}
    has = lambda name, *parts: name in fields and isinstance(fields[name].elementType, StructType) and set(parts) <= set(fields[name].elementType.names)
    counted = {n: F.col(n) for n in rules.MOST if n in fields and (n != "combinations" or has(n, "attributes"))}
    found = [rules.collection_error(counted)] if counted else []
    if has("features", "key", "value_key", "name", "value"):
        found.append(rules.feature_error(F.col("features")))
    if has("combinations", "attribute_ids"):
        found.append(rules.combination_error(F.col("combinations")))
    if "specific_prices" in fields:
        found.append(rules.specific_price_error(F.col("specific_prices"), F.lit(id_shop)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def read_stage(spark: SparkSession, path: str, policy: Policy, store: Store | None, run: Run, id_shop: int = 1, at: str = "") -> tuple[DataFrame, DataFrame]:
    """(products with hashes, rejects). The input is parsed once: raw records are written, and both come from them; without a store nothing is."""
    if extend("source"):
        raw = extend("source")(spark, path)
        if store is not None:
            store.append_partition("raw", raw, "id_run", at)
            raw = store.partition("raw", "id_run", at)
    else:
        raw = feed.load(spark, path) if store is None else read_ranges(spark, path, store, at)
    products, rejects = (extend("mapper") or (lambda df: normalize(df, policy)))(raw)
    products = (extend("size_resolver") or (lambda df: df))(products)
    size = F.octet_length(F.to_json(F.struct(*products.columns)))
    judged = products.withColumn("broken", F.when(size > MOST_PRODUCT_BYTES, F.lit("product is too large")).otherwise(child_error(products, id_shop)))
    if {"source_record", "source_key"} <= set(products.columns):
        rejects = rejects.unionByName(judged.where("broken is not null").select("source_record", F.col("source_key").alias("id"), F.col("broken").alias("reason"), F.lit(False).alias("skipped")))
    return with_hashes(judged.where("broken is null").drop("broken")), rejects


def numbered(spark: SparkSession, store: Store, keys: DataFrame, run, start: int) -> DataFrame:
    """(source_key, id_product): each key gets a number of its own from start + 1 on, without a task that sees them all: rows are numbered within their
    part of a written table, and parts go on where those before them end. run: the name of that table's partition."""
    place = F.monotonically_increasing_id()
    store.append_partition("numbered", keys.select("source_key").distinct().select("source_key", place.alias("place")), "id_run", run)
    rows = store.partition("numbered", "id_run", run).select("source_key", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("row"))
    sizes = [(r["part"], r["n"]) for r in rows.groupBy("part").agg((F.max("row") + 1).alias("n")).orderBy("part").collect()]  # a row for each part
    offsets, at = [], start
    for part, n in sizes:
        offsets.append((part, at))
        at += n
    table = spark.createDataFrame(offsets, "part long, offset long")
    return rows.join(F.broadcast(table), "part").select("source_key", (F.col("offset") + F.col("row") + 1).alias("id_product"))


# Runs.


def stored_run(store: Store, id_run: int, id_shop: int, source: str) -> dict | None:
    part = scope_key(id_shop, source)
    if not store.parts("runs", part):
        return None
    found = store.read("runs", prefix=part).where(F.col("id_run") == id_run).first()
    return found and found.asDict()


def save_run(spark: SparkSession, store: Store, run: Run, id_shop: int, source: str) -> None:
    """A row a run in the part of its scope: the part is small, and each save is a version of it. A run that was cancelled meanwhile stays so."""
    part = scope_key(id_shop, source)
    seen = store.parts("runs", part)
    row = spark.createDataFrame([run.row(id_shop, source)], RUNS)
    old = store.read("runs", prefix=part) if seen else row.limit(0)
    if old.where((F.col("id_run") == run.id_run) & (F.col("read") == "cancelled")).take(1):
        raise RunError(f"run {run.id_run} has been cancelled")
    store.write("runs", old.where(F.col("id_run") != run.id_run).unionByName(row).coalesce(1), part=part, expect=seen)


def newest_read(store: Store, id_shop: int, source: str) -> int:
    """The latest run of the scope that has completed reading; 0 if there is none."""
    part = scope_key(id_shop, source)
    if not store.parts("runs", part):
        return 0
    return store.read("runs", prefix=part).where("read = 'completed'").agg(F.max("id_run")).first()[0] or 0


def cancel(store: Store, id_run: int, id_shop: int, source: str, queues: Sequence[str] = ("image_queue", "product_queue")) -> dict[str, int]:
    """The run is cancelled, and its open jobs in both queues are freed, in one commit: all of it or nothing. A run that is complete, or cancelled, can't be.

    Returns how many jobs each queue had for it. A queue is a plain table here, or a claims.Queue's, whose log gets a last word on each job.
    """
    from ..sources.claims import Queue

    spark, part = store.spark, scope_key(id_shop, source)
    row = stored_run(store, id_run, id_shop, source)
    if row is None:
        raise RunError(f"no run {id_run}")
    run = Run(id_run).resumed(row)
    run.cancel()
    out = {}
    with store.transaction():
        seen = store.parts("runs", part)
        old = store.read("runs", prefix=part).where(F.col("id_run") != id_run)
        store.write("runs", old.unionByName(spark.createDataFrame([run.row(id_shop, source)], RUNS)).coalesce(1), part=part, expect=seen)
        for name in queues:
            if store.exists(name):
                mine = (F.col("id_run") == id_run) & (F.col("id_shop") == id_shop) & (F.col("source") == source)
                out[name] = Queue(store, name).cancel(mine)
    return out


def base_of(parts: dict[str, str]) -> str:
    """What a scope's parts are, as one word."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def run_feed(spark: SparkSession, path: str, store: Store, run: Run, policy: Policy = Policy(), id_shop: int = 1, source: str = "feed", most_removed: int = 25, dry_run: bool = False, products: DataFrame | None = None, linked: DataFrame | None = None, freeze: bool = False) -> Outcome:
    """All four stages. Raises RunError at the first gate that is closed; the state's version moves only at the end.

    products, linked: (id_product) of the shop's products and of those linked to it, where known: rows whose product is gone are created again,
    those whose link is gone are linked again. freeze: the input is copied into the store first, in parallel, and the copy alone is read; what becomes of
    the feed afterwards is of no concern to the run. A dry run writes nothing: neither rows nor a run.
    """
    at, scope = place(run.id_run, id_shop, source), scope_key(id_shop, source)
    done = run.resumed(stored_run(store, run.id_run, id_shop, source))
    run.__dict__.update(done.__dict__)
    run.check_alive()
    if freeze and not dry_run:
        path = feed.freeze_parallel(spark, path, f"{store.folder}/frozen/id_run={at}")
    language = policy_hash(policy.language_id, policy.features_auto_create, policy.size_group)
    run.resume(feed.fingerprint(path), language)
    now = F.current_timestamp()
    save = (lambda: None) if dry_run else (lambda: save_run(spark, store, run, id_shop, source))
    newest = newest_read(store, id_shop, source)
    if newest > run.id_run:
        raise RunError(f"run {newest} has completed reading")

    dry: tuple = ()
    if run.stages["read"] != "completed":
        run.start("read", newest)
        run.base = base_of(store.parts("mapping", scope))
        try:
            if not dry_run:
                save()
            made, rejects = dry = read_stage(spark, path, policy, None if dry_run else store, run, id_shop, at)
            if dry_run:
                snap = made
            else:
                store.append_partition("snapshot", made, "id_run", at, key="source_key")
                store.append_partition("rejects", rejects, "id_run", at)
                snap, rejects = store.partition("snapshot", "id_run", at), store.partition("rejects", "id_run", at)
                told = rejects.select(F.col("id").alias("source_key"), F.concat(F.when(F.col("skipped"), "SKIPPED: ").otherwise(""), "reason").alias("message"))
                if "supplier_warnings" in snap.columns:
                    told = told.unionByName(snap.select("source_key", F.explode("supplier_warnings").alias("w")).select("source_key", F.concat(F.lit("WARNING: "), "w").alias("message")))
                store.append_partition("errors", states.error_rows(told, run.id_run, "read", now).drop("id_run"), "id_run", at)
            counts = snap.agg(F.count("*"), F.count_distinct("source_key")).first()
            bad = rejects.where("not skipped").count()
            before = store.read("runs", prefix=scope).where((F.col("id_run") < run.id_run) & (F.col("read") == "completed")).orderBy(F.desc("id_run")).select("n_valid").first() if store.parts("runs", scope) else None
            gate = spark.range(1).select(delta.read_gate(*(F.lit(n) for n in (counts[0], bad, counts[0] - counts[1], before[0] if before else 0)))).first()[0]
            if gate != "ok":
                raise RunError(f"read: {gate}")
            run.resume(feed.fingerprint(path), language)  # the input is still the one that was read
        except Exception as e:
            run.fail("read", str(e))
            save()
            raise
        run.n_valid = counts[0]
        run.move("read", "completed")
        save()
    if dry_run and dry:
        snap, rejects = dry
    else:
        snap, rejects = store.partition("snapshot", "id_run", at, key="source_key"), store.partition("rejects", "id_run", at)

    parts = store.parts("mapping", scope)
    notes = store.manifest("mapping")["notes"]
    if notes.get("merged", {}).get(scope) == run.id_run:  # the break came after the commit
        return finish(store, run, save, at, rejects)
    if base_of(parts) != run.base:
        raise RunError("the scope has changed since the run was read")
    mine = store.read_bucketed("mapping", scope, MAPPING)
    skipped = rejects.where("skipped").select(F.col("id").alias("source_key")).distinct()
    found = delta.difference(snap, mine, skipped, run.id_run, products, linked).withColumn(BUCKET, store.bucket_of("source_key"))
    if not dry_run:
        store.append_partition("difference", found, "id_run", at)
        found = store.partition("difference", "id_run", at)
    n_mapped = mine.where("not out_of_feed").count()
    kinds = dict(found.groupBy("kind").count().collect())  # three rows at most
    n_new, n_changed, n_removed = (kinds.get(k, 0) for k in ("new", "changed", "gone"))
    actions = found.select("source_key", "action", "domains", "image_changed")
    if dry_run:
        return Outcome(actions, rejects, n_new, n_changed, n_removed)
    if n_mapped and n_removed * 100 > n_mapped * max(1, min(100, most_removed)):
        run.fail("remove", "too many products would be removed")
        save()
        raise RunError(f"remove: {n_removed} of {n_mapped} products would be removed")

    try:
        # Keys that are new, and those whose product is gone, get products that no key has had.
        fresh = found.where("action in ('create', 'recreate')").select("source_key")
        n_fresh = fresh.count()
        highest = 0 if store.exists("product_ids") or not store.exists("mapping") else store.read("mapping").agg(F.max("id_product")).first()[0] or 0
        start = store.reserve("product_ids", n_fresh, highest) - 1 if n_fresh else 0
        ids = numbered(spark, store, fresh, at, start).select("source_key", F.col("id_product").alias("made_id"))
        if n_fresh and taken(store, id_shop, source, ids, found.where("action = 'recreate'").select("source_key")):
            raise RunError("a key and a product have other owners")
        for stage in ("import", "update", "remove"):
            run.start(stage, newest) if run.stages[stage] != "completed" else None
            run.move(stage, "completed") if run.stages[stage] != "completed" else None
        store.append_partition("actions", actions, "id_run", at)
        gone = found.where("kind = 'gone'").select("source_key", "id_product")
        store.append_partition("shop_actions", (extend("policy") or delta.out_of_feed_actions)(gone), "id_run", at)
        touched = found.select(BUCKET).union(skipped.select(store.bucket_of("source_key"))).distinct()
        buckets = sorted(r[0] for r in touched.collect())  # at most the number of buckets
        old = delta.touch_seen(mine.where(F.col(BUCKET).isin(buckets)).drop(BUCKET, "id_shop", "source"), skipped, run.id_run)
        hashes = [f"{h}_hash" for h in HASHES]
        applied = found.where("kind <> 'gone'").join(ids, "source_key", "left").select("source_key", F.coalesce("made_id", "id_product").alias("id_product")).join(snap.select("source_key", *hashes), "source_key")
        merged = delta.mark_removed(delta.merge_mapping(old, applied, run.id_run), gone, run.id_run)
        merged = merged.select(F.lit(id_shop).cast("long").alias("id_shop"), F.lit(source).alias("source"), *merged.columns)
        seen, last = notes.get("seen", {}), notes.get("merged", {})
        store.write("mapping", merged.select(*mine.drop(BUCKET).columns), part=scope, replaces=scope, expect=parts, notes={"seen": seen | {scope: [id_shop, source, run.id_run]}, "merged": last | {scope: run.id_run}}, buckets=buckets)
    except Exception as e:
        run.errors.append(str(e)[:8000])
        run.stages = {"read": "completed"} | dict.fromkeys(("import", "update", "remove"), "pending")
        save()
        raise
    return finish(store, run, save, at, rejects)


def taken(store: Store, id_shop: int, source: str, ids: DataFrame, again: DataFrame) -> bool:
    """Somebody in the shop has one of the numbers given out. Only rows with numbers between the least and the largest of them are read."""
    if not store.parts("mapping", scope_key(id_shop)):
        return False
    least, most = ids.agg(F.min("made_id"), F.max("made_id")).first()
    owners = store.read("mapping", prefix=scope_key(id_shop)).where(F.col("id_product").between(least, most))
    owners = owners.join(again.withColumn("source", F.lit(source)), ["source", "source_key"], "left_anti")
    rows = ids.select(F.lit(source).alias("source"), "source_key", F.col("made_id").alias("id_product"))
    return bool(delta.merge_conflicts(owners, rows, ("source", "source_key")).take(1))


def finish(store: Store, run: Run, save, at: str, rejects: DataFrame) -> Outcome:
    """What a merged run has written; its row says so."""
    run.stages = dict.fromkeys(run.stages, "completed")
    save()
    written = store.partition("actions", "id_run", at)
    kinds = dict(store.partition("difference", "id_run", at).groupBy("kind").count().collect())
    if extend("writer"):
        extend("writer")(written, run.id_run)
    return Outcome(written, rejects, *(kinds.get(k, 0) for k in ("new", "changed", "gone")))


# Writers of domains.


def by_domain(actions: DataFrame) -> DataFrame:
    """(source_key, action, domain): an action for each domain that it is about. A product that is made has all of them, one that goes its availability."""
    domains = F.when(F.col("action") == "create", F.array(*(F.lit(d) for d in GRANULAR if d not in ("image", "availability")))).when(F.col("action") == "disable", F.array(F.lit("availability"))).otherwise(F.col("domains"))
    image = F.filter(F.array(F.lit("image")), lambda _: F.col("image_changed"))
    return actions.select("source_key", "action", F.explode(F.concat(domains, image)).alias("domain"))


def write_domains(store: Store, run: Run, id_shop: int, source: str, writers: dict) -> dict[str, str]:
    """Each domain's actions go to a table of its own and then to its writer, (rows, run id). A writer that fails keeps no other from its work; called again,
    only domains that aren't done are written. Returns what became of each: done, failed, or waiting where it has no writer."""
    at = place(run.id_run, id_shop, source)
    if not store.has_partition("domain_actions", "id_run", at):
        rows = by_domain(store.partition("actions", "id_run", at))
        rows.write.mode("overwrite").partitionBy("domain").parquet(f"{store.folder}/domain_actions/id_run={at}")
    part = f"{scope_key(id_shop, source)}/{run.id_run}"
    state = dict(store.read("domain_states", prefix=part).select("domain", "state").collect()) if store.parts("domain_states", part) else {}
    told = store.partition("domain_actions", "id_run", at)
    for domain in GRANULAR:
        if state.get(domain) == "done":
            continue
        if domain not in writers:
            state[domain] = "waiting"
            continue
        try:
            writers[domain](told.where(F.col("domain") == domain).select("source_key", "action"), run.id_run)
            state[domain] = "done"
        except Exception as e:  # noqa: BLE001 - whatever a caller's writer raises is its own
            state[domain] = f"failed: {e}"[:8000]
    rows = [(id_shop, source, run.id_run, d, s) for d, s in state.items()]
    store.write("domain_states", store.spark.createDataFrame(rows, "id_shop long, source string, id_run long, domain string, state string").coalesce(1), part=part)
    return state
