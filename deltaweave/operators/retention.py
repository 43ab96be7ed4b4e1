"""What may be deleted, and what state the whole is in."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constraints import Check, Holds, Reference, Unique, examine


def old_done_jobs(jobs: DataFrame, before: Column, orphans: DataFrame | None = None, orphan_keys: Sequence[str] = (), mapped: DataFrame | None = None, mapped_keys: Sequence[str] = ()) -> DataFrame:
    """Done jobs last changed before a time; without an orphan marker, and with a mapping, where these are given."""
    rows = jobs.where((F.col("status") == "done") & (F.col("updated_at") < before))
    if orphans is not None:
        rows = rows.join(orphans, list(orphan_keys), "left_anti")
    return rows if mapped is None else rows.join(mapped, list(mapped_keys), "left_semi")


def old_snapshots(runs: DataFrame, keep_from: int) -> DataFrame:
    """Runs before keep_from that a newer fully reconciled run of their scope follows."""
    newest = runs.where("reconciled").groupBy("id_shop", "source").agg(F.max("id_run").alias("newest"))
    return runs.join(newest, ["id_shop", "source"]).where((F.col("id_run") < keep_from) & (F.col("newest") > F.col("id_run"))).select("id_shop", "source", "id_run")


def broken(rows: DataFrame, *sides: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Rows of which any referred side is missing."""
    flags = []
    for k, (side, keys) in enumerate(sides):
        flag = f"_has{k}"
        rows = rows.join(side.select(*keys).distinct().withColumn(flag, F.lit(True)), list(keys), "left")
        flags.append(F.col(flag).isNull())
    return rows.where(reduce(lambda a, b: a | b, flags)).drop(*(f"_has{k}" for k in range(len(sides))))


def orphan_decision(job_active: Column, referenced: Column, exists: Column, exclusive: Column) -> Column:
    return F.when(job_active, "defer").when(referenced, "resolved").when(~exists, "resolved").when(exclusive, "delete").otherwise("defer")


@dataclass
class Budget:
    """Rows and seconds that a call may take; 0 is no limit. It stops at the first boundary after either is used up."""

    rows: int = 0
    seconds: float = 0
    clock: Callable[[], float] = time.monotonic
    spent: int = 0

    def __post_init__(self):
        self.began = self.clock()

    @property
    def reason(self) -> str | None:
        if self.rows and self.spent >= self.rows:
            return "rows"
        return "time" if self.seconds and self.clock() - self.began >= self.seconds else None

    def left(self, most: int) -> int:
        return min(most, self.rows - self.spent) if self.rows else most


def bounded_delete(df: DataFrame, doomed: DataFrame, key: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(what stays, keys that go): the first `limit` doomed rows by key."""
    gone = doomed.select(key).distinct().orderBy(key).limit(limit)
    return df.join(gone, key, "left_anti"), gone


def within_budget(frames: Sequence[tuple[str, DataFrame, str]], budget: int | Budget, most: int = 50_000) -> list[tuple[str, DataFrame]]:
    """Deletions in order under one budget of rows and time: each takes what those before it have left."""
    budget = Budget(budget) if isinstance(budget, int) else budget
    out = []
    for name, df, key in frames:
        if budget.reason:
            break
        rows = df.orderBy(key).limit(budget.left(most))
        out.append((name, rows))
        budget.spent += rows.count()
    return out


def collect_garbage(store, parts: Sequence[tuple[str, str, Callable[[DataFrame], DataFrame]]], budget: Budget, most: int = 50_000, chunk: int = 0) -> dict:
    """parts: (table of the store, its key, table to its doomed rows), in order. Of each table the first doomed rows that the budget leaves go, `most` at
    a time in all and `chunk` a step (0: all in one); the budget is looked at between steps. A step writes the keys that go, and nothing else of the table.
    The counts by table, and why it stopped before the end, if it did."""
    out: dict = {}
    for name, key, doomed in parts:
        left = budget.left(most)
        if budget.reason:
            break
        out[name] = 0
        while left > 0 and not (out[name] and budget.reason):
            table = store.read(name)
            step = min(left, chunk) if chunk else left
            gone = bounded_delete(table, doomed(table), key, step)[1]
            hit = table.join(gone, key, "left_semi").count()
            if not hit:
                break
            store.delete(name, gone)
            out[name] += hit
            budget.spent += hit
            left -= step
            if not chunk:
                break
    return out | {"total": budget.spent, "stopped_by": budget.reason}


def checks(*rows: tuple[str, DataFrame, str]) -> DataFrame:
    """One row of name and status for each condition that has to be empty."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.when(F.col("n") == 0, "ok").otherwise(severity).alias("status"), "n") for name, df, severity in rows]
    return reduce(DataFrame.unionByName, parts)


#: Conditions of the state, each with its severity and the rows that break it, as SQL conditions over what doctor() joins.
UNIQUE = (("mapping", ("id_shop", "source", "source_key")), ("mapping", ("id_shop", "id_product")), ("image_state", ("id_shop", "source", "source_key", "url_hash")), ("image_queue", ("id_shop", "id_product", "url_hash")), ("product_queue", ("id_shop", "source", "source_key")), ("orphans", ("id_shop", "id_product", "id_image")), ("category_mapping", ("id_shop", "supplier_key")))
OWNED = ("image_state", "image_queue", "orphans")
#: References that may be null: table, what is said, its columns, and the table and columns that have to have them.
REFERENCES = (
    ("mapping", "product exists", ("id_product",), "products", ("id_product",)),
    ("image_state", "product exists", ("id_product",), "products", ("id_product",)),
    ("image_state", "image exists", ("id_image", "id_product"), "images", ("id_image", "id_product")),
    ("category_mapping", "category exists", ("id_category",), "categories", ("id_category",)),
    ("size_groups", "group exists", ("id_attribute_group",), "attribute_groups", ("id_attribute_group",)),
    ("size_values", "value exists", ("id_attribute", "id_attribute_group"), "attributes", ("id_attribute", "id_attribute_group")),
    ("feature_mapping", "feature exists", ("id_feature",), "features", ("id_feature",)),
    ("feature_values", "value exists", ("id_feature_value", "id_feature"), "feature_value_rows", ("id_feature_value", "id_feature")),
    ("combination_mapping", "variant exists", ("id_product_attribute", "id_product"), "variants", ("id_product_attribute", "id_product")),
    ("specific_price_mapping", "price exists", ("id_specific_price", "id_product"), "specific_prices", ("id_specific_price", "id_product")),
)
QUEUES = ("image_queue", "product_queue")


def doctor(tables: dict[str, DataFrame], now: Column) -> DataFrame:
    """name, status (ok, warning, error), n: every check whose tables are given, in one scan of each table. Keys that rows share, rows whose owner or product
    is gone, jobs with a lapsed lease, failed or out of attempts, unknown states, orphans that are due, runs that two stages claim, rows of
    unknown runs, categories that are mapped nowhere or to no category, groups and values that don't exist, and hashes that are missing."""
    found: list[Check] = []
    has = lambda name, *cols: name in tables and set(cols) <= set(tables[name].columns)
    for name, keys in UNIQUE:
        if has(name, *keys):
            found.append(Unique(name, f"{name}: one row a {'/'.join(keys)}", keys=keys))
    owner = ("id_shop", "source", "source_key", "id_product")
    for name in OWNED:
        if has(name, *owner) and has("mapping", *owner):
            found.append(Reference(name, f"{name}: has an owner", "warning" if name == "orphans" else "error", owner, "mapping", owner))
    for name, label, keys, other, others in REFERENCES:
        if has(name, *keys) and has(other, *others):
            found.append(Reference(name, f"{name}: {label}", "error", keys, other, others, optional=True))
    for name in QUEUES:
        if has(name, "status", "locked_until", "attempts"):
            found.append(Holds(name, f"{name}: leases hold", "warning", (F.col("status") == "processing") & (F.col("locked_until").isNull() | (F.col("locked_until") < now))))
            found.append(Holds(name, f"{name}: no failed job", "warning", F.col("status") == "failed"))
            found.append(Holds(name, f"{name}: known states", "error", ~F.col("status").isin("pending", "processing", "done", "failed")))
            found.append(Holds(name, f"{name}: attempts are left", "warning", (F.col("status") == "pending") & (F.col("attempts") >= 5)))
            if has("runs", "id_run") and has(name, "id_run"):
                found.append(Reference(name, f"{name}: run is known", "warning", ("id_run",), "runs", ("id_run",)))
    if has("orphans", "available_at"):
        found.append(Holds("orphans", "orphans: none is due", "warning", F.col("available_at") <= now))
    stages = ("read", "import", "update", "remove")
    if has("runs", *stages):
        found.append(Holds("runs", "runs: one stage at a time", "error", sum((F.col(s) == "running").cast("int") for s in stages) > 1))
        found.append(Holds("runs", "runs: none has failed", "warning", reduce(lambda a, b: a | b, (F.col(s) == "failed" for s in stages))))
    if has("category_mapping", "id_category", "active"):
        found.append(Holds("category_mapping", "category_mapping: active ones are mapped", "warning", F.col("active") & F.col("id_category").isNull()))
    for c in tables["mapping"].columns if "mapping" in tables else ():
        if c.endswith("_hash"):
            found.append(Holds("mapping", f"mapping: {c} is there", "warning", F.col(c).isNull() | (F.col(c) == "")))
    return examine(tables, found)


def status_report(id_shop: int, source: str, settings: dict, runs: DataFrame, errors: DataFrame, image_queue: DataFrame, product_queue: DataFrame, orphans: DataFrame) -> DataFrame:
    """One row with one JSON text: settings, the latest run of the scope, counts of its errors and warnings, jobs by status, orphans."""
    scope = (F.col("id_shop") == id_shop) & (F.col("source") == source)
    mine = runs.where(scope)
    run = mine.agg(F.max_by(F.struct(*mine.columns), "id_run").alias("run"))
    latest = run.select(F.col("run.id_run").alias("id_run"))
    warning = F.col("message").startswith("WARNING:")
    issues = errors.join(F.broadcast(latest), "id_run").agg(F.count("*").alias("issues_total"), F.count_if(~warning).alias("errors_total"), F.count_if(warning).alias("warnings_total"))
    counts = lambda q, name: q.where(scope).agg(F.struct(*(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "done", "failed"))).alias(name))
    parts = [run, issues, counts(image_queue, "images"), orphans.where(scope).agg(F.count("*").alias("image_orphans")), counts(product_queue, "new_products")]
    one = reduce(lambda a, b: a.join(b, "one"), [p.withColumn("one", F.lit(1)) for p in parts])  # a row each
    chosen = F.struct(*(F.lit(v).alias(k) for k, v in sorted(settings.items()))) if settings else F.lit(None).cast("string")
    fields = [F.lit(id_shop).alias("shop_id"), F.lit(source).alias("source"), chosen.alias("effective_settings"), *(F.col(c) for c in ("run", "issues_total", "errors_total", "warnings_total", "images", "image_orphans", "new_products"))]
    return one.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("report"))


def progress(done: Column, stages: int = 4) -> Column:
    return F.floor(done * 100 / stages).cast("long")


def image_stage(open_jobs: Column, failed_jobs: Column, reconciled: Column) -> Column:
    return F.when(open_jobs > 0, "downloading").when(~reconciled & (failed_jobs == 0), "reconciling").when(failed_jobs > 0, "failed").otherwise("completed")


def error_counts(errors: DataFrame) -> DataFrame:
    """Warnings, skipped records and errors by the beginning of the message; errors include the skipped, blocking ones don't."""
    warning, skipped = F.col("message").startswith("WARNING:"), F.col("message").startswith("SKIPPED:")
    return errors.groupBy("id_run").agg(F.count_if(warning).alias("n_warnings"), F.count_if(skipped).alias("n_skipped"), F.count_if(~warning).alias("n_errors"), F.count_if(~warning & ~skipped).alias("n_blocking"))
