"""Worker steps composed of queue transitions, owner checks and results that someone else has fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookups, reconcile, states, work

OWNER = ["id_shop", "source", "source_key", "id_product"]


def image_step(claimed: DataFrame, mapping: DataFrame, results: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """What becomes of claimed image jobs.

    results: (id_queue, kind, content_hash, message), kind being downloaded, unchanged or failed; state: (owner, url_hash, id_image,
    content_hash, updated_at). A job without an active owner is superseded. Unchanged content touches the state; equal content of the
    product reuses its newest image; other content is attached, and the image it replaces becomes an orphan. Failures wait or end.
    Jobs without a result stay as they are claimed.
    """
    active = mapping.where(~F.col("out_of_feed")).select(*OWNER).distinct().withColumn("active", F.lit(True))
    same = reconcile.reusable_content(state, ("id_shop", "source", "id_product", "content_hash")).withColumnRenamed("id_image", "reused_image")
    prior = state.groupBy(*OWNER, "url_hash").agg(F.max(F.struct("updated_at", "id_image", "content_hash")).alias("p")).select(*OWNER, "url_hash", F.col("p.id_image").alias("prior_image"), F.col("p.content_hash").alias("prior_hash"))
    j = claimed.join(active, OWNER, "left").join(results, "id_queue", "left").join(prior, [*OWNER, "url_hash"], "left").join(same, ["id_shop", "source", "id_product", "content_hash"], "left")
    kind = F.when(F.col("active").isNull(), "stale").when(F.col("kind") == "unchanged", F.when(F.col("prior_image").isNull(), "failed").otherwise("unchanged")).when(F.col("kind") == "downloaded", F.when(F.col("reused_image").isNotNull(), "same").otherwise("new")).when(F.col("kind") == "failed", "failed").otherwise("open")
    j = j.withColumn("outcome", kind)
    failed = work.fail(j.where("outcome = 'failed'"), now, work.is_retryable(F.coalesce("message", F.lit(""))))
    open_jobs = j.where("outcome = 'open'")
    rest = j.where("outcome not in ('failed', 'open')").withColumn("status", F.lit("done"))
    replaced = F.col("prior_image").isNotNull() & ~F.col("prior_image").eqNullSafe(F.col("reused_image")) & ~F.col("prior_hash").eqNullSafe(F.col("content_hash")) & F.col("outcome").isin("same", "new")
    columns = ["id_queue", "outcome", "status", "available_at", "id_image", "orphan"]
    shape = lambda df: df.withColumns({"id_image": F.when(F.col("outcome") == "same", F.col("reused_image")).when(F.col("outcome") == "unchanged", F.col("prior_image")), "orphan": F.when(replaced, F.col("prior_image"))}).select(*columns)
    return shape(failed).unionByName(shape(rest)).unionByName(shape(open_jobs))


def counters(step: DataFrame) -> DataFrame:
    return step.groupBy("outcome").agg(F.count("*").alias("n"), F.count("orphan").alias("n_orphans"))


def image_totals(step: DataFrame) -> DataFrame:
    """One row: what a worker reports of its claim."""
    n = lambda c, name: F.count_if(c).alias(name)
    is_ = lambda o: F.col("outcome") == o
    failed, last = is_("failed"), F.col("status") == "failed"
    return step.agg(F.count("*").alias("n_claimed"), *(n(is_(o), f"n_{o}") for o in ("new", "same", "unchanged", "stale", "open")), n(failed & ~last, "n_retried"), n(failed & last, "n_failed"), F.count("orphan").alias("n_orphans"), n(F.col("status") == "done", "n_done"))


def apply_image_step(queue: DataFrame, state: DataFrame, orphans: DataFrame, claimed: DataFrame, step: DataFrame, results: DataFrame, worker: str, now: Column) -> dict[str, DataFrame]:
    """The tables after an image step: queue, state and orphans.

    results also has id_image of what was attached, and whatever of the state's other columns a download measures. Jobs that the worker no longer
    holds, and those without a result, change nothing.
    """
    held = queue.where(work.holds(worker, now)).select("id_queue")
    ended = step.where("outcome <> 'open'").join(held, "id_queue", "left_semi")
    jobs = claimed.drop("status", "available_at").join(ended.select("id_queue", "outcome", F.col("id_image").alias("kept_image"), "orphan"), "id_queue")
    measured = [c for c in state.columns if c in results.columns and c not in (*states.IMAGE_KEYS, "id_product", "id_image")]
    both = jobs.join(results.select("id_queue", F.col("id_image").alias("made_image"), *measured), "id_queue", "left")
    both = both.withColumn("id_image", F.coalesce("kept_image", "made_image")).withColumn("updated_at", now)
    if "last_seen_run_id" in state.columns:
        both = both.withColumn("last_seen_run_id", F.col("id_run"))
    saved, _ = states.save_images(state, both.where("outcome in ('new', 'same') and id_image is not null").select(*[c for c in state.columns if c in both.columns]))
    touched = [c for c in ("position", "is_cover", "last_seen_run_id", "updated_at") if c in state.columns and c in both.columns]
    after = states.upsert(saved, both.where("outcome = 'unchanged'"), states.IMAGE_KEYS, touched, insert=False)
    lost = both.where("orphan is not null").select("id_queue", "id_run", *OWNER, F.col("orphan").alias("id_image"), F.lit("replaced").alias("reason"), F.lit(None).cast("string").alias("last_error"))
    marked = states.record_orphans(orphans, lost, now)
    put = queue.join(ended.select("id_queue", F.col("status").alias("next"), F.col("available_at").alias("due"), "outcome"), "id_queue", "left").join(results.select("id_queue", F.col("message").alias("told")), "id_queue", "left")
    hit = F.col("outcome").isNotNull()
    change = {"available_at": F.when(hit & (F.col("next") == "pending"), F.col("due")).otherwise(F.col("available_at")), "last_error": F.when(F.col("outcome") == "failed", F.substring("told", 1, states.MOST_LAST_ERROR)).when(F.col("outcome") == "stale", "owner is not active").otherwise(F.col("last_error"))}
    change |= {"locked_by": F.when(~hit, F.col("locked_by")), "locked_until": F.when(~hit, F.col("locked_until")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "status": F.coalesce("next", "status")}
    return {"queue": put.withColumns(change).select(*queue.columns), "state": after, "orphans": marked}


def product_step(claimed: DataFrame, mapping: DataFrame, runs: DataFrame, products: DataFrame, busy: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """What a new-product worker does with each claimed job: defer (its key is being worked on), supersede (a newer run has read, or this one
    is past its import), update (an owner exists), recover (one ownerless product has the reference) or create.

    queue: the jobs as they are now; one whose row has moved on to a newer run since it was claimed is taken as of that run. Where runs have
    started_at, only products added since the job's run began are recovered.
    """
    keys = ["id_shop", "source", "source_key"]
    if queue is not None:
        claimed = claimed.join(queue.select("id_queue", F.col("id_run").alias("current_run")), "id_queue", "left").withColumn("id_run", F.greatest("id_run", "current_run")).drop("current_run")
    newest = runs.where("read_completed").groupBy("id_shop", "source").agg(F.max("id_run").alias("newest"))
    past = runs.where("import_completed").select("id_run").distinct().withColumn("past", F.lit(True))
    owners = mapping.select(*keys, F.col("id_product").alias("owner"))
    ownerless = products.join(mapping.select("id_product").distinct(), "id_product", "left_anti")
    wanted = claimed.select("id_queue", "id_run", "reference")
    fits = F.lit(True)
    if "started_at" in runs.columns:
        wanted = wanted.join(runs.select("id_run", "started_at").dropDuplicates(["id_run"]), "id_run", "left")
        fits = F.col("added_at") >= F.col("started_at")
    free = wanted.join(ownerless, "reference").where(fits).groupBy("id_queue").agg(F.count("*").alias("n"), F.min("id_product").alias("free_product")).where("n = 1").drop("n")
    j = claimed.join(busy.select(*keys).distinct().withColumn("busy", F.lit(True)), keys, "left").join(newest, ["id_shop", "source"], "left").join(past, "id_run", "left").join(owners, keys, "left").join(free, "id_queue", "left")
    action = F.when(F.col("busy"), "defer").when((F.col("newest") > F.col("id_run")) | F.col("past"), "supersede").when(F.col("owner").isNotNull(), "update").when(F.col("free_product").isNotNull(), "recover").otherwise("create")
    return j.select("id_queue", action.alias("action"), F.coalesce("owner", "free_product").alias("id_product"), "id_run")


def product_totals(step: DataFrame) -> DataFrame:
    """One row: claimed jobs by what becomes of them."""
    return step.agg(F.count("*").alias("n_claimed"), *(F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("defer", "supersede", "update", "recover", "create")))


def schedule_revalidation(state: DataFrame, mapping: DataFrame, unresolved: DataFrame, manifest: DataFrame, before: Column, limit: int) -> DataFrame:
    """Owners whose images are due for another look: stale, active, without open jobs; oldest first, up to a limit. An owner without a
    manifest row or an image address is an error."""
    stale = lookups.stale_owners(state, mapping, unresolved, before, OWNER)
    due = stale.groupBy(*OWNER).agg(F.min("updated_at").alias("oldest")).orderBy("oldest", *OWNER).limit(limit)
    urls = manifest.select(*OWNER, F.size("urls").alias("n_urls"))
    return due.join(urls, OWNER, "left").select(*OWNER, F.coalesce("n_urls", F.lit(0)).alias("n_urls"), F.when(F.coalesce("n_urls", F.lit(0)) > 0, "queued").otherwise("error").alias("outcome"))


def revalidate(runs: DataFrame, state: DataFrame, mapping: DataFrame, unresolved: DataFrame, manifest: DataFrame, before: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """(jobs, one row of counts). Nothing is scheduled unless the scope's latest run (runs: id_run, completed, reconciled) is completed and reconciled;
    an owner without an image to look at again makes the whole an error, and what is due beyond the limit is deferred."""
    latest = runs.agg(F.max(F.struct("id_run", (F.col("completed") & F.col("reconciled")).alias("ready"))).alias("l")).select("l.id_run", F.coalesce("l.ready", F.lit(False)).alias("ready"))
    all_due = lookups.stale_owners(state, mapping, unresolved, before, OWNER).select(*OWNER).distinct().agg(F.count("*").alias("n_due"))
    due = schedule_revalidation(state, mapping, unresolved, manifest, before, limit)
    of = due.agg(F.count("*").alias("n_candidates"), F.count_if(F.col("outcome") == "error").alias("n_errors"), F.coalesce(F.sum("n_urls"), F.lit(0)).alias("n_images"))
    one = F.lit(1).alias("one")
    counts = latest.select("*", one).join(all_due.select("*", one), "one").join(of.select("*", one), "one").drop("one")  # a row each
    status = F.when(~F.col("ready"), "not ready").when(F.col("n_errors") > 0, "error").otherwise("scheduled")
    counts = counts.select("id_run", status.alias("status"), "n_candidates", F.when(status == "scheduled", F.col("n_candidates")).otherwise(0).alias("n_products"), F.when(status == "scheduled", F.col("n_images")).otherwise(0).alias("n_images"), (F.col("n_due") - F.col("n_candidates")).alias("n_deferred"))
    jobs = due.select("*", one).join(F.broadcast(counts.where("status = 'scheduled'").select(one)), "one", "left_semi").drop("one")
    return jobs, counts
