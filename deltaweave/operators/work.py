"""Work queues as tables: pure transitions from (queue, events, now) to the next queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ATTEMPTS, MOST_CLAIMED, MOST_ORPHAN_ATTEMPTS = 5, 500, 255
IMAGE_LEASE, PRODUCT_LEASE = "INTERVAL 15 MINUTES", "INTERVAL 10 MINUTES"
STATES = ("pending", "processing", "done", "failed")
# Waits after each failed attempt and orphan check, and messages of failures that no retry mends.
BACKOFF_SECONDS = ((1, 15), (2, 30), (3, 60), (4, 120))
BACKOFF_REST = 300
ORPHAN_MINUTES = ((1, 15), (3, 60), (6, 360))
ORPHAN_REST = 1440
PERMANENT = (
    "private/reserved or unresolved image host blocked",
    "image connection endpoint changed after validation",
    "image exceeds maximum download size",
    "image exceeds prestashop resize memory limit",
    "unsupported image mime",
    "invalid or oversized image dimensions",
    "invalid image url port",
    "image redirect response without location",
    "image redirect limit exceeded",
    "image redirect loop detected",
    "image redirect protocol downgrade blocked",
    "invalid image redirect location",
)
RETRIED_STATUS, STATUS_MESSAGE = (408, 425, 429), "image http failure"
TRANSIENT_CODES = ("1205", "1213", "40001")
TRANSIENT = ("deadlock found", "lock wait timeout exceeded", "sqlstate[40001]", "serialization failure", "try restarting transaction", "server has gone away", "lost connection")


def steps(value: Column, table: Sequence[tuple[int, int]], rest: int) -> Column:
    """The first entry whose bound the value doesn't exceed."""
    out = None
    for most, result in table:
        out = F.when(value <= most, result) if out is None else out.when(value <= most, result)
    return out.otherwise(rest)


def eligible(now: Column) -> Column:
    due = (F.col("status") == "pending") & (F.col("available_at").isNull() | (F.col("available_at") <= now))
    lapsed = (F.col("status") == "processing") & (F.col("locked_until").isNull() | (F.col("locked_until") < now))
    return (due | lapsed) & (F.col("attempts") < MOST_ATTEMPTS)


def claim(queue: DataFrame, now: Column, limit: int, worker: str, lease: str = IMAGE_LEASE, most: int = MOST_CLAIMED) -> DataFrame:
    """The claimed rows as they are afterwards: the first `limit` eligible by id."""
    rows = queue.where(eligible(now)).orderBy("id_queue").limit(min(limit, most))
    return rows.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "locked_by": F.lit(worker), "locked_until": now + F.expr(lease), "updated_at": now})


def claim_active_first(queue: DataFrame, owners: DataFrame, now: Column, limit: int, worker: str, keys: Sequence[str]) -> DataFrame:
    """Rows with a live owner come first; only where there is none does a claim take others. One ordered claim: live rows before the rest,
    and of its at most `limit` rows those that are as live as the first."""
    flagged = queue.join(owners.select(*keys).distinct().withColumn("live", F.lit(1)), list(keys), "left").withColumn("live", F.coalesce("live", F.lit(0)))
    rows = flagged.where(eligible(now)).orderBy(F.desc("live"), "id_queue").limit(min(limit, MOST_CLAIMED))
    first = rows.agg(F.max("live").alias("live"))
    return claim(rows.join(F.broadcast(first), "live", "left_semi").drop("live").select(*queue.columns), now, limit, worker)  # one row


def apply_changes(queue: DataFrame, changed: DataFrame, key: str = "id_queue") -> DataFrame:
    """The queue with changed rows in place of the old ones."""
    return queue.join(changed, key, "left_anti").unionByName(changed)


def folded(base: DataFrame, log: DataFrame, key: str = "id_queue", seq: str = "seq") -> DataFrame:
    """The last word of a log (whole rows, and their place in it) on each job, and the jobs that it says nothing on."""
    columns = [c for c in log.columns if c not in (key, seq)]
    last = log.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("last")).select(key, *(F.col(f"last.{c}").alias(c) for c in columns))
    return base.join(last, key, "left_anti").unionByName(last.select(*base.columns))


def released(queue: DataFrame) -> DataFrame:
    """Jobs in work wait again, held by nobody."""
    busy = F.col("status") == "processing"
    free = lambda c: F.when(busy, F.lit(None)).otherwise(F.col(c))
    return queue.withColumns({"locked_by": free("locked_by"), "locked_until": free("locked_until"), "status": F.when(busy, "pending").otherwise(F.col("status"))})


def heartbeat(queue: DataFrame, worker: str, now: Column, lease: str = IMAGE_LEASE) -> DataFrame:
    mine = holds(worker, now)
    return queue.withColumn("locked_until", F.when(mine, now + F.expr(lease)).otherwise(F.col("locked_until")))


def holds(worker: str, now: Column) -> Column:
    return (F.col("status") == "processing") & (F.col("locked_by") == worker) & (F.col("locked_until") >= now)


def finish(queue: DataFrame, ids: DataFrame, worker: str, now: Column, note: str | None = None) -> DataFrame:
    """Rows of ids that this worker still holds are done; note says why if they were superseded."""
    hit = queue.join(ids.select("id_queue").distinct().withColumn("hit", F.lit(True)), "id_queue", "left")
    mine = F.coalesce(F.col("hit"), F.lit(False)) & holds(worker, now)
    put = lambda new, old: F.when(mine, new).otherwise(F.col(old))
    return hit.withColumns({"last_error": put(F.lit(note), "last_error"), "updated_at": put(now, "updated_at"), "locked_by": put(F.lit(None), "locked_by"), "locked_until": put(F.lit(None), "locked_until"), "status": put(F.lit("done"), "status")}).drop("hit")


def fail(rows: DataFrame, now: Column, retryable: Column) -> DataFrame:
    """Failed for good after the last attempt or if no retry helps; else pending again after a wait."""
    final = ~retryable | (F.col("attempts") >= MOST_ATTEMPTS)
    wait = steps(F.col("attempts"), BACKOFF_SECONDS, BACKOFF_REST)
    return rows.withColumns({"available_at": F.when(~final, now + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))), "status": F.when(final, "failed").otherwise("pending")})


def enqueue_images(queue: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Upsert by (id_shop, id_product, url_hash).

    A row is accepted if its run is newer, or the same with the same owner. An accepted row of the same owner leaves a lease alone; others start
    over. The run never falls. All conditions see the old values.
    """
    keys = ["id_shop", "id_product", "url_hash"]
    q, r = queue.alias("q"), rows.alias("r")
    j = q.join(r, [F.col(f"q.{k}") == F.col(f"r.{k}") for k in keys], "full_outer")
    old, new = F.col("q.id_run").isNotNull(), F.col("r.id_run").isNotNull()
    same = (F.col("q.source") == F.col("r.source")) & (F.col("q.source_key") == F.col("r.source_key"))
    accept = new & (~old | (F.col("r.id_run") > F.col("q.id_run")) | ((F.col("r.id_run") == F.col("q.id_run")) & same))
    leased = old & (F.col("q.status") == "processing") & same
    taken = lambda c: F.when(accept, F.col(f"r.{c}")).otherwise(F.col(f"q.{c}")).alias(c)
    reset = lambda c, v: F.when(accept & ~F.coalesce(leased, F.lit(False)), v).otherwise(F.col(f"q.{c}")).alias(c)
    return j.select(*(F.coalesce(f"q.{k}", f"r.{k}").alias(k) for k in keys), F.greatest("q.id_run", "r.id_run").alias("id_run"), *(taken(c) for c in ("source", "source_key", "url", "position", "is_cover")), reset("status", F.lit("pending")), reset("attempts", F.lit(0)), reset("available_at", F.lit(None)), reset("locked_by", F.lit(None)), reset("locked_until", F.lit(None)), reset("last_error", F.lit(None)), F.when(accept, now).otherwise(F.col("q.updated_at")).alias("updated_at"))


def enqueue_products(queue: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert by (id_shop, source, source_key): the payload of the same or a newer run wins; a newer run starts a row over unless it is being worked on."""
    keys = ["id_shop", "source", "source_key"]
    q, r = queue.alias("q"), rows.alias("r")
    j = q.join(r, [F.col(f"q.{k}") == F.col(f"r.{k}") for k in keys], "full_outer")
    old, new = F.col("q.id_run").isNotNull(), F.col("r.id_run").isNotNull()
    wins = new & (~old | (F.col("r.id_run") >= F.col("q.id_run")))
    starts = new & (~old | ((F.col("r.id_run") > F.col("q.id_run")) & (F.col("q.status") != "processing")))
    return j.select(*(F.coalesce(f"q.{k}", f"r.{k}").alias(k) for k in keys), F.greatest("q.id_run", "r.id_run").alias("id_run"), F.when(wins, F.col("r.payload")).otherwise(F.col("q.payload")).alias("payload"), F.when(starts, "pending").otherwise(F.col("q.status")).alias("status"), F.when(starts, 0).otherwise(F.col("q.attempts")).alias("attempts"))


def supersede_older(queue: DataFrame, manifest: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Open or failed rows of an owner that a newer run's manifest covers are done."""
    newest = manifest.groupBy(*owner).agg(F.max("id_run").alias("manifest_run"))
    j = queue.join(newest, list(owner), "left")
    old = F.col("manifest_run").isNotNull() & (F.col("id_run") < F.col("manifest_run")) & F.col("status").isin("pending", "processing", "failed")
    return j.withColumn("superseded", old).withColumn("status", F.when(old, "done").otherwise(F.col("status"))).drop("manifest_run")


def retry_failed(queue: DataFrame, limit: int, most: int = 100_000) -> DataFrame:
    """The failed rows that start over: the first by id."""
    rows = queue.where("status = 'failed'").orderBy("id_queue").limit(min(limit, most))
    return rows.withColumns({"status": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(None).cast("string")})


def requeue_errors(queue: DataFrame, owners: DataFrame, prefixes: Sequence[str], keys: Sequence[str], limit: int = 1000) -> DataFrame:
    """Failed rows with a message of these beginnings and a live owner start over."""
    told = F.lit(False)
    for p in prefixes:
        told = told | F.col("last_error").startswith(p)
    return retry_failed(queue.where(told).join(owners, list(keys), "left_semi"), limit)


def finish_generation(expected: Column) -> Column:
    """Status of a finished product job: a newer generation starts over."""
    return F.when(F.col("id_run") > expected, "pending").otherwise("done")


def finish_product_jobs(queue: DataFrame, done: DataFrame, worker: str, now: Column) -> DataFrame:
    """done: (id_queue, expected_run, id_product). A job that this worker still holds is done, unless a newer generation has come meanwhile: that starts over."""
    j = queue.join(done.select("id_queue", "expected_run", F.col("id_product").alias("made")), "id_queue", "left")
    mine = F.col("expected_run").isNotNull() & holds(worker, now)
    status = finish_generation(F.col("expected_run"))
    again = mine & (status == "pending")
    put = lambda c, v: F.when(mine, v).otherwise(F.col(c))
    changed = {"attempts": F.when(again, 0).otherwise(F.col("attempts")), "available_at": F.when(again, F.lit(None)).otherwise(F.col("available_at")), "updated_at": put("updated_at", now), "id_product": F.when(mine, F.coalesce("made", "id_product")).otherwise(F.col("id_product")), "locked_by": put("locked_by", F.lit(None)), "locked_until": put("locked_until", F.lit(None)), "status": put("status", status)}
    return j.withColumns(changed).select(*queue.columns)


def lease_counts(queue: DataFrame, now: Column, *by: str) -> DataFrame:
    """Rows being worked on, and those of them whose lease has run out."""
    busy = F.col("status") == "processing"
    return queue.groupBy(*by).agg(F.count_if(busy).alias("n_processing"), F.count_if(busy & (F.col("locked_until") < now)).alias("n_lapsed"))


def is_retryable(message: Column, invalid_argument: Column | None = None) -> Column:
    m = F.lower(message)
    permanent = F.lit(False) if invalid_argument is None else invalid_argument
    for p in PERMANENT:
        permanent = permanent | m.contains(p)
    told = F.locate(STATUS_MESSAGE, m)
    after = F.when(told > 0, F.substring(m, told + len(STATUS_MESSAGE), F.char_length(m)))
    word = F.split(F.ltrim(after), "[^0-9a-z_]", 2)[0]  # a status is the first word after the message, if it is a number of three digits
    status = F.when((F.ltrim(after) != after) & (F.char_length(word) == 3), word.try_cast("int"))
    by_status = F.when(status.isin(*RETRIED_STATUS) | (status >= 500), True).when((status >= 300) & (status < 500), False).otherwise(True)
    return F.when(permanent, False).otherwise(by_status)


def is_transient(code: Column, message: Column) -> Column:
    out = F.coalesce(code.isin(*TRANSIENT_CODES), F.lit(False))
    for needle in TRANSIENT:
        out = out | F.coalesce(F.lower(message).contains(needle), F.lit(False))
    return out


def defer_orphan(rows: DataFrame, now: Column) -> DataFrame:
    """One more attempt, and the next check after a wait that grows with the attempts made."""
    minutes = steps(F.col("attempts") + 1, ORPHAN_MINUTES, ORPHAN_REST)
    return rows.withColumns({"available_at": now + F.make_dt_interval(mins=minutes), "attempts": F.least(F.col("attempts") + 1, F.lit(MOST_ORPHAN_ATTEMPTS))})


def histogram(queue: DataFrame, states: Sequence[str] = STATES) -> DataFrame:
    """Rows of each state, 0 where there is none."""
    all_states = queue.sparkSession.range(1).select(F.explode(F.array(*(F.lit(s) for s in states))).alias("status"))
    return all_states.join(queue.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def active_unresolved(queue: DataFrame, mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Open rows whose owner is active, by run."""
    return queue.where(F.col("status").isin("pending", "processing")).join(mapping.where(~F.col("out_of_feed")), list(keys), "left_semi").groupBy("id_run").agg(F.count("*").alias("n"))
