from datetime import datetime, timedelta

from pyspark.sql import functions as F

from deltaweave.operators import workers

NOW = datetime(2024, 1, 1)
OWNER = "id_shop int, source string, source_key string, id_product long"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def test_image_jobs_end_by_their_results(spark):
    claimed = spark.createDataFrame([(k, 1, "s", str(k), k, f"u{k}", "processing", 1, None) for k in range(1, 8)], f"id_queue long, {OWNER}, url_hash string, status string, attempts int, available_at timestamp_ntz")
    mapping = spark.createDataFrame([(1, "s", str(k), k, k == 2) for k in range(1, 8)], f"{OWNER}, out_of_feed boolean")
    results = spark.createDataFrame([(1, "downloaded", "h1", None), (2, "downloaded", "h", None), (3, "unchanged", None, None), (4, "failed", None, "Image HTTP failure 404"), (5, "failed", None, "timeout"), (6, "downloaded", "h6", None)], "id_queue long, kind string, content_hash string, message string")
    state = spark.createDataFrame([(1, "s", "1", 1, "u1", 11, "old", NOW), (1, "s", "3", 3, "u3", 33, "h3", NOW), (1, "s", "6", 6, "other", 66, "h6", NOW)], f"{OWNER}, url_hash string, id_image long, content_hash string, updated_at timestamp_ntz")
    step = workers.image_step(claimed, mapping, results, state, now())
    got = {r.id_queue: (r.outcome, r.status, r.id_image, r.orphan) for r in step.collect()}
    assert got == {1: ("new", "done", None, 11), 2: ("stale", "done", None, None), 3: ("unchanged", "done", 33, None), 4: ("failed", "failed", None, None), 5: ("failed", "pending", None, None), 6: ("same", "done", 66, None), 7: ("open", "processing", None, None)}
    assert {r.outcome: r.n for r in workers.counters(step).collect()} == {"new": 1, "stale": 1, "unchanged": 1, "failed": 2, "same": 1, "open": 1}


def test_product_jobs(spark):
    claimed = spark.createDataFrame([(k, 1, "s", str(k), 5 if k != 3 else 4, f"R{k}") for k in range(1, 6)], "id_queue long, id_shop int, source string, source_key string, id_run long, reference string")
    mapping = spark.createDataFrame([(1, "s", "1", 100)], "id_shop int, source string, source_key string, id_product long")
    runs = spark.createDataFrame([(1, "s", 5, True, False), (1, "s", 4, True, True)], "id_shop int, source string, id_run long, read_completed boolean, import_completed boolean")
    products = spark.createDataFrame([(200, "R2", 1), (100, "R1", 1), (300, "R5", 1), (301, "R5", 1)], "id_product long, reference string, added_at int")
    busy = spark.createDataFrame([(1, "s", "4")], "id_shop int, source string, source_key string")
    got = {r.id_queue: (r.action, r.id_product) for r in workers.product_step(claimed, mapping, runs, products, busy).collect()}
    assert got == {1: ("update", 100), 2: ("recover", 200), 3: ("supersede", None), 4: ("defer", None), 5: ("create", None)}


def test_revalidation(spark):
    day = timedelta(days=1)
    state = spark.createDataFrame([(1, "s", str(k), k, NOW - day * k) for k in range(1, 6)], f"{OWNER}, updated_at timestamp_ntz")
    mapping = spark.createDataFrame([(1, "s", str(k), k, k == 5) for k in range(1, 6)], f"{OWNER}, out_of_feed boolean")
    open_jobs = spark.createDataFrame([(1, "s", "4", 4)], OWNER)
    manifest = spark.createDataFrame([(1, "s", "3", 3, ["u"]), (1, "s", "2", 2, [])], f"{OWNER}, urls array<string>")
    got = {r.source_key: r.outcome for r in workers.schedule_revalidation(state, mapping, open_jobs, manifest, now() - F.expr("INTERVAL 1 DAY"), 9).collect()}
    assert got == {"3": "queued", "2": "error"}
