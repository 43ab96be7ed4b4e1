"""Runs that break off, go on, are overtaken, and meet owners that have changed; the store's versions; the tables after worker steps."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from deltaweave.operators import retention, states, workers
from deltaweave.operators.runs import Run, RunError
from deltaweave.plans import feed_run
from deltaweave.plans.feed_run import extend, run_feed
from deltaweave.sources import feed
from deltaweave.sources.store import KEPT, Store
from deltaweave.streaming import increments
from tests.test_feed import record, xml

NOW = datetime(2024, 1, 1)
OWNER = "id_shop int, source string, source_key string, id_product long"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@pytest.fixture
def shop(spark, tmp_path):
    path = tmp_path / "feed.xml"
    path.write_bytes(xml(*(record(k) for k in range(1, 6))))
    return path, Store(spark, str(tmp_path / "store"))


def test_a_crash_before_the_pointer_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.write("t", spark.range(3))
    with monkeypatch.context() as m:
        m.setattr(Store, "_point", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.write("t", spark.range(9))
    assert store.version("t") == 1 and store.read("t").count() == 3
    for n in range(4, 10):
        store.write("t", spark.range(n))
    assert store.read("t").count() == 9 and len(store.versions("t")) == KEPT
    assert not (tmp_path / "t" / "v00000001").exists() and not store.exists("other")


def test_products_get_numbers_of_their_own(spark, shop):
    path, store = shop
    run_feed(spark, f"file://{path}", store, Run(1))
    path.write_bytes(xml(*(record(k) for k in range(1, 9))))
    run_feed(spark, str(path), store, Run(2))
    got = {r.source_key: r.id_product for r in store.read("mapping").collect()}
    assert sorted(got.values()) == list(range(1, 9)) and {got[str(k)] for k in range(1, 6)} == set(range(1, 6))
    keys = spark.range(5000).select(F.col("id").cast("string").alias("source_key")).repartition(7)
    numbers = [r.id_product for r in feed_run.numbered(spark, store, keys, 99, 10).collect()]
    assert sorted(numbers) == list(range(11, 5011))


def test_a_newer_run_that_has_read_stops_an_older_one(spark, shop):
    path, store = shop
    run_feed(spark, str(path), store, Run(7))
    with pytest.raises(RunError, match="run 7 has completed reading"):
        run_feed(spark, str(path), store, Run(6))
    assert run_feed(spark, str(path), store, Run(6), source="other").n_new == 5  # another scope


def test_a_run_that_broke_off_goes_on_without_reading_again(spark, shop, monkeypatch):
    path, store = shop
    run_feed(spark, str(path), store, Run(1))
    path.write_bytes(xml(record(1, price="20"), *(record(k) for k in range(2, 7))))
    write = Store.write
    with monkeypatch.context() as m:
        m.setattr(Store, "write", lambda self, name, *a, **k: (_ for _ in ()).throw(OSError("full")) if name == "mapping" else write(self, name, *a, **k))
        with pytest.raises(OSError):
            run_feed(spark, str(path), store, Run(2))
    assert store.version("mapping") == 1 and feed_run.stored_run(store, 2, 1, "feed")["read"] == "completed"
    with monkeypatch.context() as m:
        m.setattr(feed_run, "read_stage", lambda *a: pytest.fail("read again"))
        done = run_feed(spark, str(path), store, Run(2))
        assert {r.source_key: r.action for r in done.actions.collect()} == {"1": "update", "6": "create"}
        # A break after the state was written, but before the run's row was: the same actions again, and the same state.
        old = {tuple(r) for r in store.read("mapping").collect()}
        row = feed_run.stored_run(store, 2, 1, "feed")
        again = Run(2).resumed(row | dict.fromkeys(("import", "update", "remove"), "pending"))
        feed_run.save_run(spark, store, again, 1, "feed")
        more = run_feed(spark, str(path), store, Run(2))
        assert {r.source_key: r.action for r in more.actions.collect()} == {"1": "update", "6": "create"}
        assert {tuple(r) for r in store.read("mapping").collect()} == old
    path.write_bytes(xml(record(1)))
    with pytest.raises(RunError, match="feed has changed"):
        run_feed(spark, str(path), store, Run(2))


def test_a_feed_that_changes_while_it_is_read_is_refused(spark, shop):
    path, store = shop
    stage = feed_run.read_stage

    def meddle(*a):
        out = stage(*a)
        path.write_bytes(xml(record(1)))
        return out

    feed_run.read_stage = meddle
    try:
        with pytest.raises(RunError, match="feed has changed"):
            run_feed(spark, str(path), store, Run(1))
    finally:
        feed_run.read_stage = stage
    assert not store.exists("mapping") and feed_run.stored_run(store, 1, 1, "feed")["read"] == "failed"


def test_products_that_are_gone_are_made_again_and_links_too(spark, shop):
    path, store = shop
    run_feed(spark, str(path), store, Run(1))
    ids = {r.source_key: r.id_product for r in store.read("mapping").collect()}
    has = lambda *keys: spark.createDataFrame([(ids[k],) for k in keys], "id_product long")
    out = run_feed(spark, str(path), store, Run(2), products=has("1", "2", "3", "4"), linked=has("1", "2", "3"))
    assert {r.source_key: r.action for r in out.actions.collect()} == {"4": "relink", "5": "recreate"}
    after = {r.source_key: r.id_product for r in store.read("mapping").collect()}
    assert after["5"] not in ids.values() and all(after[k] == ids[k] for k in "1234")


def test_owners_that_are_in_the_way_stop_a_run(spark, shop, monkeypatch):
    path, store = shop
    run_feed(spark, str(path), store, Run(1))
    path.write_bytes(xml(*(record(k) for k in range(1, 7))))
    with monkeypatch.context() as m:
        m.setattr(feed_run, "numbered", lambda spark, store, keys, run, start: keys.withColumn("id_product", F.lit(1).cast("long")))
        with pytest.raises(RunError, match="other owners"):
            run_feed(spark, str(path), store, Run(2))
    assert store.version("mapping") == 1
    assert run_feed(spark, str(path), store, Run(2)).n_new == 1


def test_errors_are_kept_and_steps_of_the_caller_run(spark, shop):
    path, store = shop
    path.write_bytes(xml(record(1), record(2, images=("ftp://x",)), '<product id="3"><name>open', record(4)))
    seen = []
    extend("writer", lambda actions, run: seen.append((run, actions.count())))
    extend("size_resolver", lambda df: df.withColumn("quantity", F.lit(7)))
    extend("policy", lambda gone: gone.select("id_product", F.lit("gone").alias("action"), F.lit(1).alias("value")))
    try:
        run_feed(spark, str(path), store, Run(1))
        path.write_bytes(xml(record(1), *(record(k) for k in range(4, 9))))
        run_feed(spark, str(path), store, Run(2), most_removed=100)
        with pytest.raises(ValueError):
            extend("else")
    finally:
        for n in ("writer", "size_resolver", "policy"):
            extend(n, False)
    assert seen == [(1, 3), (2, 5)] and extend("writer") is None
    assert store.partition("snapshot", "id_run", 1).select("quantity").distinct().collect() == [(7,)]
    assert [r.action for r in store.partition("shop_actions", "id_run", 2).collect()] == ["gone"]
    told = {(r.source_key, r.message.split(":")[0]) for r in store.partition("errors", "id_run", 1).collect()}
    assert told == {("3", "SKIPPED"), ("2", "WARNING")}


def test_frozen_inputs_and_fingerprints_by_uri(tmp_path):
    path = tmp_path / "a b.xml"
    path.write_bytes(xml(record(1)))
    assert feed.fingerprint(str(path)) == feed.fingerprint(path.as_uri())
    kept = feed.freeze(path.as_uri(), f"file://{tmp_path}/run")
    path.write_bytes(b"other")
    assert feed.open_file(kept).read() == xml(record(1)) and feed.freeze(str(path), str(tmp_path / "run")) == f"{tmp_path}/run/source.xml"
    assert (tmp_path / "run" / "source.xml").read_bytes() == xml(record(1))
    assert feed.fingerprint_remote("u", b"a") != feed.fingerprint_remote("u", b"b")
    feed.release(str(tmp_path / "run"))
    feed.release(str(tmp_path / "run"))
    assert not (tmp_path / "run").exists()


def test_tables_after_an_image_step(spark):
    cols = f"id_queue long, {OWNER}, url_hash string, id_run long, position int, is_cover boolean, status string, attempts int, available_at timestamp_ntz, locked_by string, locked_until timestamp_ntz, last_error string, updated_at timestamp_ntz"
    later = NOW + timedelta(minutes=5)
    queue = spark.createDataFrame([(k, 1, "s", str(k), k, f"u{k}", 9, k, False, "processing", 1, None, "w" if k != 7 else "x", later, None, None) for k in range(1, 8)], cols)
    mapping = spark.createDataFrame([(1, "s", str(k), k, k == 2) for k in range(1, 8)], f"{OWNER}, out_of_feed boolean")
    results = spark.createDataFrame([(1, "downloaded", "h1", None, 111, "png"), (2, "downloaded", "h", None, 5, "png"), (3, "unchanged", None, None, None, None), (4, "failed", None, "Image HTTP failure 404", None, None), (5, "failed", None, "timeout", None, None), (7, "downloaded", "h7", None, 77, "png")], "id_queue long, kind string, content_hash string, message string, id_image long, mime string")
    state = spark.createDataFrame([(1, "s", "1", 1, "u1", 11, "old", "gif", 0, 1, NOW), (1, "s", "3", 3, "u3", 33, "h3", "gif", 0, 1, NOW - timedelta(days=9))], f"{OWNER}, url_hash string, id_image long, content_hash string, mime string, position int, last_seen_run_id long, updated_at timestamp_ntz")
    orphans = spark.createDataFrame([], f"id_queue long, id_run long, {OWNER}, id_image long, reason string, attempts int, available_at timestamp_ntz, last_error string, created_at timestamp_ntz, updated_at timestamp_ntz")
    step = workers.image_step(queue, mapping, results.drop("id_image", "mime"), state, now())
    out = workers.apply_image_step(queue, state, orphans, queue, step, results, "w", now())
    assert {r.id_queue: (r.status, r.locked_by, r.last_error) for r in out["queue"].collect()} == {1: ("done", None, None), 2: ("done", None, "owner is not active"), 3: ("done", None, None), 4: ("failed", None, "Image HTTP failure 404"), 5: ("pending", None, "timeout"), 6: ("processing", "w", None), 7: ("processing", "x", None)}
    assert {r.source_key: (r.id_image, r.content_hash, r.mime, r.position, r.last_seen_run_id, r.updated_at) for r in out["state"].collect()} == {"1": (111, "h1", "png", 1, 9, NOW), "3": (33, "h3", "gif", 3, 9, NOW)}
    assert [(r.id_image, r.attempts, r.available_at) for r in out["orphans"].collect()] == [(11, 0, NOW + timedelta(minutes=30))]
    total = workers.image_totals(step).first()
    assert (total.n_claimed, total.n_new, total.n_stale, total.n_unchanged, total.n_retried, total.n_failed, total.n_open, total.n_orphans, total.n_done) == (7, 2, 1, 1, 1, 1, 1, 1, 4)


def test_product_jobs_by_the_time_their_run_began(spark):
    key = "id_shop int, source string, source_key string"
    claimed = spark.createDataFrame([(k, 1, "s", str(k), 5, f"R{k}") for k in range(1, 5)], f"id_queue long, {key}, id_run long, reference string")
    queue = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 6)], "id_queue long, id_run long")
    runs = spark.createDataFrame([(1, "s", 5, True, False, NOW), (1, "s", 6, False, False, NOW + timedelta(days=1))], "id_shop int, source string, id_run long, read_completed boolean, import_completed boolean, started_at timestamp_ntz")
    products = spark.createDataFrame([(200, "R1", NOW), (300, "R2", NOW - timedelta(seconds=1)), (400, "R4", NOW)], "id_product long, reference string, added_at timestamp_ntz")
    step = workers.product_step(claimed, spark.createDataFrame([], f"{key}, id_product long"), runs, products, claimed.limit(0).select("id_shop", "source", "source_key"), queue)
    assert {r.id_queue: (r.action, r.id_product, r.id_run) for r in step.collect()} == {1: ("recover", 200, 5), 2: ("create", None, 5), 3: ("create", None, 5), 4: ("create", None, 6)}
    assert workers.product_totals(step).first().asDict() == {"n_claimed": 4, "n_defer": 0, "n_supersede": 0, "n_update": 0, "n_recover": 1, "n_create": 3}


def test_revalidation_waits_for_the_latest_run(spark):
    state = spark.createDataFrame([(1, "s", str(k), k, NOW - timedelta(days=k)) for k in range(1, 6)], f"{OWNER}, updated_at timestamp_ntz")
    mapping = spark.createDataFrame([(1, "s", str(k), k, False) for k in range(1, 6)], f"{OWNER}, out_of_feed boolean")
    manifest = spark.createDataFrame([(1, "s", str(k), k, ["u", "v"]) for k in range(2, 6)], f"{OWNER}, urls array<string>")
    none = mapping.limit(0).drop("out_of_feed")

    def got(*runs, limit=9, manifest=manifest):
        jobs, counts = workers.revalidate(spark.createDataFrame(list(runs), "id_run long, completed boolean, reconciled boolean"), state, mapping, none, manifest, now() - F.expr("INTERVAL 1 DAY"), limit)
        c = counts.first()
        return c.id_run, c.status, c.n_products, c.n_images, c.n_deferred, jobs.count()

    assert got((1, True, True), (2, True, True), limit=3) == (2, "scheduled", 3, 6, 1, 3)
    assert got((1, True, True), (2, True, False)) == (2, "not ready", 0, 0, 0, 0)
    assert got((2, True, True), manifest=manifest.where("id_product <> 3")) == (2, "error", 0, 0, 0, 0)


def test_garbage_goes_in_order_and_within_the_budget(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for name in ("a", "b", "c"):
        store.write(name, spark.range(10))
    parts = [(n, "id", lambda df: df.where("id % 2 = 0")) for n in ("a", "b", "c")]
    assert retention.collect_garbage(store, parts, retention.Budget(rows=7)) == {"a": 5, "b": 2, "total": 7, "stopped_by": "rows"}
    assert sorted(r.id for r in store.read("b").collect()) == [1, 3, 4, 5, 6, 7, 8, 9] and store.version("c") == 1
    ticks = iter([0, 0, 61, 61, 61])
    assert retention.collect_garbage(store, parts[2:] + parts[1:2], retention.Budget(seconds=60, clock=lambda: next(ticks))) == {"c": 5, "total": 5, "stopped_by": "time"}
    assert [n for n, _ in retention.within_budget([("a", store.read("a"), "id"), ("b", store.read("b"), "id")], 4)] == ["a"]


def test_status_of_nothing(spark):
    runs = spark.createDataFrame([], "id_shop int, source string, id_run long")
    jobs = spark.createDataFrame([], "id_shop int, source string, status string")
    errors = spark.createDataFrame([], "id_run long, message string")
    got = json.loads(retention.status_report(1, "s", {}, runs, errors, jobs, jobs, jobs).first().report)
    assert got["run"] is None and got["issues_total"] == 0 and got["images"] == {"pending": 0, "processing": 0, "done": 0, "failed": 0} and got["effective_settings"] is None


def test_rows_that_a_batch_has_twice_are_refused(spark):
    row = lambda semantic, variant, run=3: (1, "s", "k", semantic, 5, variant, run)
    cols = "id_shop int, source string, source_key string, semantic_key string, id_product long, id_product_attribute long, id_run long"
    state, bad = states.save_combinations(spark.createDataFrame([row("a", 1)], cols), spark.createDataFrame([row("b", 2), row("c", 2), row("d", 4), row("a", 9), row(" ", 8), row("e", 7, 0)], cols))
    assert {(r.semantic_key, r.id_product_attribute) for r in state.collect()} == {("a", 9), ("d", 4)}
    assert {(r.semantic_key, r.reason) for r in bad.collect()} == {("b", "given twice"), ("c", "given twice"), (" ", "identity is not whole"), ("e", "identity is not whole")}


@pytest.mark.parametrize("buckets", [0, 3])
def test_pieces_merge_into_the_state(spark, tmp_path, buckets):
    store = Store(spark, str(tmp_path / "store"))
    cols = "source_key string, id_product long, core_hash string, out_of_feed boolean, last_seen_run_id long"
    state = spark.createDataFrame([(str(k), k, "x", False, 1) for k in range(20)], cols)
    increments.write_buckets(store, state, buckets) if buckets else store.write("mapping", state)
    (tmp_path / "in").mkdir()
    rows = [("1", 1, "old", 1), ("1", 1, "new", 2), ("1", 1, "mid", 1), ("30", 30, "y", 1), ("2", 99, "z", 1)]
    spark.createDataFrame(rows, "source_key string, id_product long, core_hash string, seen long").coalesce(1).write.parquet(str(tmp_path / "in" / "p"))
    stream = spark.readStream.schema("source_key string, id_product long, core_hash string, seen long").parquet(str(tmp_path / "in" / "*"))
    refused, actions = [], []
    before = [store.version(f"mapping_{b}") for b in range(buckets)]
    q = increments.merge_stream(stream, store, str(tmp_path / "cp"), 2, lambda df, n: actions.extend(r.source_key for r in df.collect()), lambda df, n: refused.extend(r.source_key for r in df.collect()), buckets=buckets, version="seen")
    q.processAllAvailable()
    q.stop()
    out = increments.read_buckets(store, buckets) if buckets else store.read("mapping")
    got = {r.source_key: (r.id_product, r.core_hash) for r in out.collect()}
    assert got["1"] == (1, "new") and got["30"] == (30, "y") and got["2"] == (2, "x") and len(got) == 21
    assert refused == ["2"] and actions == ["1"]
    if buckets:
        touched = {(hash_of, r) for r, hash_of in ((k, spark.createDataFrame([(k,)], "source_key string").select(increments.bucket_of("source_key", buckets)).first()[0]) for k in ("1", "2", "30"))}
        assert [store.version(f"mapping_{b}") - before[b] for b in range(buckets)] == [int(b in {x for x, _ in touched}) for b in range(buckets)]
