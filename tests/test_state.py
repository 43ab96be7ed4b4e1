from datetime import datetime, timedelta

from pyspark.sql import functions as F

from deltaweave.operators import delta, paging, reconcile, work

NOW = datetime(2024, 1, 1)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def queue(spark, rows):
    schema = "id_queue long, status string, attempts int, available_at timestamp_ntz, locked_by string, locked_until timestamp_ntz, last_error string, updated_at timestamp_ntz, id_product long"
    return spark.createDataFrame([(*r, None, None, k) if len(r) == 6 else r for k, r in enumerate(rows)], schema)


def test_claims_take_due_and_lapsed_rows(spark):
    h = timedelta(hours=1)
    q = queue(spark, [(1, "pending", 0, None, None, None), (2, "pending", 0, NOW + h, None, None), (3, "processing", 1, None, "w", NOW - h), (4, "processing", 1, None, "w", NOW + h), (5, "pending", 5, None, None, None), (6, "done", 0, None, None, None), (7, "pending", 0, NOW, None, None)])
    got = work.claim(q, now(), 2, "me").collect()
    assert [(r.id_queue, r.attempts, r.locked_by) for r in sorted(got)] == [(1, 1, "me"), (3, 2, "me")]
    assert sorted(r.id_queue for r in work.claim(q, now(), 9, "me").collect()) == [1, 3, 7]
    owners = q.where("id_queue = 7").select("id_product")
    assert [r.id_queue for r in work.claim_active_first(q, owners, now(), 9, "me", ["id_product"]).collect()] == [7]
    held = work.finish(work.heartbeat(q, "w", now()), q.where("id_queue = 4"), "w", now()).where("id_queue = 4").first()
    assert held.status == "done" and held.locked_by is None


def test_failures_wait_longer_and_then_stop(spark):
    q = queue(spark, [(k, "processing", k, None, None, None) for k in range(1, 6)])
    rows = {r.id_queue: r for r in work.fail(q, now(), F.lit(True)).collect()}
    assert [(rows[k].available_at - NOW).seconds for k in range(1, 5)] == [15, 30, 60, 120] and rows[5].status == "failed"
    assert {r.status for r in work.fail(q, now(), F.lit(False)).collect()} == {"failed"}


def test_failure_messages(spark):
    cases = [("Image HTTP failure 429", True), ("image http failure 503", True), ("Image HTTP failure 404", False), ("image http failure 302", False), ("Unsupported image MIME text/html", False), ("connection reset", True), ("Image redirect loop detected", False), ("image http failure  404: gone", False), ("image http failure404", True), ("image http failure 4040", True), ("image http failure 404x", True), ("image http failure", True)]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m string")
    assert [r[0] for r in df.orderBy("i").select(work.is_retryable(F.col("m"))).collect()] == [x for _, x in cases]


def test_an_older_run_never_moves_a_job_back(spark):
    cols = "id_shop int, id_product int, url_hash string, id_run long, source string, source_key string, url string, position int, is_cover boolean, status string, attempts int, available_at timestamp_ntz, locked_by string, locked_until timestamp_ntz, last_error string, updated_at timestamp_ntz"
    base = (1, 1, "h", 5, "s", "k", "old", 0, False, "processing", 2, None, "w", NOW, None, None)
    q = spark.createDataFrame([base], cols)
    new = lambda run, key: spark.createDataFrame([(1, 1, "h", run, "s", key, "new", 1, True)], "id_shop int, id_product int, url_hash string, id_run long, source string, source_key string, url string, position int, is_cover boolean")
    got = lambda run, key: (lambda r: (r.id_run, r.url, r.status, r.attempts, r.locked_by))(work.enqueue_images(q, new(run, key), now()).first())
    assert got(4, "k") == (5, "old", "processing", 2, "w")
    assert got(5, "k") == (5, "new", "processing", 2, "w")
    assert got(5, "x") == (5, "old", "processing", 2, "w")
    assert got(6, "x") == (6, "new", "pending", 0, None)


def test_changed_domains(spark):
    cols = "source_key string, id_product long, core_hash string, price_hash string, combination_hash string, combination_stock_hash string, image_hash string, payload_hash string"
    m = spark.createDataFrame([("a", 1, *"cptsiy"), ("b", 2, *"cptsiy"), ("c", 3, *"cptsiy"), ("d", 4, *"cptsiy"), ("e", 5, *"cptsiy")], cols).withColumn("out_of_feed", F.col("source_key") == "e").withColumn("last_seen_run_id", F.lit(1).cast("long"))
    s = spark.createDataFrame([("a", 1, *"cpt9iy"), ("b", 2, *"cpts9y"), ("c", 3, *"cptsi9"), ("d", 4, *"cptsiy"), ("e", 5, *"cptsiy"), ("f", 6, *"cptsiy")], cols)
    domains = ["core", "price", "combination", "combination_stock", "image"]
    got = {r.source_key: (r.domains, r.image_changed) for r in delta.changed_rows(s, m, domains=domains).collect()}
    assert got == {"a": (["combination"], False), "b": ([], True), "c": ([], False), "e": (["core", "price", "combination"], False)}
    assert [r.source_key for r in delta.new_rows(s, m).collect()] == ["f"]
    merged = delta.merge_mapping(m, s, 2)
    assert merged.count() == 6 and not merged.where("out_of_feed").count() and not delta.conflicts(merged, "id_product").count()
    once = {tuple(r) for r in merged.collect()}
    assert once == {tuple(r) for r in delta.merge_mapping(merged, s, 2).collect()}


def test_a_manual_value_that_equals_the_desired_one_is_not_adopted(spark):
    f = lambda *rows: spark.createDataFrame(list(rows), "id_product int, feature string, value string")
    out = {r.feature: (r.value, r.owned, r.action) for r in reconcile.features(f((1, "a", "x"), (1, "b", "x")), f((1, "b", "x"), (1, "c", "y"), (1, "d", "y")), f((1, "a", "x"), (1, "b", "z"), (1, "c", "y"), (1, "d", "hand"), (1, "e", "own"))).collect()}
    assert out == {"a": ("x", False, "keep"), "b": ("x", True, "change"), "c": (None, False, "remove"), "d": ("hand", False, "keep"), "e": ("own", False, "keep")}


def test_byte_budget_takes_one_row_at_least(spark):
    df = spark.createDataFrame([(k, s) for k, s in enumerate([50, 30, 20, 5, 100])], "k long, s long")
    ids = lambda b: [r.k for r in paging.byte_budget_page(df, "k", "s", b).orderBy("k").collect()]
    assert ids(10) == [0] and ids(80) == [0, 1] and ids(100) == [0, 1, 2] and ids(104) == [0, 1, 2] and ids(1000) == [0, 1, 2, 3, 4]
    assert paging.byte_budget_page(df.limit(0), "k", "s", 5).count() == 0
