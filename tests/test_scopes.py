"""Several scopes in one state, broken and resumed in any order; frozen inputs; the ledger; cancel; writers by domain; shared queues."""

import glob
import itertools
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from deltaweave.operators.runs import Run, RunError
from deltaweave.plans import feed_run
from deltaweave.plans.feed_run import run_feed
from deltaweave.sources import feed
from deltaweave.sources.claims import Queue, StaleToken
from deltaweave.sources.store import Conflict, Store
from tests.test_feed import record, xml

NOW = datetime(2024, 1, 1)
JOBS = "id_queue long, id_run long, id_shop int, source string, source_key string, id_product long, status string, attempts int, available_at timestamp_ntz, locked_by string, locked_until timestamp_ntz, last_error string, updated_at timestamp_ntz"


def at(minutes=0):
    return F.lit(NOW + timedelta(minutes=minutes)).cast("timestamp_ntz")


@pytest.fixture
def shop(spark, tmp_path):
    path = tmp_path / "feed.xml"
    path.write_bytes(xml(*(record(k) for k in range(1, 5))))
    return path, Store(spark, str(tmp_path / "store"), buckets=2)


def breaking(monkeypatch, name):
    """Writes of a table fail as long as the context lasts."""
    write = Store.write
    m = monkeypatch.context()
    inner = m.__enter__()
    inner.setattr(Store, "write", lambda self, n, *a, **k: (_ for _ in ()).throw(OSError("full")) if n == name else write(self, n, *a, **k))
    return m


def broken(monkeypatch, name, call):
    m = breaking(monkeypatch, name)
    try:
        with pytest.raises(OSError):
            call()
    finally:
        m.__exit__(None, None, None)


@pytest.mark.parametrize("order", [(1, 2), (2, 1)])
def test_scopes_keep_each_others_rows_whoever_breaks_and_goes_on_first(spark, shop, monkeypatch, order):
    path, store = shop
    runs = {1: dict(id_shop=1, source="feed"), 2: dict(id_shop=2, source="a/b c")}
    go = lambda k, n: run_feed(spark, str(path), store, Run(n), **runs[k])
    for k in (1, 2):  # both break off after READ, with the same run id
        broken(monkeypatch, "mapping", lambda k=k: go(k, 7))
    for k in order:
        out = go(k, 7)
        assert {r.action for r in out.actions.collect()} == {"create"} and out.n_new == 4
    rows = feed_run.mapping(store).collect()
    assert sorted((r.id_shop, r.source, r.source_key) for r in rows) == sorted((*runs[k].values(), str(n)) for k in (1, 2) for n in range(1, 5))
    assert len({r.id_product for r in rows}) == 8
    # One breaks, four runs of the other follow, and it still goes on.
    path.write_bytes(xml(record(1, price="20"), *(record(k) for k in range(2, 6))))
    a, b = order
    broken(monkeypatch, "mapping", lambda: go(a, 8))
    for n in range(8, 12):
        go(b, n)
    out = go(a, 8)
    assert {r.source_key: r.action for r in out.actions.collect()} == {"1": "update", "5": "create"}
    rows = feed_run.mapping(store).collect()
    assert len(rows) == 10 and len({r.id_product for r in rows}) == 10
    assert {(r.id_shop, r.last_seen_run_id) for r in rows} == {(a, 8), (b, 11)}


def test_a_run_writes_the_buckets_that_change_and_exchanges_no_state(spark, shop):
    path, store = shop
    store = Store(spark, store.folder, buckets=8)
    path.write_bytes(xml(*(record(k) for k in range(1, 60))))
    run_feed(spark, str(path), store, Run(1))
    before = store.parts("mapping")
    assert len(before) == 8
    path.write_bytes(xml(record(1, price="20"), *(record(k) for k in range(2, 60))))
    run_feed(spark, str(path), store, Run(2))
    after = store.parts("mapping")
    assert sum(before[p] != after[p] for p in before) == 1
    rows = feed_run.mapping(store).collect()
    assert len(rows) == 59 and {r.last_seen_run_id for r in rows} == {2}
    snap = store.partition("snapshot", "id_run", feed_run.place(2, 1, "feed"), key="source_key")
    mine = store.read_bucketed("mapping", "1/feed", feed_run.MAPPING)
    off = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from deltaweave.operators import delta

        none = spark.createDataFrame([], "source_key string")
        plan = delta.difference(snap, mine, none, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", off)
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and all("Bucketed: true" in line for line in scans)
    assert "Exchange" not in plan.replace("Exchange hashpartitioning(source_key#", "", 1)  # the keys that can't be read, alone


def test_a_dry_run_leaves_nothing(spark, shop):
    path, store = shop
    out = run_feed(spark, str(path), store, Run(1), dry_run=True)
    assert (out.n_new, out.n_changed, out.n_removed) == (4, 0, 0) and not os.path.exists(store.folder)
    run_feed(spark, str(path), store, Run(1))
    files = sorted(glob.glob(f"{store.folder}/**", recursive=True))
    path.write_bytes(xml(record(1, price="20"), record(2), record(3), record(9)))
    out = run_feed(spark, str(path), store, Run(2), dry_run=True)
    assert {r.source_key: r.action for r in out.actions.collect()} == {"1": "update", "4": "disable", "9": "create"}
    path.write_bytes(xml(record(1), record(1)))
    with pytest.raises(RunError):
        run_feed(spark, str(path), store, Run(2), dry_run=True)
    assert sorted(glob.glob(f"{store.folder}/**", recursive=True)) == files


def test_a_broken_read_parses_what_is_open_from_the_frozen_copy(spark, shop, monkeypatch):
    path, store = shop
    path.write_bytes(xml(*(record(k, name=f"{k} quiet words of a name that a range may end in, and some more of them", extra="<note>" + "long and quiet words " * 150 + "</note>") for k in range(1, 41))))
    size = 16 * 1024
    monkeypatch.setattr(feed, "PARTITION_BYTES", size)
    monkeypatch.setattr(feed.plan, "__defaults__", (0, 0, size))
    monkeypatch.setattr(feed.freeze_parallel, "__defaults__", (size,))
    monkeypatch.setattr(feed_run.read_ranges, "__defaults__", (2,))
    asked, load = [], feed.load_ranges

    def third_fails(spark, path, ranges):
        if len(asked) == 2:
            raise OSError("lost")
        asked.append(ranges)
        return load(spark, path, ranges)

    with monkeypatch.context() as m:
        m.setattr(feed, "load_ranges", third_fails)
        with pytest.raises(OSError):
            run_feed(spark, str(path), store, Run(1), freeze=True)
    where = feed_run.place(1, 1, "feed")
    state = feed_run.ledger(store, where).collect()
    assert sum(r.done for r in state) == 4 < len(state)
    path.write_bytes(b"something else")  # the copy alone counts
    with monkeypatch.context() as m:
        more = []
        m.setattr(feed, "load_ranges", lambda spark, path, ranges: (more.extend(ranges), load(spark, path, ranges))[1])
        out = run_feed(spark, str(path), store, Run(1), freeze=True)
    assert sorted((a, b) for a, b, _ in more) == sorted((r.start, r.end) for r in state if not r.done)
    assert out.n_new == 40 and all(r.done for r in feed_run.ledger(store, where).collect())
    assert sorted(r.source_record for r in store.partition("snapshot", "id_run", where).collect()) == list(range(1, 41))


def test_a_frozen_copy_reads_like_the_file(spark, tmp_path):
    data = os.urandom(100_000)
    (tmp_path / "f").write_bytes(data)
    copy = feed.freeze_parallel(spark, str(tmp_path / "f"), str(tmp_path / "copy"), size=7_000)
    with feed.open_file(copy) as f:
        assert f.read() == data and f.seek(-10, os.SEEK_END) == 99_990 and f.read(99) == data[-10:]
        for a, n in ((0, 1), (6_999, 2), (20_999, 14_003), (50_000, 0), (100_000, 5)):
            f.seek(a)
            assert f.read(n) == data[a : a + n] and f.tell() == a + len(data[a : a + n])
    mark = feed.fingerprint(copy)
    assert mark == feed.fingerprint(str(tmp_path / "f"))
    (tmp_path / "f").write_bytes(b"")
    assert feed.freeze_parallel(spark, str(tmp_path / "f"), copy) == copy and feed.fingerprint(copy) == mark
    assert feed.open_file(feed.freeze_parallel(spark, str(tmp_path / "f"), str(tmp_path / "none"))).read() == b""


@pytest.mark.parametrize("stage", ["read", "import", "done"])
def test_cancel_frees_jobs_and_ends_the_run(spark, shop, monkeypatch, stage):
    path, store = shop
    jobs = [(k, 3 if k < 4 else 2, 1, "feed", str(k), k, "processing" if k % 2 else "pending", 1, None, "w" if k % 2 else None, NOW + timedelta(minutes=9) if k % 2 else None, None, None) for k in range(1, 7)]
    for name in ("image_queue", "product_queue"):
        store.write(name, spark.createDataFrame(jobs, JOBS))
    if stage == "read":
        with monkeypatch.context() as m:
            m.setattr(feed_run, "read_stage", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                run_feed(spark, str(path), store, Run(3))
    elif stage == "import":
        broken(monkeypatch, "mapping", lambda: run_feed(spark, str(path), store, Run(3)))
    else:
        run_feed(spark, str(path), store, Run(3))
        with pytest.raises(RunError, match="complete"):
            feed_run.cancel(store, 3, 1, "feed")
        with pytest.raises(RunError, match="no run"):
            feed_run.cancel(store, 4, 1, "feed")
        return
    # One of the writes is lost: neither the run nor a queue has changed.
    broken(monkeypatch, "product_queue", lambda: feed_run.cancel(store, 3, 1, "feed"))
    assert feed_run.stored_run(store, 3, 1, "feed")["import"] == "pending" and Queue(store, "image_queue").state().where("status = 'processing'").count() == 3
    assert feed_run.cancel(store, 3, 1, "feed") == {"image_queue": 2, "product_queue": 2}
    for name in ("image_queue", "product_queue"):
        got = {r.id_queue: (r.status, r.locked_by) for r in Queue(store, name).state().collect()}
        assert got == {1: ("pending", None), 3: ("pending", None), 5: ("processing", "w"), 2: ("pending", None), 4: ("pending", None), 6: ("pending", None)}
    with pytest.raises(RunError, match="cancelled"):
        run_feed(spark, str(path), store, Run(3))
    with pytest.raises(RunError, match="cancelled"):
        feed_run.cancel(store, 3, 1, "feed")
    assert run_feed(spark, str(path), store, Run(4)).n_new == 4


def test_writers_by_domain_fail_and_are_called_again_alone(spark, shop):
    path, store = shop
    run_feed(spark, str(path), store, Run(1))
    path.write_bytes(xml(record(1, price="20"), record(2, stock="9"), record(3), record(5)))
    run = Run(2)
    run_feed(spark, str(path), store, run)
    wrote, down = [], {"price": True}

    def writer(domain):
        def write(rows, id_run):
            keys = sorted((r.source_key, r.action) for r in rows.collect())
            if down.get(domain):
                raise OSError("no prices now")
            wrote.append((domain, keys))

        return write

    state = feed_run.write_domains(store, run, 1, "feed", {d: writer(d) for d in feed_run.GRANULAR if d != "core"})
    assert state["price"] == "failed: no prices now" and state["core"] == "waiting" and state["combination"] == "done"
    done = dict(wrote)
    assert done["combination"] == [("2", "update"), ("5", "create")] and done["availability"] == [("4", "disable")] and done["image"] == [("5", "create")] and "price" not in done
    wrote.clear()
    down.clear()
    state = feed_run.write_domains(store, run, 1, "feed", {d: writer(d) for d in feed_run.GRANULAR})
    assert set(state.values()) == {"done"} and sorted(d for d, _ in wrote) == ["core", "price"]
    assert dict(wrote)["price"] == [("1", "update"), ("5", "create")]


def test_child_rules_reject_products_in_a_run(spark, shop):
    path, store = shop
    prices = "array<struct<id_product_attribute:bigint,id_shop:bigint,id_currency:bigint,id_country:bigint,id_group:bigint,id_customer:bigint,from_quantity:bigint,`from`:string,`to`:string,price:double,reduction:double,reduction_tax:int,reduction_type:string>>"
    row = lambda kind, when: f"array(named_struct('id_product_attribute', 0L, 'id_shop', 1L, 'id_currency', 0L, 'id_country', 0L, 'id_group', 0L, 'id_customer', 0L, 'from_quantity', 1L, 'from', '{when}', 'to', '', 'price', -1D, 'reduction', 0.1D, 'reduction_tax', 1, 'reduction_type', '{kind}'))"
    feed_run.extend("size_resolver", lambda df: df.withColumn("specific_prices", F.when(F.col("source_key") == "2", F.expr(row("gift", ""))).when(F.col("source_key") == "3", F.expr(row("amount", "2024-02-31"))).otherwise(F.expr(row("percentage", "2024-02-29"))).cast(prices)).withColumn("features", F.when(F.col("source_key") == "4", F.concat("features", "features")).otherwise(F.col("features"))))
    try:
        with pytest.raises(RunError, match="invalid rows"):
            run_feed(spark, str(path), store, Run(1))
    finally:
        feed_run.extend("size_resolver", False)
    got = {r.id: r.reason for r in store.partition("rejects", "id_run", feed_run.place(1, 1, "feed")).collect()}
    assert got == {"2": "reduction type", "3": "date", "4": "feature pair twice"}


def test_claims_are_disjoint_and_stale_tokens_can_do_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    q = Queue(store, "image_queue")
    q.put(spark.createDataFrame([(k, 1, 1, "s", str(k), k, "pending", 0, None, None, None, None, None) for k in range(1, 8)], JOBS))
    first, a = q.claim(at(), 3, "a")
    second, b = q.claim(at(), 3, "b")
    assert [sorted(r.id_queue for r in x.collect()) for x in (a, b)] == [[1, 2, 3], [4, 5, 6]] and second > first
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "id_queue long")
    assert q.finish(first, "a", at(1), ids(1, 4)) == 3  # it holds three, of which one is meant
    with pytest.raises(StaleToken):
        q.finish(second, "a", at(1), ids(4))  # somebody else's token
    assert q.heartbeat(second, "b", at(10)) == 3
    third, c = q.claim(at(20), 9, "c")  # a's lease has run out, b's was renewed
    assert sorted(r.id_queue for r in c.collect()) == [2, 3, 7]
    with pytest.raises(StaleToken):
        q.finish(first, "a", at(20), ids(2))
    assert q.fail(third, "c", at(21), spark.createDataFrame([(2, "timeout"), (3, "Image HTTP failure 404")], "id_queue long, message string")) == 3
    q.compact()
    assert not store.parts("image_queue", "log")
    got = {r.id_queue: (r.status, r.locked_by, r.attempts) for r in q.state().collect()}
    assert got == {1: ("done", None, 1), 2: ("pending", None, 2), 3: ("failed", None, 2), 4: ("processing", "b", 1), 5: ("processing", "b", 1), 6: ("processing", "b", 1), 7: ("processing", "c", 1)}


def test_a_claim_that_comes_second_takes_what_is_left(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    q, other = Queue(store, "q"), Queue(Store(spark, store.folder), "q")
    q.put(spark.createDataFrame([(k, 1, 1, "s", str(k), k, "pending", 0, None, None, None, None, None) for k in range(1, 5)], JOBS))
    write, between = Store.write, []

    def late(self, *a, **k):
        if self is store and not between:
            between.append(other.claim(at(), 2, "b")[1].count())
        return write(self, *a, **k)

    monkeypatch.setattr(Store, "write", late)
    _, rows = q.claim(at(), 2, "a")
    assert between == [2] and sorted(r.id_queue for r in rows.collect()) == [3, 4]


def test_transactions_count_whole_or_not_at_all(spark, tmp_path):
    store, other = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    store.write("t", spark.range(3))
    with store.transaction():
        store.write("t", spark.range(5))
        store.write("u", spark.range(6))
        assert store.read("t").count() == other.read("t").count() == 3 and not other.exists("u")
    assert other.read("t").count() == 5 and other.read("u").count() == 6
    with pytest.raises(OSError):
        with store.transaction():
            store.write("t", spark.range(50))
            raise OSError
    with pytest.raises(Conflict):
        with store.transaction():
            store.write("t", spark.range(60))
            other.write("t", spark.range(7))  # comes first
    assert store.read("t").count() == 7
    seen = store.parts("t")
    other.write("t", spark.range(1), part="x")
    with pytest.raises(Conflict):
        store.write("t", spark.range(2), expect=seen)
    assert store.write("t", spark.range(2), part="y", expect={}) and sorted(store.parts("t")) == ["", "x", "y"]
    numbers = [(s.reserve("n", k), k) for s, k in zip(itertools.cycle([store, other]), (3, 4, 1), strict=False)]
    assert numbers == [(1, 3), (4, 4), (8, 1)] and store.reserve("n", 2, 100) == 101


def test_deletions_write_keys_alone_and_stop_between_chunks(spark, tmp_path):
    from deltaweave.operators import retention
    from deltaweave.sources.store import MOST_VECTORS

    store = Store(spark, str(tmp_path / "s"))
    store.write("t", spark.range(5000).selectExpr("id", "repeat('x', 500) as pad", "id % 50 as k"))
    size = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{store.folder}/t/**", recursive=True) if os.path.isfile(f))
    parts, before = dict(store.parts("t")), size()
    got = retention.collect_garbage(store, [("t", "id", lambda df: df.where("id % 2 = 0"))], retention.Budget(rows=700), chunk=300)
    assert got == {"t": 700, "total": 700, "stopped_by": "rows"} and store.parts("t")[""] == parts[""]
    keys = [f for p, f in store.parts("t").items() if p.startswith("deleted")]
    assert len(keys) == 3 and size() - before < 30_000
    left = [r.id for r in store.read("t").collect()]
    assert len(left) == 4300 and not set(left) & set(range(0, 1400, 2))
    ticks = iter([0, 0, 1, 99, 99, 99])
    got = retention.collect_garbage(store, [("t", "id", lambda df: df.where("id % 2 = 0"))], retention.Budget(seconds=60, clock=lambda: next(ticks)), chunk=100)
    assert got["stopped_by"] == "time" and got["t"] == 200
    for k in range(MOST_VECTORS):
        store.delete("t", spark.createDataFrame([(k,)], "k long").select("k")) if k == 99 else store.delete("t", spark.createDataFrame([(4901 + 2 * k,)], "id long"))
    assert sum(p.startswith("deleted") for p in store.parts("t")) < MOST_VECTORS and store.read("t").count() == 4100 - MOST_VECTORS
    with pytest.raises(LookupError):
        store.delete("none", spark.range(1))


def test_a_feed_as_a_stream_is_the_feed_as_a_table(spark, tmp_path):
    path, out = tmp_path / "feed.xml", str(tmp_path / "out")
    whole = xml(*(record(k, name=f"name {k}") for k in range(1, 31)))
    cut_at = whole.index(b'<product id="20"') + 40  # within a record
    path.write_bytes(whole[:cut_at])
    spark.dataSource.register(feed.FeedSource)

    def run(**options):
        q = spark.readStream.format("feed_xml").options(path=str(path), **options).load().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(out)
        try:
            q.processAllAvailable()
            return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        finally:
            q.stop()

    first = run(maxBytes="2500", position=str(tmp_path / "at.json"))
    assert sum(first) == 19 and len(first) > 2 and max(first) <= 6
    path.write_bytes(whole)
    more = run(maxBytes="2500", position=str(tmp_path / "at.json"))
    assert sum(more) == 11 and max(more) <= 6
    got = sorted(map(str, spark.read.parquet(out).collect()))
    assert got == sorted(map(str, feed.load(spark, str(path)).collect()))


def test_every_check_has_a_row_that_passes_and_one_that_fails(spark):
    from deltaweave.operators import retention

    owner = "id_shop int, source string, source_key string, id_product long"
    queue = f"{owner}, url_hash string, id_run long, status string, attempts int, locked_until timestamp_ntz"
    early, late = NOW - timedelta(hours=1), NOW + timedelta(hours=1)
    schemas = {
        "mapping": (f"{owner}, core_hash string", [(1, "s", "a", 1, "h"), (1, "s", "b", 2, "h")], [(1, "s", "a", 3, ""), (1, "s", "c", 2, None), (1, "s", "d", 77, "h")]),
        "products": ("id_product long", [(1,), (2,), (3,)], []),
        "image_state": (f"{owner}, url_hash string, id_image long", [(1, "s", "a", 1, "u", 5)], [(1, "s", "a", 1, "u", 6), (1, "s", "x", 88, "v", 5)]),
        "images": ("id_image long, id_product long", [(5, 1)], []),
        "image_queue": (queue, [(1, "s", "a", 1, "u", 1, "processing", 1, late), (1, "s", "b", 2, "u", 1, "done", 5, None)], [(1, "s", "z", 9, "u", 7, "processing", 1, early), (1, "s", "a", 1, "u", 1, "failed", 5, None), (1, "s", "a", 1, "w", 1, "lost", 0, None), (1, "s", "a", 1, "y", 1, "pending", 5, None)]),
        "product_queue": ("id_shop int, source string, source_key string, id_run long, status string, attempts int, locked_until timestamp_ntz", [(1, "s", "a", 1, "pending", 0, None)], [(1, "s", "a", 8, "processing", 1, None), (1, "s", "b", 1, "failed", 1, None), (1, "s", "c", 1, "?", 1, None), (1, "s", "d", 1, "pending", 9, None)]),
        "orphans": (f"{owner}, id_image long, available_at timestamp_ntz", [(1, "s", "a", 1, 4, late)], [(1, "s", "q", 1, 4, early)]),
        "runs": ("id_run long, read string, import string, update string, remove string", [(1, "completed", "running", "pending", "pending")], [(2, "running", "running", "failed", "pending")]),
        "category_mapping": ("id_shop int, supplier_key string, id_category long, active boolean", [(1, "k", 10, True)], [(1, "k", 11, True), (1, "l", None, True)]),
        "categories": ("id_category long", [(10,)], []),
        "size_groups": ("id_attribute_group long", [(1,), (None,)], [(2,)]),
        "attribute_groups": ("id_attribute_group long", [(1,)], []),
        "size_values": ("id_attribute long, id_attribute_group long", [(1, 1)], [(1, 2)]),
        "attributes": ("id_attribute long, id_attribute_group long", [(1, 1)], []),
        "combination_mapping": ("id_product_attribute long, id_product long", [(1, 1)], [(1, 2)]),
        "variants": ("id_product_attribute long, id_product long", [(1, 1)], []),
    }
    frames = lambda bad: {n: spark.createDataFrame(good + (worse if bad else []), s) for n, (s, good, worse) in schemas.items()}
    good = {r.name: (r.status, r.n) for r in retention.doctor(frames(False), at()).collect()}
    bad = {r.name: (r.status, r.n) for r in retention.doctor(frames(True), at()).collect()}
    assert len(good) >= 30 and set(good) == set(bad)
    assert all(v == ("ok", 0) for v in good.values()), {k: v for k, v in good.items() if v[1]}
    assert all(v[0] in ("warning", "error") and v[1] > 0 for v in bad.values()), {k: v for k, v in bad.items() if not v[1]}
    assert bad["mapping: one row a id_shop/source/source_key"] == ("error", 1) and bad["mapping: core_hash is there"] == ("warning", 2)
    plan = retention.doctor({"mapping": frames(True)["mapping"]}, at())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2, "the table once, and the list of checks"


def test_settings_make_a_policy():
    from deltaweave.operators.normalize import Policy

    made = lambda **s: feed_run.configured(Policy(), s, {1, 3}, 1, 9)
    policy, most = made(language="3", most_removed="40", size_group=" Sizes ")
    assert (policy.language_id, policy.size_group, most) == (3, "Sizes", 40)
    assert [(p.language_id, m) for p, m in (made(), made(language=4, most_removed=0), made(language="x", most_removed="101"))] == [(1, 25)] * 3
    assert feed_run.configured(Policy(), {"language": 4}, set(), None, 9)[0].language_id == 9
    with pytest.raises(RunError, match="no language"):
        feed_run.configured(Policy(), {}, {1}, None, None)
    assert made(size_group="x" * 64)[0].size_group == "x" * 64
    with pytest.raises(RunError, match="64 bytes"):
        made(size_group="é" * 33)
