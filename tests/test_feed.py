import io

import pytest
from pyspark.sql import functions as F

from deltaweave.functions.hashing import DOMAINS, with_hashes
from deltaweave.operators.delta import differs
from deltaweave.operators.normalize import normalize
from deltaweave.operators.runs import Run, RunError
from deltaweave.plans.feed_run import run_feed
from deltaweave.sources import feed
from deltaweave.sources.store import Store


def record(key, price="14.90", stock="3", name="Dress", images=("http://a.example/1", "http://a.example/2"), options=2, extra=""):
    opts = "".join(f'<option id="{key}{k}"><option_name>S{k}</option_name><STOCK>{stock}</STOCK><avaible_in>24h</avaible_in><ean></ean></option>' for k in range(options))
    imgs = "".join(f"<image_url>{u}</image_url>" for u in images)
    return f'<product id="{key}"><name>{name}</name><creation_date>2024-01-01</creation_date><brand>B</brand><category_path>A/B</category_path><category id="5">Cat</category><color>red</color><type>x</type><price>{price}</price><description><![CDATA[<p>ok</product></p>]]></description><images>{imgs}</images><options>{opts}</options>{extra}</product>'


def xml(*records):
    return ('<?xml version="1.0"?><!-- c --><products>' + "\n".join(records) + "</products>").encode()


def found(data, chunk=7):
    old, feed.CHUNK = feed.CHUNK, chunk
    try:
        return [data[a:b] for a, b in feed.spans(io.BytesIO(data))]
    finally:
        feed.CHUNK = old


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 100000])
def test_records_are_found_whatever_the_chunks(chunk):
    data = xml(record(1), "<!-- <product id='9'> -->", record(2), '<product id="3"/>', record(4))
    got = found(data, chunk)
    assert [feed.recover_id(g) or g for g in got] == ["1", "2", "3", "4"]


def test_a_broken_record_does_not_swallow_the_next():
    data = xml(record(1), '<product id="2"><name>open', record(3))
    got = [feed.parse(f, k, 0) for k, f in enumerate(found(data))]
    assert [g[2] for g in got] == ["1", "2", "3"] and [g[15] for g in got] == [False, True, False]


def test_fatal_records():
    for bad in (record(1, extra="<name>again</name>"), record(1, name="<b>x</b>"), '<product><name>open</product>', record(1, images=["http://a.example/%d" % i for i in range(1001)]), '<product id="' + "1" * 192 + '"><name>x</name></product>'):
        with pytest.raises(feed.FeedError):
            feed.parse(bad.encode(), 1, 0)


def test_root_and_tail():
    feed.check_root(b"\xef\xbb\xbf<?xml version='1.0'?>\n<!-- a --><products>")
    for head in (b"<items>", b"<!DOCTYPE a><products>", b""):
        with pytest.raises(feed.FeedError):
            feed.check_root(head)
    feed.check_tail(b"...</products>\n<!-- end -->\n")
    with pytest.raises(feed.FeedError):
        feed.check_tail(b"<product>")


def test_images_are_deduplicated_before_they_are_trimmed():
    row = feed.parse(record(1, images=["http://a", "http://a", " http://a", "http://b", "http://" + "c" * 17000]).encode(), 1, 0)
    assert row[10] == ["http://a", "http://a", "http://b"] and len(row[14]) == 1


def test_checkpoints(tmp_path):
    d = str(tmp_path)
    assert feed.load_checkpoint(d, 3) == (0, 0)
    feed.save_checkpoint(d, 3, 77)
    assert feed.load_checkpoint(d, 3) == (3, 77) and feed.load_checkpoint(d, 4) == (0, 0)


def products(spark, tmp_path, *records, name="f.xml"):
    path = tmp_path / name
    path.write_bytes(xml(*records))
    spark.dataSource.register(feed.FeedSource)
    return normalize(spark.read.format("feed_xml").option("path", str(path)).option("partitionBytes", 900).load())


@pytest.mark.parametrize("size", [90, 333, 900, 10**9])
def test_a_feed_is_the_same_however_it_is_dealt(spark, tmp_path, size):
    long = "many words of a text that goes on and <product id='77'> " * 40
    parts = [record(1), f"<!-- {long} -->", record(2, extra=f"<other><![CDATA[ {long} </product> ]]></other>"), '<product id="3"/>', record(4), f"<?note {long} ?>", '<product id="5"><name>open here and there', "<!---->", record(6, name="x - y ] z ? end"), "</product" + " " * 300 + ">", record(7), *(record(k, name=f"a dress of linen for the summer of {k}") for k in range(10, 30))]
    path = tmp_path / "f.xml"
    path.write_bytes(xml(*parts))
    spark.dataSource.register(feed.FeedSource)
    whole = spark.read.format("feed_xml").option("path", str(path)).load()
    got, want = (sorted(map(tuple, df.collect())) for df in (feed.load(spark, str(path), size=size), whole))
    assert got == want and [r[2] for r in got] == ["1", "2", "3", "4", "5", "6", "7", *(str(k) for k in range(10, 30))]
    ranges = feed.plan(spark, str(path), size=size)
    assert (len(ranges) > 5) == (size <= 900)
    half = got[9]
    assert sorted(map(tuple, feed.load(spark, str(path), half[1], half[0], size).collect())) == got[10:]
    path.write_bytes(b"<products>" + b" " * 2000 + b"</products>")
    assert feed.load(spark, str(path), size=size).count() == 0


def test_domains_change_alone(spark, tmp_path):
    base, _ = products(spark, tmp_path, record(1), name="a.xml")
    edits = {"price": record(1, price="15.90"), "core": record(1, name="Other"), "combination_stock": record(1, stock="9"), "image": record(1, images=("http://a.example/2", "http://a.example/1")), "combination": record(1, options=1)}
    for domain, changed in edits.items():
        new, _ = products(spark, tmp_path, changed, name=f"{domain}.xml")
        m, s = with_hashes(base).alias("m"), with_hashes(new).alias("s")
        flags = m.join(s, F.col("m.source_key") == F.col("s.source_key")).select(*(differs(d).alias(d) for d in DOMAINS)).first().asDict()
        assert {d for d, f in flags.items() if f} == {domain, *(["combination_stock"] if domain == "combination" else [])}


def test_rejects_have_reasons(spark, tmp_path):
    good, bad = products(spark, tmp_path, record(1), record(2, price="x"), record(3, name=" "), record(4, stock="1.5"), '<product id="5"><name>open', record("6x"))
    assert [r.source_key for r in good.collect()] == ["1"]
    assert {r.id: r.reason.split(":")[0] for r in bad.collect()} == {"2": "price", "3": "name", "4": "stock", "5": "unreadable", "6x": "id"}
    row = good.first()
    assert row.reference == "MH-1" and row.combinations[0].default and not row.combinations[1].default and row.categories[0].path == "A > B"


def test_a_run_after_a_run(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    path = tmp_path / "feed.xml"
    path.write_bytes(xml(*(record(k) for k in range(1, 11))))
    first = run_feed(spark, str(path), store, Run(1))
    assert (first.n_new, first.n_changed, first.n_removed) == (10, 0, 0)
    again = run_feed(spark, str(path), store, Run(2))
    assert (again.n_new, again.n_changed, again.n_removed) == (0, 0, 0)
    path.write_bytes(xml(record(1, price="20"), *(record(k) for k in range(2, 9)), record(10), record(11)))
    third = run_feed(spark, str(path), store, Run(3))
    got = {r.source_key: (r.action, r.domains) for r in third.actions.collect()}
    assert got == {"1": ("update", ["price"]), "9": ("disable", []), "11": ("create", [])}
    path.write_bytes(xml(record(1)))
    with pytest.raises(RunError, match="would be removed"):
        run_feed(spark, str(path), store, Run(4))
    path.write_bytes(xml(record(1), record(1)))
    with pytest.raises(RunError, match="duplicate"):
        run_feed(spark, str(path), store, Run(5))
    assert store.version("mapping") == 3


def test_stages_need_their_predecessors():
    r = Run(1)
    with pytest.raises(RunError):
        r.start("update")
    r.start("read")
    r.move("read", "completed")
    with pytest.raises(RunError):
        r.start("import", newest_read=2)
    r.start("import")
    with pytest.raises(RunError):
        r.start("read")
    assert r.progress == 25
