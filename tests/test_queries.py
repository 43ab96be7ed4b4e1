"""Every query with SQL gives the rows that DuckDB gives for it."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from deltaweave import plans
from deltaweave.operators import rules

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    found = db.execute(plans.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in found.fetchall())


def test_label_collisions_compares_every_part(spark, monkeypatch):
    from deltaweave.plans import delta_queries

    seen = []
    monkeypatch.setattr(delta_queries.delta, "label_collisions", lambda state, rows, keys, f=delta_queries.delta.label_collisions: seen.append(rows.count()) or f(state, rows, keys))
    plans.QUERIES["label_collisions"](spark, SF)
    assert seen == [spark.read.parquet(f"{SF}/part.parquet").count()]


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["source_key", "action", "changed_domains"] and df.count() > 0
    assert set(plans.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_sanitised_pages_keep_their_text_and_allowed_tags_alone(spark):
    """Against a plain reading of each page: what stands outside tags stays, character by character, and of tags only those that may."""
    import html
    import re

    from deltaweave.functions.text import ALLOWED_ATTRIBUTES, ALLOWED_TAGS

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = plans.QUERIES["html_sanitize"](spark, SF)
    name = next(c for c in got.columns if c != "page_id")
    rows = got.collect()
    assert len(rows) == len(pages)
    squeezed = lambda s: re.sub(r"\s+", "", html.unescape(s))
    for r in rows:
        out = r[name]
        for tag, attributes in re.findall(r"</?([A-Za-z0-9]+)((?:\s[^<>]*)?)>", out):
            assert tag in ALLOWED_TAGS and set(re.findall(r"([a-z-]+)=\"", attributes)) <= set(ALLOWED_ATTRIBUTES)
        plain = re.sub(r"<(script|style)\b[^>]*>(.*?)</\1>", lambda m: html.escape(m[2]), pages[r.page_id] or "", flags=re.S | re.I)  # no tags stand in these
        raw = re.sub(r"<!--.*?-->|<!DOCTYPE[^>]*>|</?[A-Za-z][^<>]*>", "", plain, flags=re.S | re.I)
        assert squeezed(re.sub(r"</?[A-Za-z][^<>]*>", "", out)) == squeezed(raw)


def test_combinations_make_each_key_once_a_row(spark):
    kinds = "attribute_ids array<bigint>, reference string, ean13 string, upc string, mpn string, quantity int, minimal_quantity int, price_impact double, weight_impact double, wholesale_price double, default boolean"
    one = lambda ids, least=None, ean=" ": (ids, " R", ean, None, "", 3, least, None, None, None, None)
    rows = [[one([2, 1, 2]), one([3])], [one([2, 1]), one([1, 2])], [one([1], 0)], [one([1], None, "1" * 14)], [one([])], [one(None)], [one([1, None])], [], None]
    df = spark.createDataFrame([(r,) for r in rows], f"c array<struct<{kinds}>>")
    error = df.select(rules.combination_error(F.col("c")).alias("e"))
    none = "combination without attributes"
    assert [r.e for r in error.collect()] == [None, "combination twice", "minimal quantity below 1", "combination ean13 is too long", none, none, none, None, None]
    assert error._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    keys = [[r.semantic_key for r in x.c] for x in df.where("size(c) > 0").select(rules.combinations(F.col("c")).alias("c")).collect()[:2]]
    key = lambda ids: hashlib.sha256(":".join(map(str, ids)).encode()).hexdigest()
    assert keys == [sorted([key([1, 2]), key([3])]), [key([1, 2])] * 2]
