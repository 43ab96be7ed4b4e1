"""The queries with SQL against DuckDB, and the pipeline against its stages done plainly."""

import hashlib
import os
import sys

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from deltaweave.llm import queries, setjoin  # noqa: E402
from tests.llm.test_table_operators import plain_components  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    found = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def test_there_is_one_query_of_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        kept[name] = docs.select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in kept["quality rules"]}
    labels = plain_components(list(texts.items()), setjoin.Terms())
    assert {r.doc_id for r in kept["n-gram Jaccard join"]} == {d for d, (_, c) in labels.items() if c == d}
    assert len(kept["secret scans"]) == len(kept["n-gram Jaccard join"])
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path(corpus_pipeline.BYTE_BPE))
    want = sorted((r.doc_id, hashlib.sha256(np.array(t.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in kept["mixing sources"])
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids_sha256) for r in got.collect()) == want
