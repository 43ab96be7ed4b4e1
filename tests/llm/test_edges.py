"""Empty tables, repeated rows, nulls, very long texts and columns with clashing names, for operators whose own tests lack them; a plain network."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from deltaweave.llm import ann, mixing, quality, queries, setjoin, shared, tokenfiles, toxicity, triebpe, urlfilter, warc
from deltaweave.llm.queries import quality_rules

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BPE = P.path("byte_bpe_50k.json")


def test_urls(spark):
    df = spark.createDataFrame([(1, "http://x.org/a", "h", "p", "v"), (1, "http://x.org/a", "h", "p", "v"), (None, "HTTP://X.org", None, None, None), (3, "http://x.com/de/" + "a" * 200_000, None, None, None)], "page_id long, url string, host string, path string, verdict string")
    got = sorted(((r.page_id or 0), r.host, len(r.path), r.verdict) for r in urlfilter.judge_urls(df, queries.URL_RULES).collect())
    assert got == [(0, "x.org", 0, "allow"), (1, "x.org", 2, "allow"), (1, "x.org", 2, "allow"), (3, "x.com", 200_004, "block")]
    assert urlfilter.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_archives_of_repeated_rows(spark):
    df = spark.createDataFrame([(4, "http://h/", "same", "x"), (4, "http://h/", "same", "x"), (9, None, "same", "y"), (2, "u", None, "z")], "page_id long, url string, html string, payload_digest string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(df, least_bytes=0)).collect())
    assert got == [(2, 0, "response", None), (4, 4, "revisit", 9), (4, 4, "revisit", 9), (9, 4, "response", None)]


def test_quality_of_nothing_and_of_clashing_columns(spark):
    text = " ".join(f"word{k % 70} and other things" for k in range(60))
    df = spark.createDataFrame([(1, text, "en", 5, True, "s"), (1, text, "en", 5, True, "s"), (None, None, None, None, None, None)], "doc_id long, text string, lang string, n_words int, kept boolean, script string")
    got = quality.measure_documents(df, quality_rules()).collect()
    assert [r.n_words for r in got] == [240, 240, 0] and got[0] == got[1]
    assert quality.measure_documents(df.limit(0), quality_rules()).count() == 0 and quality.keep_good(df.limit(0), quality_rules()).columns == df.columns
    long = spark.createDataFrame([(1, text * 400, "en")], "doc_id long, text string, lang string")
    assert quality.measure_documents(long, quality_rules()).first().n_words == 400 * 240 - 399


def test_tokens_of_repeated_and_missing_ids_and_of_clashing_columns(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    rows = [(3, "some text", 1, "a"), (3, "some text", 1, "a"), (3, "other", 1, "a"), (None, "no id", 1, "a"), (5, "long " * 100_000, 1, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    want = sorted((r[0] or -1, len(ids(r[1])), hashlib.sha256(np.array(ids(r[1]), "<u4").tobytes()).hexdigest()) for r in rows)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256) for r in triebpe.round_trip(df, BPE, P.PATTERN).collect()) == want
    got = tokenfiles.read_token_files(tokenfiles.write_token_files(df, BPE, P.PATTERN)).collect()
    crc = lambda t: zlib.crc32(np.array([*ids(t), 0], "<u4").tobytes())
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((r[0] or -1, len(ids(r[1])) + 1, crc(r[1])) for r in rows)
    at = sorted((r.start, r.n_tokens) for r in got)
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))


def test_scores_are_the_same_however_texts_are_dealt():
    rng, words = np.random.default_rng(7), [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 400))) for _ in range(300)]
    net = toxicity.Network.new(3)

    def scores(order, size):
        out = {}
        for k in range(0, len(order), size):
            some = order[k : k + size]
            t = toxicity.Texts.of(pa.array([texts[i] for i in some], pa.string()))
            out |= dict(zip(some, t.highest(t.logits(net)).tolist(), strict=True))
        return [out[i] for i in range(len(texts))]

    base = scores(list(range(300)), 300)
    for size in (1, 7, 64, 299):
        assert scores(rng.permutation(300).tolist(), size) == base  # to the last bit


def test_toxicity_of_nothing_and_of_contradictory_labels(spark):
    docs = spark.createDataFrame([(k, f"calm words number {k}" if k % 2 else f"vile words number {k}", 1, 0.5) for k in range(60)], "doc_id long, text string, toxic int, score double")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)] + [(k, 0) for k in range(0, 60, 4)], "doc_id long, toxic int")
    rows = sorted((r.doc_id, r.toxic) for r in toxicity.training_rows(docs, labels, 100))
    assert rows == [(k, 1 - k % 2) for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    several = docs.union(docs.where("doc_id = 2").withColumn("text", F.lit("a first")))
    assert {r.doc_id: r.text for r in toxicity.training_rows(several, labels, 100)}.get(2, "a first") == "a first"
    a, b = (sorted(map(tuple, toxicity.score_texts(docs.repartition(n), labels.repartition(n)).collect())) for n in (1, 3))
    assert a == b and len(a) == 60
    assert toxicity.score_texts(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.score_texts(docs, labels.limit(0)).collect()} == {0}


def plain_windows(n):
    """(first, last) of the windows of a text of n words: they overlap by half, and together have all words."""
    out, first = [], 0
    while True:
        out.append((first, min(n, first + toxicity.WINDOW)))
        if out[-1][1] == n:
            return out
        first += toxicity.STRIDE


def test_network_against_loops():
    rng, net = np.random.default_rng(3), toxicity.Network.new(9)
    texts = ["one two", " ".join(f"w{rng.integers(0, 50)}" for _ in range(90)), "", "Long " * 33]
    t = toxicity.Texts.of(pa.array(texts))
    vectors = net.inputs(t.keys, t.gram, t.span)
    # Each word's vector: its own, and the mean of its n-grams'.
    for k in range(len(t.keys)):
        own = [int(g) for g, s in zip(t.gram, t.span, strict=True) if s == k]
        want = net.p["words"][int(t.keys[k] % np.uint64(toxicity.WORDS))] + (np.mean([net.p["grams"][g] for g in own], axis=0) if own else 0)
        assert np.abs(vectors[k] - want).max() < 1e-5
    got, h, p = t.logits(net), toxicity.HIDDEN, net.p
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def gru(xs, d, u):
        s, out = np.zeros(h), []
        for x in xs:
            a, b = (x @ p["w"] + p["b"])[3 * h * d : 3 * h * (d + 1)], s @ u
            z, r = sigmoid(a[:h] + b[:h]), sigmoid(a[h : 2 * h] + b[h : 2 * h])
            c = np.tanh(a[2 * h :] + r * b[2 * h :])
            s = (1 - z) * c + z * s
            out.append(s)
        return out

    k, best = 0, []
    for row, text in enumerate(texts):
        n, scores = len(text.split()), []
        for first, last in plain_windows(n) if n else []:
            xs = [vectors[w] for w in t.words[k][: last - first]]
            assert int(t.mask[k].sum()) == last - first and t.row[k] == row
            states = [np.concatenate(s) for s in zip(gru(xs, 0, p["u0"]), gru(xs[::-1], 1, p["u1"])[::-1], strict=True)]
            e = np.array([np.tanh(s @ p["wa"] + p["ba"]) @ p["va"] for s in states])
            weight = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            logit = sum(w * s for w, s in zip(weight, states, strict=True)) @ p["out"] + p["bias"][0]
            assert abs(logit - got[k]) < 1e-4
            scores.append(logit)
            k += 1
        best.append(max(scores, default=-np.inf))
    assert k == len(got) and np.allclose(t.highest(got), best, atol=1e-4)


def test_words_of_windows_are_those_of_the_text():
    text = " ".join(f"w{k}" for k in range(77))
    t = toxicity.Texts.of(pa.array([text]))
    single = {w: toxicity.Texts.of(pa.array([w])).keys[0] for w in text.split()}
    for k, (first, last) in enumerate(plain_windows(77)):
        assert t.keys[t.words[k][: last - first]].tolist() == [single[f"w{j}"] for j in range(first, last)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_with_nothing_nulls_and_clashing_columns(spark, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone_id long, copies int, own_row string, own_sid long"
    good = quality.keep_good(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'"), quality_rules())
    text = good.orderBy("doc_id").first().text
    rows = [(1, text, "en", "a", 9, 1, 2, "x", 3), (1, text, "en", "a", 9, 1, 2, "x", 3), (None, None, None, None, None, None, None, None, None), (4, "", "en", None, 0, 1, 1, "y", 1)]
    df = spark.createDataFrame(rows, schema)
    out = stage(spark, df, "")
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or out.columns == df.columns
    kept = sorted((r.doc_id or 0) for r in out.collect())
    assert set(kept) <= {0, 1, 4} and 1 in kept
    assert stage(spark, df.limit(0), "").count() == 0


def test_stages_against_plain_versions(spark):
    """Secrets and mixing on real documents: what the one marks, and how often the other takes each row."""
    from deltaweave.llm import secretscan
    from tests.llm.test_table_operators import plain_findings

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    forest = secretscan.train(spark)
    got = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, docs, "").collect()}
    for d in docs.collect():
        found = plain_findings(d.text or "") if d.text else []
        score = forest.predict(np.array([x for _, _, x in found], float)) if found else []
        want = d.text
        for v in sorted({v for (_, v, _), s in zip(found, score, strict=True) if s >= 0.5}, key=lambda v: (-len(v), v)):
            want = want.replace(v, "[SECRET]")
        assert got[d.doc_id] == want
    m = {r.doc_id: r for r in mixing.taken_by_document(mixing.mix(docs)).collect()}
    times = {}
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {k: n for k, r in m.items() if r.size and (n := int(r.taken / r.size + 0.5))}


def test_tables_on_the_way_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    df = spark.createDataFrame([(k, f"a b c d e f {k % 3} g h") for k in range(30)], "doc_id long, text string")
    setjoin.similar_documents(df, setjoin.Terms(2, 60, 100)).count()
    assert [f.split("-")[0] for f in os.listdir(tmp_path)] == ["found"]
    vectors = spark.createDataFrame([(k, [float(k % 7 + 1), 1.0]) for k in range(60)], "vec_id long, embedding array<double>")
    ann.nearest(vectors).count()
    assert sorted(f.split("-")[0] for f in os.listdir(tmp_path)) == ["found", "nearest"]


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"getConf": lambda self: {}, "getCheckpointDir": lambda self: None, "master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
