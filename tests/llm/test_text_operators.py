"""Tokens, quality, toxicity and files against plain versions of the same."""

import hashlib
import io
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from deltaweave.llm import quality, tokenfiles, toxicity, triebpe, words
from deltaweave.llm.queries import quality_rules

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BPE = P.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\n\n", "é", "×", "ʰ", "中", " ", "　", "\x1c", "'s", " 's", "don't", "1", "23", "<|endoftext|>", "the", "ing", "!", "\t", "🙂", "-----", "Word", " word", "ß", "\r\n"]


def texts(n=1500, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["", None, "x" * 3000, " " * 300, "<|endoftext|>", "a <|endoftext|>  b"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@pytest.mark.parametrize("encoder", [lambda: triebpe._coder(BPE, P.PATTERN)[1], lambda: tokenfiles.library_encoder(BPE, P.PATTERN)])
def test_ids_are_the_library_s(library, encoder):
    t = texts()
    ids, at = encoder().rows(pa.array(t))
    for k, e in enumerate(library.encode_batch([x or "" for x in t], add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == e.ids, repr(t[k])


def test_round_trip_query(spark, library):
    t = texts(60)
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").withColumnRenamed("text", "text").repartition(3)
    rows = {r.doc_id: r for r in triebpe.round_trip(df, BPE, P.PATTERN).collect()}
    for k, e in enumerate(library.encode_batch([x or "" for x in t], add_special_tokens=False)):
        assert rows[k].n_tokens == len(e.ids)
        assert rows[k].ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    assert triebpe.round_trip(df.limit(0), BPE, P.PATTERN).count() == 0
    ids = {r.doc_id: r.ids for r in triebpe.encode_texts(df, BPE, P.PATTERN).collect()}
    assert len(ids[2]) == rows[2].n_tokens


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes(kind):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert (tokenfiles.from_planes(tokenfiles.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_file(kind):
    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    rng, out = np.random.default_rng(2), io.BytesIO()
    w = tokenfiles.TokenWriter(out, kind, chunk=64)
    docs = [rng.integers(0, 50257, n).astype(np.uint32) for n in (1, 200, 64, 3, 500)]
    for k, d in enumerate(docs):
        w.add(np.array([k]), np.array([len(d)]), d)
    assert w.close()[:2] == (5, sum(map(len, docs)))
    r = tokenfiles.TokenReader(File(out.getvalue()))
    assert list(r.checksums()) == [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
    assert (r.chunk(2) == np.concatenate(docs)[128:192]).all()
    with pytest.raises(Exception):
        tokenfiles.TokenReader(File(out.getvalue()[:-3]))


def test_token_files_query(spark, library):
    t = texts(80)
    df = spark.createDataFrame([(1000 - k, x, "other") for k, x in enumerate(t)], "doc_id long, text string, start string")
    got = sorted(tokenfiles.read_token_files(tokenfiles.write_token_files(df, BPE, P.PATTERN)).collect())
    at = 0
    for r, text in zip(got, reversed(t), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(df.limit(0), BPE, P.PATTERN)).count() == 0


def test_word_hashes_and_bounds():
    t = ["one two  one\n\ttwo", "", None, "\x0b", "ONE é", "x"]
    data, at = words.text_bytes(pa.array(t))
    s, e, before = words.bounds(data, at)
    got = [bytes(data[a:b]).decode() for a, b in zip(s, e, strict=True)]
    assert got == ["one", "two", "one", "two", "ONE", "é", "x"] and np.diff(before).tolist() == [4, 0, 0, 0, 2, 1]
    h = words.hashes(data, s, e, lower=True)
    assert h[0] == h[2] == h[4] != h[1] and len(set(h.tolist())) == 4


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_quality_counts():
    r = random.Random(4)
    t = ["".join(r.choice(["a ", "b ", "c", "\n", "é ", "#", "中", "\r\n", " ", "the cat\n"]) for _ in range(r.randint(0, 120))) for _ in range(400)] + [None, "", "a a a a", "x\nx\n\n\n \nx"]
    m = quality.measure(pa.array(t), quality_rules())
    for k, x in enumerate(t):
        assert tuple(int(m[n][k]) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_counts(x), repr(x)


def test_fertility_against_plain_encoding():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    t = ["the quick brown fox " * 20, "Привет мир " * 10, "中文 字 " * 9]
    m = quality.measure(pa.array(t), quality_rules())
    for k, x in enumerate(t):
        ids = [i for w in x.split() for i in sp.encode(w)]
        c = np.array(list(Counter(ids).values())) / len(ids)
        assert abs(m["chars_per_piece"][k] - sum(map(len, x.split())) / len(ids)) < 1e-9
        assert abs(m["byte_share"][k] - np.mean([sp.is_byte(i) for i in ids])) < 1e-9
        assert abs(m["entropy"][k] + (c * np.log2(c)).sum()) < 1e-9
    assert [list(quality.SCRIPTS)[s] for s in m["script"]] == ["latin", "cyrillic", "cjk"]


def test_quality_verdicts(spark):
    r = random.Random(5)
    prose = " ".join(r.choice("the of and to in is that for it was on are with they be at one have this from".split()) + r.choice(["", "", "ing", "er"]) for _ in range(120))
    noise = " ".join("".join(r.choice("\x01\x02\x03͸΀") for _ in range(8)) for _ in range(120))
    df = spark.createDataFrame([(1, prose, "en"), (2, noise, "en"), (3, "too short", None), (4, "go on now " * 60, "en"), (5, None, None)], "doc_id long, text string, lang string")
    got = {x.doc_id: (x.base_failed, x.kept) for x in quality.measure_documents(df, quality_rules()).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (True, False), 4: (True, False), 5: (True, False)}
    assert [x.doc_id for x in quality.keep_good(df, quality_rules()).collect()] == [1]


def test_bands_reject_mashing_and_symbols_and_leave_prose():
    import pyarrow.parquet as pq

    r = random.Random(11)
    typed = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(200))
    prose = ["The committee met on Tuesday to discuss the budget and agreed that further work was needed before any decision. ", "Der Ausschuss traf sich am Dienstag, um den Haushalt zu besprechen, und war sich einig, dass weitere Arbeit nötig sei. ", "Le comité s'est réuni mardi pour discuter du budget et a convenu que des travaux supplémentaires étaient nécessaires. ", "Komisja spotkała się we wtorek, aby omówić budżet, i zgodziła się, że przed podjęciem decyzji potrzebna jest praca. "]
    junk = [typed("asdfghjkl"), typed("abcdefghijklmnopqrstuvwxyz"), typed("abcdefgh#$%&*|"), " ".join(bytes(r.randrange(256) for _ in range(9)).hex() for _ in range(100))]

    def good(texts, langs):
        m = quality.measure(pa.array(texts), quality_rules())
        return quality.judge({k: v if k != "n_words" else v + 50 for k, v in m.items()} | {"n_repeat_words": 0 * m["n_words"]}, langs, quality_rules())[1]

    assert not good(junk, [None] * 4).any() and not good(junk, ["en"] * 4).any()
    assert good(prose, ["en", "de", "fr", "pl"]).all() and good(prose, [None] * 4).all()
    # On labelled documents that pass the base rules: nearly all good ones stay, and the bands decide on the bad ones.
    docs, labels = (pq.read_table(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    marks = dict(zip(labels["doc_id"].to_pylist(), labels["quality"].to_pylist(), strict=True))
    docs = docs.slice(5000)
    y = np.array([marks.get(d, -1) for d in docs["doc_id"].to_pylist()])
    text = docs["text"].combine_chunks()
    failed, kept = quality.judge(quality.measure(text, quality_rules()), docs["lang"].to_pylist(), quality_rules())
    assert kept[~failed & (y == 1)].mean() > 0.99 and kept[~failed & (y == 0)].mean() < 0.8


def test_toxicity_gradients():
    rng, net = np.random.default_rng(0), toxicity.Network.new()
    net.p = {k: v if k in ("words", "grams") else v.astype(float) for k, v in net.p.items()}
    x, w = rng.standard_normal((9, toxicity.WIDTH)) / 2, rng.integers(0, 9, (4, toxicity.WINDOW))
    mask, y, weight = np.arange(toxicity.WINDOW) < np.array([[32], [5], [1], [20]]), np.array([1, 0, 1, 0.0]), np.array([1, 2, 1, 0.5])
    g, _, _ = net.gradients(x, w, mask, y, weight)

    def loss():
        p = toxicity.sigmoid(net.forward(x, w, mask))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    for name in ("w", "u0", "u1", "wa", "va", "out", "bias"):
        a = net.p[name]
        at = tuple(rng.integers(0, s) for s in a.shape)
        old = a[at]
        a[at] = old + 1e-3
        up = loss()
        a[at] = old - 1e-3
        assert abs((up - loss()) / 2e-3 - g[name][at]) < 1e-4, name
        a[at] = old


def test_toxicity_learns_words_it_has_seen_in_other_forms(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    bad = lambda: "zork" + r.choice(["el", "ix", "um", "ath"]) + r.choice("xyz")

    def text(toxic):
        t = [word() for _ in range(r.randint(20, 150))]
        for _ in range(3 * toxic):
            t[r.randrange(len(t))] = bad()
        return " ".join(t)

    rows = [(k, text(k % 2), k % 2) for k in range(500)]
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, ""), (902, "  ")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_texts(df, labels, bound=200).collect()}
    assert len(got) == 503 and all(got[k].score == 0.0 for k in (900, 901, 902))
    held = [k for k, _, _ in rows if got[k].held_out]
    assert held == [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k].predicted == k % 2 for k in held]) >= 0.95
    flat = toxicity.score_texts(df, labels.where("toxic = 0")).collect()
    assert {x.score for x in flat} == {0.0}


def test_bands_fitted_to_labelled_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rules = quality_rules()
    bands = quality.fit_bands(docs, labels, rules)
    assert {(lang, "latin") for lang in quality.FITTED} <= set(bands)
    for lang, (_, limit) in quality.FITTED.items():
        assert abs(bands[lang, "latin"].least_byte_chars - limit) < 0.25
    own = quality.Rules(rules.piece_model, rules.byte_ranks, rules.pattern, languages=bands)
    found = quality.measure_documents(docs, own).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg({"*": "count", "kept": "max"}).collect()
    kept = {r.quality: r.n for r in quality.measure_documents(docs, own).where("kept").join(labels, "doc_id").groupBy("quality").count().withColumnRenamed("count", "n").collect()}
    whole = {r.quality: r["count(1)"] for r in found}
    assert kept[1] == whole[1] and kept.get(0, 0) < whole[0]
    assert quality.fit_bands(docs.limit(0), labels, rules) == {} and quality.fit_bands(docs, labels, rules, least_texts=10**9) == {}
