"""Spelling variants, branch merges and the multi-index join against plain loops."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deltaweave.llm import branchmerge, multiindex, queries, setjoin, spelling
from tests.llm.test_table_operators import plain_components


def edits(w, alphabet):
    """All strings one edit away."""
    out = {w[:k] + w[k + 1 :] for k in range(len(w))}
    out |= {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in alphabet}
    out |= {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in alphabet}
    return out - {w}


@pytest.mark.parametrize("word", ["aaa", "abcabc", "zzyzzy", "éclair"])
def test_neighbourhoods_are_whole_and_distinct(word):
    alphabet = sorted(set(word) | set("abé"))
    letters = spelling.Letters(alphabet)
    made = []
    for kind, h, distinct in letters.neighbours(letters.rows([word])):
        for x in np.argwhere(distinct).tolist():
            new = spelling._edited(word, kind, x[1], alphabet[x[2]] if len(x) > 2 else "")
            assert letters.hashes(letters.rows([new]))[0] == h[tuple(x)]
            made.append(new)
    assert len(made) == len(set(made)) and set(made) == edits(word, alphabet)


def plain_variants(rows, rules):
    import re

    counts = {}
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % rules.slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= rules.letters and n >= rules.occurrences}
    alphabet = sorted({c for w in words for c in w})
    near = {w: sorted((-words[x], x) for x in edits(w, alphabet) if x in words) for w in words}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= rules.ratio * words[w] else None for w in words}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n, form[w] or "", root(w), len(near[w]), words.get(form[w], 0)) for w, n in words.items())


def test_spelling_variants(spark):
    rng = random.Random(3)
    stems = ["letter", "lettre", "Planets", "écharpe", "aaaaaa", "receive", "überall"]
    rows = []
    for d in range(60):
        words = [rng.choice(stems) for _ in range(120)]
        for k in range(0, 120, 6):
            w = words[k]
            words[k] = rng.choice(sorted(edits(w, "abeé")))
        rows.append((d if d % 9 else None, " ".join(words), "x"))
    rows += [(d, "linkone " * 200 + "linkoney " * 30 + "linkoneyz " * 5, None) for d in range(200, 205)]
    rows += [(5, None, None), (6, "", None), (7, "123 ... short", None), (7, "letter " * 50_000, None), (7, "letter " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    rules = spelling.Spelling(slip=7)
    for bits in (26, 8):  # 8: nearly every candidate passes the map
        got = spelling.spelling_variants(df, spelling.Spelling(slip=7, map_bits=bits)).collect()
        assert sorted((r.word, r.n, r.form or "", r.root, r.n_near, r.form_n or 0) for r in got) == plain_variants([r[:2] for r in rows], rules)
    assert any(r.form and r.root != r.form for r in got), "a chain of two forms"
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def plain_merge(base, left, right):
    """base: lines; left, right: {at: (kind, value)} and {at: inserted}; the text, and counts by kind."""
    out, n = [], dict.fromkeys(branchmerge.COUNTS, 0)
    for i in range(-1, len(base)):
        a, b = left[0].get(i), right[0].get(i)
        if a or b:
            n["n_clean" if not (a and b) or a == b else "n_edit_edit" if a[0] == b[0] == "replace" else "n_edit_delete"] += 1
        now = b or a
        if i >= 0 and (now is None or now[0] == "replace"):
            out.append(now[1] if now else base[i])
        a, b = left[1].get(i), right[1].get(i)
        if a or b:
            n["n_clean" if not (a and b) or a == b else "n_insert_insert"] += 1
            out.append(b or a)
    return "\n".join(out), tuple(n.values())


def test_operations_of_two_branches(spark):
    rng = random.Random(11)
    rows, flat, want = [], ([], []), []
    for d in range(40):
        base = [rng.choice(["", "one", "two"]) for _ in range(rng.randrange(1, 9))]
        rows.append((d, "\n".join(base)))
        plain = []
        for side in range(2):
            lines, gaps = {}, {}
            for i in range(-1, len(base)):
                if i >= 0 and rng.random() < 0.4:
                    lines[i] = rng.choice([("delete", None), ("replace", "one"), ("replace", "x")])
                    flat[side].append((d, i, *lines[i]))
                if rng.random() < 0.3:
                    gaps[i] = rng.choice("uv")
                    flat[side].append((d, i, "insert", gaps[i]))
            plain.append((lines, gaps))
        want.append((d, *plain_merge(base, *plain)))
    flat[0].extend([(99, 0, "delete", None), (3, 1000, "delete", None)])  # neither is there
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, ops in zip(("l", "r"), flat, strict=True):
        df = branchmerge.operations(df, spark.createDataFrame(ops, "doc_id long, at int, kind string, value string"), "doc_id", "text", name)
    for name, ops in (("left", "l"), ("right", "r")):
        df = df.withColumn(name, F.struct(F.lit(False).alias("deletes"), F.struct(F.lit(0).alias("none")).alias("columns"), F.col(ops).alias("lines"), F.array().cast("array<struct<doc_id:long,text:string>>").alias("adds")))
    got = branchmerge.merge(df, columns=()).collect()
    assert sorted((r.doc_id, r.text, tuple(r[c] for c in branchmerge.COUNTS)) for r in got) == sorted(want)


def plain_coded(rows):
    code = lambda b, d, name: zlib.crc32(f"{b}:{'' if d is None else d}:{name}".encode()) % 7
    out = []
    for d, lang, source, text in rows:
        base = {"lang": lang or "", "source": source or ""}
        lines = (text or "").split("\n")
        state, added = {}, {}
        for b in "LR":
            row = code(b, d, "row")
            mark = {0: lambda v: "", 1: lambda v: v + "!", 2: lambda v: v + "?"}
            columns = {c: mark.get(code(b, d, c), lambda v: v)(v) for c, v in base.items()}
            changes, gaps = {}, {}
            for i, line in enumerate(lines):
                c = code(b, d, i)
                if c == 0:
                    changes[i] = ("delete", None)
                elif c in (1, 2):
                    changes[i] = ("replace", line + "?!"[c % 2])
                elif c in (3, 4):
                    gaps[i] = "?!"[c % 2]
            state[b] = (row == 0, columns, (changes, gaps))
            if row in (3, 4):
                added[b] = "?!"[row % 2]
        (lx, lc, lo), (rx, rc, ro) = state["L"], state["R"]
        touched = {b: state[b][1] != base or any(state[b][2]) for b in "LR"}
        if lx or rx:
            dispute = lx != rx and touched["R" if lx else "L"]
            n = (0, 0, 1, 0) if dispute else (1, 0, 0, 0)
            now = (*rc.values(), plain_merge(lines, ({}, {}), ro)[0]) if dispute and lx else (None, None, None)
        else:
            whole, n = plain_merge(lines, lo, ro)
            n = list(n)
            values = []
            for c, v in base.items():
                a, b = lc[c] != v, rc[c] != v
                if a or b:
                    n[1 if a and b and lc[c] != rc[c] else 0] += 1
                values.append(rc[c] if b else lc[c])
            now = (*values, whole)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out.append((d, now[0], now[1], None if now[2] is None else sha(now[2]), *n))
        if added:
            clash = len(set(added.values())) == 2
            out.append((None if d is None else -1 - d, *base.values(), sha(added.get("R", added.get("L"))), int(not clash), 0, 0, int(clash)))
    return sorted(out, key=str)


def test_coded_branches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(d, rng.choice(["en", None, ""]), rng.choice(["s", None]), rng.choice([None, "", "\n", "a\n\nb", "x" * 10, "\n".join(str(k) for k in range(rng.randrange(30)))])) for d in range(300)]
    rows += [(7, "en", "s", "again\nand again"), (7, "en", "s", "again\nand again"), (None, None, None, None), (None, "en", "s", "no id"), (-3, "en", "s", "below zero"), (1000, "en", "s", "line\n" * 20_000)]
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], "doc_id long, lang string, source string, text string, left string, n_clean int, id string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_branch_merge(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == plain_coded(rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op12_branch_merge(spark, f"{tmp_path}/none").count() == 0


SMALL = multiindex.Signature(values=24, bits=2, chunk=4, errors=1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=24, max_size=24), st.dictionaries(st.integers(0, 23), st.integers(0, 3), max_size=SMALL.radius))
def test_every_pair_within_the_radius_shares_a_list(values, changes):
    x, y = np.array(values, np.uint8), np.array(values, np.uint8)
    for k, v in changes.items():
        y[k] = v
    a, b = SMALL.keys(np.stack([x, y]))
    assert (x != y).sum() <= SMALL.radius and set(a.tolist()) & set(b.tolist())
    assert SMALL.first_shared(x[None], y[None])[0] == next(p for p, q in zip(a.tolist(), b.tolist(), strict=True) if p == q)
    assert len(set(a.tolist())) == len(a) == SMALL.chunks * 4


def test_signatures_tell_similarity():
    sign = multiindex.Signature()
    assert sign.radius == 31 and sign.missed(0.85) < 1e-5 and sign.missed(0.9) < sign.missed(0.85)
    rng = np.random.default_rng(2)
    far = []
    for _ in range(40):
        base = rng.integers(1, 1 << 63, 2000, dtype=np.uint64)
        other = np.unique(np.concatenate([base[: 2000 - 81], rng.integers(1, 1 << 63, 81, dtype=np.uint64)]))  # some 0.92 alike
        x, y = (np.frombuffer(s, np.uint8) for s in sign.signatures([base, other]))
        far.append((x != y).sum())
    assert abs(np.mean(far) / sign.values - 0.078) < 0.012 and max(far) <= sign.radius
    assert sign.signatures([np.empty(0, np.uint64)]) == [None]
    for wrong in ({"values": 95}, {"errors": 6}, {"chunk": 16}):
        with pytest.raises(ValueError):
            multiindex.Signature(**wrong)


def test_multiindex_join(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(4, 200))]
        for _ in range(rng.randrange(1, 30)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    wide = [f"v{k}" for k in range(530)]  # sets on both sides of the width of the common sketch
    rows += [(len(rows) + k, " ".join(wide[: 530 - 5 * k])) for k in range(8)]
    rows += [(900, None), (901, ""), (902, "two words"), (903, "TWO words"), (904, "long text here " * 30_000), (905, "long text here " * 30_000)]
    terms = setjoin.Terms(n=3, num=85, den=100)
    df = spark.createDataFrame([(*r, True, 0) for r in rows], "doc_id long, text string, kept boolean, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in multiindex.near_duplicates(df, terms).collect()}
    assert got == plain_components(rows, terms)
    assert all(r.kept == (r.doc_id == r.component_id) for r in multiindex.near_duplicates(df, terms).collect())
    odd = spark.createDataFrame([(None, "some words of a text"), (None, "some words of a text"), (4, "some words of a text"), (4, "some words of a text"), (4, "else")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in multiindex.near_duplicates(odd, terms).collect()) == [("4", 4, True)] * 3 + [("None", 4, True)] * 2
    assert multiindex.near_duplicates(df.limit(0), terms).count() == 0
