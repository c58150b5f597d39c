"""Whitening, licence index and periodic runs against numpy and plain programmes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lethewise.llm import licenses, queries, runs, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


# -- whitening --------------------------------------------------------------------------------------------------------

def numpy_whitened(vectors, wanted=16):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    return n, (n * x - sums).__pow__(2).sum(1), (x - sums / n) @ u / np.sqrt(e), e / np.trace(v)


def compare(found, ids, want):
    n, deviation, whitened, explained = want
    table = found.toPandas()
    assert set(table["n"]) == {n} and table["identity_error"].max() < 1e-9
    assert len(table) == len(ids) * len(explained)
    for k in range(len(explained)):
        mine = table[table["component"] == k + 1].sort_values("vec_id")
        assert mine["vec_id"].tolist() == ids and mine["deviation"].tolist() == deviation.tolist()
        sign = np.sign((mine["whitened"].to_numpy() * whitened[:, k]).sum())
        assert np.abs(sign * mine["whitened"].to_numpy() - whitened[:, k]).max() < 1e-7
        assert np.abs(mine["explained"] - explained[k]).max() < 1e-12


def test_whole_table_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    compare(queries.op11_whitened(spark, SF), [r.vec_id for r in rows], numpy_whitened([r.embedding for r in rows]))


def test_few_directions_do_where_the_spectrum_falls(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 60)) * 2.0 ** -np.arange(60)[None] * 1e3
    x = np.concatenate([x, np.repeat(x[:1], 300, axis=0)])  # a hot vector counts once
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, v array<double>").repartition(5)
    fit = whiten.Fit(whiten.prepared(df, "v"), "v")
    assert fit.n == 900 and not whiten.components(fit, 3)[2] and whiten.components(fit, 40)[2]
    compare(whiten.whiten(df, "v", 3), list(range(1200)), numpy_whitened(x, 3))


def test_vectors_that_go(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (None, [2.0, 0.0]), (7, [0.5, 0.25]), (8, [1e300, -1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("mine")).withColumn("Whitened", F.lit(1)).withColumn("_x", F.lit("own"))
    got = whiten.whiten(df).collect()
    assert sorted({r.vec_id for r in got}, key=str) == [1, 7, 8, None] and {r["_x"] for r in got} == {"own"}
    assert len([r for r in got if r.vec_id == 1]) == 2 * len([r for r in got if r.vec_id == 7])
    assert [r.deviation for r in got if r.vec_id == 8][0] is None
    assert got[0].asDict().keys() == {"vec_id", "_x", *whiten.ADDED}
    assert whiten.whiten(df.limit(0)).count() == 0 and whiten.whiten(df.where("vec_id in (1, 3)")).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    assert {r.component for r in whiten.whiten(line).collect()} == {1}
    with pytest.raises(ValueError, match="lengths"):
        whiten.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_deviations_are_exact():
    rng = random.Random(1)
    x = np.array([[1_000_000 + rng.randint(-900, 900) for _ in range(4)] for _ in range(50)])
    for n in (7, 10**6, 10**11, 10**16):
        sums = np.array([n * 1_000_000 + rng.randint(-10 * n, 10 * n) for _ in range(4)], object)
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums.tolist(), strict=True)) for r in x]
        assert whiten.deviations(x, n, sums) == [v if v < 1 << 63 else None for v in want]


# -- licences ---------------------------------------------------------------------------------------------------------

def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    w, found = plain_words(text), []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return found


def notice(t, style):
    words = t[1].split(" ")
    if style == "comment":
        return "\n".join(" * " + " ".join(words[k : k + 9]) for k in range(0, len(words), 9))
    return " ".join(words).upper() if style == "upper" else " ".join(words)


def test_every_notice_is_found(spark):
    rng = random.Random(4)
    rows = []
    for k, t in enumerate(licenses.TEMPLATES):
        filler = " ".join(rng.choices("lorem ipsum dolor sit amet the of any free".split(), k=200))
        rows += [(3 * k + j, f"{filler} {notice(t, style)} {filler}") for j, style in enumerate(("plain", "comment", "upper"))]
    both = " ".join(notice(t, "plain") + " and more" for t in licenses.TEMPLATES[:10])
    torn = " ".join(w for i, w in enumerate(licenses.TEMPLATES[0][1].split()) if i % 4)
    rows += [(1000, both), (1001, torn), (1002, "permission is hereby granted free of charge")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, t in enumerate(licenses.TEMPLATES):
        for j in range(3):
            r = got[3 * k + j]
            assert t[0] in r.labels and r.licence_score == 1.0, (t[0], j)
            span = [s for s in r.licence_spans if s.label == t[0] and not s.base][0]
            assert plain_words(rows[3 * k + j][1])[span.start : span.end] == plain_words(t[1])
    assert {t[0] for t in licenses.TEMPLATES[:10]} <= set(got[1000].labels)
    assert got[1001].labels == [] and got[1002].labels == []


def test_words_put_in_and_taken_out(spark):
    text = licenses.TEMPLATES[2][1].replace("binary forms", "binary forms of any kind")
    got = licenses.scan(spark.createDataFrame([(1, text), (2, text.split(" ", 1)[1])], SCHEMA)).orderBy("doc_id").collect()
    assert got[0].labels == ["bsd"] and 0.3 < got[0].licence_score < 1
    assert got[1].labels == []  # a mandatory phrase lacks its first word


words_of_phrases = st.lists(st.sampled_from(["mit", "MIT", "license", "License", "apache", "general", "public", "x", "é", "licensé"]), max_size=30)


@settings(max_examples=12, deadline=None)
@given(st.lists(words_of_phrases, min_size=30, max_size=40), st.sampled_from([" ", "  ", "\n* ", ", "]))
def test_base_phrases_against_brute_force(spark, texts, between):
    rows = [(i, between.join(w)) for i, w in enumerate(texts)]
    for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect():
        want = plain_base(rows[r.doc_id][1])
        assert sorted((s.start, s.label) for s in r.licence_spans if s.base) == sorted(want)
        assert r.base_labels == sorted({x for _, x in want}) and set(r.base_labels) <= set(r.labels) and 0 <= r.licence_score <= 1
        assert r.n_words == len(plain_words(rows[r.doc_id][1]))


def test_licence_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "The MIT License"), (4, "mit license " * 30_000), (5, "license " * 50_000 + "general public license"), (6, "Kelvin İ mité license")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("Labels", F.lit("mine")).withColumn("_w", F.lit(7)).withColumn("n_words", F.lit(None).cast("int"))
    got = licenses.scan(df).collect()
    assert len(got) == 7 and {r["_w"] for r in got} == {7}
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_words == 0 and by_id[1].licence_spans == [] and by_id[1].labels == [] and by_id[1].licence_score == 0
    assert by_id[None].base_labels == ["mit"] and by_id[None].licence_score == 0.5
    assert len(by_id[4].licence_spans) == 30_000 and [(s.start, s.label) for s in by_id[5].licence_spans] == [(50_000, "gpl")]
    assert by_id[6].n_words == 4 and by_id[6].labels == []
    assert licenses.scan(df.limit(0)).count() == 0


def test_no_python_in_the_licence_query(spark):
    plan = queries.op12_licence_index(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


# -- periodic runs ----------------------------------------------------------------------------------------------------

def plain_runs(w, least=12):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - start >= max(least, 2 * p):
                found.setdefault((start, i + p), p)
            i += 1
    return sorted((a, b - a, p) for (a, b), p in found.items())


def plain_tail(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    w = plain_tail(doc_id, [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x])
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    )


def test_whole_table_of_runs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, SF).collect()))
    assert got == sorted(plain_row(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 10


@st.composite
def repetitive(draw):
    w = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 3, 40]))), max_size=90))
    for _ in range(draw(st.integers(0, 3))):
        if len(w) > 3:
            a, p = draw(st.integers(0, len(w) - 2)), draw(st.integers(1, 12))
            for i in range(a, draw(st.integers(a, len(w)))):
                w[i] = w[a + (i - a) % p]
    return w


@settings(max_examples=300, deadline=None)
@given(st.lists(repetitive(), min_size=1, max_size=8), st.sampled_from([12, 20]), st.sampled_from([40, 1 << 17]), st.sampled_from([50, 1 << 20]))
def test_runs_against_brute_force(texts, least, group, pairs):
    before = runs.GROUP_WORDS, runs.PAIRS
    runs.GROUP_WORDS, runs.PAIRS = group, pairs
    try:
        got = runs.runs_of(np.array([x for w in texts for x in w], np.int64), np.array([len(w) for w in texts], np.int64), least)
    finally:
        runs.GROUP_WORDS, runs.PAIRS = before
    assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, w in enumerate(texts) for r in plain_runs(w, least)]


def test_extensions():
    rng = random.Random(2)
    texts = [[rng.randrange(2) for _ in range(n)] for n in (1, 30, 64, 5)] + [[7] * 33]
    words, number = np.array([x for w in texts for x in w]), np.repeat(np.arange(5), [len(w) for w in texts])
    found, at = runs.Extensions(words, number), 0
    for w in texts:
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                want = next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j)
                assert found.of(np.array([at + i]), np.array([at + j]))[0] == want
        at += len(w)


def test_run_edges(spark):
    rows = [(1, None), (2, ""), (2, " \n\t "), (3, "a b " * 6), (3, "a b " * 6), (None, "x y z " * 20), (4, "a b c d e f " * 10 + "g " * 12), (5, "z " * 300_000), (6, "word " * 11)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("RUNS", F.lit(1)).withColumn("collapsed", F.lit("mine")).withColumn("n", F.lit(3))
    got = runs.find(df).collect()
    assert len(got) == 9 and {r.n for r in got} == {3} and got[0].asDict().keys() == {"doc_id", "n", "runs", "collapsed"}
    by_id = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in got}
    assert by_id[1] == by_id[2] == ([], "")
    assert by_id[3] == ([(0, 12, 2)], "a b") and by_id[None] == ([(0, 60, 3)], "x y z")
    assert by_id[4] == ([(0, 60, 6), (60, 12, 1)], "a b c d e f g") and by_id[5] == ([(0, 300_000, 1)], "z") and by_id[6] == ([], "word " * 10 + "word")
    assert runs.find(df.limit(0)).count() == 0
    clean = runs.collapse(df).collect()
    assert clean[0].asDict().keys() == set(df.columns) and {r.doc_id: r.text for r in clean}[3] == "a b" and {r["collapsed"] for r in clean} == {"mine"}
    assert queries.periodic_tails(df.select("doc_id", "text")).count() == 9

