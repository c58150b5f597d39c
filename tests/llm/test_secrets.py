"""Secret scans: base spans against the plain regular expressions over a whole table, the battery, and redaction."""

import random
import re
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from lethewise.llm import secrets

SCHEMA = "doc_id long, text string"
EDGES = [(1, "Some plain words."), (1, "Some plain words."), (2, None), (3, ""), (None, "null id"), (5, "x" * 200_000), (6, " \n\t ")]
BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def plain_spans(text):
    """The base spans as the contract states them."""
    text, out = text or "", []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for rank, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24)):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_base_spans_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(3)
    parts = ["password", "Token", "API_KEY", "apikey", "passwd", "secret", ": ", "=", " = ", "'", '"', "AKIA", "ABCD1234EFGH5678", "é", "日本", " ", "\n", "abcdef0123456789", "deadbeef" * 3, "x.y-z/+", "K", "K", "ſecret"]
    made = [(10_000 + i, "".join(rng.choices(parts, k=rng.randint(1, 30)))) for i in range(600)]
    docs = docs.unionByName(spark.createDataFrame([*made, *EDGES], SCHEMA))
    rows = secrets.scan(docs).collect()
    assert len(rows) == docs.count() and sum(bool(r.secret_spans) for r in rows) > 300
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.secret_spans if s.kind != "random"] == plain_spans(r.text)
        assert r.secret_spans == sorted(r.secret_spans, key=lambda s: (s.start, secrets.KINDS.index(s.kind)))


def test_noise_is_found_beside_base_spans(spark):
    rng = random.Random(4)
    noise = ["".join(rng.choices(BASE62 + "+/", k=44)) for _ in range(3)]
    hexes = "0123456789abcdef" * 2
    rows = [(1, f"é key {noise[0]} end"), (2, f"see {hexes}/{noise[1]} AKIA{'A1' * 9}/{noise[2]}"), (3, "deadbeef" * 4), (4, "Api-Key: x apiKEY:'abcdef'"), (5, "internationalizationandlocalization abcdefghijklmnopqrstuvwxyz"), *EDGES]
    rows += [(100 + i, " ".join("".join(rng.choices(["the", "and", "ing", "tion", "er", "re", "in"], k=9)) for _ in range(3))) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("_base", "_found", "Secret_Spans", "family"):
        docs = docs.withColumn(name, F.lit("mine"))
    found = secrets.scan(docs).collect()
    assert found[0].asDict().keys() == {"doc_id", "text", "_base", "_found", "family", "secret_spans"} and all(r._base == r._found == r.family == "mine" for r in found)
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append([(s.kind, s.start, s.end) for s in r.secret_spans])
    assert got[1][0] == [("random", 6, 50)]
    assert [k for k, _, _ in got[2][0]] == ["hex", "random", "access", "random"]
    assert [rows[1][1][s:e].strip("/") for k, s, e in got[2][0] if k == "random"] == noise[1:]
    assert got[3][0] == [("hex", 0, 32)] and got[4][0] == [("assign", 11, 25)]
    assert not any(got[5][0]) and not any(x for i in got if i is None or i >= 100 for x in got[i])
    marked = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert marked[1].text in ("é key [SECRET] end", "Some plain words.") and marked[1].Secret_Spans == "mine"
    assert secrets.redact(docs).where("text = 'é key [SECRET] end'").count() == 1
    assert secrets.scan(docs.limit(0)).count() == 0 and secrets.redact(docs.limit(0)).columns == docs.columns


def test_candidates_are_what_spans_leave():
    run = b"A" * 30 + b"B" * 25 + b"C" * 30
    assert list(secrets.candidates(run, [(30, 55, "hex")])) == [(0, 30), (55, 85)]
    assert list(secrets.candidates(run, [(10, 20, "hex"), (15, 40, "hex"), (45, 60, "assign")])) == [(60, 85)]
    assert list(secrets.candidates(run, [])) == [(0, 85)]
    assert list(secrets.candidates(b"x " + run + b" " + run, [(0, 3, "hex"), (80, 90, "hex")])) == [(3, 80), (90, 173)]


def test_tails():
    for n, p, k in ((30, 0.12, 9), (30, 0.12, 2), (25, 0.62, 20), (8, 0.5, 8), (8, 0.5, 9), (8, 0.5, 0)):
        assert secrets.binomial_tail(n, p, k) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)), rel=1e-9, abs=1e-12)
    assert secrets.binomial_tail(4999, 0.12, 300) == pytest.approx(1)
    assert secrets.chi_squared_tail(9.210340371976182, 2) == pytest.approx(0.01)
    assert secrets.chi_squared_tail(13.276704135987622, 4) == pytest.approx(0.01)
    assert secrets.chi_squared_tail(37.56623, 25) == pytest.approx(0.051, abs=0.002)


def test_battery_tells_noise_from_words():
    rng = random.Random(9)
    assert secrets.battery(b"abcdefghijklmnopqrstuvwxyz0123456789")[1] == 1.0
    for words in (b"getUserAccountInformationByIdentifier", b"counterrevolutionariesandothers", b"11111111111111111111111", b"2024-01-01-2024-02-02-2024", b"ACEGIKMOQSUWYACEGIKMOQSUWY", b"/usr/local/lib/python3/dist-packages/numpy/core/tests/data"):
        assert secrets.battery(words)[1] > 1e-4
    joined = ["the", "and", "house", "people", "water", "number", "value", "list", "index", "server", "report", "account", "Name", "User", "Get"]
    ordinary = [secrets.battery("".join(rng.choice(joined) + rng.choice(["", "", "-", "_", "/", "2"]) for _ in range(9)).encode())[1] for _ in range(1000)]
    assert np.quantile(ordinary, 0.01) > 1e-3
    base = Counter((secrets.family(40), secrets._bin(p)) for p in ordinary)
    for name, alphabet in secrets.ALPHABETS[1:]:
        caught = 0
        for _ in range(60):
            own = secrets.family(40), secrets._bin(secrets.battery(bytes(rng.choices(alphabet, k=40)))[1])
            counts = base + Counter([own])
            caught += own[1] >= secrets.thresholds([(f, b, n) for (f, b), n in counts.items()]).get(own[0], 1 << 30)
        assert caught >= 45, (name, caught)
    assert secrets.thresholds([(6, 1000, 3), (6, 0, 1000)], 0.001) == {6: 1000}
    assert secrets.thresholds([(6, 0, 1000)], 0.001) == {}
