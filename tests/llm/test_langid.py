"""Language identification: its sample, its n-grams and scores against a plain programme, held-out accuracy, rejection."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lethewise.llm import langid, textbuf

EDGES = [(1, "Some plain words."), (1, "Some plain words."), (2, None), (3, ""), (None, "null id"), (5, "x" * 200_000), (6, " \n\t ")]


def test_sample_of_copies(spark):
    few = spark.range(6000).select(F.concat(F.lit("copied text "), F.element_at(F.array(*map(F.lit, "abcdefgh")), (F.col("id") % 3 + 1).cast("int"))).alias("text"), F.lit("xx").alias("lang"))
    many = spark.range(3000).select(F.concat(F.lit("text of its own "), F.col("id").cast("string")).alias("text"), F.lit("yy").alias("lang"))
    hot = spark.range(3000).select(F.lit("one hot text").alias("text"), F.lit("yy").alias("lang"))
    rows = langid.sample(few.unionByName(many).unionByName(hot)).collect()
    assert Counter(r.label for r in rows) == {"xx": 3, "yy": langid.SAMPLE_PER_LANGUAGE}
    at, n = langid.bag(b"copied text a")
    assert (at.astype("<i4").tobytes(), n.astype("<i4").tobytes()) in {(bytes(r.idx), bytes(r["count"])) for r in rows if r.label == "xx"}
    assert len({(r.label, r.hash) for r in rows}) == len(rows)


def plain_grams(text: bytes) -> list[bytes]:
    y = bytearray()
    for b in text:
        b = b + 32 if 65 <= b <= 90 else b
        if b >= 128 or 97 <= b <= 122 or b == 39:
            y.append(b)
        elif y and y[-1] != 32:
            y.append(32)
    return [bytes(y[i : i + n]) for n in langid.ORDERS for i in range(len(y) - n + 1) if 32 not in y[i + 1 : i + n - 1]]


def bucket(gram: bytes) -> int:
    h = len(gram)
    for b in reversed(gram):
        h = (h ^ b) * 0x9E3779B97F4A7C15 % (1 << 64)
    return h >> 64 - 15


def test_scores_against_a_plain_programme():
    rng = np.random.default_rng(4)
    model = langid.Model(["a", "b", "c"], rng.standard_normal((langid.BUCKETS, 3)).astype(np.float32), rng.standard_normal(3), 1.0, 0.0)
    pick = random.Random(2)
    texts = ["".join(pick.choices("abcXYZ'é .,\n1", k=pick.randint(0, 400))) for _ in range(60)] + ["", None, " ", "word", "ab " * 9000]
    raw, off = textbuf.flat(pa.array(texts))
    got = model.logits(raw, off)
    for row, text in zip(got, texts, strict=True):
        g = [bucket(x) for x in plain_grams((text or "").encode())]
        assert row == pytest.approx(model.table[g].astype(float).sum(0) / max(1, len(g)) + model.bias, rel=1e-6, abs=1e-9)
        at, n = langid.bag((text or "").encode())
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == Counter(g)
    whole = [np.concatenate([x[k] for x, _ in langid.grams(raw, off)]) for k in range(4)]
    for chunk in (1, 7, 1000):
        parts = list(langid.grams(raw, off, chunk=chunk))
        assert all((np.concatenate([x[k] for x, _ in parts]) == whole[k]).all() for k in range(4))


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, where=~langid.held_out())
    got = langid.predict(docs.withColumn("Lang_Pred", F.lit("q")).withColumn("letters", F.lit("l")).withColumn("_has_letter", F.lit(7)), model)
    assert got.columns == [*docs.columns, "letters", "_has_letter", "lang_pred", "lang_score", "lang_rejected"]
    got = got.where(langid.held_out()).toPandas()
    assert (got["letters"] == "l").all() and (got["_has_letter"] == 7).all()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    assert got["lang_rejected"].mean() < 0.02
    assert got["lang_score"].between(0, 1).all()
    rng = random.Random(1)
    noise = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(80))) for i in range(50)]
    assert langid.predict(spark.createDataFrame(noise, "doc_id long, text string"), model).where("lang_rejected").count() >= 45
    rows = langid.predict(spark.createDataFrame(EDGES, "doc_id long, text string"), model).collect()
    assert len(rows) == len(EDGES)
    assert all((r.lang_pred == "und" and r.lang_score == 0 and r.lang_rejected) for r in rows if r.text is None or not r.text.strip())
    assert langid.predict(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en"), (3, "123", "en")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    rows = langid.predict(docs, model).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.lang_score, r.lang_rejected) for r in rows] == [("und", 0, False), ("und", 0, True), ("und", 0, True)]
    assert langid.keep_identified(docs, model).columns == docs.columns
    many = spark.range(langid.MOST_LANGUAGES + 1).selectExpr("concat('w', id) as text", "cast(id as string) as lang")
    with pytest.raises(ValueError, match="labels"):
        langid.train(many)
