"""Near-duplicates: every pair whose five-word shingles overlap by 0.8 is linked, and none below."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lethewise.llm import neardup


def _grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _overlap(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _texts():
    rng = np.random.default_rng(5)
    out = []
    for k in range(30):  # copies of one text with more and more words changed: overlaps on either side of the limit
        base = [f"w{x}" for x in rng.integers(0, 5000, 100 + 10 * k)]
        out.append(" ".join(base))
        for changes in (1, 2, 3, 4, 6):
            w = list(base)
            for at in rng.choice(len(w), changes, replace=False):
                w[at] = "changed"
            out.append(" ".join(w))
    shared = [f"s{x}" for x in range(100)]
    for k in range(60):  # a crowd: all share two thirds, and lie in pairs that are nearly equal
        own = [f"own{k // 2}_{x}" for x in range(40)]
        out.append(" ".join(shared + own + ["odd"] * (k % 2)))
    return out


def test_overlap(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate([*texts, texts[0], None, "", " "])], "_row long, doc_id long, text string")
    got = {r._row: r.component_id for r in neardup.cluster(docs).collect()}
    grams = [_grams(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _overlap(grams[i], grams[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert [got[i] for i in range(len(texts))] == label
    assert got[len(texts)] == 0
    assert len({got[len(texts) + k] for k in (1, 2, 3)}) == 1
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs.select("doc_id", "text"), "")
    assert kept.columns == ["doc_id", "text"]
    assert {r.doc_id for r in kept.collect()} == {*label, len(texts) + 1}
    assert neardup.keep_one(docs.select("doc_id", "text").where(F.lit(False))).count() == 0


def test_sketches_differ_as_sets_do():
    rng = np.random.default_rng(2)
    assert neardup.SKETCH_APART == 150
    for both, low, high in ((534, 60, neardup.SKETCH_APART), (480, 120, 220), (300, 290, 400), (600, 0, 0)):  # overlaps 0.8, 2/3, 1/3, 1
        x = rng.integers(0, 1 << 63, 1200 - both).astype(np.uint64)
        apart = int(np.bitwise_count(neardup.sketch(x[:600]) ^ neardup.sketch(np.concatenate([x[:both], x[600:]]))).sum())
        assert low <= apart <= high
