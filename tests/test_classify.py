"""Logistic regression against numerical gradients, and on held-out labels."""

import math

import numpy as np
from pyspark.sql import functions as F

from lethewise.operators import classify
from lethewise.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_gradient_is_the_slope(spark):
    rng = np.random.default_rng(1)
    rows = [(" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 9))), int(rng.integers(0, 3))) for _ in range(60)] + [(None, 1)]
    data = spark.createDataFrame(rows, "text string, label int").repartition(3).select(classify.hashed("text", 16).alias("features"), "label").cache()
    w = rng.standard_normal((17, 3))
    loss, grad, n = classify.loss_and_gradient(data, w, 0.1)
    assert n == 61
    for i, k in [(0, 0), (5, 2), (16, 1), (9, 1)]:
        step = np.zeros_like(w)
        step[i, k] = 1e-5
        slope = (classify.loss_and_gradient(data, w + step, 0.1)[0] - classify.loss_and_gradient(data, w - step, 0.1)[0]) / 2e-5
        assert math.isclose(slope, grad[i, k], rel_tol=1e-5, abs_tol=1e-8)
    plain = 0.0
    for r in data.collect():
        z = w[-1] + sum((w[f] for f in r.features), np.zeros(3)) / math.sqrt(max(1, len(r.features)))
        plain += math.log(np.exp(z).sum()) - z[r.label]
    assert math.isclose(loss, plain / 61 + 0.05 * (w[:-1] ** 2).sum(), rel_tol=1e-9)


def test_minimum_of_a_quadratic():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((6, 6))
    a, b = a @ a.T + np.eye(6), rng.standard_normal((6, 1))
    x, losses = classify.minimized(lambda x: (0.5 * (x * (a @ x)).sum() - (b * x).sum(), a @ x - b), np.zeros((6, 1)), 200, tolerance=1e-9)
    assert np.abs(x - np.linalg.solve(a, b)).max() < 1e-6 and losses == sorted(losses, reverse=True)


def test_classes_that_words_tell_apart(spark):
    rows = [(i, f"good text number {i} of this sort" if i % 2 else f"zzz qqq {i} xxx", i % 2) for i in range(80)] + [(90, None, 1), (91, "none", None), (92, "other", 7)]
    df = spark.createDataFrame(rows, "id int, text string, label int")
    model = classify.train(df.where("id < 60 or id > 80"), "text", "label", buckets=256, steps=20)
    assert model.losses[-1] < 0.4 * model.losses[0]
    got = {r.id: r.prob for r in model.probabilities(df, "text").collect()}
    assert all(abs(sum(p) - 1) < 1e-9 for p in got.values()) and len(got) == 83
    assert all((got[i][1] > 0.5) == (i % 2 == 1) for i in range(60, 80))
    empty = classify.train(df.limit(0), "text", "label", buckets=16)
    assert all(r.prob == [0.5, 0.5] for r in empty.probabilities(df, "text").collect())


def test_held_out_loss_beats_the_prior(spark):
    row = QUERIES["classifier_prob"](spark, SF).where("held_out").agg(F.avg("loss").alias("loss"), F.avg("prior_loss").alias("prior")).first()
    assert row.loss < row.prior
