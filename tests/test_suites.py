"""All configured metrics, on small frames."""

import pytest
from pyspark.sql import functions as F

from lethewise.plans import metric_plan, suites


def frames(spark):
    scores = spark.createDataFrame([(i, k, j, 0.5 * i + j + 0.5) for i in range(4) for k, n in (("answer", 1), ("paraphrase", 1), ("perturbed", 3)) for j in range(n)], "item int, kind string, answer_pos int, avg_loss double").withColumn("prob", F.exp(-F.col("avg_loss")))
    said = spark.createDataFrame([(0, "a b c", "a b"), (1, "d", "d")], "item int, truth string, said string")
    predicted = spark.createDataFrame([(0, 0, "x", "x"), (0, 1, "y", "x")], "item int, pos int, token string, pred_token string")
    out = {}
    for s, shift in (("forget", 0.0), ("holdout", 1.0), ("retain", 0.0), ("ra", 0.0), ("wf", 0.0)):
        tokens = spark.createDataFrame([(i, p, -1.0 - 0.1 * i - shift, -2.0, -1.5, 0.25, 7, 0.1 * i + shift) for i in range(3) for p in range(4)], "item int, pos int, logprob double, reference_logprob double, mu double, sigma2 double, n_zlib int, grad_norm double")
        out |= {f"{s}.scores": scores, f"{s}.generated": said, f"{s}.predicted": predicted, f"{s}.tokens": tokens}
    return out | {f"{s}.generated": said for s in ("forget_knowmem", "retain_knowmem", "forget_verbmem", "forget_para", "forget_pert")}


def test_every_instance(spark):
    given = frames(spark)
    classifier = {"classifier": lambda texts: [0.25] * len(texts)}
    ratio = suites.truth_ratio(given["forget.scores"], "closer_to_1_better")
    options = {"forget_Q_A_gibberish": classifier, "forget_gibberish": classifier, "forget_quality": {"reference": ratio}}
    found = suites.plan(list(suites.INSTANCES), given, options).run()
    assert set(found) == set(suites.INSTANCES)
    value = {r.metric: r.value for r in metric_plan.summary(found, list(found)).collect()}
    assert set(value) == set(suites.INSTANCES)
    assert value["forget_quality"] == 1.0
    assert value["mia_loss"] == value["mia_min_k"] == value["mia_gradnorm"] == 1.0
    assert value["mia_reference"] == 1.0
    assert value["privleak"] == pytest.approx(-100, abs=1e-6)
    assert value["forget_gibberish"] == 0.25
    assert (value["exact_memorization"], value["extraction_strength"]) == (0.5, 0.5)
    assert 0 < value["model_utility"] < 1
    for names in suites.SUITES.values():
        suites.plan(names, given)
    with pytest.raises(KeyError, match="needs forget.scores"):
        suites.plan(["forget_Q_A_Prob"], {})
    with pytest.raises(ValueError, match="classifier"):
        suites.plan(["forget_gibberish"], given).run()
    assert suites.plan(["forget_quality"], given).run()["forget_quality"].first().value is None


def test_a_classifier_of_the_engine(spark):
    from lethewise.operators import classify

    labelled = spark.createDataFrame([("a b c", 0), ("x y z", 1)] * 5, "text string, label int")
    model = classify.train(labelled, "text", "label", buckets=64, steps=10)
    said = spark.createDataFrame([(0, "", "a b"), (1, "", "z")], "item int, truth string, said string")
    found = suites.plan(["forget_gibberish"], {"forget_verbmem.generated": said}, {"forget_gibberish": {"classifier": model, "class_id": 1}}).run()["forget_gibberish"]
    value = {r["item"]: r.value for r in found.collect()}
    assert value[0] < 0.5 < value[1]


def test_settings_and_layers(spark):
    from lethewise.operators import generation
    from lethewise.plans import config

    assert config.unfilled({"a": {"b": "???", "c": [1, "???"]}, "d": 2}) == ["a.b", "a.c[1]"]
    assert config.merged({"a": {"x": 1}, "l": [1], "s": 1}, {"a": {"y": 2}, "l": [2], "s": 3}) == {"a": {"x": 1, "y": 2}, "l": [1, 2], "s": 3}
    assert (config.warmup_steps(1.0, 400, 8, 2), config.steps_per_epoch(3, 8)) == (25, 1)
    layers = spark.createDataFrame([(1, 0, [2.0, 0.0], [2.0, 0.1]), (1, 8, [2.0, 0.0], [0.0, 3.0])], "k int, layer int, final array<double>, early array<double>")
    row = generation.layer_contrast(layers, "k", "final", "early").first()
    assert row.layer == 8
    assert row.scores[0] > 0 > row.scores[1]
