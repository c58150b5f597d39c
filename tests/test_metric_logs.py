"""Metric logs as other tools write and read them."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lethewise.functions import stats
from lethewise.plans import metric_plan
from lethewise.sources import metric_logs

LOG = {
    "forget_Q_A_Prob": {"agg_value": 0.25, "value_by_index": {"0": {"prob": 0.5, "avg_loss": 0.6931471805599453}, "10": {"prob": None, "avg_loss": 1e-300}, "2": {"prob": 0.25, "avg_loss": float("nan")}}},
    "forget_truth_ratio": {"agg_value": 0.9, "value_by_index": {str(i): {"score": 0.01 * i} for i in range(40)}},
    "mia": {"forget": {"agg_value": 1.5, "value_by_index": {"3": {"score": 1.5}}}, "holdout": {"agg_value": 2, "value_by_index": {"4": {"score": 2}}}, "auc": 0.75, "agg_value": 0.75},
    "empty": {"agg_value": None, "value_by_index": {}},
    "said \"x\"": {"agg_value": 1.0, "value_by_index": {"7": {"generation": 'a "quoted"\n{text} é', "ground_truth": "", "rouge": [0.5, None, 1]}}},
}


def same(a, b):
    if isinstance(a, dict):
        return isinstance(b, dict) and set(a) == set(b) and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(map(same, a, b))
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def test_round_trip(spark, tmp_path):
    source, target = tmp_path / "TOFU_EVAL.json", tmp_path / "out" / "TOFU_EVAL.json"
    source.write_text(json.dumps(LOG, indent=4))
    items, totals = metric_logs.read_items(spark, str(source)), metric_logs.read_aggregates(spark, str(source))
    got = {(r.metric, r.side, r["item"], r.answer_pos, r.stat): r.value if r.text is None else r.text for r in items.collect()}
    assert len(got) == 6 + 40 + 2 + 5
    assert got["forget_Q_A_Prob", None, 0, None, "avg_loss"] == 0.6931471805599453 and got["forget_Q_A_Prob", None, 10, None, "prob"] is None
    assert got["mia", "holdout", 4, None, "score"] == 2 and got['said "x"', None, 7, None, "generation"] == 'a "quoted"\n{text} é'
    assert [got['said "x"', None, 7, k, "rouge"] for k in range(3)] == [0.5, None, 1.0]
    assert {(r.metric, r.side, r.stat): r.value for r in totals.collect()} == {
        ("forget_Q_A_Prob", None, "agg_value"): 0.25, ("forget_truth_ratio", None, "agg_value"): 0.9, ("mia", None, "auc"): 0.75, ("mia", None, "agg_value"): 0.75,
        ("mia", "forget", "agg_value"): 1.5, ("mia", "holdout", "agg_value"): 2.0, ("empty", None, "agg_value"): None, ('said "x"', None, "agg_value"): 1.0,
    }
    (tmp_path / "out").mkdir()
    for _ in range(2):  # the second takes the place of the first
        metric_logs.write_log(items.repartition(4), totals, str(target))
        written = json.loads(target.read_text())
        want = {k: v for k, v in LOG.items()}
        want["empty"] = {"agg_value": None}  # an item-less metric has no field for items
        assert list(written) == sorted(want) and same(written, want)
        assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")] == ["TOFU_EVAL.json"]
    assert list(written["forget_truth_ratio"]["value_by_index"]) == [str(i) for i in range(40)]


def test_a_log_of_several_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(metric_logs, "ITEMS", 25)
    rows = spark.range(100).select(F.lit("m").alias("metric"), F.lit(None).cast("string").alias("side"), F.col("id").alias("item"), F.lit(None).cast("int").alias("answer_pos"), F.lit("score").alias("stat"), (F.col("id") / 7).alias("value"), F.lit(None).cast("string").alias("text"))
    totals = spark.createDataFrame([("m", None, "agg_value", 3.0)], metric_logs.AGGREGATES_SCHEMA)
    path = str(tmp_path / "log.json")
    metric_logs.write_log(rows, totals, path)
    parts = [p for p in (tmp_path / "log.json").iterdir() if p.name.startswith("part-")]
    assert len(parts) > 2 and all(set(json.loads(p.read_text())) == {"m"} for p in parts)
    back = metric_logs.read_items(spark, path)
    assert sorted((r["item"], r.value) for r in back.collect()) == [(i, i / 7) for i in range(100)]
    assert metric_logs.read_aggregates(spark, path).count() == 1


def test_missing_and_empty_logs(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        metric_logs.read_items(spark, str(tmp_path / "none.json"))
    assert metric_logs.read_items(spark, str(tmp_path / "none.json"), missing_ok=True).count() == 0
    path = str(tmp_path / "empty.json")
    metric_logs.write_log(spark.createDataFrame([], metric_logs.ITEMS_SCHEMA), spark.createDataFrame([], metric_logs.AGGREGATES_SCHEMA), path)
    assert metric_logs.read_items(spark, path).count() == 0 and metric_logs.read_aggregates(spark, path).count() == 0


def test_against_a_log_of_another_run(spark, tmp_path):
    path = tmp_path / "retain.json"
    path.write_text(json.dumps(LOG, indent=4))
    logged = metric_logs.read_items(spark, str(path)).where("metric = 'forget_truth_ratio' and stat = 'score'").select("value", F.lit(1).alias("side"))
    mine = spark.range(40).select((F.col("id") * 0.01 + 0.205).alias("value"), F.lit(0).alias("side"))
    row = stats.ks_statistic(mine.unionByName(logged), "value", "side").first()
    assert (row.n0, row.n1) == (40, 40) and math.isclose(row.ks, 0.525) and stats.ks_pvalue(row.ks, 40, 40) < 1e-3
    totals = metric_logs.read_aggregates(spark, str(path)).where("side is null and stat = 'agg_value'")
    current = spark.createDataFrame([("mia", 0.5), ("new", 0.1)], "metric string, value double")
    assert {r.metric: r.reference for r in metric_plan.with_reference(current, totals).collect()} == {"mia": 0.75, "new": None}
