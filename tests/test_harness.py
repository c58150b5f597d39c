"""Multiple-choice evaluation on small tables."""

from pyspark.sql import functions as F

from lethewise.operators import harness


def test_choices_and_groups(spark):
    rows = [
        ("g", "t1", 1, 0, -4.0, 4, 0), ("g", "t1", 1, 1, -5.0, 10, 0),  # right; per length the other wins
        ("g", "t1", 2, 0, -4.0, 4, 1), ("g", "t1", 2, 1, -4.0, 4, 1),  # equal: the first counts
        ("g", "t2", 3, 0, None, 4, 0), ("g", "t2", 3, 1, -9.0, 0, 1),  # no log-probability, no length
        ("h", "t3", 4, 0, -1.0, 2, 0),
    ]
    df = spark.createDataFrame(rows, "grp string, task string, item int, choice int, lp double, n int, gold int").where("item <> 3 or choice = 1")
    judged = harness.judged_choices(df, ["grp", "task", "item"], "choice", "lp", F.col("n"), "gold")
    assert {r["item"]: (r.acc, r.acc_norm) for r in judged.collect()} == {1: (1, 0), 2: (0, 0), 3: (1, 0), 4: (1, 1)}
    rolled = harness.rolled_up(judged, "grp", "task", ["acc", "acc_norm"])
    got = {(r["name"], r.metric): (r.value, r.n, r.is_group) for r in rolled.collect()}
    assert got["t1", "acc"] == (0.5, 2, False) and got["g", "acc"] == (2 / 3, 3, True) and got["all", "acc_norm"] == (0.25, 4, True)
    summary = {r.metric: r.value for r in harness.summarized(harness.harness_results(rolled), ["g", "t1"]).collect()}
    assert set(summary) == {f"{t}/{m}" for t in ("g", "t1") for m in ("acc", "acc_stderr", "acc_norm", "acc_norm_stderr")}
    assert summary["t1/acc"] == 0.5 and abs(summary["t1/acc_stderr"] - 0.5) < 1e-12
    assert harness.rolled_up(judged.where("item > 9"), "grp", "task", ["acc"]).where("n > 0").count() == 0


def test_a_task_named_as_a_group_gives_way(spark):
    rows = spark.createDataFrame([("x", True, "acc,none", "0.5"), ("x", False, "acc,none", "0.1"), ("x", True, "alias", "x"), ("y", False, "acc,none", "text")], "task string, is_group boolean, name string, value string")
    assert {(r.metric, r.value) for r in harness.summarized(rows, ["x", "y"]).collect()} == {("x/acc", 0.5), ("y/acc", None)}
