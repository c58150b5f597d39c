"""Small inputs with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lethewise.functions import arrays, losses, stats
from lethewise.functions import text as tx
from lethewise.operators import metrics, prep, ranks, sample, select
from lethewise.operators.joins import lookup, salted_join
from lethewise.plans import metric_plan, sweep


def scores(spark):
    right, wrong = [1.0, 2.0, 0.5], [[2.0, 3.0], [1.0, 1.0], [0.5, 0.5]]
    data = [(i, k, 0, x) for i, x in enumerate(right) for k in ("answer", "paraphrase")] + [(i, "perturbed", j, x) for i, w in enumerate(wrong) for j, x in enumerate(w)]
    return spark.createDataFrame(data, "item long, kind string, answer_pos int, avg_loss double").withColumn("prob", F.exp(-F.col("avg_loss")))


@pytest.mark.parametrize(("form", "mean"), [("closer_to_1_better", 0.5303365338), ("true_better", 0.2589566134), ("prob_mean", 0.5288386324)])
def test_truth_ratio(spark, form, mean):
    assert metrics.truth_ratio(scores(spark), form).agg(F.avg("value")).first()[0] == pytest.approx(mean, abs=1e-9)
    with pytest.raises(ValueError, match="aggregator"):
        metrics.truth_ratio(scores(spark), "other")


def test_probability_with_options(spark):
    got = [r.value for r in metrics.probability_with_options(scores(spark)).orderBy("item").collect()]
    assert got == pytest.approx([0.6652409557, 0.1553624035, 0.3333333333], abs=1e-9)


def test_min_k(spark):
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate([-1.0, -4.0, -2.0, -3.0, -0.5])] + [(1, 0, -1.0)], "item int, pos int, lp double")
    assert {r.item: r.score for r in metrics.min_k(df, "item", "lp", 0.4).collect()} == {0: 3.5, 1: 1.0}
    one = df.where("item = 1").withColumn("lp", F.lit(-2.0))
    assert metrics.min_k_plus_plus(one, "item", "lp", F.lit(-1.5), F.lit(0.25), 0.4).first().score == pytest.approx(1.0)


def test_extraction_strength(spark):
    preds = [[1, 2, 3, 4], [9, 2, 3, 4], [1, 2, 3, 9], [9, 9, 9, 9]]
    df = spark.createDataFrame([(i, j, p, j + 1) for i, ps in enumerate(preds) for j, p in enumerate(ps)], "item int, pos int, pred_token int, token int")
    everything = metrics.strength_with_empty(spark.range(5).select(F.col("id").cast("int").alias("item")), metrics.extraction_strength(df))
    assert [r.value for r in everything.orderBy("item").collect()] == [1.0, 0.75, 0.25, 0.25, 0.0]


def test_auc_and_ks(spark):
    df = spark.createDataFrame([(float(s), 0) for s in (1, 2, 2, 3)] + [(float(s), 1) for s in (2, 3, 4)], "s double, y int")
    assert stats.auc(df, "s", "y").first().auc == pytest.approx(0.7916666667)
    assert stats.auc(df.withColumn("s", -F.col("s")), "s", "y").first().auc == pytest.approx(1 - 0.7916666667)
    two = spark.createDataFrame([(x, 0) for x in (0.1, 0.2, 0.3, 0.4)] + [(x, 1) for x in (0.3, 0.5, 0.6, 0.7, 0.8)], "x double, g int")
    row = stats.ks_statistic(two, "x", "g").first()
    assert (row.ks, row.n0, row.n1) == (pytest.approx(0.8), 4, 5)
    assert stats.ks_pvalue(0.8, 4, 5) == pytest.approx(10 / 126)
    assert stats.ks_pvalue(0.0, 4, 5) == 1.0
    assert stats.ks_pvalue(0.05, 20_000, 20_000) < 1e-20


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(stats.privacy_leakage(F.lit(0.7), F.lit(0.5)).alias("p"), stats.relative_change(F.lit(0.7), F.lit(0.5)).alias("r")).first()
    assert (got.p, got.r) == (pytest.approx(-40), pytest.approx(40))
    values = spark.createDataFrame([(0.5,), (0.25,), (1.0,)], "v double")
    assert values.agg(stats.harmonic_mean(F.col("v"))).first()[0] == pytest.approx(0.4285714286)
    assert values.unionByName(spark.createDataFrame([(0.0,)], "v double")).agg(stats.harmonic_mean(F.col("v"))).first()[0] == 0
    assert stats.memory_aggregate(0.5, 0.4, 0.6, 0.64) == (pytest.approx(0.5625), pytest.approx(0.5987525988))
    assert stats.memory_aggregate(None, 0.4, 0.6, 0.64) is None


def test_interleaving(spark):
    def run(n_short, longer):
        rows = [(i, True, i) for i in range(n_short)] + [(x, False, i) for i, x in enumerate(longer)]
        df = spark.createDataFrame(rows, "v int, short boolean, i int")
        slot = sample.balanced_slots(F.col("i"), F.col("short"), F.lit(n_short), F.lit(len(longer)))
        return [r.v for r in df.withColumn("s", slot).where("s is not null").orderBy("s").collect()]

    assert run(2, [10, 11, 12, 13, 14]) == [0, 10, 11, 1, 12, 13]
    assert run(3, [10, 11, 12, 13, 14]) == [0, 10, 11, 1, 12, 13, 2, 14]
    eight = spark.range(8).withColumn("s", sample.block_slot(F.col("id"), F.lit(8), 2))
    assert [r.id for r in eight.orderBy("s").collect()] == [0, 1, 4, 5, 2, 3, 6, 7]


def test_logits(spark):
    df = spark.createDataFrame([([5.0, 4.0, 2.0, 0.0], [4.0, 1.0, 3.0, 2.0], [1.0, 1.0, 3.0, 2.0])], "b array<double>, a array<double>, c array<double>")
    mask = arrays.relative_top_mask(F.col("b"), 0.1)
    row = df.select(mask.alias("m"), arrays.composed(F.col("b"), [(F.col("a"), -0.8), (F.col("c"), 0.8)], mask).alias("s"), arrays.lp_norm(F.col("b"), 2).alias("n"), arrays.sampled(F.col("b"), F.lit(0.0)).alias("t")).first()
    assert row.m == [False, False, True, True]
    assert row.s == pytest.approx([2.6, 4.0, 2.0, 0.0])
    assert row.n == pytest.approx(math.sqrt(45))
    assert row.t == 0
    with pytest.raises(ValueError, match="norm"):
        arrays.lp_norm(F.col("b"), 3)
    with pytest.raises(NotImplementedError):
        losses.loss("other")


def test_chunks(spark):
    def sizes(n, least):
        df = spark.createDataFrame([(1, ["x"] * n)], "id int, t array<string>")
        return [len(r.tokens) for r in prep.row_chunks(df, F.col("t"), 4, least).orderBy("chunk_idx").collect()]

    assert (sizes(8, 0), sizes(9, 0), sizes(3, 0), sizes(8, 1)) == ([4, 4, 0], [4, 4, 1], [3], [4, 4])
    docs = spark.createDataFrame([("a", 1, ["p", "q", "r"]), ("a", 2, []), ("a", 3, ["s", "t"]), ("b", 4, ["u"])], "split string, id int, t array<string>")
    got = {(r.split, r.view_no, r.chunk_idx): r.tokens for r in prep.corpus_chunks(docs, "split", "id", F.col("t"), 4, views=2).collect()}
    assert got == {("a", 0, 0): ["p", "q", "r", "s"], ("a", 0, 1): ["t"], ("a", 1, 0): ["r", "s", "t"], ("b", 0, 0): ["u"]}


def test_top_fraction_rounds_half_to_even():
    assert [select.top_fraction_size(f, n) for f, n in ((0.25, 10), (0.25, 14), (0.25, 18), (0.40, 105), (0.25, 105))] == [2, 4, 4, 42, 26]


def test_utility_golden():
    v = [0.9822, 0.9898, 0.4719, 0.9180, 0.4445, 0.5868, 0.9088, 0.4187, 0.5468]
    assert len(v) / sum(1 / x for x in v) == pytest.approx(0.62034, abs=1e-4)


def test_order_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).unionByName(spark.createDataFrame([(5,), (5,)], "k long"))
    for parts in ("1", "4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = ranks.add_row_index(df, "k").orderBy("index").collect()
        assert [r["index"] for r in got] == list(range(1002))
        assert [r.k for r in got] == sorted(r.k for r in got)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_joins_of_heavy_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [(-1, None), (-2, "absent")], "id int, key string")
    table = rows.where("key is not null and key <> 'absent'").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = lookup(rows, table, "key", "n", rows.count())
    assert got.count() == 3002
    assert got.where("key = 'hot' and low <> 1").count() == 0
    assert {r.id for r in got.where("low is null").collect()} == {-1, -2}
    assert salted_join(rows, table, "key").where("low is null").count() == 2


def test_selection(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    one = select.similarity(vectors, vectors, not_self=True, block_rows=2).orderBy("vec_id").collect()
    assert [r.max_sim for r in one] == pytest.approx([0.6, 0.8, 0.8, 0.0])
    assert [r.n_pairs for r in one] == [3, 3, 3, 3]
    scored = spark.createDataFrame([(i, float(i), float(-i)) for i in range(6)], "vec_id long, s_f double, s_r double")
    assert [r.vec_id for r in select.gated_top_k(scored, 2).collect()] == [0, 1]
    with pytest.raises(ValueError, match="median"):
        select.gated_top_k(scored, 3)
    with pytest.raises(ValueError, match="twice|2 times"):
        select.refuse_duplicates(scored.unionByName(scored.limit(1)), "vec_id")
    a, b = (spark.createDataFrame([(i,) for i in v], "item int") for v in ((1, 2), (1, 3)))
    with pytest.raises(Exception, match="one side"):
        metrics.checked_join(a, b, "item").collect()
    assert [r.item for r in metrics.checked_join(a, a.unionByName(spark.createDataFrame([(None,)], "item int")), "item").orderBy("item").collect()] == [1, 2]


def test_rouge(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat on a mat"), ("", "x"), ("running dogs", "run dog")], "a string, b string")
    got = tx.rouge(df, "a", "b").collect()
    assert got[0].rouge1_recall == pytest.approx(4 / 6)
    assert got[0].rougeL_recall == pytest.approx(4 / 6)
    assert got[0].rougeL_f1 == pytest.approx(2 * (4 / 6) * (4 / 5) / (4 / 6 + 4 / 5))
    assert got[1].rougeL_f1 == 0
    assert tx.rouge(df, "a", "b", stemmer=True).collect()[2].rouge1_recall == pytest.approx(1.0)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 80))] for _ in range(2))
        assert tx.lcs_length(a, b) == slow(a, b)


def test_zlib_and_sampling(spark):
    import zlib

    said = ["", "abc" * 50, "é", None]
    got = spark.createDataFrame([(s,) for s in said], "t string").select(tx.zlib_length("t").alias("n")).collect()
    assert [r.n for r in got] == [None if s is None else len(zlib.compress(s.encode())) for s in said]
    logits = [0.5, -1.0, 2.0, 0.0]
    p = [math.exp(x) / sum(map(math.exp, logits)) for x in logits]
    draws = [i / 97 for i in range(97)]
    df = spark.createDataFrame([(logits, u) for u in draws], "v array<double>, u double").coalesce(1)
    want = [next(k for k in range(4) if sum(p[: k + 1]) > u) for u in draws]
    assert [r.t for r in df.select(arrays.sampled(F.col("v"), F.col("u")).alias("t")).collect()] == want


def test_plan(spark):
    calls = []

    def make(name):
        def compute(*parts):
            calls.append(name)
            return spark.createDataFrame([(1, float(len(parts) + 1))], "item int, value double")

        return compute

    plan = metric_plan.Plan([metric_plan.Metric("c", make("c"), ("a", "b")), metric_plan.Metric("a", make("a")), metric_plan.Metric("b", make("b"), ("a",))])
    saved = []
    out = plan.run(sink=lambda n, _: saved.append(n))
    assert calls == saved == ["a", "b", "c"]
    assert {r.metric: r.value for r in metric_plan.summary(out, ["a", "c"]).collect()} == {"a": 1.0, "c": 3.0}
    plan.run(done=out)
    assert calls == ["a", "b", "c"]
    with pytest.raises(ValueError, match="itself"):
        metric_plan.Plan([metric_plan.Metric("a", make("a"), ("a",))])
    assert sweep.markdown([{"m": "x", "v": 0.001}, {"m": "y", "v": None}], ["m", "v"]).splitlines()[2:] == ["| x | 1.00e-03 |", "| y | — |"]
