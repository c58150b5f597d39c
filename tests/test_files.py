"""Readers, writers and streaming jobs."""

import glob
import json
import math

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lethewise.functions import text as tx
from lethewise.operators import ranks
from lethewise.plans import registries, sweep
from lethewise.sources import catalog, files
from lethewise.streaming import jobs


def test_lines_and_lists(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('"I can\'t say."\n"No \\"idea\\"."\n')
    assert [r.value for r in files.json_strings(spark, str(tmp_path / "a.jsonl")).collect()] == ["I can't say.", 'No "idea".']
    (tmp_path / "b.csv").write_text("i,k,q,a\n1,x,\"['p', 'q']\",\"['r']\"\n2,y,__import__('os'),[]\n")
    got = files.csv_lists(spark, str(tmp_path / "b.csv")).orderBy("i").collect()
    assert (got[0].q, got[0].a, got[1].q, got[1].a) == (["p", "q"], ["r"], None, [])
    two = catalog.load(spark, {"x": {"handler": "lines", "path": str(tmp_path / "a.jsonl"), "access_key": "idk"}})
    assert two["idk"].count() == 2
    with pytest.raises(NotImplementedError):
        catalog.load(spark, {"x": {"handler": "other"}})
    both = catalog.assemble({"forget": two["idk"], "retain": two["idk"], "eval": two["idk"]}, "unlearn")
    assert both["train"].count() == 4
    assert set(both) == {"train", "eval"}


def test_results(spark, tmp_path):
    path = str(tmp_path / "log")
    with pytest.raises(AnalysisException):
        files.metric_log(spark, path)
    assert files.metric_log(spark, path, missing_ok=True).count() == 0
    rows = spark.createDataFrame([("a", "x", 1, 0, "prob", 0.5), ("b", "x", 1, 0, "prob", 0.7)], files.METRIC_ITEMS_SCHEMA)
    files.write_metric(rows, path)
    files.write_metric(rows.where("metric = 'b'").withColumn("value", F.lit(0.9)), path)
    assert {r.metric: r.value for r in files.metric_log(spark, path).collect()} == {"a": 0.5, "b": 0.9}


def test_append_and_index(spark, tmp_path):
    path = str(tmp_path / "aug")
    rows = spark.createDataFrame([(0, 0, "x", 1, 1), (0, 1, "y", 1, 1)], files.AUGMENTATION_SCHEMA)
    files.append_jsonl(rows.limit(1), path, ["chunk_idx", "view"])
    (tmp_path / "aug" / "part-cut.json").write_text('{"chunk_idx": 5, "vi')
    files.append_jsonl(rows, path, ["chunk_idx", "view"])
    assert files.jsonl(spark, path).count() == 2
    files.write_index(spark.createDataFrame([(7, 0.1), (3, 0.2)], "i int, s double"), str(tmp_path / "rsub"), "i", "s", {"forget_split": "forget05", "retain_num": 2})
    row = files.json_document(spark, str(tmp_path / "rsub")).first()
    assert (row.indices, row.max_sim, row.k, row.forget_split) == ([3, 7], [0.2, 0.1], 2, "forget05")


def test_completions(spark):
    def client(x):
        if x == "bad":
            raise OSError
        return x.upper()

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "text string")
    assert [r.output for r in files.completions(df, client, wait=lambda s: None).collect()] == ["A", None, None]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, "x"), (0, 0, "x"), (0, 1, "y")], "chunk_idx int, view int, text string")
    rows.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        jobs.append_results(stream, str(tmp_path / "out"), str(tmp_path / f"ck{k}"), ["chunk_idx", "view"]).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    q = jobs.tumbling_mean(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from tumbling").first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def _json(path):
    return [json.loads(x) for f in glob.glob(f"{path}/part-*") for x in open(f, encoding="utf-8").read().splitlines()]


def _whole(path):
    return [json.loads(open(f, encoding="utf-8").read()) for f in sorted(glob.glob(f"{path}/part-*"))]


def test_more_sinks(spark, tmp_path, monkeypatch):
    chosen = spark.createDataFrame([(5, 0.5, 0.1), (2, 0.9, 0.2)], "vec_id int, s_f double, s_r double")
    files.write_variant_index(chosen, f"{tmp_path}/v", "vec_id", "s_f", "s_r", 0.4, {"mode": "retain", "encoder": "e"})
    assert _json(f"{tmp_path}/v") == [{"mode": "retain", "encoder": "e", "k": 2, "indices": [2, 5], "s_F": [0.9, 0.5], "s_R": [0.2, 0.1], "s_F_median_all": 0.4}]
    assert files.json_document(spark, f"{tmp_path}/v", files.RSUB_VARIANT_SCHEMA).first().s_R == [0.2, 0.1]
    files.write_eval_log(spark.createDataFrame([(1, 0.5, 7), (0, 0.25, 3)], "item int, gt_loss double, num_token_gt int"), f"{tmp_path}/log", "item", ["gt_loss", "num_token_gt"])
    assert _whole(f"{tmp_path}/log") == [{"gt_loss": [0.25, 0.5], "num_token_gt": [3, 7]}]
    monkeypatch.setattr(files, "LOG_ITEMS", 40)
    many = spark.range(100).select(F.col("id").alias("item"), F.when(F.col("id") != 50, F.col("id") / 4).alias("loss"), (F.col("id") * 2).alias("n")).repartition(5)
    files.write_eval_log(many, f"{tmp_path}/many", "item", ["loss", "n"])
    parts = _whole(f"{tmp_path}/many")
    assert len(parts) == 3 and [x for p in parts for x in p["n"]] == [2 * i for i in range(100)]
    assert [x for p in parts for x in p["loss"]] == [i / 4 if i != 50 else None for i in range(100)]
    files.write_row_csv(spark.createDataFrame([(0.5, None, "a,b")], "x double, y double, z string"), f"{tmp_path}/row")
    files.write_row_csv(spark.createDataFrame([(0.75, 1.0, 'say "x"')], "x double, y double, z string"), f"{tmp_path}/row")  # in place of the first
    assert [tuple(r) for r in spark.read.schema("x double, y double, z string").csv(f"{tmp_path}/row", header=True).collect()] == [(0.75, 1.0, 'say "x"')]
    assert len(glob.glob(f"{tmp_path}/row/part-*.csv")) == 1
    files.write_metadata(spark, f"{tmp_path}/meta", {"lr": 1e-3, "name": "a"}, {"forget": chosen, "retain": chosen.limit(0)})
    assert _json(f"{tmp_path}/meta") == [{"config": '{"lr": 0.001, "name": "a"}', "n_forget": 2, "n_retain": 0}]
    schema = "tag string, w1 double, FQ double, MU double"
    files.append_result(spark, f"{tmp_path}/grid", {"tag": "a", "w1": -0.8, "FQ": 0.7, "MU": 0.6}, schema)
    files.append_result(spark, f"{tmp_path}/grid", {"tag": "b", "w1": -0.5}, schema)
    assert [tuple(r) for r in spark.read.schema(schema).csv(f"{tmp_path}/grid", header=True).orderBy("tag").collect()] == [("a", -0.8, 0.7, 0.6), ("b", -0.5, None, None)]
    events = spark.createDataFrame([("x", 1.0), ("y", 5.0), ("x", 2.0)], "action string, s double")
    files.write_profile(sweep.profile(events, "action", "s"), events, f"{tmp_path}/profile")
    assert [r.action for r in spark.read.csv(f"{tmp_path}/profile/report", header=True).collect()] == ["y", "x"]
    assert spark.read.json(f"{tmp_path}/profile/events").count() == 3
    rows = [{"name": "a_b", "value": 0.5}, {"name": "c", "value": None}]
    assert sweep.latex(rows, ["name", "value"]).splitlines() == ["\\begin{tabular}{ll}", "\\hline", "name & value \\\\", "\\hline", "a\\_b & 0.5000 \\\\", "c & -- \\\\", "\\hline", "\\end{tabular}"]
    assert [sweep.cell(v) for v in (0.1234567, 0.0012, 0.0, None)] == ["0.1235", "1.20e-03", "0.0000", "—"]


def test_qa_items_keep_the_files_order(spark, tmp_path):
    with open(f"{tmp_path}/qa.json", "w", encoding="utf-8") as f:
        f.writelines(json.dumps({"question": f"q{i}", "answer": "a"}) + "\n" for i in range(50))
    assert [r.question for r in files.qa_items(spark, f"{tmp_path}/qa.json", 5).collect()] == [f"q{i}" for i in range(5)]


def test_streams_of_duals_and_results(spark, tmp_path):
    spark.createDataFrame([("a", s, float(v)) for s, v in enumerate((5, 1, 9))] + [("b", 0, 3.0)], "run string, step long, loss double").write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("a", 3, 4.0)], "run string, step long, loss double").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("run string, step long, loss double").option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in")
    duals = jobs.dual_updates(stream, "run", "step", "loss", epsilon=2.0, rate=0.5)
    jobs.append_results(duals, f"{tmp_path}/out", f"{tmp_path}/check", ["run", "step"]).awaitTermination()
    assert [(r.run, r.step, r.dual) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("run", "step").collect()] == [("a", 0, 1.5), ("a", 1, 1.0), ("a", 2, 4.5), ("a", 3, 5.5), ("b", 0, 0.5)]
    jobs.checkpointed_results(stream, f"{tmp_path}/metrics", f"{tmp_path}/check2", {"mean": lambda d: d.agg(F.avg("loss").alias("value")), "n": lambda d: d.agg(F.count("*").cast("double").alias("value"))}).awaitTermination()
    assert {r.metric: r.value for r in spark.read.parquet(f"{tmp_path}/metrics").collect()} == {"mean": 4.4, "n": 5.0}


def test_registries_attacks_and_logs(spark, tmp_path):
    tokens = [(i, p, -float(x)) for i, xs in ((0, (1, 2, 3)), (1, (1, 1))) for p, x in enumerate(xs)]
    forget = spark.createDataFrame(tokens, "item int, pos int, logprob double")
    holdout = forget.withColumn("logprob", F.col("logprob") - 3)
    for name, means in (("loss", (1.5, 4.5)), ("min_k", (2.0, 5.0)), ("centred_loss", (-1.5, 1.5))):
        row = registries.run_attack(registries.ATTACKS[name](), forget, holdout).first()
        assert row.auc == 1.0 and (row.mean_forget, row.mean_holdout) == pytest.approx(means)
    with pytest.raises(NotImplementedError, match="no attack 'x'"):
        registries.ATTACKS["x"]
    assert set(registries.EVALUATORS) == {"question_answer", "raw_text", "raw_text_fast"} and set(registries.SCORERS) == {"unigram", "bigram", "table"}
    batch = registries.COLLATORS["padded"](spark.createDataFrame([([7, 8],), ([1, 2, 3, 4],)], "t array<int>"), "t", 3, left=True).collect()
    assert [(r.input_ids, r.attention_mask) for r in batch] == [([0, 7, 8], [0, 1, 1]), ([1, 2, 3], [1, 1, 1])]
    words = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "b")], "doc int, pos int, token string")
    counted = registries.SCORERS["unigram"](words.drop("pos"), ["doc"], {"m": F.lit(True)}).collect()
    assert {(r.doc, r.token): (r.c, round(r.lp_m, 6)) for r in counted} == {(1, "a"): (2, round(math.log(3 / 6), 6)), (1, "b"): (1, round(math.log(3 / 6), 6)), (2, "b"): (1, round(math.log(3 / 6), 6))}
    assert registries.SCORERS["bigram"](words, ["doc"], {"m": F.lit(True)}).count() == 2
    given = spark.createDataFrame([(1, 0, -1.0), (1, 1, -2.0)], "doc int, pos int, logprob double")
    assert registries.SCORERS["table"](words, ["doc"], {"net": given}).agg(F.sum("lp_net")).first()[0] == -3.0
    log = registries.json_log(f"{tmp_path}/run.log", "lethewise.test", drop=("kind", "noise"))
    log.info("step", extra={"fields": {"loss": 0.5}})
    log.info("step", extra={"fields": {"kind": "noise"}})
    lines = [json.loads(x) for x in open(f"{tmp_path}/run.log", encoding="utf-8")]
    assert [(x["event"], x["loss"], x["level"], x["logger"]) for x in lines] == [("step", 0.5, "info", "lethewise.test")]
    with pytest.raises(ValueError, match="wanted"):
        ranks.matched_tail(words, "pos", 9)
    with pytest.raises(Exception, match="neither question"):
        none = F.lit(None).cast("string")
        spark.range(1).select(tx.instruction_form(none, none, none, none, none)).collect()
