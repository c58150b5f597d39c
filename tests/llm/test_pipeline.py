"""The pipeline's stages, and the queries with SQL, on small tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lethewise.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in queries.ORACLE_SQL if n in queries.QUERIES])
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (d[columns].astype(str).replace({"nan": "None", "<NA>": "None", "NaN": "None"}).sort_values(columns).reset_index(drop=True) for d in (got, want))
    for c in columns:
        assert [str(x).removesuffix(".0") for x in a[c]] == [str(x).removesuffix(".0") for x in b[c]]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, "password = verysecret1 and a few more words", "en", "s", 40), (9002, None, None, None, None), (9003, "12345", "en", "s", 5)], docs.schema)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    extra = extra.unionByName(spark.createDataFrame([(9004, "Some words before. " + benchmark, "en", "s", 1)], docs.schema))
    docs = docs.unionByName(extra).unionByName(docs.where("doc_id = 0"))
    for name in ("n_hit", "item_ids", "lang_pred", "lang_rejected", "secret_spans", "_base", "_row", "_fp", "kept"):
        docs = docs.withColumn(name, F.lit(f"mine {name}"))
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        path = f"{os.environ.get('TMPDIR', '/tmp')}/lethewise-test-{os.getpid()}-{name}"
        after.write.mode("overwrite").parquet(path)
        before = spark.read.parquet(path)
        assert before.where("n_hit <> 'mine n_hit' or lang_pred <> 'mine lang_pred' or secret_spans <> 'mine secret_spans' or _row <> 'mine _row' or _fp <> 'mine _fp'").count() == 0
        kept[name] = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
    assert not {9002, 9003} & set(kept["language_id"])
    assert before.where("doc_id = 0").count() <= 1
    assert 9004 in kept["near_dedup"] and 9004 not in kept["decontaminate"]
    assert kept["redact_secrets"][9001] == "[SECRET] and a few more words"
    assert len(kept["language_id"]) > 0.97 * spark.read.parquet(f"{SF}/documents.parquet").count()
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert last.columns == ["doc_id", "n_pieces", "ids_crc32", "piece_ids"]
    assert last.count() == before.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert corpus_pipeline.run(spark, SF).where(F.col("n_pieces") != F.size("piece_ids")).count() == 0
