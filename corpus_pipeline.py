"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. The first four return the columns of ``docs``:

1. ``language_id`` learns from the labelled rows and drops documents whose language it can't tell: a null text, one
   without a letter, or a score below the calibrated limit (of which there is none without labelled rows);
2. ``near_dedup`` links texts whose sets of five-word shingles overlap by 0.8 or more (verified on the sets), and keeps
   the document with the smallest id of each group;
3. ``decontaminate`` drops documents in which a window of a benchmark item occurs;
4. ``redact_secrets`` puts a mark in place of every secret; ``n_chars``, where there is one, is the new length;
5. ``piece_ids`` encodes the texts: doc_id, n_pieces, ids_crc32, piece_ids.

An empty table passes through every stage. Nulls in other columns and repeated rows have no effect but their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewise.llm import decontam, langid, neardup, pieces, secrets, storage
from lethewise.llm.queries import tokenizer_path

#: Words of a shingle in the near-duplicate stage.
SHINGLE_WORDS = 5


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.small_batches(spark)
    return langid.keep_identified(docs, langid.train(docs))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.small_batches(spark)
    return neardup.keep_one(docs, width=SHINGLE_WORDS)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.small_batches(spark)
    return decontam.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.small_batches(spark)
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.small_batches(spark)
    return pieces.encode(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"), keep_text=False).select("doc_id", "n_pieces", "ids_crc32", "piece_ids")


STAGES = [
    ("language_id", _language_id),
    ("near_dedup", _near_dedup),
    ("decontaminate", _decontaminate),
    ("redact_secrets", _redact_secrets),
    ("piece_ids", _piece_ids),
]

#: No stage but the third has a SQL form that runs on whole tables; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
