"""Queries of class probabilities by a classifier that is trained in the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewise.operators import classify

from .frames import documents, table

QUERIES, ORACLE_SQL = {}, {}


def classifier_prob(spark: SparkSession, sf: str) -> DataFrame:
    """The probability of the class ``quality`` = 0 for every document, by a model of four fifths of the labelled ones; for a
    labelled one, its loss and that of the share of its class among those."""
    docs = documents(spark, sf).select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    docs = docs.withColumn("held_out", F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0))
    learnable = docs.where(~F.col("held_out"))
    model = classify.train(learnable, "text", "quality")
    prior = learnable.where("quality is not null").agg(F.avg(F.col("quality").cast("double")).alias("_p"))
    scored = model.probabilities(docs, "text").join(F.broadcast(prior))
    of = F.get("prob", F.col("quality"))
    share = F.when(F.col("quality") == 1, F.col("_p")).otherwise(1 - F.col("_p"))
    return scored.select("doc_id", "held_out", F.get("prob", 0).alias("prob"), (-F.ln(of)).alias("loss"), F.when(F.col("quality").isNotNull(), -F.ln(share)).alias("prior_loss"))


QUERIES["classifier_prob"] = classifier_prob
