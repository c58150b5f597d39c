"""Queries that go through a metric log and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewise import tables
from lethewise.functions import stats
from lethewise.plans import metric_plan
from lethewise.sources import metric_logs

from .frames import ANSWER_SCORES, answer_scores, items

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def logged(spark: SparkSession, sf: str) -> str:
    """The path of a log of probabilities and losses: of the true answers, and of the perturbed ones as lists; of the true
    answers' by side."""
    s = answer_scores(spark, sf).join(items(spark, sf).select("item", "split"), "item").where("kind <> 'paraphrase'")
    stat = F.inline(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(c).alias("value")) for n, c in (("prob", "prob"), ("avg_loss", "avg_loss"))]))
    metric = F.when(F.col("kind") == "answer", "answer_Q_A_Prob").otherwise("perturb_Q_A_Prob").alias("metric")
    position = F.when(F.col("kind") == "perturbed", F.col("answer_pos") - 1).alias("answer_pos")
    rows = s.select(metric, F.lit(None).cast("string").alias("side"), "item", position, stat)
    sides = s.where("kind = 'answer'").select(F.lit("mia_loss").alias("metric"), F.col("split").alias("side"), "item", F.lit(None).cast("int").alias("answer_pos"), F.lit("score").alias("stat"), F.col("avg_loss").alias("value"))
    rows = tables.written(rows.unionByName(sides).withColumn("text", F.lit(None).cast("string")), "log-rows")
    means = rows.where("stat <> 'avg_loss'").groupBy("metric", "side").agg(F.avg("value").alias("value")).withColumn("stat", F.lit("agg_value"))
    path = tables.shared_dir(spark, "log") + ".json"
    metric_logs.write_log(rows, means, path)
    return path


_LOGGED = f"""WITH {ANSWER_SCORES}, log AS (
  SELECT CASE WHEN kind = 'answer' THEN 'answer_Q_A_Prob' ELSE 'perturb_Q_A_Prob' END AS metric, '' AS side, item, CASE WHEN kind = 'perturbed' THEN answer_pos - 1 ELSE -1 END AS answer_pos, unnest(['prob', 'avg_loss']) AS stat, unnest([prob, avg_loss]) AS value
  FROM item_scores WHERE kind <> 'paraphrase'
  UNION ALL SELECT 'mia_loss', split, item, -1, 'score', avg_loss FROM item_scores JOIN items USING (item) WHERE kind = 'answer')"""


@query(_LOGGED + " SELECT metric, side, item, CAST(answer_pos AS INTEGER) AS answer_pos, stat, round(value, 6) AS value FROM log")
def metric_log_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of a log that was written and read again."""
    found = metric_logs.read_items(spark, logged(spark, sf))
    return found.select("metric", F.coalesce("side", F.lit("")).alias("side"), "item", F.coalesce("answer_pos", F.lit(-1)).alias("answer_pos"), "stat", F.round("value", 6).alias("value"))


@query(_LOGGED + " SELECT metric, side, round(avg(value), 6) AS value FROM log WHERE stat <> 'avg_loss' AND starts_with(metric, 'mia') GROUP BY metric, side")
def metric_log_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregates of the metrics with a prefix."""
    found = metric_plan.metric_subset(metric_logs.read_aggregates(spark, logged(spark, sf)), prefixes=["mia"])
    return found.select("metric", F.coalesce("side", F.lit("")).alias("side"), F.round("value", 6).alias("value"))


@query(_LOGGED + """, l AS (SELECT round(value, 9) AS s, CASE WHEN side = 'forget' THEN 0 ELSE 1 END AS y FROM log WHERE metric = 'mia_loss'), c AS (SELECT s, sum(count(*) FILTER (y = 0)) OVER w AS c0, sum(count(*) FILTER (y = 1)) OVER w AS c1 FROM l GROUP BY s WINDOW w AS (ORDER BY s))
SELECT round(max(abs(c0 / n0 - c1 / n1)), 6) AS ks FROM c, (SELECT count(*) FILTER (y = 0)::DOUBLE AS n0, count(*) FILTER (y = 1)::DOUBLE AS n1 FROM l)""")
def metric_log_forget_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The distance of the sides of a logged attack."""
    found = metric_logs.read_items(spark, logged(spark, sf)).where("metric = 'mia_loss'")
    sides = found.select(F.round("value", 9).alias("value"), F.when(F.col("side") == "forget", 0).otherwise(1).alias("y"))
    return stats.ks_statistic(sides, "value", "y").select(F.round("ks", 6).alias("ks"))
