"""Queries of multiple-choice evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewise.operators import harness

from .frames import ANSWER_SCORES, answer_scores, answers, items

QUERIES, ORACLE_SQL = {}, {}
GROUP = "CASE WHEN split = 'forget' THEN 'forgetting' ELSE 'utility' END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Items with the true answer among three others, in places that turn with the item."""
    said = answers(spark, sf).where("kind <> 'paraphrase'").select("item", "answer_pos", F.octet_length("text").alias("n_bytes"))
    scores = answer_scores(spark, sf).where("kind <> 'paraphrase'").select("item", "answer_pos", (-F.col("sum_loss")).alias("lp"))
    choices = said.join(scores, ["item", "answer_pos"], "left").join(items(spark, sf).select("item", "split"), "item")
    turned = choices.withColumns({"choice": (F.col("answer_pos") + F.col("item")) % 4, "gold": F.col("item") % 4, "group": F.expr(GROUP)})
    return harness.judged_choices(turned, ["group", "split", "item"], "choice", "lp", F.col("n_bytes"), "gold")


_JUDGED = f"""WITH {ANSWER_SCORES}, choices AS (
  SELECT a.item, split, {GROUP} AS grp, (a.answer_pos + a.item) % 4 AS choice, a.item % 4 AS gold, round(-sum_loss, 9) AS lp, round(-sum_loss / nullif(octet_length(encode(text)), 0), 9) AS norm
  FROM answers a JOIN items ON items.item = a.item LEFT JOIN item_scores s ON s.item = a.item AND s.kind = a.kind AND s.answer_pos = a.answer_pos WHERE a.kind <> 'paraphrase'
), judged AS (
  SELECT grp, split, item, coalesce((arg_max(choice, (lp, -choice)) FILTER (lp IS NOT NULL) = any_value(gold))::INT::DOUBLE, 0) AS acc, coalesce((arg_max(choice, (norm, -choice)) FILTER (norm IS NOT NULL) = any_value(gold))::INT::DOUBLE, 0) AS acc_norm
  FROM choices GROUP BY ALL
), rolled AS (
  SELECT CASE WHEN grouping(split) = 0 THEN split WHEN grouping(grp) = 0 THEN grp ELSE 'all' END AS name, grouping(split) > 0 AS is_group, count(*) AS n,
    avg(acc) AS acc, stddev_samp(acc) / sqrt(count(*)) AS acc_s, avg(acc_norm) AS norm, stddev_samp(acc_norm) / sqrt(count(*)) AS norm_s FROM judged GROUP BY ROLLUP (grp, split))"""


@query(_JUDGED + " SELECT name, is_group, n, 'acc' AS metric, round(acc, 6) AS value, round(acc_s, 6) AS stderr FROM rolled UNION ALL SELECT name, is_group, n, 'acc_norm', round(norm, 6), round(norm_s, 6) FROM rolled")
def harness_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of every task, group and of all."""
    rolled = harness.rolled_up(judged(spark, sf), "group", "split", ["acc", "acc_norm"])
    return rolled.select("name", "is_group", "n", "metric", F.round("value", 6).alias("value"), F.round("stderr", 6).alias("stderr"))


@query(_JUDGED + """ SELECT name || '/' || m AS metric, round(v, 6) AS value FROM (SELECT name, unnest(['acc', 'acc_stderr', 'acc_norm', 'acc_norm_stderr']) AS m, unnest([acc, acc_s, norm, norm_s]) AS v FROM rolled) WHERE name IN ('utility', 'forget')""")
def harness_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept of a group and of a task."""
    results = harness.harness_results(harness.rolled_up(judged(spark, sf), "group", "split", ["acc", "acc_norm"]))
    return harness.summarized(results, ["utility", "forget"]).select("metric", F.round("value", 6).alias("value"))
