"""Queries of contrasted layers and of activations with masked places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewise.functions import arrays, losses
from lethewise.operators import generation

from .frames import table
from .logit_losses import _L, _logits

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT vec_id, k AS layer, unnest(range(0, 16)) AS i, unnest(v[49:64]) AS f, unnest(v[16 * k + 1:16 * k + 16]) AS a FROM e, (SELECT unnest([0, 1, 2]) AS k)),
p AS (SELECT *, f - ln(sum(exp(f)) OVER w) AS lf, a - ln(sum(exp(a)) OVER w) AS la FROM l WINDOW w AS (PARTITION BY vec_id, layer)),
m AS (SELECT *, ln((exp(lf) + exp(la)) / 2) AS lm FROM p), d AS (SELECT vec_id, layer, sum(exp(lf) * (lf - lm) + exp(la) * (la - lm)) / 2 AS js FROM m GROUP BY ALL),
b AS (SELECT vec_id, layer, js FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY js DESC, layer) AS r FROM d) WHERE r = 1)
SELECT vec_id, layer, round(any_value(js), 6) AS js, round(sum(lf - la), 6) AS total, round(max(lf - la), 6) AS top FROM b JOIN p USING (vec_id, layer) GROUP BY vec_id, layer""")
def layer_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """Quarters of a vector stand for layers' logits over 16 tokens, the last for the final layer's."""
    v = arrays.doubles(F.col("embedding"))
    quarter = F.array(*[F.struct(F.lit(k).alias("layer"), F.slice(v, 16 * k + 1, 16).alias("early")) for k in range(3)])
    layers = table(spark, sf, "embeddings").select("vec_id", F.slice(v, 49, 16).alias("final"), F.inline(quarter))
    best = generation.layer_contrast(layers, "vec_id", "final", "early")
    return best.select("vec_id", "layer", F.round("js", 6).alias("js"), F.round(arrays.total(F.col("scores")), 6).alias("total"), F.round(F.array_max("scores"), 6).alias("top"))


@query(f"WITH {_L} SELECT target, round(avg(d) FILTER (vec_id % 4 <> 0), 6) AS loss FROM (SELECT vec_id, target, avg((base - a1) * (base - a1)) AS d FROM x GROUP BY vec_id, target) GROUP BY target")
def loss_rmu_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a target are places of a sequence, of which every fourth is not scored."""
    scored = F.col("vec_id") % 4 != 0
    return _logits(spark, sf).groupBy("target").agg(F.round(losses.masked_mse(F.col("base"), F.col("a1"), scored), 6).alias("loss"))
