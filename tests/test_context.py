"""Scores in context against a dense vocabulary."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lethewise.functions import text as tx
from lethewise.operators import context
from lethewise.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_moments_of_a_dense_distribution(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    texts = [(i, i % 3 != 0, [rng.choice(words[: 5 + i]) for _ in range(rng.choice([0, 1, 2, 30]))]) for i in range(30)]
    texts.append((99, False, ["never", "seen", "never", "seen"]))
    rows = [(i, t, a, b, n) for i, t, w in texts for (a, b), n in Counter(zip(w, w[1:], strict=False)).items()]
    vocabulary = sorted({x for _, _, w in texts for x in w})
    weights = np.array([1 + rng.random() for _ in vocabulary])
    u = dict(zip(vocabulary, weights / weights.sum(), strict=True))
    counted = spark.createDataFrame(rows, "doc_id int, training boolean, prev string, token string, c int")
    logprobs = spark.createDataFrame([(w, math.log(p)) for w, p in u.items()], "token string, lp double")
    scored = context.pair_scores(counted, logprobs, "lp", F.col("training")).cache()
    got = context.standard_scores(scored).collect()
    n2 = Counter()
    for _, t, a, b, n in rows:
        n2[a, b] += n if t else 0
    n1 = Counter()
    for (a, _), n in n2.items():
        n1[a] += n
    assert len(got) == len(rows) and any(n1[r.prev] == 0 for r in got) and any(n2[r.prev, r.token] == 0 < n1[r.prev] for r in got)
    for r in got:
        p = np.array([0.5 * n2[r.prev, w] / n1[r.prev] + 0.5 * u[w] if n1[r.prev] else u[w] for w in vocabulary])
        assert math.isclose(p.sum(), 1, abs_tol=1e-12)
        lp = np.log(p)
        mu = (p * lp).sum()
        sigma2 = (p * lp * lp).sum() - mu * mu
        assert math.isclose(r.z, (lp[vocabulary.index(r.token)] - mu) / math.sqrt(max(sigma2, 1e-6)), rel_tol=1e-9, abs_tol=1e-9)
    norms = {r.doc_id: (r.norm_1, r.norm_2) for r in context.gradient_norms(scored, "doc_id").collect()}
    assert len(norms) == len({r[0] for r in rows})
    for i, _, w in texts:
        if len(w) < 2:
            continue
        gradient = {a: np.zeros(len(vocabulary)) for a in w[:-1]}  # of the mean loss, to the logits of every context
        for a, b in zip(w, w[1:], strict=False):
            gradient[a] += np.array([0.5 * n2[a, v] / n1[a] + 0.5 * u[v] if n1[a] else u[v] for v in vocabulary]) / (len(w) - 1)
            gradient[a][vocabulary.index(b)] -= 1 / (len(w) - 1)
        flat = np.concatenate(list(gradient.values()))
        assert math.isclose(norms[i][0], np.abs(flat).sum(), rel_tol=1e-9) and math.isclose(norms[i][1], math.sqrt((flat**2).sum()), rel_tol=1e-9)


def test_pairs_of_short_texts(spark):
    got = spark.createDataFrame([("a b c",), ("a",), ("",), (None,)], "t string").select(context.pairs_of(tx.words("t")).alias("p")).collect()
    assert [[tuple(x) for x in r.p] for r in got] == [[("a", "b"), ("b", "c")], [], [], []]


def test_context_tells_what_the_vocabulary_can_not(spark):
    plain, moved, in_context = (QUERIES[q](spark, SF).first().auc for q in ("mia_min_k_auc", "mia_min_k_pp_auc", "mia_min_k_pp_context"))
    assert plain == pytest.approx(moved, abs=1e-5) and abs(plain - in_context) > 1e-3
