"""Ranks with heavy keys, and chunks of whole splits."""

import random

from pyspark.sql import functions as F

from lethewise.functions import text as tx
from lethewise.operators import prep, ranks, select


def test_a_key_of_many_rows_is_dealt_over_ranges(spark):
    rng = random.Random(1)
    for name, tie in (("long", lambda i: i), ("string", lambda i: f"é{i:05d}")):
        rows = [(0.0 if i % 3 else round(rng.gauss(0, 1), 2), tie(i)) for i in range(3000)] + [(None, tie(9999))]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, f"score double, id {name}").repartition(7)
        ranges = ranks._ranges(df, "score", ["id"]).groupBy("_range").count()
        assert max(r["count"] for r in ranges.collect()) < 700
        got = ranks.add_row_index(df, "score", ties=["id"]).orderBy("index").collect()
        want = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))
        assert [(r.score, r.id) for r in got] == want and [r["index"] for r in got] == list(range(3001))
    scored = spark.createDataFrame([(i, 0.0 if i % 3 else 0.5) for i in range(900)], "vec_id long, score double")
    chosen = select.top_share(scored, 0.5).where("chosen").select("vec_id").collect()
    assert sorted(r.vec_id for r in chosen) == sorted([i for i in range(900) if i % 3 == 0] + [i for i in range(900) if i % 3][:150])


def test_sums_within_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", *map(str, range(40))]), rng.randrange(50), i) for i in range(1500)]
    got = ranks.running_sums(spark.createDataFrame(rows, "g string, k long, i long").repartition(5), "k", {"n": F.lit(1), "s": F.col("i")}, ["i"], within="g").collect()
    assert len(got) == 1500
    for r in got:
        before = [x for x in rows if x[0] == r.g and (x[1], x[2]) <= (r.k, r.i)]
        assert (r.n, r.s) == (len(before), sum(x[2] for x in before))


def test_chunks_lose_no_row(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "", "a", *map(str, range(30))]), rng.choice([i, i, 7]), " ".join(f"{i}.{k}" for k in range(rng.choice([0, 1, 5, 40])))) for i in range(300)] + [("a", None, "x y"), ("a", 3, None)]
    df = spark.createDataFrame(rows, "part string, id long, text string").repartition(4)
    for views in (1, 3):
        got = prep.corpus_chunks(df, "part", "id", tx.words("text"), 16, views=views).collect()
        assert {r.view_no for r in got} == set(range(views)) and max(len(r.tokens) for r in got) <= 16
        for part in {r[0] for r in rows}:
            want = sorted(x for p, _, t in rows if p == part for x in (t or "").split())
            mine = sorted((r.chunk_idx, r.tokens) for r in got if r.part == part and r.view_no == 0)
            assert sorted(x for _, t in mine for x in t) == want
            assert all(len(t) == 16 for _, t in mine[:-1])
            flat = [x for _, t in mine for x in t]
            ids = [next(i for p, i, t in rows if p == part and x in (t or "").split()) for x in flat]
            assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
            if views == 3 and len(want) > 5:
                moved = [x for r in sorted((r for r in got if r.part == part and r.view_no == 1), key=lambda r: r.chunk_idx) for x in r.tokens]
                assert moved == flat[5:]


def test_common_count_against_counters(spark):
    from collections import Counter

    rng = random.Random(9)
    rows = [([rng.choice("abcdef") for _ in range(rng.randrange(30))], [rng.choice("abcxyz") for _ in range(rng.randrange(30))]) for _ in range(60)] + [([], []), (["a"] * 2000, ["a"] * 1500 + ["b"])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(tx.common_count(F.col("a"), F.col("b")).alias("n"), "a", "b").collect()
    assert all(r.n == sum((Counter(r.a) & Counter(r.b)).values()) for r in got) and len(got) == 62


def test_a_grid_of_what_occurs(spark):
    import pytest

    from lethewise.plans.sweep import grid_of

    runs = spark.createDataFrame([(2, -0.5, "a"), (4, -1.0, "a"), (2, None, "b")], "epoch int, w double, tag string")
    got = grid_of(runs, ["epoch", "w"]).orderBy("config").collect()
    assert [tuple(r) for r in got] == [(2, -1.0, 0), (2, -0.5, 1), (4, -1.0, 2), (4, -0.5, 3)]
    with pytest.raises(ValueError, match="over 1"):
        grid_of(runs, ["epoch"], most=1)
