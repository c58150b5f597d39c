"""Pseudo-likelihood against definitions, slopes against differences, and independence of the number of tasks."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lethewise.llm import pseudolm

SCHEMA = "doc_id long, text string"


def small_units(n=40, seed=0):
    rng = np.random.default_rng(seed)
    keys = rng.integers(-(1 << 62), 1 << 62, n)
    return pseudolm.Units.of([(int(k), 5000 // (i + 1)) for i, k in enumerate(keys)], rng.integers(0, 9, pseudolm.TAIL)), keys.view(np.uint64)


def test_units_and_probabilities():
    units, keys = small_units()
    got, tail = units.number(np.concatenate([keys, keys + np.uint64(1)]))
    assert got[:40].tolist() == list(range(40)) and not tail[:40].any() and tail[40:].all()
    assert (got[40:] == 40 + (keys + np.uint64(1)) % pseudolm.TAIL).all()
    for c in range(pseudolm.CLASSES):
        some = units.class_of == c
        assert not some.any() or units.share[some].sum() == pytest.approx(1, rel=1e-4)
    net, n = pseudolm.Network(units), len(units.class_of)
    near = [np.full(n, k, np.int32) for k in (3, 7, n, 1)]
    assert np.exp(net.log_probability(near, np.arange(n))).sum() == pytest.approx(1, rel=1e-4)
    # word by word, from the definition
    h = np.tanh(net.left[3] + 0.5 * net.left[7] + net.right[n] + 0.5 * net.right[1])
    z, q = h @ net.linear + net.bias, np.exp(h @ net.mixer + net.mixer_bias)
    want = z[units.class_of[5]] - np.log(np.exp(z).sum()) + np.log(q / q.sum() @ net.table[5])
    assert net.log_probability([k[:1] for k in near], np.array([5]))[0] == pytest.approx(float(want), rel=1e-4)
    doc = np.array([0, 0, 0, 1])
    assert [k.tolist() for k in pseudolm.sides(np.array([1, 2, 3, 4], np.int32), doc, 9)] == [[9, 1, 2, 9], [9, 9, 1, 9], [2, 3, 9, 9], [3, 9, 9, 9]]


def test_slopes_are_those_of_the_loss():
    units, _ = small_units()
    net = pseudolm.Network(units, width=4, topics=3)
    net.weights[:] = net.weights.astype(np.float32)
    rng = np.random.default_rng(1)
    n = len(units.class_of)
    unit, near = rng.integers(0, n, 50), [rng.integers(0, n + 1, 50) for _ in range(4)]
    p, q, back, h, share = net.slopes(near, unit)
    assert share.sum(1) == pytest.approx(np.ones(50), rel=1e-4)
    left = np.zeros_like(net.left)
    np.add.at(left, near[0], back)
    np.add.at(left, near[1], 0.5 * back)
    right = np.zeros_like(net.right)
    np.add.at(right, near[2], back)
    np.add.at(right, near[3], 0.5 * back)
    for table, slope in ((net.linear, h.T @ p), (net.bias, p.sum(0)), (net.mixer, h.T @ q), (net.mixer_bias, q.sum(0)), (net.left, left), (net.right, right)):
        for at in [tuple(rng.integers(0, s) for s in table.shape) for _ in range(6)] + [np.unravel_index(np.abs(slope).argmax(), slope.shape)]:
            was, loss = table[at], []
            for step in (0.01, -0.01):
                table[at] = was + np.float32(step)
                loss.append(-net.log_probability(near, unit).sum())
            table[at] = was
            assert (loss[0] - loss[1]) / 0.02 == pytest.approx(float(slope[at]), rel=0.05, abs=0.02)


class Plain(pseudolm.Network):
    """The network's steps, word by row: indexing, softmaxes about their largest number, sums of sorted rows."""

    def parts(self, near, unit):
        a, b, c, d = near
        h = np.tanh(self.left[a] + np.float32(0.5) * self.left[b] + self.right[c] + np.float32(0.5) * self.right[d])
        p, q = h @ self.linear + self.bias, h @ self.mixer + self.mixer_bias
        for x in (p, q):
            np.exp(x - x.max(1, keepdims=True), out=x)
            x /= x.sum(1, keepdims=True)
        return h, p, q, q * self.table[unit]

    def log_probability(self, near, unit):
        out = []
        for i in range(0, len(unit), 4096):
            u = unit[i : i + 4096]
            _, p, _, joint = self.parts([k[i : i + 4096] for k in near], u)
            own = p[np.arange(len(u)), self.units.class_of[u]].astype(np.float64)
            out.append(np.log(np.maximum(own, 1e-30)) + np.log(np.maximum(joint.sum(1), 1e-30)))
        return np.concatenate(out)

    def learn(self, near, unit):
        def by_row(rows, values):
            order = np.argsort(rows.astype(np.uint16), kind="stable")
            rows = rows[order]
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            return rows[first], np.add.reduceat(values[order], first, axis=0), np.diff(np.append(first, len(rows)))

        start, seen, since = self.counts * np.float32(pseudolm.START_WORDS), np.zeros_like(self.counts), 0
        for i in range(0, len(unit), pseudolm.STEP_WORDS):
            now, u = [k[i : i + pseudolm.STEP_WORDS] for k in near], unit[i : i + pseudolm.STEP_WORDS]
            h, p, q, share = self.parts(now, u)
            share /= np.maximum(share.sum(1, keepdims=True), np.float32(1e-30))
            p[np.arange(len(u)), self.units.class_of[u]] -= 1
            q -= share
            back = (p @ self.linear.T + q @ self.mixer.T) * (1 - h * h)
            rows, sums, _ = by_row(u, share)
            seen[rows] += sums
            self.linear -= h.T @ p / np.float32(len(u))
            self.bias -= p.mean(0)
            self.mixer -= h.T @ q / np.float32(len(u))
            self.mixer_bias -= q.mean(0)
            for table, (x, y) in ((self.left, now[:2]), (self.right, now[2:])):
                rows, sums, n = by_row(np.concatenate([x, y]), np.concatenate([back, np.float32(0.5) * back]))
                table[rows] -= sums / n[:, None].astype(np.float32)
            since += len(u)
            if since >= pseudolm.TABLE_WORDS:
                since = 0
                self.retable(start + seen)
        self.counts[:] = seen / seen.sum()
        self.retable(start + seen)


def zipf(n_words, seed=5):
    rng = np.random.default_rng(seed)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, pseudolm.HEAD))
    units = pseudolm.Units.of([(int(k), 2_000_000 // (i + 1)) for i, k in enumerate(rng.permutation(keys))], rng.integers(0, 900, pseudolm.TAIL))
    unit = np.minimum(np.exp(rng.random(n_words) * np.log(len(units.class_of))) - 1, len(units.class_of) - 1).astype(np.int32)
    return units, unit, pseudolm.sides(unit, np.arange(n_words) // 300, len(units.class_of))


def test_steps_are_those_of_the_plain_programme_at_less_cost():
    units, unit, near = zipf(70_300)  # ends in a part of a step
    nets, spent, lps = {}, {}, {}
    for kind in (pseudolm.Network, Plain) * 3:
        net = nets[kind] = kind(units)
        began = time.thread_time()
        net.learn(near, unit)
        lps[kind] = net.log_probability(near, unit)
        spent[kind] = min(spent.get(kind, 1e9), time.thread_time() - began)
    new, plain = nets[pseudolm.Network], nets[Plain]
    assert lps[pseudolm.Network] == pytest.approx(lps[Plain], rel=1e-4, abs=1e-3)
    for name in ("left", "right", "linear", "bias", "mixer", "mixer_bias", "counts", "table"):
        assert getattr(new, name) == pytest.approx(getattr(plain, name), rel=1e-3, abs=1e-3), name
    assert new.counts.sum() == pytest.approx(1, rel=1e-4)
    assert spent[pseudolm.Network] < 0.8 * spent[Plain]


@pytest.mark.parametrize("scale", [1, 30, 3000])
def test_softmaxes_of_any_size(scale):
    units, unit, near = zipf(3000)
    net, plain = pseudolm.Network(units), Plain(units)
    for n in (net, plain):
        n.linear *= scale
        n.mixer *= scale
        n.bias[:5] += scale
    got = net.log_probability(near, unit)
    assert np.isfinite(got).all() and got == pytest.approx(plain.log_probability(near, unit), rel=1e-3, abs=1e-2)
    p, q, back, h, share = net.slopes(near, unit)
    assert all(np.isfinite(x).all() for x in (p, q, back, h, share)) and p.sum(1) == pytest.approx(np.zeros(3000), abs=1e-4)


def test_training_beats_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = pseudolm.vocabulary(docs)
    units, tail, rare = pseudolm.units_of(words, 4000)
    rows = docs.withColumn("_key", F.col("doc_id")).withColumn("_hash", F.xxhash64("doc_id", "text"))
    coded = pseudolm._coded(rows, units, "text")
    packed = pseudolm.packs(coded, words.agg(F.sum("n")).first()[0])
    net = pseudolm.train(packed, units)
    _, unit, doc = pseudolm._unpacked(packed.first().asDict())
    near = pseudolm.sides(unit, doc, len(units.class_of))
    counts = np.bincount(unit, minlength=len(units.class_of))
    alone = np.log(counts[unit] / counts.sum()).mean()
    assert net.log_probability(near, unit).mean() > alone + 0.4
    shuffled = unit.copy()
    np.random.default_rng(0).shuffle(shuffled)
    assert net.log_probability(near, unit).mean() > net.log_probability(near, shuffled).mean() + 0.5


def brute_words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_tasks_do_not_matter_and_unseen_words_are_counted(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 90)) + [f"only{i}", f"Pair{i // 2}", "ünï"])) for i in range(120)]
    rows += [(500, rows[7][1]), (501, None), (502, ""), (503, " \n"), (504, "long " * 60_000), (505, "same"), (505, "same"), (None, "null id")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("Pll", F.lit("x")).withColumn("_key", F.lit("mine")).withColumn("_hash", F.lit("own")).withColumn("part", F.lit(1)).withColumn("_n", F.lit(2))
    got = [pseudolm.pseudo_likelihood(docs.repartition(k), head=50, part_words=9000).orderBy("doc_id", "n_words").collect() for k in (2, 9)]
    assert got[0][0].asDict().keys() == {"doc_id", "_key", "_hash", "part", "_n", "n_words", "n_unseen", "pll", "pll_mean"}
    assert [(r.doc_id, r.n_words, r.n_unseen) for r in got[0]] == [(r.doc_id, r.n_words, r.n_unseen) for r in got[1]]
    assert [r.pll for r in got[0]] == pytest.approx([r.pll for r in got[1]], rel=1e-3)
    total = Counter(w for _, t in rows for w in brute_words(t))
    head = {w for w, _ in total.most_common(49)}
    by_id = {r.doc_id: r for r in got[0]}
    assert all(r._key == "mine" and r._hash == "own" and r.part == 1 and r._n == 2 for r in got[0])
    for i, t in rows:
        own = Counter(brute_words(t))
        assert by_id[i].n_words == sum(own.values())
        if not set(own) & head or i < 120:
            assert by_id[i].n_unseen == sum(k for w, k in own.items() if total[w] == k and w not in head and w != "long")
    assert by_id[501].pll == by_id[502].pll == by_id[503].pll == 0 and by_id[501].pll_mean is None
    assert pseudolm.pseudo_likelihood(docs.limit(0)).count() == 0
    assert pseudolm.pseudo_likelihood(docs.where("doc_id between 501 and 503")).agg(F.sum("pll")).first()[0] == 0
    flat = pa.array(["A b", None, "c"])
    assert pseudolm.words_of(flat)[1].tolist() == [0, 0, 2]


def test_shares_of_rare_words_are_those_of_other_documents(spark):
    rng = random.Random(4)
    ids = [u + pseudolm.TAIL * j for u in (0, 3, 200) for j in range(5)]
    texts = {k: Counter(rng.choices(ids, k=30)) for k in range(9)}
    total = sum(texts.values(), Counter())
    tail = np.zeros((pseudolm.TAIL, 2))
    for w, n in total.items():
        tail[w % pseudolm.TAIL] += (n, 1)
    coded = spark.createDataFrame([(k, [(w, n) for w, n in c.items()]) for k, c in texts.items()] + [(99, [])], "_key long, _tail array<struct<word:long,k:long>>")
    words = spark.createDataFrame([(w, n) for w, n in total.items()], "word long, n long")
    got = {r._key: r for r in pseudolm._tail_scores(coded, words, tail).collect()}
    assert set(got) == set(texts)
    for k, own in texts.items():
        others = {w: n - own[w] for w, n in total.items()}
        share = {w: (n + pseudolm.ALPHA) / sum(m + pseudolm.ALPHA for v, m in others.items() if v % pseudolm.TAIL == w % pseudolm.TAIL) for w, n in others.items()}
        assert got[k].lt == pytest.approx(sum(n * np.log(share[w]) for w, n in own.items()))
        assert got[k].unseen == sum(n for w, n in own.items() if not others[w])
