"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its character n-grams (of bytes, lower-cased in A-Z, within words with a mark
at either end), hashed into buckets; a linear layer and a softmax give the languages' probabilities. Embeddings and layer
are trained together by stochastic gradient descent in numpy on a bounded sample of labelled texts: per language, those of
the smallest hashes, copies counted once, each with all its n-grams. A part of the sample is kept from training; it sets
the softmax's temperature and the score below which a prediction is rejected.

At prediction the embeddings and the layer are multiplied out, so that an n-gram costs one look-up of a row with one
number per language, whatever the embedding's width. Whole texts are read, a long one in pieces whose sums add up.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected; rows with a null label or text
teach nothing; repeated rows each get a row; without any labelled row nothing is learned: every text is ``und`` with
score 0, and only those without a letter are rejected; more labels than ``MOST_LANGUAGES`` raise an error; an empty table
gives no rows. Other columns are kept (those named as in ``ADDED``, in any case of letters, are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage, textbuf

#: Different labelled texts that training uses at most: of one language, and (where there are very many languages) of all.
SAMPLE_PER_LANGUAGE, SAMPLE_IN_ALL, MOST_LANGUAGES = 600, 24_000, 1000
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
WIDTH = 16
EPOCHS, LEAST_STEPS = 5, 8000
RATE = 0.1
#: Share of the sample that calibrates (a sample under LEAST_SAMPLE has none to spare, and then nothing with a letter is
#: rejected), and the share of its right predictions that may be rejected.
CALIBRATION, LEAST_SAMPLE, MAY_REJECT = 0.25, 40, 0.001
UNDETERMINED = "und"
#: Bytes of text that are scored together: some 120 bytes of numbers for each.
PASS_BYTES = 1 << 19

ADDED = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())]

_CODE = np.arange(256)
_LOWER = np.where((_CODE >= 0x41) & (_CODE <= 0x5A), _CODE + 32, _CODE).astype(np.uint8)
_INWORD = (_CODE >= 0x80) | ((_CODE >= 0x61) & (_CODE <= 0x7A)) | (_CODE == 0x27)
_EDGE = np.uint64(0x20)


def grams(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, chunk: int = PASS_BYTES) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """For a chunk of bytes at a time, the buckets of the n-grams of each order that end at each byte (-1: none), and the
    text of each byte.

    Bytes outside words become one mark, so that no n-gram reaches from one word into the next but by a mark."""
    x = _LOWER[raw]
    x[~_INWORD[x]] = _EDGE
    inside = x != _EDGE
    behind = np.zeros(len(x) + 1, bool)
    behind[1:] = inside
    behind[offsets] = False  # what ends a text marks nothing in the next
    keep = inside | behind[:-1]  # one mark behind each word
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    x = x[keep]
    reach = max(ORDERS) - 1
    for c0 in range(0, len(x), chunk):
        c1, lo = min(len(x), c0 + chunk), max(0, c0 - reach)
        d0, d1 = np.searchsorted(ends, [c0, c1 - 1], side="right") - 1
        doc = np.repeat(np.arange(d0, d1 + 1), np.diff(np.clip(ends[d0 : d1 + 2], c0, c1)))
        lead = np.arange(c0, c1) - ends[doc]
        y = np.concatenate([np.zeros(reach - (c0 - lo), np.uint64), x[lo:c1].astype(np.uint64)])  # ``reach`` bytes of lead-in
        out = []
        for n in ORDERS:
            h, ok = np.full(c1 - c0, np.uint64(n), np.uint64), lead >= n - 1
            for j in range(n):
                part = y[reach - j : len(y) - j]
                h = (h ^ part) * textbuf._ODD
                if 0 < j < n - 1:
                    ok &= part != _EDGE
            idx = (h >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int64)
            idx[~ok] = -1
            out.append(idx)
        yield out, doc


def bag(text: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text's n-grams, each once, and their numbers."""
    total = np.zeros(buckets, np.int64)
    for by_order, _ in grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]), buckets):
        for idx in by_order:
            total += np.bincount(idx[idx >= 0], minlength=buckets)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # float32 [buckets, languages]
    bias: np.ndarray
    temperature: float
    least: float  # the least score that isn't rejected

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, width = len(offsets) - 1, len(self.languages)
        sums, count = np.zeros((n, width)), np.zeros(n)
        for by_order, doc in grams(raw, offsets, len(self.table), max(1 << 12, min(PASS_BYTES, (1 << 23) // max(1, width)))):
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            for idx in by_order:
                ok = idx >= 0
                value = self.table[np.where(ok, idx, 0)]
                value[~ok] = 0
                sums[doc[first]] += np.add.reduceat(value, first, axis=0, dtype=np.float64)
                count[doc[first]] += np.add.reduceat(ok.astype(np.int64), first)
        return sums / np.maximum(count, 1)[:, None] + self.bias

    def scored(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of logits: number of the language, its calibrated probability, and whether it is rejected."""
        if not self.languages:
            return np.zeros(len(z), np.int64), np.zeros(len(z)), np.zeros(len(z), bool)
        z = z / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = p[np.arange(len(p)), best]
        return best, score, score < self.least


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7, buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Train on labelled bags of n-grams; each text is averaged over all its n-grams in every step."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 0.0)
    number = {v: i for i, v in enumerate(languages)}
    y = np.array([number[v] for v in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    n_cal = int(len(bags) * CALIBRATION) if len(bags) >= LEAST_SAMPLE else 0
    cal, train = order[:n_cal], order[n_cal:]
    emb = (rng.standard_normal((buckets, width)) / width).astype(np.float32)
    lin, bias = np.zeros((width, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    epochs = max(epochs, -(-LEAST_STEPS // max(1, len(train))))  # a small sample is gone through more often
    step, total = 0, max(1, epochs * len(train))
    for _ in range(epochs):
        for i in rng.permutation(train):
            idx, c = bags[i]
            lr = np.float32(rate * (1 - step / total))
            step += 1
            if not len(idx):
                continue
            w = (c / c.sum()).astype(np.float32)
            e = emb[idx]
            x = w @ e
            z = x @ lin + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = lin @ p
            lin -= lr * np.outer(x, p)
            bias -= np.float32(0.01) * lr * p
            # over the sum of squares, so that the text's average moves by lr * back, however many n-grams it has
            emb[idx] -= (lr / (w @ w) * w)[:, None] * back
    model = Model(languages, emb @ lin, bias.astype(np.float64), 1.0, 0.0)
    if n_cal:
        z, t = np.array([(c[:, None] * model.table[idx].astype(np.float64)).sum(0) / max(1, c.sum()) + model.bias for idx, c in (bags[i] for i in cal)]), y[cal]

        def loss(temp: float) -> float:
            q = z / temp
            m = q.max(1)
            return float((m + np.log(np.exp(q - m[:, None]).sum(1)) - q[np.arange(len(t)), t]).mean())

        model.temperature = min(np.geomspace(1, 50, 61).tolist(), key=loss)
        best, score, _ = model.scored(z)
        right = np.sort(score[best == t])
        if len(right):
            model.least = float(right[int(MAY_REJECT * len(right))])
    return model


def sample(docs: DataFrame, text: str = "text", label: str = "lang", where: Column | None = None, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(label, hash, idx, count): bags of the different labelled texts of ``docs`` (those for which ``where`` holds) with
    the smallest hashes of their language; idx and count hold 32-bit numbers, BUCKETS at most."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    if where is not None:
        rows = rows.where(where)
    rows = rows.select(F.col(text).alias("text"), F.col(label).alias("label"), F.xxhash64(text).alias("hash"))
    sizes = rows.groupBy("label").agg(F.approx_count_distinct("hash").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more labels than {MOST_LANGUAGES}, which is the most that can be learned")
    limit = min(per_language, SAMPLE_IN_ALL // max(1, len(sizes)))
    # a language's smallest hashes are its sample: some twice as many as the limit are below this (all, if there are few)
    most = [(r["label"], (1 << 63) - 1 if r["n"] <= 4 * limit else int((1 << 63) * 2 * limit / r["n"])) for r in sizes]
    below = docs.sparkSession.createDataFrame(most, T.StructType([T.StructField("label", rows.schema["label"].dataType), T.StructField("most", T.LongType())]))
    taken = rows.join(F.broadcast(below), "label").where(F.shiftrightunsigned("hash", 1) <= F.col("most")).select("label", "hash", "text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # a few times the sample; copies of a text are one
        for batch in batches:
            for i, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("hash").to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    at, n = bag(batch.column("text")[i].as_py().encode())
                    yield pa.RecordBatch.from_pydict({"label": [key[0]], "hash": pa.array([key[1]], pa.int64()), "idx": pa.array([at.astype("<i4").tobytes()]), "count": pa.array([n.astype("<i4").tobytes()])})
        textbuf.give_back()

    schema = T.StructType([taken.schema["label"], taken.schema["hash"], T.StructField("idx", T.BinaryType()), T.StructField("count", T.BinaryType())])
    each = taken.mapInArrow(bags, schema).groupBy("label", "hash").agg(F.min(F.struct("idx", "count")).alias("b"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.shiftrightunsigned("hash", 1), "hash"))
    return each.withColumn("place", place).where(F.col("place") <= limit).select("label", "hash", "b.*")


def train(docs: DataFrame, text: str = "text", label: str = "lang", where: Column | None = None, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit a model on the sample of ``docs``, at most SAMPLE_IN_ALL bags."""
    got = sample(docs, text, label, where, per_language).orderBy("hash", "label").collect()
    return fit([(np.frombuffer(r["idx"], "<i4").astype(np.int64), np.frombuffer(r["count"], "<i4").astype(np.int64)) for r in got], [r["label"] for r in got])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected."""

    def work(rows: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(model)
        own, schema = rows.columns, T.StructType([*rows.schema.fields, *ADDED])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            names = np.array([*m.languages, UNDETERMINED], object)
            for batch in batches:
                for some in textbuf.passes(batch, "text", PASS_BYTES):
                    has = np.asarray(some.column("letters").fill_null(False).to_pylist(), bool)
                    best, score, rejected = m.scored(m.logits(*textbuf.flat(some.column("text"))))
                    added = [pa.array(names[np.where(has, best, len(m.languages))], pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(rejected | ~has)]
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in own), *added], names=[*own, *(f.name for f in ADDED)])

        return rows.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)

    return storage.apart(docs, [f.name for f in ADDED], work, text=text)


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without those that are rejected, with its own columns."""
    return storage.beside(docs, [text], lambda d: predict(d, model, text).where(~F.col("lang_rejected")))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document belongs to the fold that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
