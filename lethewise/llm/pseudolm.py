"""Language-model scores by masked pseudo-likelihood.

A network predicts every word of a text from the words on both sides of it, with the word itself hidden; the sum of the
log-probabilities over all words is the text's pseudo-log-likelihood.

Words. All documents' distinct words are counted by a distributed aggregate; this vocabulary grows with the corpus and is
never collected. The ``HEAD`` most frequent words are units of their own; every other word belongs to one of ``TAIL``
units, by its last two bytes.

Network. The embeddings of two units on either side make a hidden vector. A softmax over classes of units gives
p(class | both sides); a second softmax, over ``TOPICS`` topics, weighs as many tables of p(unit | class, topic), so that
a word is predicted from its sides within its class as well:

    log p(word | sides) = log p(class | sides) + log sum_t p(t | sides) p(unit | class, t) + log p(word | unit)

Training is in numpy. The embeddings and both softmaxes follow gradient descent; the tables are expected counts, which
add up over tasks. Texts are dealt by hash into parts of about ``PART_WORDS`` words and those into ``ROUNDS`` slices, so
what is learned depends on the documents and not on the number of tasks. A warm start on one slice tells the topics
apart; then, in each round, every part learns from its slice of that round, and the results are averaged by numbers of
words. All words of all documents are learned from.

p(word | unit), for words of the tail, is the word's share of its unit's mass in the *other* documents, smoothed by
``ALPHA``: the document's own occurrences are taken off the word's and off the unit's, so the shares of a unit's words sum to one. (Document, tail word) pairs, already summed per document, meet
the vocabulary in a shuffle; no tail word makes up more than a ``HEAD``-th of all words. ``n_unseen`` counts the words of
a text that occur in no other.

Defined results: a null or wordless text has 0 words, a sum of 0 and a null mean; repeated rows are counted, learned
from, and scored each; on an empty table nothing is learned and there are no rows. All columns but the text are kept
(those named as in ``ADDED``, in any case of letters, are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage, textbuf

HEAD, TAIL = (1 << 15) - 256, 256
CLASSES, OWN_CLASS = 64, 32
TOPICS, WIDTH = 16, 16
#: Weights of the neighbours at distance 1 and 2, on either side.
REACH = (1.0, 0.5)
STEP_WORDS, RATE = 1024, 1.0
#: Words of a part, rounds, and the words that a slice learns from at least: smaller ones are gone through again.
PART_WORDS, ROUNDS, LEAST_WORDS, MOST_PASSES = 4_000_000, 4, 400_000, 16
#: The tables are made anew after so many words; what earlier rounds counted weighs as much as START_WORDS in a slice.
TABLE_WORDS, START_WORDS = 32_768, 200_000
#: Share of the unit's overall share of its class in each topic's.
FLOOR = 0.02
ALPHA = 0.1
#: Numbers of a block of weights; distinct words that a counting task holds.
BLOCK, HELD_WORDS = 1 << 14, 1 << 20

ADDED = [T.StructField("n_words", T.LongType()), T.StructField("n_unseen", T.LongType()), T.StructField("pll", T.DoubleType()), T.StructField("pll_mean", T.DoubleType())]

_CODE = np.arange(256)
_WORD = (_CODE >= 0x80) | ((_CODE >= 0x30) & (_CODE <= 0x39)) | ((_CODE >= 0x61) & (_CODE <= 0x7A))
_LOWER = np.where((_CODE >= 0x41) & (_CODE <= 0x5A), _CODE + 32, _CODE).astype(np.uint8)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each word of the texts, and the text of each. The key's low bits tell the word's tail unit; the
    others are a hash."""
    raw, offsets = textbuf.flat(column)
    raw = _LOWER[raw]
    s, e, doc = textbuf.words_at(raw, _WORD, offsets)
    if not len(s):
        return np.zeros(0, np.uint64), doc
    ending = raw[e - 1].astype(np.uint64) * np.uint64(31) + np.where(e - s > 1, raw[np.maximum(e - 2, 0)], 0).astype(np.uint64)
    return textbuf.hashes(raw, s, e) // np.uint64(TAIL) * np.uint64(TAIL) + ending % np.uint64(TAIL), doc


def sides(units: np.ndarray, doc: np.ndarray, edge: int) -> list[np.ndarray]:
    """The neighbours at distance 1 and 2 on the left, then on the right; ``edge`` where the text has ended."""
    out = []
    for step in (-1, -2, 1, 2):
        k = np.full(len(units), edge, np.int32)
        a, b = (slice(-step, None), slice(None, step)) if step < 0 else (slice(None, -step), slice(step, None))
        if len(units) > abs(step):
            k[a] = np.where(doc[a] == doc[b], units[b], edge)
        out.append(k)
    return out


@dataclass
class Units:
    """What the corpus's counts fix. ``known`` are the head's keys in ascending order, ``unit`` their units."""

    known: np.ndarray
    unit: np.ndarray
    class_of: np.ndarray  # of each unit
    share: np.ndarray  # of each unit in its class
    mass: np.ndarray  # of each class; an empty one has none

    @classmethod
    def of(cls, head: list[tuple[int, int]], tail: np.ndarray, classes: int = CLASSES, own: int = OWN_CLASS) -> Units:
        """From (key, count) of the head's words, the most frequent first, and the words in each tail unit."""
        keys = np.array([k for k, _ in head], np.int64).view(np.uint64)
        n = np.concatenate([np.array([c for _, c in head], np.float64), tail]) + 1  # an empty unit has a share as well
        by_count = np.argsort(-n, kind="stable")
        class_of = np.zeros(len(n), np.int32)
        own = min(own, len(n))
        class_of[by_count[:own]] = np.arange(own)
        rest = by_count[own:]
        mass = np.cumsum(n[rest])
        if len(rest):
            class_of[rest] = own + np.minimum(classes - own - 1, (mass - n[rest]) / mass[-1] * (classes - own)).astype(np.int32)
        order = np.argsort(keys)
        total = np.bincount(class_of, weights=n, minlength=classes)
        return cls(keys[order], order.astype(np.int32), class_of, (n / total[class_of]).astype(np.float32), total / total.sum())

    def __post_init__(self):
        # where a key's leading bits belong to one word of the head, a table look-up finds it; else a search does
        slot = (self.known >> np.uint64(44)).astype(np.int64)
        self.first, self.several = np.full(1 << 20, -1, np.int32), np.zeros(1 << 20, bool)
        self.first[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.several[slot[1:][slot[1:] == slot[:-1]]] = True

    def number(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of words, and which of the words are in the tail."""
        tail = np.ones(len(keys), bool)
        out = (len(self.known) + (keys % np.uint64(TAIL)).astype(np.int64)).astype(np.int32)
        if len(self.known):
            slot = (keys >> np.uint64(44)).astype(np.int64)
            at = self.first[slot]
            more = np.flatnonzero(self.several[slot])
            at[more] = np.minimum(np.searchsorted(self.known, keys[more]), len(self.known) - 1)
            found = (at >= 0) & (self.known[at] == keys)
            out[found] = self.unit[at[found]]
            tail = ~found
        return out, tail


class Network:
    """Embeddings, two softmaxes and the topics' tables, all in one vector of weights. The last unit is a text's edge."""

    def __init__(self, units: Units, weights: np.ndarray | None = None, classes: int = CLASSES, topics: int = TOPICS, width: int = WIDTH, seed: int = 11):
        n = len(units.class_of)
        shapes = [(2 * (n + 1), width), (width, classes + topics), (classes + topics,), (n, topics)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        fresh = weights is None
        self.units, self.weights = units, np.zeros(ends[-1], np.float32) if fresh else weights
        self._near, self._both, self._biases, self.counts = (w.reshape(s) for w, s in zip(np.split(self.weights, ends[:-1]), shapes, strict=True))  # views
        self.left, self.right = self._near[: n + 1], self._near[n + 1 :]
        self.linear, self.mixer = self._both[:, :classes], self._both[:, classes:]
        self.bias, self.mixer_bias = self._biases[:classes], self._biases[classes:]
        self._order = np.argsort(units.class_of, kind="stable")
        self._ends = np.searchsorted(units.class_of[self._order], np.arange(classes + 1))
        if fresh:
            rng = np.random.default_rng(seed)
            self.left[:], self.right[:] = (rng.standard_normal((2, n + 1, width)) * 0.3).astype(np.float32)
            self.bias[:] = np.log(np.maximum(units.mass, 1e-12))
            self.linear[:], self.mixer[:] = rng.standard_normal((width, classes)) * 0.1, rng.standard_normal((width, topics)) * 0.3
            self.counts[:] = units.share[:, None] * np.exp(0.5 * rng.standard_normal((n, topics)))  # told apart a little
            self.counts /= self.counts.sum()
        self.retable(self.counts)

    def retable(self, counts: np.ndarray) -> None:
        """p(unit | class, topic) from expected counts; the unit's overall share keeps each above zero."""
        by_class = counts.take(self._order, 0)
        mass = np.array([by_class[i:j].sum(0) for i, j in zip(self._ends[:-1], self._ends[1:], strict=True)], np.float32)
        self.table = (np.float32(1 - FLOOR) / np.maximum(mass, np.float32(1e-30))).take(self.units.class_of, 0)
        self.table *= counts
        self.table += np.float32(FLOOR) * self.units.share[:, None]

    def _rows(self, near: list[np.ndarray]) -> np.ndarray:
        """Rows of ``_near``: those of ``left`` for the neighbours on the left, then those of ``right``."""
        rows = np.array(near, np.intp)
        rows[2:] += len(self.left)
        return rows

    def _hidden(self, rows: np.ndarray) -> np.ndarray:
        one, two = (np.float32(r) for r in REACH)
        h, far = self._near.take(rows[0], 0), self._near.take(rows[1], 0)
        h += self._near.take(rows[2], 0)
        far += self._near.take(rows[3], 0)
        h *= one
        far *= two
        h += far
        return np.tanh(h, out=h)

    def _exponentials(self, h: np.ndarray, room: np.ndarray | None, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Numerators of the class softmax and of the topic softmax, a column per word (in ``room``, if it has as many
        columns), and the logarithms of those at the cells ``at``; the sum of a column is the denominator."""
        x = np.matmul(self._both.T, h.T, out=room if room is not None and room.shape[1] == len(h) else None)
        x += self._biases[:, None]
        if not (np.abs(self._both).sum(0) + np.abs(self._biases)).max() < 60:  # else exp can't overflow, as |h| <= 1
            for part in (x[: len(self.bias)], x[len(self.bias) :]):
                part -= part.max(0)
        logs = None if at is None else x.reshape(-1).take(at)
        np.exp(x, out=x)
        return x[: len(self.bias)], x[len(self.bias) :], logs

    def _cells(self, unit: np.ndarray) -> np.ndarray:
        """The place of every word's class, a column per word."""
        at = self.units.class_of.take(unit).astype(np.intp)
        at *= len(unit)
        at += np.arange(len(unit))
        return at

    def log_probability(self, near: list[np.ndarray], unit: np.ndarray) -> np.ndarray:
        """log p(unit | both sides) of every word."""
        out, room = np.empty(len(unit), np.float64), np.empty((len(self._biases), STEP_WORDS), np.float32)
        for i in range(0, len(unit), STEP_WORDS):
            u = unit[i : i + STEP_WORDS]
            p, q, own = self._exponentials(self._hidden(self._rows([k[i : i + STEP_WORDS] for k in near])), room, self._cells(u))
            joint = np.multiply(self.table.take(u, 0).T, q, order="C").sum(0) / q.sum(0)
            out[i : i + STEP_WORDS] = np.maximum(own - np.log(p.sum(0, np.float64)), np.log(1e-30)) + np.log(np.maximum(joint, 1e-30))
        return out

    def slopes(self, near: list[np.ndarray], unit: np.ndarray):
        """Slopes of -log p, word by word: at the class softmax, the topic softmax and the hidden sums; the hidden vectors
        and the topics' shares in each word."""
        p, q, back, h, share = self._slopes(self._rows(near), unit, np.empty((len(self._biases), len(unit)), np.float32))
        return p.T, q.T, back, h, share.T

    def _slopes(self, rows: np.ndarray, unit: np.ndarray, room: np.ndarray):
        """``slopes``, with a column per word but at the hidden sums and in the hidden vectors; those at the softmaxes are
        in ``room``, which has a column per word."""
        h = self._hidden(rows)
        p, q, _ = self._exponentials(h, room)
        p /= p.sum(0)
        q /= q.sum(0)
        share = np.multiply(self.table.take(unit, 0).T, q, order="C")
        share /= np.maximum(share.sum(0), np.float32(1e-30))
        room.reshape(-1)[self._cells(unit)] -= 1
        q -= share
        back = room.T @ self._both.T
        back *= 1 - h * h
        return p, q, back, h, share

    def learn(self, near: list[np.ndarray], unit: np.ndarray, rate: float = RATE) -> None:
        """Steps of gradient descent over all words, in order; a row of an embedding moves by its mean slope. The tables
        follow the expected counts, which replace ``counts`` in the end (as shares of all words)."""
        start, seen, since = self.counts * np.float32(START_WORDS), np.zeros_like(self.counts), 0
        reach = np.float32(-rate) * np.array([REACH * 2], np.float32).T
        x = np.empty((len(self._biases), STEP_WORDS), np.float32)
        for i in range(0, len(unit), STEP_WORDS):
            rows, u = self._rows([k[i : i + STEP_WORDS] for k in near]), unit[i : i + STEP_WORDS]
            x = x if len(u) == STEP_WORDS else np.empty((len(x), len(u)), np.float32)
            _, _, back, h, share = self._slopes(rows, u, x)
            _add_rows(seen, u, share.T)
            self._both -= np.float32(rate / len(u)) * (x @ h).T
            self._biases -= np.float32(rate / len(u)) * x.sum(1)
            rows = rows.ravel()
            n = np.bincount(rows, minlength=len(self._near)).take(rows).astype(np.float32).reshape(len(reach), -1)
            _add_rows(self._near, rows, (reach / n)[:, :, None] * back)
            since += len(u)
            if since >= TABLE_WORDS:
                since = 0
                self.retable(start + seen)
        if len(unit):
            self.counts[:] = seen / seen.sum()
            self.retable(start + seen)


def _add_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add each row of ``values`` to its row of a contiguous table; rows may repeat. Two numbers go as one complex number."""
    kind = np.complex64 if table.shape[1] % 2 == 0 else np.float32
    flat, values = table.reshape(-1).view(kind), values.reshape(-1).view(kind)
    width = len(flat) // len(table)
    at = np.repeat(rows.astype(np.intp) * width, width)
    at += np.tile(np.arange(width), len(rows))
    np.add.at(flat, at, values)


# -- words of the corpus ----------------------------------------------------------------------------------------------

def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): every distinct word's key and number, over all documents; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed():
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)

        def row(keys, n):
            return pa.RecordBatch.from_pydict({"word": pa.array(keys.view(np.int64)), "n": pa.array(n)})

        for batch in batches:
            for some in textbuf.passes(batch, text):
                held.append(np.unique(words_of(some.column(text))[0], return_counts=True))
                size += len(held[-1][0])
                if size >= 2 * HELD_WORDS:
                    held = [summed()]
                    size = len(held[0][0])
                    if size >= HELD_WORDS:
                        yield row(*held[0])
                        held, size = [], 0
        if size:
            yield row(*summed())

    return storage.written(docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")


def units_of(words: DataFrame, head: int = HEAD) -> tuple[Units, np.ndarray, Column]:
    """Units of a vocabulary; for each tail unit (words, distinct words); and whether a row of it is in the tail."""
    top = [tuple(r) for r in words.orderBy(F.desc("n"), "word").limit(head).collect()]  # ``head`` rows at most
    last = top[-1] if top else (0, 0)
    rare = (F.col("n") < last[1]) | ((F.col("n") == last[1]) & (F.col("word") > last[0]))
    tail = np.zeros((TAIL, 2))
    for u, n, k in words.where(rare).groupBy(F.pmod("word", F.lit(TAIL)).alias("u")).agg(F.sum("n"), F.count("*")).collect():  # TAIL rows
        tail[u] = n, k
    return Units.of(top, tail[:, 0]), tail, rare


def _coded(docs: DataFrame, units: Units, text: str) -> DataFrame:
    """``docs`` without the text, with n_words, the words' units (16 bits each), and the distinct words of the tail with
    their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(units)
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in textbuf.passes(batch, text):
                keys, doc = words_of(some.column(text))
                unit, rare = shared.value.number(keys)
                n = np.bincount(doc, minlength=some.num_rows)
                ends = np.concatenate([[0], np.cumsum(n)])
                body = textbuf.tiles(np.frombuffer(unit.astype("<u2").tobytes(), np.uint8), 2 * ends).cast(pa.binary())
                where, key = doc[rare], keys[rare]
                order = np.lexsort((key, where))
                where, key = where[order], key[order]
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (where[1:] != where[:-1])])) if len(key) else np.zeros(0, np.int64)
                upto = pa.array(np.searchsorted(where[first], np.arange(some.num_rows + 1)), pa.int32())
                words, times = pa.array(key[first].view(np.int64)), pa.array(np.diff(np.append(first, len(key))), pa.int32())
                tail = pa.ListArray.from_arrays(upto, pa.StructArray.from_arrays([words, times], ["word", "k"]))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in rest), pa.array(n, pa.int64()), body, tail], names=[*rest, "_n", "_units", "_tail"])

    more = [T.StructField("_n", T.LongType()), T.StructField("_units", T.BinaryType()), T.StructField("_tail", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("k", T.IntegerType())])))]
    return docs.mapInArrow(run, T.StructType([*docs.select(*rest).schema.fields, *more]))


_PACKS = "part int, slice int, seq int, n long, keys binary, sizes binary, units binary"


def packs(coded: DataFrame, total: int, part_words: int = PART_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """Rows (part, slice, seq) with many texts' units each, from rows (_key, _hash, _n, _units); a written table."""
    parts = max(1, -(-total // part_words))
    most = max(1, 2 * part_words // rounds)
    where = F.pmod(F.shiftrightunsigned("_hash", 8), F.lit(parts)).cast("int").alias("part"), F.pmod("_hash", F.lit(rounds)).cast("int").alias("slice")
    rows = coded.where("_n > 0").select(*where, "_hash", "_key", "_units").repartition("part", "slice").sortWithinPartitions("part", "slice", "_hash", "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, held, size = None, 0, [], 0

        def row():
            sizes = np.array([len(u) // 2 for _, u in held], "<i4")
            body = {"keys": np.array([k for k, _ in held], "<i8").tobytes(), "sizes": sizes.tobytes(), "units": b"".join(u for _, u in held)}
            return pa.RecordBatch.from_pydict({"part": pa.array([now[0]], pa.int32()), "slice": pa.array([now[1]], pa.int32()), "seq": pa.array([seq], pa.int32()), "n": pa.array([size], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in body.items()}})

        for batch in batches:
            for part, slice_, key, units in zip(*(batch.column(c).to_pylist() for c in ("part", "slice", "_key", "_units")), strict=True):
                if held and (now != (part, slice_) or size >= most):
                    yield row()
                    seq, held, size = seq + 1 if now == (part, slice_) else 0, [], 0
                now = part, slice_
                held.append((key, units))
                size += len(units) // 2
        if held:
            yield row()

    return storage.written(rows.mapInArrow(run, _PACKS), "packs")


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a pack's texts, units of all words, and the number of the text of each."""
    sizes = np.frombuffer(row["sizes"], "<i4")
    return np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["units"], "<u2").astype(np.int32), np.repeat(np.arange(len(sizes)), sizes)


# -- training ---------------------------------------------------------------------------------------------------------

_BLOCKS = "block int, task int, n long, body binary"


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, task) to the mean of each such group, weighted by n; one group is held at a time."""
    now, total, mass = None, None, 0

    def row():
        return pa.RecordBatch.from_pydict({"block": pa.array([now[0]], pa.int32()), "task": pa.array([now[1]], pa.int32()), "n": pa.array([mass], pa.int64()), "body": pa.array([(total / max(mass, 1)).astype(np.float32).tobytes()], pa.binary())})

    for batch in batches:
        for block, task, n, body in zip(*(batch.column(c).to_pylist() for c in ("block", "task", "n", "body")), strict=True):
            if now != (block, task):
                if now is not None:
                    yield row()
                now, total, mass = (block, task), 0.0, 0
            total = total + np.frombuffer(body, np.float32).astype(np.float64) * n
            mass += n
    if now is not None:
        yield row()


def _round(some: DataFrame, network: Network, groups: int) -> np.ndarray | None:
    """Every pack learns by itself from ``network``; the mean of the weights, by words."""
    shared = some.sparkSession.sparkContext.broadcast((network.units, network.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, start = shared.value
        total, mass = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                net = Network(units, start.copy())
                _, unit, doc = _unpacked(row)
                near = sides(unit, doc, len(units.class_of))
                for _ in range(min(MOST_PASSES, max(1, -(-LEAST_WORDS // max(1, len(unit)))))):
                    net.learn(near, unit)
                total = (0 if total is None else total) + net.weights.astype(np.float64) * len(unit)
                mass += len(unit)
        if mass:
            mean = (total / mass).astype(np.float32)
            parts = [mean[i : i + BLOCK].tobytes() for i in range(0, len(mean), BLOCK)]
            k, task = len(parts), TaskContext.get().partitionId() % groups
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(k), pa.int32()), "task": pa.array([task] * k, pa.int32()), "n": pa.array([mass] * k, pa.int64()), "body": pa.array(parts, pa.binary())})
        textbuf.give_back()

    def mean(rows: DataFrame) -> DataFrame:
        return rows.repartition("block", "task").sortWithinPartitions("block", "task").mapInArrow(_averaged, _BLOCKS)

    in_groups = mean(some.mapInArrow(run, _BLOCKS))
    blocks = (mean(in_groups.withColumn("task", F.lit(0))) if groups > 1 else in_groups).orderBy("block").collect()  # the weights of one network
    shared.unpersist()
    return np.frombuffer(b"".join(r["body"] for r in blocks), np.float32).copy() if blocks else None


def train(packed: DataFrame, units: Units, rounds: int = ROUNDS) -> Network:
    """The network of all packs."""
    network = Network(units)
    first = packed.agg(F.min(F.struct("part", "slice", "seq"))).first()[0]
    if first is None:
        return network
    n = packed.count()
    network = Network(units, _round(packed.where((F.col("part") == first["part"]) & (F.col("slice") == first["slice"]) & (F.col("seq") == first["seq"])), network, 1))
    for r in range(rounds):
        before = network.counts.copy()
        weights = _round(packed.where(F.col("slice") == r), network, max(1, round((n / rounds) ** 0.5)))
        if weights is not None:
            network = Network(units, weights)
            # counts of all rounds, the later ones (made with better tables) weighing more
            network.counts[:] = (network.counts + before / 2) / (network.counts + before / 2).sum()
            network.retable(network.counts)
    return network


# -- scoring ----------------------------------------------------------------------------------------------------------

def _scored(packed: DataFrame, network: Network) -> DataFrame:
    """(_key, lp): the network's part of each text's sum."""
    shared = packed.sparkSession.sparkContext.broadcast((network.units, network.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = None
        for batch in batches:
            net = net or Network(*shared.value)
            for row in batch.to_pylist():
                key, unit, doc = _unpacked(row)
                lp = net.log_probability(sides(unit, doc, len(net.units.class_of)), unit)
                yield pa.RecordBatch.from_pydict({"_key": pa.array(key), "lp": pa.array(np.bincount(doc, weights=lp, minlength=len(key)))})
        textbuf.give_back()

    return packed.mapInArrow(run, "_key long, lp double")


def _tail_scores(coded: DataFrame, words: DataFrame, tail: np.ndarray) -> DataFrame:
    """(_key, lt, unseen): what the words of the tail add to each text's sum, and how many occur in no other text."""
    pairs = coded.where(F.size("_tail") > 0).select("_key", F.explode("_tail").alias("t")).select("_key", "t.word", "t.k")
    unit = F.pmod("word", F.lit(TAIL)).cast("int").alias("unit")
    met = pairs.join(words, "word").select("_key", "k", (F.col("n") - F.col("k")).alias("others"), unit)
    # one shuffle by text serves both sums: a text's words of a unit, then its units
    shares = met.repartition("_key").groupBy("_key", "unit").agg(F.sum(F.col("k") * F.log(F.col("others") + ALPHA)).alias("up"), F.sum("k").alias("own"), F.sum(F.when(F.col("others") == 0, F.col("k")).otherwise(0)).alias("unseen"))
    mass = F.get(F.array(*[F.lit(float(n + ALPHA * k)) for n, k in tail]), F.col("unit"))
    return shares.groupBy("_key").agg(F.sum(F.col("up") - F.col("own") * F.log(mass - F.col("own"))).alias("lt"), F.sum("unseen").alias("unseen"))


def pseudo_likelihood(docs: DataFrame, text: str = "text", head: int = HEAD, part_words: int = PART_WORDS) -> DataFrame:
    """Train on all of ``docs``, and score them: the columns of ``docs`` without the text, and those of ADDED."""
    taken = {f.name for f in ADDED}
    own = [c for c in docs.columns if c != text and c.lower() not in taken]
    plain = [f.name for f in docs.schema.fields if f.name in (text, *own) and isinstance(f.dataType, T.AtomicType)]
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("_hash"), *[F.col(f"`{c}`").alias(f"_col{i}") for i, c in enumerate(own)])
    words = vocabulary(rows)
    units, tail, rare = units_of(words, head)
    total = words.agg(F.sum("n")).first()[0] or 0
    coded = storage.written(_coded(rows.withColumn("_key", F.monotonically_increasing_id()), units, "text"), "coded")
    packed = packs(coded, total, part_words)
    network = train(packed, units)
    whole = coded.drop("_units", "_tail", "_hash").join(_scored(packed, network), "_key", "left").join(_tail_scores(coded, words.where(rare), tail), "_key", "left")
    pll = F.coalesce("lp", F.lit(0.0)) + F.coalesce("lt", F.lit(0.0))
    return whole.select(
        *[F.col(f"_col{i}").alias(c) for i, c in enumerate(own)], F.col("_n").alias("n_words"), F.coalesce("unseen", F.lit(0)).cast("long").alias("n_unseen"),
        pll.alias("pll"), F.when(F.col("_n") > 0, pll / F.col("_n")).alias("pll_mean"),
    )
