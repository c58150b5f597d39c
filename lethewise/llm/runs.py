"""Periodic runs of words: stretches that repeat themselves at a distance.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word
extends, at least ``MIN_WORDS`` and at least 2q words long.

Every run with period p holds two neighbours of the grid 0, p, 2p, ...; so for each p up to half a text's words and each
j, the longest common extensions of the words at jp and (j+1)p, forwards and backwards, give the run through them if there
is one. All grids of a text together are n (1 + 1/2 + 1/3 + ...) pairs. Extensions are minima over a range of the suffix array's
table of common prefixes (a sparse table answers each in two look-ups); the array of the reversed words gives those that
go backwards. A stretch found under several periods counts once, under the smallest.

A pair is asked only if the four words from it on, or the four that end with it, are equal at both places: within a run
at least max(12 - p, p) >= 6 places in a row agree with their partner, so the pair inside has four on one of its sides. The four words are
compared by a hash, which may let a pair through but never holds one back; arrays are built for texts with such a pair.

Texts are independent, so the work is one pass over the table without a shuffle; a text is never split. A batch is worked
on 2 MB of text at a time; arrays take up to some 100 bytes a word of a group of texts of ``GROUP_WORDS`` (or of one
longer text), pairs ``PAIRS`` at a time.

Defined results: a null, empty or blank text has no words, no runs and an empty collapsed text; repeated rows each get a
row; an empty table gives no rows; a text counts whole, however long. Columns of the input but the text are kept (those
named as in ``ADDED``, in any case of letters, give way).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage, textbuf

MIN_WORDS = 12
GROUP_WORDS, PAIRS = 1 << 17, 1 << 20
ADDED = ["runs", "collapsed"]

_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_NONE = np.zeros((0, 4), np.int64)


class Extensions:
    """Longest common extensions of places in words, each within its text. ``text`` numbers the texts in order."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        n = len(words)
        last = np.searchsorted(text, text, side="right")  # end of each place's text
        _, rank = np.unique(text * (int(words.max(initial=0)) + 1) + words, return_inverse=True)
        levels, width, at = [rank.astype(np.int32)], 1, np.arange(n)
        longest = int(np.bincount(text).max(initial=0))
        while width < longest and int(rank.max(initial=0)) < n - 1:
            behind = np.where(at + width < last, rank[np.minimum(at + width, n - 1)] + 1, 0)
            _, rank = np.unique(rank * np.int64(n + 1) + behind, return_inverse=True)
            levels.append(rank.astype(np.int32))
            width *= 2
        self.rank = rank
        order = np.empty(n, np.int64)
        order[rank] = at
        # common prefixes of neighbours in the array, from the widest equal block to the narrowest; no two places agree
        # at the widest, so each width counts once
        x, y, shared = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int64)
        end_x, end_y = last[order[:-1]], last[order[1:]]
        for k in range(len(levels) - 1, -1, -1):
            level, size = levels[k], 1 << k
            fits = (x + size <= end_x) & (y + size <= end_y) & (x < n) & (y < n)
            same = fits & (level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)])
            x[same] += size
            y[same] += size
            shared[same] += size
        del levels
        self.table = [shared.astype(np.int32)]
        while 2 << (len(self.table) - 1) <= min(longest, len(shared)):
            before, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(before[:-half], before[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from a and from b on; a and b differ and stand in one text."""
        i, j = self.rank[a], self.rank[b]
        lo, size = np.minimum(i, j), np.abs(i - j)
        out = np.zeros(len(a), np.int64)
        level = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[lo[at]], row[lo[at] + size[at] - (1 << k)])
        return out


def _fours(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the four words from each place on, and of the four that end there; places without four have values of
    their own."""
    n = len(words)
    own = textbuf.mixed(np.arange(n, dtype=np.uint64) + np.uint64(1 << 40))
    w = textbuf.mixed(words.astype(np.uint64) + np.uint64(1))
    on, upto = own.copy(), textbuf.mixed(own)
    if n >= 4:
        h = np.zeros(n - 3, np.uint64)
        for k, p in enumerate(textbuf.powers(textbuf._ODD, 4)):
            h += w[k : n - 3 + k] * p
        place = np.arange(n) - np.repeat(starts, sizes)
        room = np.flatnonzero(place[: n - 3] + 4 <= np.repeat(sizes, sizes)[: n - 3])
        on[room] = h[room]
        upto[room + 3] = h[room]
    return on, upto


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place jp, period) of all grids of texts of ``sizes`` words, in rising order of periods within a text."""
    half = sizes // 2
    text = np.repeat(np.arange(len(sizes)), half)
    period = textbuf.ragged(np.ones(len(half), np.int64), half)
    count = (sizes[text] - 1) // period
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        m, p = count[at:to], np.repeat(period[at:to], count[at:to])
        yield np.repeat(text[at:to], m), textbuf.ragged(np.zeros(to - at, np.int64), m) * p + np.repeat(starts[text[at:to]], m), p
        at = to


def runs_of(words: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in order of text, start and period. ``words`` are numbers, those of
    all texts end to end."""
    if min_words < MIN_WORDS:
        raise ValueError(f"a run has {MIN_WORDS} words at least")
    starts = np.cumsum(sizes) - sizes
    on, upto = _fours(words, starts, sizes)
    live = np.zeros(len(sizes), bool)
    some = np.flatnonzero(sizes >= min_words)
    for text, a, p in _pairs(starts[some], sizes[some]):
        live[some[text[(on[a] == on[a + p]) | (upto[a] == upto[a + p])]]] = True
    left, found = np.flatnonzero(live), [_NONE]
    groups = np.cumsum(sizes[left]) // GROUP_WORDS
    for g in np.unique(groups):
        mine = left[groups == g]
        found.append(_grouped(words[textbuf.ragged(starts[mine], sizes[mine])], sizes[mine], mine, min_words))
    return np.concatenate(found)


def _grouped(words: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, min_words: int) -> np.ndarray:
    starts, n = np.cumsum(sizes) - sizes, len(words)
    text = np.repeat(np.arange(len(sizes)), sizes)
    on, upto = _fours(words, starts, sizes)
    forward = Extensions(words, text)
    back = Extensions(words[::-1], (len(sizes) - 1 - text)[::-1])
    kept = np.zeros((0, 3), np.int64)  # start, end, period
    for _, a, p in _pairs(starts, sizes):
        ask = (on[a] == on[a + p]) | (upto[a] == upto[a + p])
        a, p = a[ask], p[ask]
        if not len(a):
            continue
        ahead = forward.of(a, a + p)
        behind = back.of(n - 1 - a, n - 1 - a - p)
        start, end = a - behind + 1, a + p + ahead
        good = (ahead > 0) & (end - start >= np.maximum(min_words, 2 * p))
        # periods rise, so the first of equal stretches has the smallest
        kept = np.concatenate([kept, np.stack([start[good], end[good], p[good]], axis=1)])
        kept = kept[np.sort(np.unique(kept[:, 0] * (n + 1) + kept[:, 1], return_index=True)[1])]
    of = text[kept[:, 0]]
    out = np.stack([numbers[of], kept[:, 0] - starts[of], kept[:, 1] - kept[:, 0], kept[:, 2]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, equal words alike, and the number of words of each text."""
    sizes = np.array([len(w) for w in texts], np.int64)
    flat = pa.array([x for w in texts for x in w], pa.large_binary())
    return np.asarray(flat.dictionary_encode().indices, dtype=np.int64), sizes


def find(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the text, and with ``runs`` (start, length, period, by start and then period; words of ASCII white
    space apart, from 0) and ``collapsed``, the words that stay when each run keeps its first period, a space between."""
    return storage.apart(docs, ADDED, lambda rows: _found(rows, min_words), text=text)


def _found(docs: DataFrame, min_words: int) -> DataFrame:
    rest = [c for c in docs.columns if c != "text"]
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in textbuf.passes(batch, "text"):
                raw, off = textbuf.flat(some.column("text"))
                data, at = raw.tobytes(), off.tolist()
                texts = [data[a:b].split() for a, b in zip(at[:-1], at[1:], strict=True)]
                words, sizes = numbered(texts)
                runs = runs_of(words, sizes, min_words)
                ends = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
                for k in np.unique(runs[:, 0]).tolist():
                    mine = runs[ends[k] : ends[k + 1]]
                    edge = np.zeros(sizes[k] + 1, np.int64)
                    np.add.at(edge, mine[:, 1] + mine[:, 3], 1)
                    np.add.at(edge, mine[:, 1] + mine[:, 2], -1)
                    texts[k] = [texts[k][i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                fields = [pa.array(runs[:, c]) for c in (1, 2, 3)]
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"])).cast(run_type)
                joined = pa.array([b" ".join(w) for w in texts], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in rest), listed, joined], names=[*rest, *ADDED])

    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])
    return docs.mapInArrow(work, schema)


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with collapsed texts; a null text is an empty one."""
    return storage.beside(docs, [text], lambda rows: find(rows, text).select(*[c for c in rows.columns if c != text], F.col("collapsed").alias(text)))
