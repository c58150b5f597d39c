"""Benchmark decontamination by word windows.

Texts are lower-cased in A-Z; words are runs of ASCII letters, digits and characters beyond ASCII. A window is ``width``
consecutive words of one benchmark item, or a whole shorter item that has a word. The windows' hashes are broadcast in
blocks of at most ``block_windows``, so that what an executor holds is bounded however large the benchmark is; each block
is one pass over the documents, whose own windows of the same lengths are hashed with rolling sums and probed. Each
probe that matches is verified byte by byte. The hit words of all blocks are then united per document, and the operator
reports them or removes spans or documents.

Defined results: a null text, or one without words, has no words and no hits; a benchmark text without words is no item;
an item whose id is null marks hits but is not listed in ``item_ids``; repeated rows are each judged; an empty benchmark
hits nothing. All columns of ``docs`` are kept (those named as in ``ADDED``, in any case of letters, are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage, textbuf

WIDTH = 10
#: Windows in one broadcast block: hashes, places and item numbers take some 40 bytes each, so a block under 50 MB with
#: its words, and a worker holds 4 MB of bitmap for each of the (at most WIDTH) lengths of window.
BLOCK_WINDOWS = 1_000_000
#: Probes that are verified together.
VERIFIED = 1 << 15

_CODE = np.arange(256)
_WORD = (_CODE >= 0x80) | ((_CODE >= 0x30) & (_CODE <= 0x39)) | ((_CODE >= 0x61) & (_CODE <= 0x7A))
_LOWER = np.where((_CODE >= 0x41) & (_CODE <= 0x5A), _CODE + 32, _CODE).astype(np.uint8)

ADDED = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("hit_starts", T.ArrayType(T.IntegerType())), T.StructField("hit_ends", T.ArrayType(T.IntegerType())),
]


def words(text: str | None) -> list[bytes]:
    """The words of one text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    raw = _LOWER[raw]
    s, e, _ = textbuf.words_at(raw, _WORD, np.array([0, len(raw)]))
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def _window_hashes(word: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on; the last width - 1 places have none."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, p in enumerate(textbuf.powers(textbuf._ODD, width)):
        out += word[j : j + n] * p
    return out


class Words:
    """The words of lower-cased bytes: ``starts`` and ``ends`` in ``raw``, and the text of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = raw
        self.starts, self.ends, self.text = textbuf.words_at(raw, _WORD, offsets)

    def hashes(self) -> np.ndarray:
        return textbuf.hashes(self.raw, self.starts, self.ends)

    def same(self, i: np.ndarray, other: Words, j: np.ndarray, width: int) -> np.ndarray:
        """Whether the ``width`` words from each i on are the other's from j on."""
        out = np.zeros(len(i), bool)
        for a in range(0, len(i), VERIFIED):
            at = np.arange(a, min(len(i), a + VERIFIED))
            for k in range(width):
                x, y = i[at] + k, j[at] + k
                size = self.ends[x] - self.starts[x]
                ok = size == other.ends[y] - other.starts[y]
                at, x, y, size = at[ok], x[ok], y[ok], size[ok]
                if not len(at):
                    break
                differ = self.raw[textbuf.ragged(self.starts[x], size)] != other.raw[textbuf.ragged(other.starts[y], size)]
                at = at[np.add.reduceat(differ, np.cumsum(size) - size) == 0]
            out[at] = True
        return out


class Windows:
    """A block of benchmark windows, ready to be probed: equal ones are one, with the items they stand in."""

    def __init__(self, items: list[tuple[str | None, bytes, int, int]], width: int = WIDTH):
        """From (item id, words with a space between, first window, number of windows)."""
        self.ids = [x[0] for x in items]
        offsets = np.cumsum([0, *(len(x[1]) for x in items)])
        self.words = Words(np.frombuffer(b"".join(x[1] for x in items), np.uint8), offsets)
        n_words = np.bincount(self.words.text, minlength=len(items)) if items else np.zeros(0, np.int64)
        base = np.cumsum(n_words) - n_words
        self.by_width: dict[int, tuple] = {}
        hashes = self.words.hashes() if items else None
        for size in sorted({min(width, int(n)) for n in n_words}):
            mine = [k for k, n in enumerate(n_words.tolist()) if min(width, n) == size]
            at = np.concatenate([base[k] + items[k][2] + np.arange(items[k][3]) for k in mine])
            of = np.concatenate([np.full(items[k][3], k) for k in mine])
            h = _window_hashes(hashes, size)[at]
            order = np.argsort(h, kind="stable")
            h, at, of = h[order], at[order], of[order]
            first = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), np.arange(len(h)), 0))
            # windows that share a hash and not their words (hardly ever) stand for themselves
            alone = ~self.words.same(at, self.words, at[first], size)
            first[alone] = np.flatnonzero(alone)
            order = np.lexsort((of, first))
            of, first = of[order], first[order]
            lead, where = np.unique(first, return_index=True)
            known = h[lead]
            coarse = np.zeros(1 << 22, bool)
            coarse[(known >> np.uint64(42)).astype(np.int64)] = True
            self.by_width[size] = known, coarse, at[lead], np.append(where, len(of)), of

    def find(self, words: Words):
        """For each width, hits as the place of the first word and the number of the window."""
        if not len(words.starts) or not self.by_width:
            return
        h = words.hashes()
        for width, (known, coarse, place, _, _) in self.by_width.items():
            g = _window_hashes(h, width)
            at = np.flatnonzero(coarse[(g >> np.uint64(42)).astype(np.int64)])
            at = at[words.text[at] == words.text[at + width - 1]]
            low, high = (np.searchsorted(known, g[at], side=x) for x in ("left", "right"))
            k = textbuf.ragged(low, high - low)
            at = np.repeat(at, high - low)
            ok = words.same(at, self.words, place[k], width)
            yield width, at[ok], k[ok]

    def items(self, width: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of windows, end to end, and their numbers."""
        _, _, _, where, of = self.by_width[width]
        n = where[windows + 1] - where[windows]
        return of[textbuf.ragged(where[windows], n)], n


def _scan(windows: Windows, batch: pa.RecordBatch, only_hits: bool) -> pa.RecordBatch:
    """The batch with the columns of ADDED; ``hit_starts`` and ``hit_ends`` number runs of hit words."""
    raw, offsets = textbuf.flat(batch.column("text"))
    words = Words(_LOWER[raw], offsets)
    doc, n = words.text, len(offsets) - 1
    cover, pairs = np.zeros(len(doc) + 1, np.int64), [np.zeros((0, 2), np.int64)]
    for width, at, window in windows.find(words):
        np.add.at(cover, at, 1)
        np.add.at(cover, at + width, -1)
        some = np.unique(np.stack([doc[at], window], 1), axis=0)
        item, times = windows.items(width, some[:, 1])
        pairs.append(np.stack([np.repeat(some[:, 0], times), item], 1))
    hit = np.cumsum(cover[:-1]) > 0
    n_words, n_hit = np.bincount(doc, minlength=n), np.bincount(doc[hit], minlength=n)
    listed: dict[int, set] = {}
    for d, k in np.unique(np.concatenate(pairs), axis=0).tolist():
        if windows.ids[k] is not None:
            listed.setdefault(d, set()).add(windows.ids[k])
    first = np.cumsum(n_words) - n_words
    none = np.zeros(0, np.int64)
    starts, ends = [none] * n, [none] * n
    for d in np.flatnonzero(n_hit).tolist():
        h = np.diff(np.concatenate([[0], hit[first[d] : first[d] + n_words[d]].astype(np.int8), [0]]))
        starts[d], ends[d] = np.flatnonzero(h == 1), np.flatnonzero(h == -1)
    added = [
        pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(listed.get(d, ())) for d in range(n)], pa.list_(pa.string())),
        pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())),
    ]
    out = pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(f.name for f in ADDED)])
    return out.filter(pa.array(n_hit > 0)) if only_hits else out


def _blocks(benchmark: DataFrame, item_id: str, text: str, width: int, block_windows: int) -> Iterator[list]:
    """Items of the benchmark in blocks of windows; a row at a time reaches the driver. An item with more windows than a
    block holds is in several."""
    held, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("string"), text).toLocalIterator():
        w = words(row[1])
        n, at = max(1, len(w) - width + 1) if w else 0, 0
        while at < n:
            take = min(n - at, block_windows - size)
            held.append((row[0], b" ".join(w[at : at + take + width - 1]) + b" ", 0, take))
            size, at = size + take, at + take
            if size >= block_windows:
                yield held
                held, size = [], 0
    if held:
        yield held


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (as strings, sorted) and the runs of hit words (numbers of words, end
    exclusive)."""
    blocks = _blocks(benchmark, item_id, item_text, width, block_windows)
    return storage.apart(docs, [f.name for f in ADDED], lambda rows: _annotated(rows, blocks, width), text=text)


def _pass_over(rows: DataFrame, block: list, width: int, only_hits: bool = False) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Windows(block, width))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in textbuf.passes(batch, "text"):
                yield _scan(shared.value, some, only_hits)

    return rows.mapInArrow(scan, T.StructType([*rows.schema.fields, *ADDED]))


def _annotated(rows: DataFrame, blocks: Iterator[list], width: int) -> DataFrame:
    one, two = next(blocks, []), next(blocks, None)
    if two is None:
        return _pass_over(rows, one, width)
    # More than one block: a key of our own for each row, a pass for each block, and the union of the hit words by key.
    keyed = storage.written(rows.withColumn("row", F.monotonically_increasing_id()), "decontam")
    parts = None
    while one is not None:
        found = _pass_over(keyed.select("row", "text"), one, width, True).select("row", "item_ids", F.arrays_zip("hit_starts", "hit_ends").alias("runs"))
        found = storage.written(found, "hits")
        parts = found if parts is None else parts.unionByName(found)
        one, two = two, next(blocks, None) if two is not None else None
    positions = F.flatten(F.transform("runs", lambda r: F.sequence(r["hit_starts"], r["hit_ends"] - 1)))
    united = parts.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(positions)))).alias("hit"))
    united = united.select(
        "row", "item_ids", F.size("hit").cast("long").alias("n_hit"),
        F.filter("hit", lambda x, i: (i == 0) | (F.get(F.col("hit"), i - 1) != x - 1)).alias("hit_starts"),
        F.transform(F.filter("hit", lambda x, i: F.coalesce(F.get(F.col("hit"), i + 1) != x + 1, F.lit(True))), lambda x: x + 1).alias("hit_ends"),
    )
    counted = _pass_over(keyed, [], width).drop("n_hit", "item_ids", "hit_starts", "hit_ends")
    return counted.join(united, "row", "left").select(
        *rows.columns, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        *[F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in ("hit_starts", "hit_ends")],
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones, with its own columns."""
    return storage.beside(docs, [text], lambda d: annotate(d, benchmark, text=text, **options).where("n_hit = 0"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every run of hit words, and what stands between them, cut out of the text."""
    return storage.beside(docs, [text], lambda d: _cut_spans(annotate(d, benchmark, text=text, **options), text))


def _cut_spans(marked: DataFrame, text: str) -> DataFrame:
    schema = T.StructType([f for f in marked.schema.fields if f not in ADDED])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, starts, ends in zip(*(batch.column(c).to_pylist() for c in (text, "hit_starts", "hit_ends")), strict=True):
                if starts:
                    data = x.encode()
                    raw = _LOWER[np.frombuffer(data, np.uint8)]
                    s, e, _ = textbuf.words_at(raw, _WORD, np.array([0, len(raw)]))
                    at, kept = 0, []
                    for a, b in zip(starts, ends, strict=True):
                        kept.append(data[at : s[a]])
                        at = int(e[b - 1])
                    x = b"".join([*kept, data[at:]]).decode()
                out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else batch.column(c) for c in schema.names], names=schema.names)

    return marked.mapInArrow(cut, schema)
