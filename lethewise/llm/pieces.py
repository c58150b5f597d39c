"""SentencePiece encoding and decoding with a batched Viterbi in numpy.

The vocabulary and scores come from a public ``.model`` file; the segmentation is the one of highest total score. A text
is escaped as the file's normaliser says (identity; a space is one mark, and one stands before the text), and cut into
words where a mark follows something else; no piece of the vocabulary reaches over such a cut (checked on loading), so
words are segmented one by one, and each distinct word once.

Words beyond ``LONG_WORD`` bytes are first cut where no piece reaches over, which is exact as well. What is still longer is
advanced in windows of ``WINDOW`` bytes, all windows together: from every place where a path may enter a window, the best
scores of all places in it; running through the windows then joins them.

New words are segmented in batches. For each piece length, hashes of all substrings of that length, from one running sum
over the whole batch, are probed in a coarse bitmap and then among the sorted hashes of that length's pieces, and matches
are verified byte by byte. Words of equal length then advance together: for each end, the best predecessor over all piece
lengths is a maximum over vectors, whose arg is the back-pointer. Of equal scores the longest last piece wins. A character
without a piece of its own costs ``UNKNOWN_PENALTY`` below the lowest score and becomes its bytes' pieces.

Defined results: a null text gives null ids and 0 tokens; an empty text gives no ids; a text that holds the mark itself
decodes with spaces instead; repeated rows each get a row; an empty table gives no rows. Other columns are kept (those named as a new one, in any case
of letters, are replaced).

The ids are those of the highest total score. Where the file was made by merging pairs (its type is BPE, its scores are
the merges' ranks), the library's own encoder applies the merges instead, and its ids differ; where the file's type is
unigram, it maximises the same sum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import storage, textbuf
from .memo import PieceMemo

MARK = "▁".encode()
UNKNOWN_PENALTY = 10.0
#: Bytes of new words that are segmented together; words beyond LONG_WORD bytes are cut, or advanced in windows.
BATCH_BYTES, LONG_WORD = 1 << 18, 512
#: Bytes of a window, and windows advanced together.
WINDOW, WINDOWS = 128, 256
#: Words whose ids a worker remembers, between tasks too.
KNOWN_WORDS = 250_000


class Vocabulary:
    """Pieces by length, with sorted hashes; in them a space stands for the mark."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text: list[bytes] = [b""] * n
        self.byte_id = np.full(256, sp.unk_id(), np.uint32)
        normal: list[tuple[bytes, int, float]] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[i] = piece.encode().replace(MARK, b" ")
                normal.append((self.text[i], i, sp.get_score(i)))
        if any(b" " in p.lstrip(b" ") for p, _, _ in normal):
            raise ValueError("a piece reaches over the end of a word")
        self.unknown = min(s for _, _, s in normal) - UNKNOWN_PENALTY
        self.lengths = sorted({len(p) for p, _, _ in normal})
        self.by_length = {}
        for size in self.lengths:
            some = [x for x in normal if len(x[0]) == size]
            raw = np.frombuffer(b"".join(p for p, _, _ in some), np.uint8)
            at = np.arange(len(some)) * size
            h = textbuf.hashes(raw, at, at + size)
            order = np.argsort(h, kind="stable")
            coarse = np.zeros(1 << 18, bool)
            coarse[(h >> np.uint64(46)).astype(np.int64)] = True
            self.by_length[size] = h[order], coarse, np.array([some[i][1] for i in order], np.uint32), np.array([some[i][2] for i in order]), raw.reshape(-1, size)[order]
        sizes = np.array([len(t) for t in self.text])
        self.sizes, self.starts, self.bytes = sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(self.text), np.uint8)

    def probe(self, raw: np.ndarray, at: np.ndarray, size: int, sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the places ``at``, those where a piece of this length stands; its id and score."""
        known, coarse, ids, scores, rows = self.by_length[size]
        h = sums(at, at + size)
        hit = coarse[(h >> np.uint64(46)).astype(np.int64)]
        at, h = at[hit], h[hit]
        k = np.minimum(np.searchsorted(known, h), len(known) - 1)
        ok = known[k] == h
        at, k = at[ok], k[ok]
        ok = (raw[at[:, None] + np.arange(size)] == rows[k]).all(1)
        return at[ok], ids[k[ok]], scores[k[ok]]


def _running(raw: np.ndarray):
    """A function that hashes slices of ``raw`` as ``textbuf.hashes`` does, with the running sum made once."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * textbuf.powers(textbuf._ODD, n), out=sums[1:])
    inverse = textbuf.powers(textbuf._INV, n + 1)
    return lambda a, b: textbuf.mixed((sums[b] - sums[a]) * inverse[a] ^ (b - a).astype(np.uint64))


class Encoder:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.memo = PieceMemo(self._encode_words, KNOWN_WORDS)

    def _edges(self, raw: np.ndarray, left: np.ndarray) -> dict[int, np.ndarray]:
        """Per length, the score of the edge that starts at each byte (-inf: none); ``left`` is the number of bytes to
        the end of the byte's word."""
        v, sums = self.vocabulary, _running(raw)
        lead = (raw & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        width = 1 + (raw >= 0xC0).astype(np.int64) + (raw >= 0xE0) + (raw >= 0xF0)
        edges, single = {}, np.zeros(len(raw), bool)
        for size in sorted({*v.lengths, 1, 2, 3, 4}):
            at = at[left[at] >= size]
            if not len(at):
                break
            score = np.full(len(raw), -np.inf)
            if size in v.by_length:
                where, _, found = v.probe(raw, at, size, sums)
                score[where] = found
                single[where] |= width[where] == size
            if size <= 4:
                alone = at[(width[at] == size) & ~single[at]]
                score[alone] = v.unknown
            edges[size] = score
        return edges

    def _together(self, edges: dict[int, np.ndarray], starts: np.ndarray, n: int) -> np.ndarray:
        """Back-pointers [word, end] (lengths of the last edge) of words of n bytes."""
        best = np.full((n + 1, len(starts)), -np.inf)
        best[0] = 0
        back = np.zeros((n + 1, len(starts)), np.int32)
        sizes = sorted(edges, reverse=True)
        for end in range(1, n + 1):
            for size in sizes:
                if size <= end:
                    x = best[end - size] + edges[size][starts + (end - size)]
                    up = x > best[end]
                    best[end][up] = x[up]
                    back[end][up] = size
        return back.T

    def _cut(self, word: bytes) -> list[bytes]:
        """The word's parts between places that no piece (or character) reaches over."""
        raw, reach = np.frombuffer(word, np.uint8), max(*self.vocabulary.lengths, 4)
        ends = np.arange(1, len(raw) + 1)
        for a in range(0, len(raw), BATCH_BYTES):
            part = raw[a : a + BATCH_BYTES + reach]
            for size, score in self._edges(part, len(part) - np.arange(len(part))).items():
                at = np.flatnonzero(score[:BATCH_BYTES] > -np.inf) + a
                ends[at] = np.maximum(ends[at], at + size)
        cuts = np.flatnonzero(np.maximum.accumulate(ends) == np.arange(1, len(raw) + 1)) + 1
        return [word[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def _windowed(self, raw: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Edge lengths of long words, which stand end to end in ``raw``."""
        reach = max(*self.vocabulary.lengths, 4)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        windows = -(-sizes // WINDOW)
        at = np.repeat(starts, windows) + WINDOW * (np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows))
        room = np.repeat(ends, windows) - at
        back = np.zeros(len(raw) + 1, np.uint8)  # length of the last edge into each place
        first_state, state, last = np.full(reach, -np.inf), None, None
        first_state[0] = 0
        for b0 in range(0, len(at), WINDOWS):
            a, r = at[b0 : b0 + WINDOWS], room[b0 : b0 + WINDOWS]
            lo, hi = int(a[0]), min(len(raw), int(a[-1]) + WINDOW + reach)
            word_end = ends[np.searchsorted(ends, np.arange(lo, hi), side="right")]
            places = np.minimum(a[:, None] - lo + np.arange(WINDOW), hi - lo - 1)
            outside = np.arange(WINDOW) >= r[:, None]
            edges = {}
            for size, score in self._edges(raw[lo:hi], np.minimum(word_end, hi) - np.arange(lo, hi)).items():
                edges[size] = score[places]
                edges[size][outside] = -np.inf
            best = np.full((WINDOW + reach, len(a), reach), -np.inf)  # [place, window, entry]
            into = np.zeros(best.shape, np.uint8)
            best[np.arange(reach), :, np.arange(reach)] = 0
            for end in range(1, WINDOW + reach):
                for size in sorted(edges, reverse=True):
                    if 0 <= end - size < WINDOW:
                        x = best[end - size] + edges[size][:, end - size, None]
                        up = x > best[end]
                        best[end][up] = x[up]
                        into[end][up] = size
            for k in range(len(a)):
                if b0 + k == 0 or at[b0 + k] != at[b0 + k - 1] + WINDOW or room[b0 + k - 1] <= WINDOW:
                    state, last = first_state, np.zeros(reach, np.uint8)
                score, edge = best[:, k] + state, into[:, k]
                edge[np.arange(reach), np.arange(reach)] = last
                top = score.max(1)
                edge = np.where((score == top[:, None]) & (top > -np.inf)[:, None], edge, 0).max(1)
                n = min(WINDOW, int(r[k]) + 1)
                back[a[k] + 1 : a[k] + n] = edge[1:n]
                if edge[0]:
                    back[a[k]] = edge[0]
                if r[k] <= WINDOW:
                    back[a[k] + r[k]] = edge[r[k]]
                state, last = top[WINDOW:], edge[WINDOW:]
        out = []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            steps, path = back[s : e + 1].tolist(), []
            while e > s:
                path.append(steps[e - s])
                e -= path[-1]
            out.append(np.array(path[::-1], np.int64))
        return out

    def _encode_words(self, whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._cut(w) if len(w) > LONG_WORD else [w] for w in whole]
        words = [w for p in parts for w in p]
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out: list[np.ndarray] = [None] * len(words)  # edge lengths of each word
        short = [i for i in order if len(words[i]) <= LONG_WORD]
        for some, work in ((short, self._batch), (order[len(short) :], self._long)):
            batch, size = [], 0
            for i in some:
                batch.append(i)
                size += len(words[i])
                if size >= BATCH_BYTES:
                    work(words, batch, out)
                    batch, size = [], 0
            if batch:
                work(words, batch, out)
        raw = np.frombuffer(b"".join(words), np.uint8)
        length = np.concatenate(out) if out else np.zeros(0, np.int64)
        at = np.cumsum(length) - length
        ids, known, sums = np.zeros(len(length), np.uint32), np.zeros(len(length), bool), _running(raw)
        for s in self.vocabulary.lengths:
            mine = np.flatnonzero(length == s)
            if len(mine):
                where, found, _ = self.vocabulary.probe(raw, at[mine], s, sums)
                hit = mine[np.searchsorted(at[mine], where)]
                ids[hit], known[hit] = found, True
        # an edge without a piece is one character: its bytes' pieces
        n_ids = np.where(known, 1, length)
        ends = np.cumsum(n_ids)
        flat = np.repeat(ids, n_ids)
        lost = np.flatnonzero(~known)
        if len(lost):
            flat[textbuf.ragged((ends - n_ids)[lost], n_ids[lost])] = self.vocabulary.byte_id[raw[textbuf.ragged(at[lost], length[lost])]]
        upto = np.concatenate([[0], ends])[np.cumsum(np.fromiter(map(len, out), np.int64, len(out)))]
        upto = upto[np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) - 1]  # of the words as they came
        return flat, np.diff(upto, prepend=0)

    def _long(self, words: list[bytes], batch: list[int], out: list) -> None:
        for i, edges in zip(batch, self._windowed(np.frombuffer(b"".join(words[i] for i in batch), np.uint8), np.array([len(words[i]) for i in batch])), strict=True):
            out[i] = edges

    def _batch(self, words: list[bytes], batch: list[int], out: list) -> None:
        sizes = np.fromiter((len(words[i]) for i in batch), np.int64, len(batch))  # ascending
        raw = np.frombuffer(b"".join(words[i] for i in batch), np.uint8)
        starts = np.cumsum(sizes) - sizes
        edges = self._edges(raw, np.repeat(starts + sizes, sizes) - np.arange(len(raw)))
        first = np.flatnonzero(np.concatenate([[True], sizes[1:] != sizes[:-1]]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(batch)], strict=True):
            n = int(sizes[a])
            back = self._together(edges, starts[a:b], n)
            rows, at, steps = np.arange(b - a), np.full(b - a, n), []
            while (at > 0).any():
                step = back[rows, at]
                steps.append(step)
                at = at - step  # at 0 the pointer is 0
            path = np.array(steps[::-1]).T
            counts = (path > 0).sum(1)
            for k, part in enumerate(np.split(path[path > 0].astype(np.int64), np.cumsum(counts)[:-1])):
                out[batch[a + k]] = part

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the n + 1 places where texts begin and end in them."""
        raw, offsets = textbuf.flat(column)
        data = raw.tobytes()
        if MARK in data:
            parts = [data[a:b].replace(MARK, b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            raw, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
        some = np.flatnonzero(np.diff(offsets))
        raw = np.insert(raw, offsets[some], 0x20)  # the mark before each text that isn't empty
        lead = np.zeros(len(offsets), np.int64)
        lead[some + 1] = 1
        offsets = offsets + np.cumsum(lead)
        cut = np.zeros(len(raw) + 1, bool)
        cut[:-1] = raw == 0x20
        cut[1:-1] &= raw[:-1] != 0x20
        cut[offsets] = True
        ids, upto = self.memo.stream(raw, np.flatnonzero(cut), offsets)
        return ids, upto

    def decode(self, ids: np.ndarray, upto: np.ndarray) -> pa.Array:
        """The texts of ids between neighbouring places."""
        v = self.vocabulary
        size = v.sizes[ids]
        raw = v.bytes[textbuf.ragged(v.starts[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[upto]
        some = np.flatnonzero(np.diff(ends))
        keep = np.ones(len(raw), bool)
        first = ends[some]
        keep[first[raw[first] == 0x20]] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        raw = raw[keep]
        data = textbuf.tiles(raw, kept[ends])
        try:
            return data.cast(pa.large_string())
        except pa.ArrowInvalid:  # ids that aren't from a text
            return pa.array([x.decode(errors="replace") for x in data.to_pylist()], pa.large_string())


@lru_cache(maxsize=1)
def _encoder(model: str) -> Encoder:
    """One encoder for all tasks of a Python worker, so that what it has learned of words lasts."""
    return Encoder(model)


def encode(docs: DataFrame, model: str, text: str = "text", verify: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with piece_ids (array of int), n_pieces and ids_crc32 (of the ids as little-endian 32-bit numbers).

    With ``verify`` the ids are decoded again, and ``round_trip`` tells whether that gives the text (the mark itself
    counted as a space); ``keep_text`` false leaves the text out of the result."""
    made = ["piece_ids", "n_pieces", "ids_crc32", *["round_trip"] * verify]
    return storage.apart(docs, made, lambda rows: _encoded(rows, model, "text", verify, keep_text), text=text)


def _encoded(docs: DataFrame, model: str, text: str, verify: bool, keep_text: bool) -> DataFrame:
    own = [c for c in docs.columns if keep_text or c != text]
    checked = [T.StructField("round_trip", T.BooleanType())] if verify else []
    schema = T.StructType([*docs.select(*own).schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), *checked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            for some in textbuf.passes(batch, text):
                column = some.column(text)
                ids, upto = encoder.encode(column)
                raw, at = memoryview(ids.astype("<u4").tobytes()), upto.tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                listed = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids.view(np.int32)), mask=column.is_null() if column.null_count else None)
                added = [listed, pa.array(np.diff(upto), pa.int64()), pa.array(crc, pa.int64())]
                if verify:
                    plain = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), "▁", " ")
                    added.append(pc.equal(encoder.decode(ids, upto), plain))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in own), *added], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; null ids give a null text, and none an empty one."""

    def work(inner: DataFrame) -> DataFrame:
        schema = T.StructType([*inner.schema.fields, T.StructField(to, T.StringType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = _encoder(model)
            for batch in batches:
                for a in range(0, batch.num_rows, 1000):
                    some = batch.slice(a, 1000)
                    column = some.column("ids")
                    size = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
                    out = encoder.decode(np.asarray(column.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(size)]))
                    if column.null_count:
                        out = pa.array([None if null else x for x, null in zip(out.to_pylist(), column.is_null().to_pylist(), strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([*some.columns, out.cast(pa.string())], names=schema.names)

        return inner.mapInArrow(run, schema)

    return storage.apart(rows, [to], work, ids=ids)
