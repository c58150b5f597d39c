"""Token ids as a wavelet matrix per shard.

A shard holds consecutive documents. Its ids are replaced by their rank in the shard's sorted alphabet and stored as one
bit-plane per bit of that rank, the highest first; before each next plane the ids are stably parted by the plane's bit
(Claude, Navarro, Ordonez 2015). The image holds a directory of the ones before every ``STRIDE`` bits, so that ``rank`` is a
look-up and a popcount, and ``select`` a search in it. Planes are deflated in blocks where that makes them smaller, and a
block is inflated when a query first touches it: one image answers token access, counts, and the place of the k-th
occurrence, and reads only the blocks on its way. ``access``, ``count`` and ``occurrence`` ask all shards of a folder.

Defined results: a null text is empty and holds only the end id; rows with equal doc_id stand in the order of their
texts; a null doc_id comes first; an empty table makes no shard. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbuf
from .memo import KNOWN_PIECES, PieceMemo

MAGIC = b"WVMX2\n"
#: Bits between two entries of a plane's running count.
STRIDE = 4096
#: Bytes of a plane that are deflated together.
BLOCK = 1 << 15
#: Ids in a shard, unless a single document has more.
SHARD_TOKENS = 1 << 20
#: Bytes of text that are encoded together.
PASS_BYTES = 4 << 20
#: Questions to all shards that are asked at once.
MOST_QUESTIONS = 100_000


class WaveletShard:
    """Ids of consecutive documents; ``starts`` are the n + 1 offsets of the documents."""

    def __init__(self, blocks, ones, zeros, n, alphabet, doc_ids, starts):
        self.blocks, self.ones, self.zeros, self.n, self.alphabet, self.doc_ids, self.starts = blocks, ones, zeros, n, alphabet, doc_ids, starts
        self._open: dict[tuple[int, int], np.ndarray] = {}

    # -- building ---------------------------------------------------------------------------------------------------

    @classmethod
    def build(cls, tokens: np.ndarray, doc_ids: list, starts: np.ndarray) -> WaveletShard:
        seen = np.zeros(int(tokens.max(initial=0)) + 1, bool)
        seen[tokens] = True
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        rank = np.cumsum(seen) - 1
        x = rank.astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)[tokens]
        planes, zeros = [], []
        for level in reversed(range(max(1, int(len(alphabet) - 1).bit_length()))):
            bit = (x & x.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)  # places: half the time of masks on mixed bits
            zeros.append(len(low))
            x = np.concatenate([x[low], x[high]])
        ones = []
        for p in planes:
            whole = np.zeros(-(-len(p) // (STRIDE // 8)) * (STRIDE // 8), np.uint8)
            whole[: len(p)] = p
            ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(whole).reshape(-1, STRIDE // 8).sum(1, dtype=np.uint32), dtype=np.uint32)]))
        blocks = []
        for p in planes:
            blocks.append([])
            for i in range(0, len(p), BLOCK):
                part = p[i : i + BLOCK].tobytes()
                small = zlib.compress(part, 1)
                blocks[-1].append(small if len(small) < 0.95 * len(part) else part)
        return cls(blocks, ones, zeros, len(tokens), alphabet, doc_ids, np.asarray(starts, np.int64))

    # -- the file image ---------------------------------------------------------------------------------------------

    def to_bytes(self) -> bytes:
        lens = np.diff(self.starts).astype("<u4").tobytes()
        head = {"n": self.n, "zeros": self.zeros, "blocks": [[len(b) for b in plane] for plane in self.blocks], "docs": self.doc_ids}
        meta = zlib.compress(json.dumps(head).encode(), 1)
        alpha, docs = zlib.compress(self.alphabet.astype("<u4").tobytes(), 1), zlib.compress(lens, 1)
        ones = b"".join(x.astype("<u4").tobytes() for x in self.ones)
        return b"".join([MAGIC, struct.pack("<IIII", len(meta), len(alpha), len(docs), len(ones)), meta, alpha, docs, ones, *(b for plane in self.blocks for b in plane)])

    @classmethod
    def from_bytes(cls, image: bytes) -> WaveletShard:
        """Opens an image; its planes stay as they are until they are asked."""
        if image[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        at = len(MAGIC) + 16
        sizes = struct.unpack("<IIII", image[len(MAGIC) : at])
        parts, view = [], memoryview(image)
        for k, s in enumerate(sizes):
            parts.append(zlib.decompress(view[at : at + s]) if k < 3 else view[at : at + s])
            at += s
        head, blocks = json.loads(parts[0]), []
        for plane in head["blocks"]:
            blocks.append([])
            for s in plane:
                blocks[-1].append(view[at : at + s])
                at += s
        starts = np.concatenate([[0], np.cumsum(np.frombuffer(parts[2], "<u4").astype(np.int64))])
        return cls(blocks, np.frombuffer(parts[3], "<u4").reshape(len(blocks), -1), head["zeros"], head["n"], np.frombuffer(parts[1], "<u4"), head["docs"], starts)

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._open:
            raw, size = self.blocks[level][k], min(BLOCK, (self.n + 7) // 8 - k * BLOCK)
            self._open[level, k] = np.frombuffer(raw if len(raw) == size else zlib.decompress(raw), np.uint8)
        return self._open[level, k]

    def _bytes(self, level: int, a: int, b: int) -> np.ndarray:
        """Bytes a to b of a plane, within one stretch of STRIDE bits (a block holds a whole number of them)."""
        k = a // BLOCK
        return self._block(level, k)[a - k * BLOCK : b - k * BLOCK] if a < b else np.zeros(0, np.uint8)

    # -- queries ----------------------------------------------------------------------------------------------------

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        b = i // STRIDE
        out = int(self.ones[level][b]) + int(np.bitwise_count(self._bytes(level, b * STRIDE // 8, i // 8)).sum(dtype=np.int64))
        return out + int(self._bytes(level, i // 8, i // 8 + 1)[0] & ((1 << i % 8) - 1)).bit_count() if i % 8 else out

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of this value in a plane."""
        ones = self.ones[level].astype(np.int64)
        have = ones if bit else np.arange(len(ones), dtype=np.int64) * STRIDE - ones
        b = int(np.searchsorted(have, k, side="right")) - 1
        bits = np.unpackbits(self._bytes(level, b * STRIDE // 8, min((b + 1) * STRIDE // 8, (self.n + 7) // 8)), bitorder="little")
        return b * STRIDE + int(np.flatnonzero(bits == bit)[k - int(have[b])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, z in enumerate(self.zeros):
            bit = int(self._bytes(level, i // 8, i // 8 + 1)[0] >> i % 8 & 1)
            ones = self._rank1(level, i)
            i, value = (z + ones, value << 1 | 1) if bit else (i - ones, value << 1)
        return int(self.alphabet[value])

    def _range(self, token: int, i: int, j: int) -> tuple[int, int, int] | None:
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return None
        for level, z in enumerate(self.zeros):
            a, b = self._rank1(level, i), self._rank1(level, j)
            i, j = (z + a, z + b) if code >> (len(self.zeros) - 1 - level) & 1 else (i - a, j - b)
        return i, j, code

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """How often an id stands in places i to j (exclusive)."""
        r = self._range(token, i, self.n if j is None else j)
        return r[1] - r[0] if r else 0

    def occurrence(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id."""
        r = self._range(token, 0, self.n)
        if r is None or not 0 <= k < r[1] - r[0]:
            raise IndexError(k)
        at, code = r[0] + k, r[2]
        for level in reversed(range(len(self.zeros))):
            bit = code >> (len(self.zeros) - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        x = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for k, level in enumerate(reversed(range(len(self.zeros)))):
            plane = np.concatenate([self._block(level, b) for b in range(len(self.blocks[level]))]) if self.n else np.zeros(0, np.uint8)
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            up, z = np.empty_like(x), self.zeros[level]
            up[np.flatnonzero(~bit)] = x[:z]
            up[np.flatnonzero(bit)] = x[z:] | x.dtype.type(1 << k)
            x = up
        return self.alphabet[x]


# -- encoding ---------------------------------------------------------------------------------------------------------

_CODE = np.arange(256)
_ALNUM = ((_CODE >= 0x30) & (_CODE <= 0x39)) | ((_CODE >= 0x41) & (_CODE <= 0x5A)) | ((_CODE >= 0x61) & (_CODE <= 0x7A))
# an apostrophe may begin a contraction, and a bar stands within the library's own end-of-text token
_MARK = (_CODE > 0x20) & (_CODE < 0x7F) & ~_ALNUM & (_CODE != ord("'")) & (_CODE != ord("|"))


def _cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets at which the byte-level pre-tokeniser always begins a new pre-token: every text's start, an ASCII space or
    newline after a character that is surely no white space, and an ASCII mark after an ASCII letter or digit or a Latin
    letter. (Its pattern has no look-behind; no pre-token holds white space after anything else, or a mark after a letter
    or digit, contractions aside. So pieces between such cuts encode independently.)"""
    at = np.zeros(len(raw) + 1, bool)
    if len(raw):
        prev = np.empty_like(raw)
        prev[0], prev[1:] = 0, raw[:-1]
        space = (raw == 0x20) | (raw == 0x0A)
        space &= ((prev > 0x20) & (prev < 0x7F)) | (prev >= 0x80)
        # no cut after C2 xx, E1 xx xx, E2 xx xx, E3 xx xx: Unicode's other white space is among them
        space[2:] &= raw[:-2] != 0xC2
        space[3:] &= ~((raw[:-3] >= 0xE1) & (raw[:-3] <= 0xE3))
        letter = _ALNUM[prev]
        letter[2:] |= (raw[:-2] == 0xC3) & (prev[2:] != 0x97) & (prev[2:] != 0xB7)  # not the signs for times and divide
        at[:-1] = space | (letter & _MARK[raw])
    at[offsets] = True
    return np.flatnonzero(at)


#: Bytes of pieces that go to the tokenizer as one text.
JOINED_BYTES = 1 << 14


class PieceEncoder:
    """Encodes batches of texts with the tokenizers library; each distinct piece is encoded once, and remembered."""

    def __init__(self, path: str, end_id: int, known_pieces: int = KNOWN_PIECES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end_id, self.memo = Tokenizer.from_file(path), end_id, PieceMemo(self._encode_new, known_pieces)
        letters = {c: 1 for c in pre_tokenizers.ByteLevel.alphabet()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        # bytes of each id; an id that isn't made of byte letters (an added token) keeps 0, which fails the sum below
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            if all(c in letters for c in token):
                self.bytes_of[i] = len(token)

    def _encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and their numbers. Pieces are joined where a cut between them holds: there the ids' bytes
        tell which piece they belong to. Texts of which they do not are encoded piece by piece."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        safe = np.isin(ends, _cuts(raw, np.array([0, len(raw)])))
        group = np.cumsum(np.concatenate([[True], ~safe[:-1] | (np.diff(ends // JOINED_BYTES) > 0)])) - 1
        first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(pieces)]])
        data, edge = raw.tobytes(), np.concatenate([[0], ends])
        texts = [data[edge[a] : edge[b]].decode() for a, b in zip(first[:-1], first[1:], strict=True)]
        ids, sizes = [], []
        for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            a, b = first[k], first[k + 1]
            got = np.array(e.ids, np.uint32)
            upto = np.cumsum(self.bytes_of[got])
            at = np.searchsorted(upto, edge[a + 1 : b + 1] - edge[a])
            if b - a == 1:
                n = np.array([len(got)])
            elif len(got) and at[-1] < len(got) and (upto[at] == edge[a + 1 : b + 1] - edge[a]).all() and upto[-1] == edge[b] - edge[a]:
                n = np.diff(at + 1, prepend=0)
            else:
                one = [x.ids for x in self.tokenizer.encode_batch_fast([p.decode() for p in pieces[a:b]], add_special_tokens=False)]
                n, got = np.array([len(x) for x in one]), np.array([i for x in one for i in x], np.uint32)
            ids.append(got)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind, and their numbers."""
        raw, offsets = textbuf.flat(column)
        stream, upto = self.memo.stream(raw, _cuts(raw, offsets), offsets)
        return np.insert(stream, upto[1:], self.end_id), np.diff(upto) + 1


@lru_cache(maxsize=1)
def _encoder(path: str, end_id: int) -> PieceEncoder:
    """One encoder for all tasks of a Python worker, so that what it has learned of pieces lasts."""
    return PieceEncoder(path, end_id)


SHARD_SCHEMA = "part int, seq int, part_start long, n_tokens long, n_docs long, image binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write shard images in ascending doc_id order: ``part`` numbers ranges of
    doc_id, ``seq`` the shards in one. The images are rows of a Parquet container, so any store that Spark can write
    holds them, and a failed task writes its shards anew."""
    arrow = SHARD_SCHEMA

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, base = _encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0, 0
        held, ids, lens, size = [], [], [], 0

        def shard():
            nonlocal held, ids, lens, size, seq, base
            tokens, starts = np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(lens))])
            image = WaveletShard.build(tokens, ids, starts).to_bytes()
            row = pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "part_start": pa.array([base], pa.int64()),
                    "n_tokens": pa.array([len(tokens)], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "image": pa.array([image], pa.binary()),
                }
            )
            held, ids, lens, size, seq, base = [], [], [], 0, seq + 1, base + len(tokens)
            return row

        for batch in batches:
            for some in textbuf.passes(batch, "text", PASS_BYTES):
                tokens, n = encoder.encode(some.column("text"))
                held.append(tokens)
                lens.append(n)
                ids += some.column("doc_id").to_pylist()
                size += len(tokens)
                if size >= shard_tokens:
                    yield shard()
        if ids:
            yield shard()

    (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(build, arrow)
        .write.option("compression", "none")
        .parquet(path)
    )


def shards(spark, path: str) -> DataFrame:
    """The shards at ``path`` with ``base``, the number of ids before each one's part."""
    rows = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # one row for each range of doc_id: their number is that of the writer's tasks, whatever the corpus holds
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    return rows.join(F.broadcast(rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", before.alias("base"))), "part")


def read_documents(spark, path: str) -> DataFrame:
    """Per document of the shards at ``path``: doc_id, start, n_tokens, ids_crc32, shard (part and seq)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                shard = WaveletShard.from_bytes(r["image"])
                raw, at = memoryview(shard.tokens().astype("<u4").tobytes()), shard.starts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                k = len(crc)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(shard.doc_ids, pa.int64()), "start": pa.array(r["base"] + r["part_start"] + at[:-1], pa.int64()), "n_tokens": pa.array(np.diff(at), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array([r["part"]] * k, pa.int32()), "seq": pa.array([r["seq"]] * k, pa.int32()),
                    }
                )

    return shards(spark, path).select("part", "seq", "part_start", "base", "image").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, seq int")


def _asked(spark, path: str, questions: list[tuple], answer, schema: str) -> DataFrame:
    """``answer(shard, start, questions)`` of every shard, as rows (part, seq, ...)."""
    if len(questions) > MOST_QUESTIONS:
        raise ValueError(f"{len(questions)} questions; ask {MOST_QUESTIONS} at once at most")
    shared = spark.sparkContext.broadcast(questions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                rows = [(r["part"], r["seq"], *x) for x in answer(WaveletShard.from_bytes(r["image"]), r["base"] + r["part_start"], shared.value, (r["part"], r["seq"]))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int32(), *[pa.int64()] * (len(rows[0]) - 2)], strict=True)], names=["part", "seq", *(f.split()[0] for f in schema.split(", "))])

    return shards(spark, path).select("part", "seq", "part_start", "base", "image").mapInArrow(run, f"part int, seq int, {schema}")


def access(spark, path: str, places: list[int]) -> DataFrame:
    """(place, token) for places in the ids of all documents, from 0; places that don't exist give no row."""

    def answer(shard, start, asked, _):
        return [(p, shard.access(p - start)) for p in asked if start <= p < start + shard.n]

    return _asked(spark, path, sorted(set(places)), answer, "place long, token long").select("place", "token")


def _counts(spark, path: str, tokens: list[int]) -> DataFrame:
    def answer(shard, start, asked, _):
        return [(start, t, n) for t, n in ((t, shard.count(t)) for t in asked) if n]

    return _asked(spark, path, sorted(set(tokens)), answer, "start long, token long, n long")


def count(spark, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each token occurs in all documents; one that doesn't gives no row."""
    return _counts(spark, path, tokens).groupBy("token").agg(F.sum("n").alias("n"))


def occurrence(spark, path: str, wanted: list[tuple[int, int]]) -> DataFrame:
    """(token, k, place): where the k-th (from 0) occurrence of a token stands; one that doesn't exist gives no row."""
    per_shard = _counts(spark, path, [t for t, _ in wanted])
    # a token has one row for each shard that holds it, a millionth of its ids or less
    before = F.sum("n").over(Window.partitionBy("token").orderBy("start")) - F.col("n")
    asked = spark.createDataFrame(sorted(set(wanted)), "token long, k long")
    found = per_shard.withColumn("before", before).join(F.broadcast(asked), "token").where("k >= before and k < before + n")
    homes = {}
    for r in found.select("part", "seq", "token", "k", "before").collect():  # one row a question at most
        homes.setdefault((r["part"], r["seq"]), []).append((r["token"], r["k"], r["before"]))

    def answer(shard, start, asked, which):
        return [(t, k, start + shard.occurrence(t, k - b)) for key, some in asked if key == which for t, k, b in some]

    return _asked(spark, path, list(homes.items()), answer, "token long, k long, place long").select("token", "k", "place")
