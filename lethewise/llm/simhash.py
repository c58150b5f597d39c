"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant that is within half the radius of both. Each distinct fingerprint
emits all variants within half the radius (2081 for a radius of 4), equal variants meet in a shuffle, and what meets is
verified. Where several fingerprints meet, the smallest one is linked to each other one (any two of them are within the
radius), so no group's pairs are enumerated; for components alone, a task passes on
only those of its links that connect anything new.

The variants are shuffled in ``SLICES`` passes: a slice is a few parity bits of the variant, and since parities add up, a
fingerprint's variants in a slice are those differences whose own parities are its parities plus the slice's. Nothing is
made and thrown away, and the shuffle files of a slice go before the next begins, so the disk holds one slice at a time.

No link is lost (a pair within the radius meets in every one of its common variants). Links, and never all fingerprints
or links at once, then give components (``components``). Exact copies count as one fingerprint throughout.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; fewer than ``width`` words
are one shingle; repeated rows each get a row; a row with a null id links others but has no say in ``component_id``,
which is null where no reachable row has an id; an empty table gives no rows. All columns but the text are kept (those
named as in ``ADDED``, in any case of letters, are replaced).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, textbuf
from .components import components, forest
from lethewise.operators.joins import lookup

#: Passes over the variants (a power of two); variants in a bucket of the shuffle, on average, how many a task holds, and
#: how many it makes at once.
SLICES = 8
BUCKET, HELD, MADE = 1 << 19, 1 << 20, 1 << 18
ADDED = ["_fp", "component_id"]

_PARITY = textbuf.mixed(np.arange(1, 17, dtype=np.uint64))
_LANES = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], np.uint64)


def _majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document, the bits set in over half its hashes; ``counts`` are the numbers of hashes, one at least."""
    docs = np.repeat(np.arange(len(counts)), -(-counts // 255))
    first = np.cumsum(-(-counts // 255)) - -(-counts // 255)
    starts = (np.cumsum(counts) - counts)[docs] + (np.arange(len(docs)) - first[docs]) * 255
    out = np.zeros(len(counts), np.uint64)
    eight = h.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[eight[:, k]], starts)  # 255 hashes at most: no lane overflows
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = (2 * ones > counts[:, None]).astype(np.uint64) << np.arange(8 * k, 8 * k + 8, dtype=np.uint64)
        out |= np.bitwise_or.reduce(bits, axis=1)
    return out


def shingles(texts: list[bytes], width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, end to end, and their number in each text."""
    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    hashes, counts = [np.zeros(0, np.uint64)], []
    for text in texts:
        w = text.lower().split()  # of bytes: A-Z and ASCII white space alone
        n = max(1, len(w) - width + 1) if w else 0
        grams = map(b" ".join, zip(*(w[j:] for j in range(width)), strict=False)) if len(w) >= width else [b" ".join(w)] * n
        hashes.append(np.fromiter(map(digest, grams), np.uint64, n))
        counts.append(n)
    return np.concatenate(hashes), np.array(counts, np.int64)


def fingerprint_texts(texts: list[bytes], width: int, seed: int, prints: int = 1) -> np.ndarray:
    """Fingerprints [print, text]: the first of the shingles' hashes themselves, the others of the hashes mixed anew."""
    h, counts = shingles(texts, width, seed)
    out = np.zeros((prints, len(texts)), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        for k in range(prints):
            out[k, some] = _majority(h if k == 0 else textbuf.mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))), counts[some])
    return out


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4, seed: int = 42, prints: int = 1) -> DataFrame:
    """``docs`` without the text, and with ``_fp`` (and ``_fp1`` ...), the fingerprints as signed longs."""
    names = ["_fp", *(f"_fp{k}" for k in range(1, prints))]
    return storage.apart(docs, names, lambda rows: _fingerprinted(rows, "text", width, seed, names), text=text)


def _fingerprinted(docs: DataFrame, text: str, width: int, seed: int, names: list[str]) -> DataFrame:
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in textbuf.passes(batch, text):
                raw, off = textbuf.flat(some.column(text))
                data, at = raw.tobytes(), off.tolist()
                fp = fingerprint_texts([data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], width, seed, len(names))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in rest), *(pa.array(x.view(np.int64)) for x in fp)], names=[*rest, *names])

    schema = docs.select(*rest).withColumns({n: F.lit(0).cast("long") for n in names}).schema
    return docs.select(*rest, text).mapInArrow(run, schema)


def ball(bits: int, radius: int, dtype: type) -> np.ndarray:
    """All differences of at most ``radius`` bits."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)], dtype)


def _dealt(kind: int, keys: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, kind, n, body): what goes to each bucket, column after column."""
    to = (textbuf.mixed(keys.astype(np.uint64) + np.uint64(kind) * textbuf._ODD) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to.astype(np.uint16) if buckets <= 1 << 16 else to, kind="stable")
    ids, first = np.unique(to[order], return_index=True)
    ends = np.append(first[1:], len(order))
    columns = [c[order] for c in (keys, *columns)]
    body = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(ids, pa.int64()), "kind": pa.array([kind] * len(ids), pa.int32()), "n": pa.array(ends - first, pa.int64()), "body": pa.array(body, pa.binary())})


def _gathered(batches: Iterator[pa.RecordBatch], dtypes: list, work: Callable) -> Iterator[pa.RecordBatch]:
    """Feed each (bucket, kind) of sorted rows to ``work(kind, columns, memory, last)``, HELD variants at a time. It
    returns a batch of links and the columns that it wants to see again with what follows; ``memory`` is a dict of its
    own for the bucket."""
    now, held, size, memory = None, [], 0, {}

    def call(last: bool):
        return work(now[1], [np.concatenate(c) for c in zip(*held, strict=True)], memory, last)

    for batch in batches:
        for b, kind, n, body in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "n", "body")), strict=True):
            if now != (b, kind):
                if held:
                    yield call(True)[0]
                now, held, size, memory = (b, kind), [], 0, {}
            at, row = 0, []
            for t in dtypes:
                row.append(np.frombuffer(body, t, n, at))
                at += n * np.dtype(t).itemsize
            held.append(row)
            size += n
            if size >= HELD:
                out, keep = call(False)
                yield out
                held, size = [keep], 0
    if held:
        yield call(True)[0]
        held.clear()
    textbuf.give_back()


def slice_of(x: np.ndarray, slices: int) -> np.ndarray:
    """A few parities of each number: those of a ^ b are those of a and of b, added without carry."""
    out = np.zeros(len(x), np.int64)
    for k in range(slices.bit_length() - 1):
        out |= (np.bitwise_count(x & _PARITY[k]).astype(np.int64) & 1) << k
    return out


def _ball_links(masks: np.ndarray, radius: int, thin: bool) -> Callable:
    def work(_: int, columns: list[np.ndarray], memory: dict, last: bool):
        key, code = columns
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if last:
            key, order = key[met], order[met]
        fp = key ^ masks[code[order]]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        low = np.minimum.reduceat(fp, start) if len(key) else fp
        star = np.repeat(low, np.diff(np.append(start, len(key))))
        near = np.flatnonzero((fp != star) & (np.bitwise_count(fp ^ star) <= radius))
        u, v = fp[near], star[near]
        if len(near):
            u, v = forest(u, v) if thin else np.unique(np.stack([u, v]), axis=1)
        rows = pa.RecordBatch.from_pydict({"u": pa.array(u.view(np.int64), pa.int64()), "v": pa.array(v.view(np.int64), pa.int64())})
        if last:
            return rows, []
        keep = fp == star  # the smallest of each variant stands for the others
        return rows, [key[keep], code[order[keep]]]

    return work


def links(fps: DataFrame, radius: int = 4, bucket: int = BUCKET, slices: int = SLICES, thin: bool = True) -> DataFrame:
    """Distinct fingerprints (``_fp``) to links (u, v) between them, enough to connect whatever is within ``radius``. With
    ``thin`` they are only good for components; without it, every one is between two that are within the radius."""
    masks = ball(64, radius // 2, np.uint64)
    of_mask = slice_of(masks, slices)
    mine = [np.flatnonzero(of_mask == k).astype(np.uint16) for k in range(slices)]
    chunk = max(1, MADE * slices // len(masks))
    buckets = max(64, fps.count() * len(masks) // slices // bucket)

    def deal(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fp = np.asarray(batch.column("_fp")).view(np.uint64)
                for i in range(0, len(fp), chunk):
                    x = fp[i : i + chunk]
                    own = slice_of(x, slices)
                    some = [(x[own == k], mine[number ^ k]) for k in range(slices)]
                    keys = np.concatenate([(y[:, None] ^ masks[m]).ravel() for y, m in some])
                    if len(keys):
                        yield from _dealt(0, keys, [np.concatenate([np.tile(m, len(y)) for y, m in some])], buckets)
                textbuf.give_back()

        return run

    out = None
    for number in range(slices):
        dealt = fps.select("_fp").mapInArrow(deal(number), "bucket long, kind int, n long, body binary").repartition(max(16, buckets // 2), "bucket").sortWithinPartitions("bucket", "kind")
        found = storage.written(dealt.mapInArrow(lambda batches: _gathered(batches, [np.uint64, np.uint16], _ball_links(masks, radius, thin)), "u long, v long"), "ball")
        out = found if out is None else out.unionByName(found)
    return out


def print_links(marked: DataFrame, name: str, radius: int) -> DataFrame:
    """Links between first fingerprints whose texts are near in another one: for each value of that, the smallest first
    fingerprint stands for all with this value, and is linked to them and to those of near values."""
    both = storage.written(marked.select("_fp", name).distinct(), "prints")
    low = storage.written(both.groupBy(name).agg(F.min("_fp").alias("_rep"), F.count("*").alias("_k")), "print-groups")
    own = lookup(both, low, name, "_k", both.count()).where("_fp <> _rep").select(F.col("_fp").alias("u"), F.col("_rep").alias("v"))
    # a pair meets in each of its common variants: once is enough
    near = storage.written(links(storage.written(low.select(F.col(name).alias("_fp")), "distinct"), radius, thin=False).distinct(), "near")
    side = [low.select(F.col(name).alias(c), F.col("_rep").alias(f"_{c}")) for c in ("u", "v")]
    return own.unionByName(near.join(side[0], "u").join(side[1], "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")).where("u <> v"))


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, radius: int = 4, prints: int = 1) -> DataFrame:
    """``docs`` without the text, with ``_fp`` and ``component_id``, the smallest id reachable over links.

    With several ``prints`` two texts are linked if any of their independent fingerprints are within the radius: of texts
    that are 0.9 alike, one print in two to five is, so a few of them find most."""

    def work(rows: DataFrame) -> DataFrame:
        marked = storage.written(fingerprints(rows, "text", width, seed, prints), "fingerprints")
        found = links(storage.written(marked.select("_fp").distinct(), "distinct"), radius)
        for k in range(1, prints):
            found = found.unionByName(storage.written(print_links(marked, f"_fp{k}", radius), "print-links"))
        return named(marked.drop(*[f"_fp{k}" for k in range(1, prints)]), found, "id")

    return storage.apart(docs, ADDED, work, id=doc_id, text=text)


def named(marked: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """``marked``, a written table with ``_fp``, with the ``component_id`` that links between values of ``_fp`` give."""
    fps = storage.written(marked.groupBy("_fp").agg(F.min(doc_id).alias("_low"), F.count("*").alias("_n")), "counted")
    label = components(found).select(F.col("u").alias("_fp"), F.col("v").alias("_label"))
    labelled = storage.written(fps.join(label, "_fp", "left").withColumn("_label", F.coalesce("_label", "_fp")), "labels")
    whole = storage.written(labelled.groupBy("_label").agg(F.min("_low").alias("component_id"), F.count("*").alias("_m")), "components")
    by_fp = storage.written(lookup(labelled, whole, "_label", "_m", fps.count()).select("_fp", "_n", "component_id"), "by_fp")
    return lookup(marked, by_fp, "_fp", "_n", marked.count())


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component: the row with the component's smallest id, of rows with the same id the first as read
    in. Of rows in a component without any id, one of each fingerprint stays."""
    return storage.beside(docs, [doc_id, text], lambda d: kept(d, doc_id, text, options))


def kept(docs: DataFrame, doc_id: str, text: str, options: dict, how: Callable = cluster) -> DataFrame:
    row = storage.written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = how(row.select("_row", F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_id", "_text", **options)
    # the row that stands for a component: smallest id, then smallest row number; both are minima, so no group is gathered
    best = found.groupBy(F.coalesce(F.col("component_id"), F.col("_fp")).alias("_c"), F.col("component_id").isNull().alias("_none")).agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_b"))
    return row.join(best.select(F.col("_b._row").alias("_row")), "_row", "left_semi")
