"""Near-duplicates by the exact overlap (Jaccard) of word shingles, with fingerprints only to find what to compare.

1. A text is the set of its shingles' 64-bit hashes; texts of equal sets are one set from here on.
2. Candidates. Sets meet that agree in one of ``BANDS`` bands of ``ROWS`` minimum hashes each: of two sets that overlap by
   s, with chance 1 - (1 - s ** ROWS) ** BANDS, which is 0.99993 at 0.8. SimHashes within 4 bits (``simhash``) meet too.
3. Every candidate is verified on the sets themselves; only an overlap of ``LEAST`` or more is a link.

Where many sets meet, not all pairs are compared. Each set is compared with the centre of its bucket, c, the one that meets
most others in all its buckets; then those
that aren't connected to c yet, with every other of the bucket from which components part them. As 1 - overlap is a
metric, |overlap(x, c) - overlap(y, c)| can't exceed 1 - ``LEAST`` for a link, nor can the sizes differ by more than
``LEAST``; such pairs are left out, as are pairs already connected, and pairs whose sketches of ``SKETCH_BITS`` one-bit
minimum hashes differ in more places than a link's do but once in three million (five standard deviations). Sketches
are made of the sets that come so far alone. Such pairs of one bucket are weighed within the join; only those that pass
are rows.

Defined results: null, empty and blank texts are one set, the empty one; fewer than ``width`` words are one shingle;
repeated rows each get a row; null ids are as in ``simhash``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash, storage, textbuf
from .components import components
from lethewise.operators.joins import lookup

#: The least overlap of a link, as a fraction of whole numbers, so that the limit itself is met exactly.
LEAST = (4, 5)
BANDS, ROWS = 24, 5
#: Bits of a sketch, and in how many the sketches of a link may differ: the mean at ``LEAST`` is a tenth of them.
SKETCH_BITS = 1024
SKETCH_APART = int(SKETCH_BITS * (1 - LEAST[0] / LEAST[1]) / 2 + 5 * (SKETCH_BITS * 0.09) ** 0.5)

_KEYS = textbuf.mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * textbuf._ODD)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * textbuf._ODD
_SALT, _FACTOR = _KEYS[::2], _KEYS[1::2] | np.uint64(1)


def bands(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys [text, band] of the bands of minimum hashes; ``counts`` are the numbers of hashes, one at least."""
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(counts), _BAND[b], np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            x = h ^ _SALT[k]
            x *= _FACTOR[k]
            key = textbuf.mixed(key ^ np.minimum.reduceat(x, starts)) * textbuf._ODD
        out[:, b] = key
    return out


_BITS = textbuf.mixed(np.arange(1 << 20, (1 << 20) + 2 * SKETCH_BITS, dtype=np.uint64) * textbuf._ODD).reshape(2, -1)


def sketch(h: np.ndarray) -> np.ndarray:
    """One bit of each of SKETCH_BITS minimum hashes of a set, 64 to a number."""
    out = np.zeros(SKETCH_BITS // 64, np.uint64)
    for k in range(len(out)):
        low = np.full(64, np.iinfo(np.uint64).max)
        for a in range(0, len(h), 1 << 12):
            x = h[a : a + (1 << 12), None] ^ _BITS[0, 64 * k : 64 * k + 64]
            x *= _BITS[1, 64 * k : 64 * k + 64] | np.uint64(1)
            low = np.minimum(low, x.min(0))
        out[k] = np.bitwise_or.reduce((textbuf.mixed(low) & np.uint64(1)) << np.arange(64, dtype=np.uint64))
    return out


def sketches(rows: DataFrame, text: str, width: int, seed: int) -> DataFrame:
    """(_set, _k0 ...) of rows (_set, text), one for each set."""
    names = [f"_k{i}" for i in range(SKETCH_BITS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in textbuf.passes(batch, text):
                made = np.array([sketch(s) for s in _sets(_texts(some.column(text)), width, seed)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column("_set"), *(pa.array(np.ascontiguousarray(c)) for c in made.T)], names=["_set", *names])

    return rows.select("_set", text).mapInArrow(run, "_set long, " + ", ".join(f"{n} long" for n in names))


def _texts(column: pa.Array) -> list[bytes]:
    raw, off = textbuf.flat(column)
    data, at = raw.tobytes(), off.tolist()
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _sets(texts: list[bytes], width: int, seed: int) -> list[np.ndarray]:
    h, counts = simhash.shingles(texts, width, seed)
    return [np.unique(x) for x in np.split(h, np.cumsum(counts)[:-1])] if len(counts) else []


def marks(docs: DataFrame, text: str, width: int, seed: int) -> DataFrame:
    """``docs`` without the text, and with ``_set`` (a digest of the set), ``_size``, ``_print`` and ``_bands``."""
    import xxhash

    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in textbuf.passes(batch, text):
                texts = _texts(some.column(text))
                sets = _sets(texts, width, seed)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                keys = bands(np.concatenate([sets[i] for i in full]), size[full]).view(np.int64) if len(full) else np.zeros((0, BANDS), np.int64)
                added = [
                    pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)),
                    pa.array(size),
                    pa.array(simhash.fingerprint_texts(texts, width, seed)[0].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(size > 0, BANDS, 0))), pa.int32()), pa.array(keys.ravel())),
                ]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in rest), *added], names=[*rest, "_set", "_size", "_print", "_bands"])

    added = {"_set": "long", "_size": "long", "_print": "long", "_bands": "array<long>"}
    schema = docs.select(*rest).withColumns({n: F.lit(None).cast(t) for n, t in added.items()}).schema
    return docs.select(*rest, text).mapInArrow(run, schema)


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text: str, width: int, seed: int) -> DataFrame:
    """Pairs (u, v) of sets with ``overlap`` and ``near``; ``sets`` names a row of ``docs`` for each (_set, _row)."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in textbuf.passes(batch, text):
                body = [s.tobytes() for s in _sets(_texts(some.column(text)), width, seed)]
                yield pa.RecordBatch.from_arrays([some.column("_set"), pa.array(body, pa.binary())], names=["_set", "body"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            overlap, near = [], []
            for x, y in zip(batch.column("_a"), batch.column("_b"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                whole = len(a) + len(b) - both
                overlap.append(both / whole if whole else 1.0)
                near.append(both * LEAST[1] >= whole * LEAST[0])
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(overlap, pa.float64()), pa.array(near, pa.bool_())], names=["u", "v", "overlap", "near"])
            textbuf.give_back()

    pairs = storage.written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "pairs")
    used = pairs.select(F.col("u").alias("_set")).unionByName(pairs.select(F.col("v").alias("_set"))).distinct()
    rows = storage.written(used.join(sets.select("_set", "_row"), "_set"), "used")
    bodies = storage.written(docs.select("_row", text).join(rows, "_row").select("_set", text).mapInArrow(sets_of, "_set long, body binary"), "sets")
    total = pairs.count()
    for side, name in (("u", "_a"), ("v", "_b")):  # the smallest of a large bucket is in very many pairs
        often = pairs.groupBy(side).agg(F.count("*").alias("_k"))
        table = storage.written(often.join(bodies.withColumnRenamed("_set", side), side).select(side, "_k", F.col("body").alias(name)), "sides")
        pairs = lookup(pairs, table, side, "_k", total)
        if side == "u":
            pairs = storage.written(pairs, "half-pairs")
    return storage.written(pairs.mapInArrow(compare, "u long, v long, overlap double, near boolean"), "verified")


def _labels(found: DataFrame) -> DataFrame:
    return storage.written(components(found.where("near").select("u", "v")).select(F.col("u").alias("_set"), F.col("v").alias("_label")), "labels")


def linked(sets: DataFrame, docs: DataFrame, text: str, width: int, seed: int) -> DataFrame:
    """Links (u, v) between sets (_set, _row, _size, _print, _bands), enough to connect whatever candidates overlap enough."""
    members = storage.written(sets.select("_set", "_size", F.explode("_bands").alias("_key")), "bands")
    total = members.count()
    full = storage.written(members.groupBy("_key").agg(F.count("*").alias("_k"), F.col("_key").alias("_b")).where("_k > 1"), "buckets")
    met = storage.written(lookup(members, full.withColumn("_n", F.col("_k")), "_key", "_k", total).where("_b is not null").drop("_b"), "members")
    # a bucket's centre is the set that meets most others in all its buckets: the nearest to what the group is made of
    degree = storage.written(met.groupBy("_set").agg(F.sum("_n").alias("_d")), "degrees")
    met = met.drop("_n").join(degree, "_set")
    low = storage.written(met.groupBy("_key").agg(F.max_by("_set", F.struct("_d", "_set")).alias("_c"), F.count("*").alias("_k")), "centres")
    met = storage.written(lookup(storage.written(met.drop("_d"), "members"), low, "_key", "_k", total), "met")
    ball = simhash.print_links(sets.select(F.col("_set").alias("_fp"), "_print"), "_print", 4)
    first = verified(met.where("_set <> _c").select(F.col("_c").alias("u"), F.col("_set").alias("v")).unionByName(ball), sets, docs, text, width, seed)

    # those of a bucket that the first round hasn't connected to its centre, with the others there
    label = _labels(first)
    named = met.join(label, "_set", "left").withColumn("_label", F.coalesce("_label", "_set"))
    named = named.join(label.select(F.col("_set").alias("_c"), F.col("_label").alias("_main")), "_c", "left").withColumn("_main", F.coalesce("_main", "_c"))
    named = storage.written(named.where("_set <> _c").join(first.select(F.col("u").alias("_c"), F.col("v").alias("_set"), "overlap"), ["_c", "_set"]), "named")
    apart = named.where("_label <> _main")
    rest = storage.written(named.join(apart.select("_key").distinct(), "_key", "left_semi"), "rest")
    rows = storage.written(rest.select("_set").distinct().join(sets.select("_set", "_row"), "_set"), "rest-rows")
    drawn = storage.written(sketches(docs.select("_row", text).join(rows, "_row"), text, width, seed), "sketches")
    rest = storage.written(rest.join(drawn, "_set"), "rest")
    # a pair is a row at the smallest key only at which it can be one: each set's keys as the one side and as the other
    alone, bits = F.col("_label") != F.col("_main"), [c for c in drawn.columns if c != "_set"]
    keys = rest.groupBy("_set").agg(F.collect_set(F.when(alone, F.col("_key"))).alias("_as1"), F.collect_set("_key").alias("_as2"))
    rest = storage.written(rest.join(keys, "_set").withColumn("_alone", alone), "rest-keys")
    a, b = (d.select("_key", *[F.col(c).alias(f"{c}{n}") for c in ("_set", "_size", "_label", "overlap", "_alone", f"_as{n}", *bits)]) for d, n in ((rest.where("_alone"), 1), (rest, 2)))
    might = (
        (F.col("_label1") != F.col("_label2"))
        & (F.abs(F.col("overlap1") - F.col("overlap2")) <= 1 - LEAST[0] / LEAST[1] + 1e-9)
        & (F.least("_size1", "_size2") * LEAST[1] >= F.greatest("_size1", "_size2") * LEAST[0])
        & (sum((F.bit_count(F.col(f"{c}1").bitwiseXOR(F.col(f"{c}2"))) for c in bits), F.lit(0)) <= SKETCH_APART)
        & (~F.col("_alone2") | (F.col("_set1") < F.col("_set2")))
        & (F.col("_key") == F.array_min(F.array_intersect("_as11", "_as22")))
    )
    second = verified(a.join(b, "_key").where(might).select(F.col("_set1").alias("u"), F.col("_set2").alias("v")), sets, docs, text, width, seed)
    return first.unionByName(second).where("near").select("u", "v")


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, seed: int = 42) -> DataFrame:
    """``docs``, with a ``_row`` that tells its rows apart, without the text and with ``_fp`` (the set's digest) and
    ``component_id``, the smallest id reachable over links."""
    marked = storage.written(marks(docs, text, width, seed), "marks")
    sets = storage.written(marked.groupBy("_set").agg(F.min("_row").alias("_row"), *[F.first(c).alias(c) for c in ("_size", "_print", "_bands")]), "distinct-sets")
    return simhash.named(marked.drop("_size", "_print", "_bands").withColumnRenamed("_set", "_fp"), linked(sets, docs, text, width, seed), doc_id)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component, as ``simhash.keep_one``."""
    return storage.beside(docs, [doc_id, text], lambda d: simhash.kept(d, doc_id, text, options, cluster))
