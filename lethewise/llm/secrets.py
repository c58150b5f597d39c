"""Secret scans: patterns of credentials, and strings that a battery of randomness tests can't tell from noise.

Patterns. Assignments to names like ``password``, access keys, and long hexadecimal strings, by regular expressions over
whole texts; positions are in code points.

Battery. Candidates are runs of base-64 characters; what the patterns' spans cover is cut out of them, and each piece of
at least ``CANDIDATE_MIN`` characters is tested. Its encoding is inferred as the smallest alphabet that holds all its
characters (decimal, hexadecimal of either case, base 32, letters, base 62, base 64).

1. Is it noise? Three tests of its n codes in that alphabet: chi-squared of their counts against uniformity, the number of
   runs above and below the alphabet's middle, and the serial correlation of neighbours. If the smallest of the three
   p-values, times three, is below ``NOISE_LEVEL``, it isn't, and its p-value is 1.
2. How likely would prose, names or numbers look so? The chances under such ordinary strings of
   * so small a chi-squared against uniformity (ordinary characters are uneven: ``SQUARES``),
   * so large a chi-squared of common, middling and rare letters against ``LETTER_SHARES``, where rare ones are many,
   * so many changes between upper case, lower case, digits and signs (``CLASS_CHANGES``),
   * so few changes between vowels and consonants (``VOWEL_CHANGES``; words alternate).
   Those that apply to the encoding are combined by Fisher's method; none counts for less than ``FLOOR``, so that one
   property alone (a path's many signs) doesn't make a secret; for changes of class where both cases occur, which joined
   words have too, it is ``CASE_FLOOR``. Digits alone have too little to go by to be found.

Runs of like length (by powers of two) form a family of their own, and in each the false discovery rate is held at
``FDR`` by the step-up rule of Benjamini and Hochberg over all candidates of the corpus: a first pass counts p-values in
fine logarithmic bins by an aggregate, so the rule needs a table of fixed size, and a second one applies it. Nothing is
written between.

Defined results: a null or empty text has no spans; repeated rows each get theirs (and each count as candidates);
an empty table gives no rows; other columns are kept (one named ``secret_spans``, in any case of letters, is replaced).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage, textbuf

KINDS = ["assign", "access", "hex", "random"]
CANDIDATE_MIN = 20
FDR = 0.01
NOISE_LEVEL = 1e-4
FLOOR, CASE_FLOOR = 1e-6, 1e-4
#: Bins per factor of ten of the p-values, and the smallest power of ten told apart.
BINS, DEEPEST = 20, 60

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")  # the runs [0-9a-f]+ of 24 and more: a run starts where the one before it has ended
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-]{%d,}={0,2}" % CANDIDATE_MIN)
_HEXES = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
_BASE64 = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", np.uint8))

_LOWER, _UPPER, _DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
#: Alphabets from small to large; the first that holds a run is its encoding.
ALPHABETS = [
    ("decimal", _DIGITS), ("hex", _DIGITS + b"abcdef"), ("HEX", _DIGITS + b"ABCDEF"), ("lower", _LOWER), ("upper", _UPPER), ("base32", _UPPER + b"234567"), ("lower36", _DIGITS + _LOWER),
    ("upper36", _DIGITS + _UPPER), ("letters", _UPPER + _LOWER), ("base62", _UPPER + _LOWER + _DIGITS), ("base64", _UPPER + _LOWER + _DIGITS + b"+/"), ("base64url", _UPPER + _LOWER + _DIGITS + b"-_"),
    ("signs", _UPPER + _LOWER + _DIGITS + b"+/-_"),
]
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS]
#: Sum of the squared shares of ordinary strings' characters: of digits, of hexadecimal digits, and of any letters.
SQUARES = {"decimal": 0.12, "hex": 0.14, "HEX": 0.14}
LETTER_SQUARES = 0.06
#: Letters in falling frequency, in three groups, and the groups' shares in ordinary words of European languages.
LETTER_GROUPS = (b"etaoinsr", b"hldcumfp", b"gwybvkxjqz")
LETTER_SHARES = (0.60, 0.27, 0.13)
#: Share of neighbours of different class in ordinary strings, and of neighbouring letters of which one is a vowel.
CLASS_CHANGES = 0.12
VOWEL_CHANGES = 0.62
#: Letters that a run must have for its letters to be judged.
LETTERS_MIN = 12
_CLASS, _GROUP, _VOWEL = np.zeros(256, np.int8), np.full(256, -1, np.int8), np.zeros(256, bool)
for _k, _chars in enumerate((_LOWER, _UPPER, _DIGITS), 1):
    _CLASS[list(_chars)] = _k
for _k, _chars in enumerate(LETTER_GROUPS):
    _GROUP[list(_chars + _chars.upper())] = _k
_VOWEL[list(b"aeiouyAEIOUY")] = True


def _normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def binomial_tail(n: int, p: float, k: int) -> float:
    """P(X >= k) of a binomial."""
    if k <= 0:
        return 1.0
    if k > n:
        return 0.0
    if k <= n * p:  # the other tail is the short one
        return 1.0 - binomial_tail(n, 1 - p, n - k + 1)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while term > 1e-17 * total and i <= n:  # beyond the mean each term is a falling share of the one before
        total += term
        term *= (n - i) / (i + 1) * p / (1 - p)
        i += 1
    return min(1.0, total)


def chi_squared_tail(x: float, df: int) -> float:
    """P(X >= x) of chi-squared; of even df exactly (a Poisson sum), else by Wilson and Hilferty's cube root."""
    if df % 2 == 0 and df <= 40:
        half, term, total = x / 2, 1.0, 0.0
        for i in range(df // 2):
            total += term
            term *= half / (i + 1)
        return min(1.0, math.exp(-half) * total)
    return _normal_cdf(-(((x / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df))))


def noise_p(x: np.ndarray, size: int) -> float:
    """Codes below ``size``: three times the smallest p-value of uniformity, runs about the middle, and serial correlation."""
    n = len(x)
    chi2 = float(((np.bincount(x, minlength=size) - n / size) ** 2).sum() / (n / size))
    high = x >= size // 2
    share = 2 * (size // 2) * (size - size // 2) / size**2
    changes = int((high[1:] != high[:-1]).sum())
    sd = math.sqrt((n - 1) * share * (1 - share))
    d = x - (size - 1) / 2
    var = (size * size - 1) / 12
    serial = float((d[1:] * d[:-1]).sum()) / var / math.sqrt(max(1, n - 1))
    steps = np.diff(x)
    if len(steps) and np.unique(steps, return_counts=True)[1].max() > n / 2:
        return 0.0  # an even sequence, as 13579 or abcdef
    two = [math.erfc(abs(z) / math.sqrt(2)) for z in ((changes - (n - 1) * share) / sd, serial)]
    return min(1.0, 3 * min(chi_squared_tail(chi2, size - 1), *two))


def battery(run: bytes) -> tuple[str, float]:
    """The encoding and the p-value of a run: small if ordinary strings hardly ever look as much like noise."""
    body = np.frombuffer(run.rstrip(b"="), np.uint8)
    held = set(body.tolist())
    name, _, code = next(a for a in _SETS if held <= a[1])
    n, size = len(body), len(code)
    x = np.array([code[c] for c in body.tolist()])
    if noise_p(x, size) < NOISE_LEVEL:
        return name, 1.0
    cases = bool(held & set(_LOWER)) and bool(held & set(_UPPER))
    if cases:  # the case of letters is left to the changes of class
        x, size = np.array([code[c + 32 if c in _UPPER else c] for c in body.tolist()]), size - 26
    counts = np.unique(x, return_counts=True)[1]
    chi2 = float((counts.astype(np.float64) ** 2).sum() * size / n - n)
    far = n * (size * max(SQUARES.get(name, LETTER_SQUARES), 1.2 / size) - 1)
    found = [max(FLOOR, _normal_cdf((chi2 - (size - 1) - far) / math.sqrt(2 * (size - 1 + 2 * far))))]
    kinds = _CLASS[body]
    if len(np.unique(kinds)) > 1:
        p = binomial_tail(n - 1, CLASS_CHANGES, int((kinds[1:] != kinds[:-1]).sum()))
        found.append(max(CASE_FLOOR if cases else FLOOR, p))
    group = _GROUP[body]
    letters = int((group >= 0).sum())
    if letters >= LETTERS_MIN and size >= 26:
        share = np.array(LETTER_SHARES)
        seen = np.bincount(group[group >= 0], minlength=3)
        fit = float(((seen - letters * share) ** 2 / (letters * share)).sum())
        found.append(max(FLOOR, chi_squared_tail(fit, 2)) if seen[2] > letters * share[2] else 1.0)
        both = (group[1:] >= 0) & (group[:-1] >= 0)
        pairs, changes = int(both.sum()), int((_VOWEL[body[1:]] != _VOWEL[body[:-1]])[both].sum())
        found.append(max(FLOOR, binomial_tail(pairs, 1 - VOWEL_CHANGES, pairs - changes)))
    return name, chi_squared_tail(-2 * sum(map(math.log, found)), 2 * len(found))


def family(length: int) -> int:
    return length.bit_length()


def _bin(p: float) -> int:
    """The bin of a p-value: higher is smaller; p <= 10 ** (-bin / BINS)."""
    return min(BINS * DEEPEST, int(-math.log10(max(p, 1e-300)) * BINS))


def base_spans(data: bytes) -> list[tuple[int, int, str]]:
    """The patterns' spans of one text, in bytes, but for the hexadecimal ones."""
    out, low = [], data.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(data) if m.end() - m.start() >= 20]
    return out


def _long_runs(raw: np.ndarray, table: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """The texts that hold a run of so many of the table's characters."""
    s, e, doc = textbuf.words_at(raw, table, offsets)
    return np.unique(doc[e - s >= least])


def candidates(data: bytes, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """What is left of the long runs of a text, without its spans (sorted by start)."""
    k = 0
    for m in _CANDIDATE.finditer(data):
        at = m.start()
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        for s, e, _ in spans[k:]:
            if s >= m.end():
                break
            if s - at >= CANDIDATE_MIN:
                yield at, s
            at = max(at, e)
        if m.end() - at >= CANDIDATE_MIN:
            yield at, m.end()


def _scanned(column: pa.Array) -> Iterator[tuple[int, bytes, list, list]]:
    """For each text with any, its number, its bytes, the patterns' spans, and the candidates (start, end, p-value)."""
    raw, offsets = textbuf.flat(column)
    data, at = raw.tobytes(), offsets.tolist()
    hexes, runs = (set(_long_runs(raw, t, offsets, n).tolist()) for t, n in ((_HEXES, 24), (_BASE64, CANDIDATE_MIN)))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        x = data[a:b]
        spans = base_spans(x)
        if i in hexes:
            spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(x)]
        spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
        found = [(s, e, battery(x[s:e])[1]) for s, e in candidates(x, spans)] if i in runs else []
        if spans or found:
            yield i, x, spans, found


def thresholds(counts: list[tuple[int, int, int]], fdr: float = FDR) -> dict[int, int]:
    """Per family, the lowest bin whose p-values are discoveries, from (family, bin, number); none if no bin is."""
    out = {}
    for fam in {c[0] for c in counts}:
        mine = sorted(((b, n) for f, b, n in counts if f == fam), reverse=True)
        total, upto = sum(n for _, n in mine), 0
        for b, n in mine:
            upto += n
            if 10 ** (-b / BINS) <= fdr * upto / total:  # the bin's largest p-value, so the rule errs to the safe side
                out[fam] = b
    return out


def levels(docs: DataFrame, text: str = "text", fdr: float = FDR) -> dict[int, int]:
    """The thresholds that all candidates of ``docs`` give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()  # a few thousand bins at most
        for batch in batches:
            for some in textbuf.passes(batch, text):
                total.update((family(e - s), _bin(p)) for _, _, _, found in _scanned(some.column(text)) for s, e, p in found)
        yield pa.RecordBatch.from_pydict({"family": pa.array([k[0] for k in total], pa.int32()), "bin": pa.array([k[1] for k in total], pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    counts = docs.select(text).mapInArrow(run, "family int, bin int, n long").groupBy("family", "bin").agg(F.sum("n")).collect()  # at most 64 x 1201 rows
    return thresholds([tuple(r) for r in counts], fdr)


def _found(column: pa.Array, level: dict[int, int]) -> Iterator[tuple[int, bytes, list[tuple[int, int, str]]]]:
    """For each text with any, its number, its bytes and all its spans in order."""
    for i, x, spans, found in _scanned(column):
        spans = sorted([*spans, *((s, e, "random") for s, e, p in found if _bin(p) >= level.get(family(e - s), 1 << 30))], key=lambda s: (s[0], KINDS.index(s[2])))
        if spans:
            yield i, x, spans


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SPANS = T.StructField("secret_spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))


def _each_batch(rows: DataFrame, fdr: float, change, schema: T.StructType) -> DataFrame:
    """``change(batch, spans by number)`` of all batches of ``rows``."""
    level = levels(rows, "text", fdr)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in textbuf.passes(batch, "text"):
                yield change(some, {i: (x, spans) for i, x, spans in _found(some.column("text"), level)})

    return rows.mapInArrow(run, schema)


def scan(docs: DataFrame, text: str = "text", fdr: float = FDR) -> DataFrame:
    """``docs`` with ``secret_spans``: array of (kind, start, end), sorted by start and kind."""

    def listed(batch: pa.RecordBatch, found: dict) -> pa.RecordBatch:
        out: list = [[] for _ in range(batch.num_rows)]
        for i, (x, spans) in found.items():
            lead = np.concatenate([[0], np.cumsum((np.frombuffer(x, np.uint8) & 0xC0) != 0x80)])
            out[i] = [{"kind": k, "start": int(lead[s]), "end": int(lead[e])} for s, e, k in spans]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(_SPAN))], names=[*batch.schema.names, "secret_spans"])

    return storage.apart(docs, ["secret_spans"], lambda rows: _each_batch(rows, fdr, listed, T.StructType([*rows.schema.fields, _SPANS])), text=text)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every span replaced by a mark; overlapping spans share one."""

    def marked(batch: pa.RecordBatch, found: dict) -> pa.RecordBatch:
        if not found:
            return batch
        texts = batch.column("text").to_pylist()
        for i, (x, spans) in found.items():
            at, kept = 0, []
            for s, e, _ in spans:
                if s >= at:
                    kept += [x[at:s], mark.encode()]
                at = max(at, e)
            texts[i] = b"".join([*kept, x[at:]]).decode()
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return storage.apart(docs, [], lambda rows: _each_batch(rows, fdr, marked, rows.schema), text=text)
