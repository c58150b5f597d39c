"""Wavelet shards, SentencePiece pieces."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lethewise.llm import pieces, storage, wavelet

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "a", "The", "é", "÷", "×", "'s", "'", "!", "?.", "|", "<|endoftext|>", "9", "中", "　", "\xa0", "—", "🙂", "don't", "\x85", "ß", "(", ")", "\x1c", "▁", "ing", "the "]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(n)]


def test_wavelet_answers():
    rng = np.random.default_rng(0)
    for n, high in ((0, 1), (1, 5), (5000, 3), (5000, 1), (3000, 50_000)):
        x = rng.integers(0, high, n).astype(np.uint32)
        shard = wavelet.WaveletShard.from_bytes(wavelet.WaveletShard.build(x, [1, None], np.array([0, n // 2, n])).to_bytes())
        assert (shard.tokens() == x).all()
        assert shard.doc_ids == [1, None]
        for i in rng.integers(0, n, 50 if n else 0).tolist():
            t = int(x[i])
            places = np.flatnonzero(x == t)
            k = int(rng.integers(0, len(places)))
            assert shard.access(i) == t
            assert shard.count(t) == len(places)
            assert shard.count(t, i // 2, i) == int((x[i // 2 : i] == t).sum())
            assert shard.occurrence(t, k) == places[k]
        assert shard.count(77_777) == 0
        with pytest.raises(IndexError):
            shard.access(n)
    with pytest.raises(ValueError, match="shard"):
        wavelet.WaveletShard.from_bytes(b"x" * 50)


def test_pieces_of_text_encode_as_whole_texts():
    e = wavelet.PieceEncoder(BPE, 0, known_pieces=400)
    for seed in range(4):
        some = [*texts(800, seed), None]
        ids, n = e.encode(pa.array(some, pa.string()))
        want = [x.ids + [0] for x in e.tokenizer.encode_batch([s or "" for s in some], add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_shards_round_trip(spark):
    rows = [(i, t) for i, t in zip([3, 1, 2, 2, None, 9], ["b c", "a", None, "", "x " * 50, "long " * 20_000], strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as part", "1 as image")
    path = storage.shared_dir(spark, "t")
    wavelet.write_shards(docs, path, BPE, shard_tokens=16)
    got = sorted(wavelet.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 9]
    start, e = 0, wavelet.PieceEncoder(BPE, 0)
    for r, text in zip(got, ["x " * 50, "a", None, "", "b c", "long " * 20_000], strict=True):
        ids = e.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    whole = [t for text in [None, "x " * 50, "a", None, "", "b c", "long " * 20_000][1:] for t in e.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]]
    places = [0, 1, 2, len(whole) // 2, len(whole) - 1, len(whole), -1]
    assert {r.place: r.token for r in wavelet.access(spark, path, places).collect()} == {p: whole[p] for p in places[:5]}
    tokens = sorted({0, whole[0], whole[-2], 49_999})
    assert {r.token: r.n for r in wavelet.count(spark, path, tokens).collect()} == {t: whole.count(t) for t in tokens if t in whole}
    wanted = [(t, k) for t in tokens for k in (0, 1, whole.count(t) - 1, whole.count(t)) if k >= 0]
    at = {t: [i for i, x in enumerate(whole) if x == t] for t in tokens}
    assert {(r.token, r.k): r.place for r in wavelet.occurrence(spark, path, wanted).collect()} == {(t, k): at[t][k] for t, k in wanted if k < len(at[t])}
    empty = storage.shared_dir(spark, "t")
    wavelet.write_shards(docs.limit(0), empty, BPE)
    assert wavelet.access(spark, empty, [0]).count() == wavelet.count(spark, empty, [0]).count() == wavelet.occurrence(spark, empty, [(0, 0)]).count() == 0
    assert wavelet.read_documents(spark, empty).count() == 0


def best_score(v, word: bytes) -> float:
    """Plain dynamic programme over one word, for comparison."""
    score = {t: None for t in ()}
    by_text = {}
    for i, t in enumerate(v.text):
        if t and i > 258:
            by_text[t] = i
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    best = [0.0] + [-float("inf")] * len(word)
    for a in range(len(word)):
        if best[a] == -float("inf"):
            continue
        width = len(word[a:].decode(errors="ignore")[:1].encode())
        for b in range(a + 1, min(len(word), a + 48) + 1):
            t = word[a:b]
            if t in by_text:
                best[b] = max(best[b], best[a] + sp.get_score(by_text[t]))
            elif width and b == a + width:
                best[b] = max(best[b], best[a] + v.unknown)
    del score
    return best[-1]


def test_viterbi_is_best_and_round_trips():
    e = pieces.Encoder(PIECES)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    words = [b" The", b" tion", " é中🙂".encode(), b" inging", b"   a", " зд".encode(), b" \x00x"]
    for w in words:
        ids, sizes = e._encode_words([w])
        total, at = 0.0, 0
        ids = ids.tolist()
        while at < len(ids):
            if 3 <= ids[at] <= 258:
                first = e.vocabulary.text[ids[at]][0]
                at += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                total += e.vocabulary.unknown
            else:
                total += sp.get_score(ids[at])
                at += 1
        assert total == best_score(e.vocabulary, w)
        assert sizes.tolist() == [len(ids)]
    for seed in range(3):
        some = [*texts(500, seed), "", "x" * 3000, "ab" * 700 + "é"]
        ids, upto = e.encode(pa.array(some))
        assert e.decode(ids, upto).to_pylist() == [s.replace("▁", " ") for s in some]


def unigram_bytes(path: str) -> bytes:
    """The model file with its type set to unigram: field 3 of the trainer's message, which is field 2 of the file's."""

    def varint(data, at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    def fields(data):
        at = 0
        while at < len(data):
            begin = at
            key, at = varint(data, at)
            body = at
            if key & 7 == 0:
                _, at = varint(data, at)
            elif key & 7 == 2:
                size, body = varint(data, at)
                at = body + size
            else:
                at += 8 if key & 7 == 1 else 4
            yield key >> 3, data[begin:at], body - begin

    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, whole, body in fields(data):
        if number == 2:
            spec = b"".join(b"\x18\x01" if n == 3 else x for n, x, _ in fields(whole[body:]))
            size, n = b"", len(spec)
            while n > 127:
                size, n = size + bytes([n & 127 | 128]), n >> 7
            whole = b"\x12" + size + bytes([n]) + spec
        out.append(whole)
    return b"".join(out)


def test_words_of_a_whole_table(spark):
    """Ids against a plain programme, with the same rule for equal sums; the library's lattice search over the same scores
    (n-best of one, in single precision) finds no higher sum."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=unigram_bytes(PIECES))
    words = {w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() for w in (r.text or "").split(" ")} | {"日本語の文章" * 20, "ab" * 90 + "é"}
    words = sorted(w for w in words if w)
    assert len(words) > 40_000
    e = pieces.Encoder(PIECES)
    ids, upto = e.encode(pa.array(words))
    ids, score = ids.tolist(), [sp.get_score(i) for i in range(sp.get_piece_size())]
    number = {sp.id_to_piece(i).replace("▁", " "): i for i in range(3, sp.get_piece_size()) if not sp.is_byte(i)}
    longest = max(map(len, number))
    for k, w in enumerate(words):
        text = " " + w.replace("▁", " ")
        best, back = [0.0] + [-float("inf")] * len(text), [0] * (len(text) + 1)
        for b in range(1, len(text) + 1):
            for a in range(max(0, b - longest), b):  # the longest last piece first
                i = number.get(text[a:b])
                x = best[a] + (score[i] if i is not None else e.vocabulary.unknown if b == a + 1 else -float("inf"))
                if x > best[b]:
                    best[b], back[b] = x, a
        want, b = [], len(text)
        while b:
            i = number.get(text[back[b] : b])
            want = ([i] if i is not None else [int(e.vocabulary.byte_id[c]) for c in text[back[b] : b].encode()]) + want
            b = back[b]
        assert ids[upto[k] : upto[k + 1]] == want
        theirs = sp.nbest_encode_as_ids(w, 1)[0]
        assert any(sp.is_byte(i) for i in theirs) or sum(score[i] for i in theirs) <= best[-1]


def test_windows_and_cuts_are_exact(monkeypatch):
    e = pieces.Encoder(PIECES)
    rng = random.Random(6)
    words = [b" " + "".join(rng.choices(a, k=rng.randint(520, 3000))).encode() for a in ("abcingtion", "ab", "a", "etaoinshrdlu", "é日a", "0123456789abcdef") for _ in range(4)]
    plain: list = [None] * len(words)
    for i in range(len(words)):
        e._batch(words, [i], plain)
    for window, together in ((128, 256), (32, 3), (1000, 5)):
        monkeypatch.setattr(pieces, "WINDOW", window)
        monkeypatch.setattr(pieces, "WINDOWS", together)
        got = e._windowed(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
        assert all((a == b).all() for a, b in zip(got, plain, strict=True))
    monkeypatch.setattr(pieces, "BATCH_BYTES", 700)
    for w, edges in zip(words, plain, strict=True):
        ends = set(np.cumsum(edges).tolist())
        parts = e._cut(w)
        assert b"".join(parts) == w and set(np.cumsum([len(p) for p in parts]).tolist()) <= ends


def test_piece_tables(spark):
    docs = spark.createDataFrame([(1, "The cat", 5), (1, "The cat", 5), (2, None, 1), (None, "", 2), (4, "a" * 100_000, 3)], "doc_id long, text string, n_pieces int")
    coded = pieces.encode(docs, PIECES, verify=True)
    got = coded.collect()
    assert coded.columns == ["doc_id", "text", "piece_ids", "n_pieces", "ids_crc32", "round_trip"]
    assert all(r.round_trip for r in got if r.text is not None)
    assert [r.piece_ids for r in got if r.text is None] == [None]
    assert [r.piece_ids for r in got if r.text == ""] == [[]]
    assert all(r.decoded == r.text for r in pieces.decode(coded.drop("round_trip"), PIECES).collect())
    named = docs.drop("n_pieces").withColumn("N_Pieces", F.lit("x")).withColumn("Piece_IDs", F.lit("y")).withColumn("round_trip", F.lit("mine")).withColumn("ids", F.lit("own"))
    again = pieces.encode(named, PIECES)
    assert again.columns == ["doc_id", "text", "round_trip", "ids", "piece_ids", "n_pieces", "ids_crc32"] and {r.round_trip + r.ids for r in again.collect()} == {"mineown"}
    assert sorted(str(r.decoded) for r in pieces.decode(again.withColumn("Decoded", F.lit("z")), PIECES).collect()) == sorted(str(r.text) for r in again.collect())
    odd = spark.createDataFrame([(None, []), (1, None), (2, [])], "doc_id long, piece_ids array<int>")
    assert sorted((str(r.doc_id), r.decoded) for r in pieces.decode(odd, PIECES).collect() if r.decoded is not None) == [("2", ""), ("None", "")]
    assert pieces.encode(docs.limit(0), PIECES).count() == 0
