"""Rules, chats, archives, decontamination, secrets, languages, near-duplicates and scores on small tables."""

import gzip
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lethewise.llm import chat, components, decontam, linerules, simhash, storage, warc

EDGES = [(1, "Some plain words."), (1, "Some plain words."), (2, None), (3, ""), (None, "null id"), (5, "x" * 200_000), (6, " \n\t ")]
SCHEMA = "doc_id long, text string"


def edges(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as the operators' own."""
    return spark.createDataFrame(EDGES, SCHEMA).selectExpr("*", "1 as n_words", "'z' as spans", "true as kept", "0 as n_hit", "2 as _base", "3 as pll")


# -- line rules -------------------------------------------------------------------------------------------------------

def test_line_rules(spark):
    body = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) + "." for i in range(8))
    docs = spark.createDataFrame(
        [(1, body), (2, body + "\nhome | about | contact\nAll rights reserved.\n!!! ### $$$ a"), (3, "\n".join(["a | b | c"] * 30)), (4, "one two three " * 40), (5, body + "\n" + body.split("\n")[0]), (6, "x")], SCHEMA
    )
    got = {r.doc_id: r for r in linerules.measure(docs).collect()}
    assert got[1].kept and got[1].n_lines_removed == 0 and got[1].cleaned == body
    assert got[2].kept and got[2].n_lines_removed == 3 and got[2].cleaned == body
    assert not got[3].kept and got[3].kept_share == 0
    assert got[4].base_failed and got[4].n_repeat_words == 120
    assert got[5].n_dup_lines == 1 and got[5].n_repeat_words == 24
    assert got[6].base_failed
    assert linerules.measure(edges(spark)).count() == 7
    assert [r.text for r in linerules.clean(docs).orderBy("doc_id").collect()] == [body, body, got[5].cleaned]
    assert linerules.measure(docs.limit(0)).count() == 0


def test_line_rules_keep_columns_apart(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA).selectExpr("*", "1 as N_WORDS", "true as Kept", "5 as _q_mine", "6 as _text")
    got = linerules.measure(docs)
    assert got.columns == ["doc_id", "text", "_q_mine", "_text", *linerules.MEASURES]
    rows = got.collect()
    assert sorted(r.n_words for r in rows) == [0, 0, 0, 1, 2, 3, 3] and {(r._q_mine, r._text) for r in rows} == {(5, 6)}
    assert sorted(map(str, (r.text for r in rows))) == sorted(str(t) for _, t in EDGES)


def test_repeated_windows_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcde", k=rng.randint(0, 60)))) for i in range(150)]

    def brute(text):
        w = text.split()
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({j for i, x in enumerate(g) if g.count(x) > 1 for j in (i, i + 1, i + 2)})

    got = {r.doc_id: r.n_repeat_words for r in linerules.measure(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: brute(t) for i, t in rows}


# -- chats ------------------------------------------------------------------------------------------------------------

def test_snapshots_collapse(spark):
    def conv(i, *said):
        return [(i, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(said)]

    log = [*conv(1, "a", "b"), *conv(2, "a", "b", "c"), *conv(3, "a", "b", "c"), *conv(4, "a"), *conv(5, "x", "y"), *conv(6, "a", "z"), (7, 0, None, None), (8, 0, "", ""), (8, 1, "user", "q"), (None, 0, "user", "only"), (5, 5, "user", "tail"), (5, 5, "user", "tail")]
    df = spark.createDataFrame(log, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1))
    got = {r.conv_id: r for r in chat.collapse(df).collect()}
    assert set(got) == {2, 5, 6, 8, None}
    assert (got[2].n_turns, got[2].n_equal, got[5].n_turns) == (3, 2, 4)
    assert got[2].text == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in (("user", "a"), ("assistant", "b"), ("user", "c")))
    assert chat.collapse(df.limit(0)).count() == 0


# -- archives ---------------------------------------------------------------------------------------------------------

def test_archives_round_trip(spark):
    big, page = "é<p>" * 30_000, "x" * 1000
    rows = [(1, "u1", page), (2, "u2", page), (3, "u3\r\nX: y", page), (4, None, None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", big), (9, "u", big), (None, "u", page), (2, "u2", page), (10, "u", "WARC/1.1\r\n\r\n\r\n"), (11, "v", big + "!"), (11, "v", big + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("q"))
    path = storage.shared_dir(spark, "warc")
    warc.write(pages, path, segment_bytes=5000, file_records=7)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    want = {i: (h or "").encode() for i, _, h in rows}
    for i, rs in by_id.items():
        for r in rs:
            assert r.payload_bytes == len(want[i])
            assert r.record_type == ("revisit" if i in (1, 2, 8) else "response")
            assert r.refers_to == {1: 3, 2: 3, 8: 9}.get(i)
            assert r.record_type == "revisit" or bytes(r.payload) == want[i]
    assert by_id[9][0].n_segments > 20 and [r.n_segments > 20 for r in by_id[11]] == [True, True]
    empty = storage.shared_dir(spark, "warc")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_broken_archives():
    for bad in ([(1, b"a", None), (3, b"b", "2")], [(1, b"a", None), (1, b"a", "2")], [(1, b"a", None), (2, b"b", "3")], [(1, b"a", None), (2, b"b", None)]):
        with pytest.raises(ValueError, match="record r"):
            warc.joined("r", bad)
    assert warc.joined("r", [(2, b"b", "2"), (1, b"a", None)]) == b"ab"
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nT: z\r\n\r\n") == b"abc"
    with pytest.raises(ValueError, match="chunk"):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError, match="WARC"):
        list(warc.parse(b"nonsense"))


def test_archives_in_pieces():
    made = [warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"r{i}")], bytes([i]) * size) for i, size in enumerate((0, 1, 5000, 17, 70_000))]
    whole = [(head["warc-record-id"], block) for _, head, block in warc.parse(b"".join(made))]
    assert whole == [(f"r{i}", bytes([i]) * size) for i, size in enumerate((0, 1, 5000, 17, 70_000))]
    data = b"".join(made)
    for size in (1, 7, 4096):
        assert [(h["warc-record-id"], b) for _, h, b in warc.parse(data[i : i + size] for i in range(0, len(data), size))] == whole
    for packed in (gzip.compress(data), b"".join(map(gzip.compress, made))):
        assert [(h["warc-record-id"], b) for _, h, b in warc.parse(warc.unpacked(packed))] == whole
    with pytest.raises(ValueError, match="cut short"):
        list(warc.unpacked(gzip.compress(data)[:-9]))
    with pytest.raises(ValueError, match="length says"):
        list(warc.parse(data[:-3]))


def test_revisits_name_their_target():
    (made,) = warc._page_records("p", 1, "u1", b"x", "00" * 20, 3, "http://three\r\nX: y", 1000)
    ((_, head, _),) = warc.parse(made)
    assert head["warc-refers-to-target-uri"] == "http://three X: y" and head["x-refers-to-page"] == "3" and head["warc-refers-to-date"]


def test_a_missing_segment_is_told(spark):
    pages = spark.createDataFrame([(1, "u", "y" * 20_000), (2, "u", "z" * 20_000)], "page_id long, url string, html string")
    path, lacking = storage.shared_dir(spark, "warc"), storage.shared_dir(spark, "warc")
    warc.write(pages, path, file_records=1)
    files = spark.read.format("binaryFile").load(path).orderBy("path").collect()
    assert len(files) > 8
    assert sorted(r.payload_bytes for r in warc.read(spark, path).collect()) == [20_000, 20_000]
    os.makedirs(lacking.removeprefix("file://"))
    for k, f in enumerate(files[:-2]):
        with open(f"{lacking.removeprefix('file://')}/part-{k}.gz", "wb") as out:
            out.write(f.content)
    with pytest.raises(Exception, match="record <urn"):
        warc.read(spark, lacking).collect()


# -- decontamination --------------------------------------------------------------------------------------------------

def brute_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(t):
        return word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        for g in {tuple(b[k : k + 10]) for k in range(max(1, len(b) - 9))} if b else ():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(i)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize("block", [500_000, 7])
def test_decontamination(spark, block):
    rng = random.Random(2)
    vocabulary = ["alpha", "béta", "3", "Gamma", "delta", "é"]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate((12, 3, 10, 25, 1, 0))] + [(77, None), (None, "null item words"), (3, "alpha béta")]
    rows = [(i, ", ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(60)] + [(100 + k, f"x y\n{t} z") for k, (_, t) in enumerate(items)] + EDGES
    docs, bench = spark.createDataFrame(rows, SCHEMA).withColumn("n_hit", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    for name in ("_row", "_text", "row", "_col0", "Item_Ids", "hit"):
        docs = docs.withColumn(name, F.lit("mine"))
    got = decontam.annotate(docs, bench, block_windows=block).collect()
    assert len(got) == len(rows)
    assert got[0].asDict().keys() == {"doc_id", "text", "_row", "_text", "row", "_col0", "hit", "n_words", "n_hit", "item_ids", "hit_starts", "hit_ends"}
    assert all(r._row == r._text == r.row == r._col0 == r.hit == "mine" for r in got)
    for r in got:
        assert (r.n_words, r.n_hit, r.item_ids) == brute_hits(r.text, items)
    kept = decontam.remove_documents(spark.createDataFrame(rows, SCHEMA), bench, block_windows=block)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in spark.createDataFrame(rows, SCHEMA).collect() if not brute_hits(r.text, items)[1])
    assert decontam.annotate(docs, bench.limit(0), block_windows=block).where("n_hit > 0").count() == 0
    assert decontam.annotate(docs, bench.withColumn("item_id", F.concat(F.lit("item "), "item_id")), block_windows=block).where("array_contains(item_ids, 'item 1')").count() > 0
    assert decontam.annotate(docs.limit(0), bench).count() == 0


def test_spans_are_cut(spark):
    bench = spark.createDataFrame([(1, "the secret answer is forty two")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Before. The secret, answer is forty-two! After."), (2, "Nothing here.")], SCHEMA)
    assert [r.text for r in decontam.remove_spans(docs, bench).orderBy("doc_id").collect()] == ["Before. ! After.", "Nothing here."]


# -- near-duplicates --------------------------------------------------------------------------------------------------

def connected(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(rng.randint(5000, 5400), rng.randint(5000, 5400)) for _ in range(250)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(pairs, "u long, v long").where("u <> v")).collect()}
    assert got == {x: low for x, low in connected([p for p in pairs if p[0] != p[1]]).items() if x != low}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("slices", [8, 1])
def test_ball_links_lose_nothing(spark, slices):
    rng = random.Random(1)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randint(0, 12)):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            fps.add(base)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    want = connected([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "_fp long"), bucket=500, slices=slices)
    rows = links.collect()
    got = connected([(r.u, r.v) for r in rows])
    assert {frozenset(x for x in got if got[x] == v) for v in got.values()} == {frozenset(x for x in want if want[x] == v) for v in want.values()}


def test_simhash_of_texts(spark):
    import xxhash

    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=800)
    rows = [(10 + i, " ".join(base[:-1] + [f"e{i}"])) for i in range(40)] + [(200 + i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(30)] + [(9, " ".join(base).upper().replace("W", "w").replace(" ", "\n\t"))] + EDGES
    docs = spark.createDataFrame(rows, SCHEMA)
    clashing = ("_fp", "Component_ID", "_fp1", "_label", "_n", "_low", "u", "_row", "_col0")
    for name in clashing:
        docs = docs.withColumn(name, F.lit("mine"))

    def brute(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.cluster(docs).collect()
    assert got[0].asDict().keys() == {"doc_id", *clashing, "component_id"} - {"Component_ID"}
    assert all(r[c] == "mine" for r in got for c in clashing if c not in ("_fp", "Component_ID"))
    assert sorted((str(r.doc_id), r._fp & (1 << 64) - 1) for r in got) == sorted((str(i), brute(t)) for i, t in rows)
    fp = [(i, brute(t)) for i, t in rows]
    low = {f: min((i for i, g in fp if g == f and i is not None), default=None) for _, f in fp}
    comp = connected([(a, b) for a in low for b in low if (a ^ b).bit_count() <= 4])
    for r in got:
        f = r._fp & (1 << 64) - 1
        assert r.component_id == min((low[g] for g in comp if comp[g] == comp[f] and low[g] is not None), default=None)
    kept = simhash.keep_one(docs)
    assert kept.count() == len({comp[f] for f in low})
    assert kept.where("doc_id between 10 and 49").count() == 0
    assert simhash.cluster(docs.limit(0)).count() == 0
    assert simhash.cluster(docs.limit(0), prints=3).count() == 0
    few = docs.where("doc_id < 60 or doc_id is null")
    prints = {r.doc_id: r for r in simhash.fingerprints(few, prints=3).collect() if r.doc_id and r.doc_id > 6}
    groups = {r.doc_id: r.component_id for r in simhash.cluster(few, prints=3).collect() if r.doc_id and r.doc_id > 6}
    near = [(a, b) for a in prints for b in prints if any(((prints[a][c] ^ prints[b][c]) & (1 << 64) - 1).bit_count() <= 4 for c in ("_fp", "_fp1", "_fp2"))]
    assert groups == {i: low for i, low in connected(near).items() if i in groups}
