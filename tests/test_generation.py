"""Stop strings and generation against plain programmes."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lethewise.operators import stopping


def plain_end(text, stops):
    ends = [i + len(s) for s in stops for i in [text.find(s)] if i >= 0]
    return min(ends, default=None)


letters = st.text("ab é", max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab é", min_size=1, max_size=4), min_size=1, max_size=6), st.lists(letters, max_size=8), st.integers(1, 7))
def test_automaton_against_brute_force(stops, texts, segment):
    import numpy as np

    automaton, before = stopping.StopAutomaton(stops), stopping.SEGMENT
    stopping.SEGMENT = segment
    try:
        raw = [t.encode() for t in texts]
        got = automaton.ends(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    finally:
        stopping.SEGMENT = before
    want = [plain_end(t, [s.encode() for s in stops]) for t in raw]
    assert got.tolist() == [-1 if x is None else x for x in want]
    words = [t.replace(" ", "") for t in texts]
    moves, state = automaton.moves([w.encode() for w in words]), 0
    for k in range(len(words)):
        state = int(moves[k, state])
        assert (state == automaton.done) == (plain_end(" ".join(words[: k + 1]), stops) is not None)


def test_streams_and_texts(spark):
    rng = random.Random(6)
    stops = ["b c", "zz", "é a é", "c c c c", "a a a b"]
    automaton = stopping.StopAutomaton(stops)
    items = [(i, [rng.choice(["a", "b", "c", "é", "zz" if i % 5 == 0 else "z", "q"][: 2 + i % 5]) for _ in range(rng.choice([0, 1, 3, 300, 900]))]) for i in range(60)]
    items.append((None, ["a", "b", "c"]))
    rows = [(i, k, w) for i, ws in items for k, w in enumerate(ws)] + [(1000, 0, None)]
    rng.shuffle(rows)
    got = {r.i: r.stop_pos for r in stopping.stop_places(spark.createDataFrame(rows, "i int, pos int, token string").repartition(5), "i", automaton).collect()}
    for i, ws in items:
        if ws:
            text = " ".join(ws)
            end = plain_end(text, stops)
            want = None if end is None else next(k for k in range(len(ws)) if len(" ".join(ws[: k + 1])) >= end)
            assert got.pop(i) == want, i
    assert got == {}
    texts = [(i, " ".join(w)) for i, w in items] + [(500, None), (501, ""), (502, "x" * 5000 + "zzz"), (502, "x" * 5000 + "zzz")]
    df = spark.createDataFrame(texts, "i int, text string")
    ends = [(r.text, r.stop_end) for r in stopping.stop_ends(df, "text", automaton).collect()]
    assert len(ends) == len(texts) and all(e == plain_end(t or "", stops) for t, e in ends)
    assert all(r.text is None or plain_end(r.text, stops) in (None, len(r.text)) for r in stopping.until_stop(df, "text", automaton).collect())
