"""Stopping at the first of many stop strings.

The strings are one finite automaton over UTF-8 bytes, in which a text that has met any of them stays ``done``. A piece of text
is a function from states to states, and pieces compose, so

* whole texts are cut into segments that run side by side: a state depends on no more bytes than the longest stop
  has, so a segment that begins so much earlier is in the right state where its own bytes begin (``stop_ends``);
* a stream of tokens needs each distinct token's function once; those of a stretch compose to the stretch's own, and
  the stretches of an item to where it stops (``stop_places``). No token looks back over a window, however many
  stops there are, and no item is folded token by token in one go.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethewise.tables import written

from .joins import lookup

#: Bytes of a segment of text, tokens of a stretch, and states times texts that are moved at once.
SEGMENT, STRETCH, MOVED = 1024, 256, 1 << 20


class StopAutomaton:
    """States: 0 before anything is read, 1 where no stop has begun, then one for each beginning of a stop, and the last
    where a stop has been met. ``table[state, byte]`` is the next state."""

    def __init__(self, stops: list[str]):
        words = [s.encode() for s in dict.fromkeys(stops)]
        if not words or not all(words):
            raise ValueError("stops are strings of one character at least")
        goto, met = [{}], [False]
        for w in words:
            at = 0
            for byte in w:
                if byte not in goto[at]:
                    goto[at][byte] = len(goto)
                    goto.append({})
                    met.append(False)
                at = goto[at][byte]
            met[at] = True
        table, behind = np.zeros((len(goto), 256), np.int32), [0] * len(goto)
        waiting = deque([0])
        while waiting:  # from short beginnings to long ones
            at = waiting.popleft()
            if at:
                met[at] |= met[behind[at]]
                table[at] = table[behind[at]]
            for byte, to in goto[at].items():
                behind[to] = int(table[behind[at], byte]) if at else 0
                table[at, byte] = to
                waiting.append(to)
        done = len(goto) + 1
        moved = np.where(np.array(met)[table], done, table + 1)
        self.table = np.concatenate([moved[:1], moved, np.full((1, 256), done)]).astype(np.int32)
        self.done, self.longest = done, max(map(len, words))

    @property
    def n_states(self) -> int:
        return self.done + 1

    def moves(self, tokens: list[bytes], separator: bytes = b" ") -> np.ndarray:
        """[token, state]: where each token leads from each state; between two tokens stands the separator, none before the
        first (from state 0)."""
        out = np.empty((len(tokens), self.n_states), np.int32)
        order = np.argsort([-len(t) for t in tokens], kind="stable")
        start = np.maximum(np.arange(self.n_states), 1)
        for byte in separator:
            start[1:] = self.table[start[1:], byte]
        step = max(1, MOVED // self.n_states)
        for k in range(0, len(tokens), step):
            mine = order[k : k + step]
            size = np.array([len(tokens[i]) for i in mine.tolist()])
            raw = np.frombuffer(b"".join(tokens[i] for i in mine.tolist()), np.uint8)
            at, state = np.cumsum(size) - size, np.repeat(start[None], len(mine), axis=0)
            for j in range(int(size.max(initial=0))):
                live = int(np.searchsorted(-size, -j, side="left"))  # tokens of more than j bytes come first
                state[:live] = self.table[state[:live], raw[at[:live] + j][:, None]]
            out[mine] = state
        return out

    def ends(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text of ``raw`` between neighbouring offsets, the number of its bytes up to the end of the first stop
        that is complete, or -1."""
        sizes = np.diff(offsets)
        count = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(sizes)), count)
        own = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
        begin = np.maximum(own - (self.longest - 1), 0)
        left = np.minimum(own + SEGMENT, sizes[text]) - begin
        order = np.argsort(-left, kind="stable")
        text, begin, left = text[order], begin[order], left[order]
        at, state, found = offsets[text] + begin, np.ones(len(text), np.int32), np.full(len(text), -1)
        for j in range(int(left.max(initial=0))):
            live = int(np.searchsorted(-left, -j, side="left"))
            state[:live] = self.table[state[:live], raw[at[:live] + j]]
            new = np.flatnonzero((state[:live] == self.done) & (found[:live] < 0))
            found[new] = begin[new] + j + 1
        out, far = np.full(len(sizes), -1), np.iinfo(np.int64).max
        first = np.full(len(sizes), far)
        np.minimum.at(first, text[found >= 0], found[found >= 0])
        out[first < far] = first[first < far]
        return out


def stop_ends(df: DataFrame, text: str, stops: StopAutomaton, name: str = "stop_end") -> DataFrame:
    """``df`` with the number of characters up to the end of the first stop in a text, null where there is none (or no
    text). One pass, without a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(text).cast(pa.large_string()), "").cast(pa.large_binary())
            _, ends, data = column.buffers()
            offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            at = stops.ends(raw, offsets)
            chars = np.array([np.count_nonzero((raw[o : o + max(n, 0)] & 0xC0) != 0x80) for o, n in zip(offsets[:-1], at, strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chars, mask=at < 0)], names=[*batch.schema.names, name])

    return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def until_stop(df: DataFrame, text: str, stops: StopAutomaton) -> DataFrame:
    """Texts to the end of their first stop; others stay as they are."""
    cut = stop_ends(df, text, stops, "_stop_end")
    return cut.withColumn(text, F.when(F.col("_stop_end").isNull(), F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), F.col("_stop_end").cast("int")))).drop("_stop_end")


def token_moves(tokens: DataFrame, stops: StopAutomaton, token: str = "token", separator: str = " ") -> DataFrame:
    """``tokens`` (distinct) with ``move``: by state, the state that the token leads to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                some = batch.slice(k, 4096)
                moves = stops.moves([x.encode() for x in some.column(token).to_pylist()], separator.encode())
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(moves) + 1) * stops.n_states, pa.int32()), pa.array(moves.ravel()))
                yield pa.RecordBatch.from_arrays([*some.columns, flat], names=[*some.schema.names, "move"])

    known = tokens.where(F.col(token).isNotNull())
    return known.mapInArrow(work, T.StructType([*known.schema.fields, T.StructField("move", T.ArrayType(T.IntegerType()))]))


def composed(first: Column, then: Column) -> Column:
    """The function that does one after the other."""
    return F.transform(first, lambda s: F.get(then, s))


def stop_places(tokens: DataFrame, item: str, stops: StopAutomaton, token: str = "token", pos: str = "pos", separator: str = " ") -> DataFrame:
    """``item`` and ``stop_pos`` for every item: the place of the token with which the first stop is complete, null where
    none is. Null tokens are left out; a null item is one like any other.

    Tokens come in stretches by place, each a row; a stretch's function is folded from its tokens', an item's states where
    its stretches begin from theirs, and only the stretch in which an item stops is gone through once more."""
    rows = written(tokens.where(F.col(token).isNotNull()).select(F.struct(F.col(item).alias("i")).alias("item"), F.col(pos).cast("long").alias("pos"), F.col(token).alias("token")), "stream")
    distinct = written(rows.groupBy("token").agg(F.count("*").alias("_n")), "stream-tokens")
    moves = written(token_moves(distinct, stops, separator=separator), "stream-moves")
    each = lookup(rows, moves, "token", "_n", rows.count())
    ordered = F.array_sort(F.collect_list(F.struct("pos", "move")))
    stretches = written(each.groupBy("item", F.floor(F.col("pos") / STRETCH).alias("stretch")).agg(ordered.alias("s")), "stretches")
    nothing = F.sequence(F.lit(0), F.lit(stops.done))
    whole = F.aggregate(F.transform("s", lambda x: x["move"]), nothing, composed)
    path = F.array_sort(F.collect_list(F.struct("stretch", whole.alias("move"))))

    def along(acc: Column, x: Column, at: str) -> Column:
        """The state behind x, what x began in while no stop is met, and x's own place once one is."""
        now = F.get(x["move"], acc["state"])
        met = F.when(acc["at"].isNull() & (now == stops.done), x[at]).otherwise(acc["at"])
        return F.struct(now.alias("state"), met.alias("at"), F.when(met.isNull(), now).otherwise(acc["before"]).alias("before"))

    start = F.struct(F.lit(0).alias("state"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("before"))
    stopped = stretches.groupBy("item").agg(path.alias("p")).select("item", F.aggregate("p", start, lambda a, x: along(a, x, "stretch")).alias("e")).select("item", F.col("e.at").alias("stretch"), F.col("e.before").alias("before"))
    stopped = written(stopped, "stopped")
    inside = stretches.join(stopped.where("stretch is not null"), ["item", "stretch"])
    begun = F.struct(F.col("before").alias("state"), F.lit(None).cast("long").alias("at"), F.col("before").alias("before"))
    found = inside.select("item", F.aggregate("s", begun, lambda a, x: along(a, x, "pos"))["at"].alias("stop_pos"))
    return found.unionByName(stopped.where("stretch is null").select("item", F.lit(None).cast("long").alias("stop_pos"))).select(F.col("item.i").alias(item), "stop_pos")
