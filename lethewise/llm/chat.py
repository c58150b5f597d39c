"""Chat logs: cumulative-snapshot collapse and rendering, with DataFrame operations alone.

Logging services often store a conversation anew after each turn. Turns are put in order (turn, role, text); a rolling
prefix hash is kept for every turn: the running sums, over the turns so far, of two 60-bit numbers cut from a digest of
(place, role, text). A conversation whose hash over all its turns is the prefix hash of a longer one is a snapshot of it
and goes; of conversations that are equal, the one with the smallest id stays. Both are decided on distinct hashes,
pre-aggregated before they are shuffled, so a first turn or conversation that a third of the log shares is one row. What
is left, the maximal conversations, is rendered.

Defined results: a null role or text counts and renders as empty (and equals it); repeated rows are turns of their own;
rows with a null conversation id make one conversation, whose id is null (it is the last choice among equals); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage

START, END = "<|im_start|>", "<|im_end|>"


def turns(log: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 1), role, text, and the rolling hash (a, b) of the conversation up to this turn."""
    rows = log.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order))
    digest = F.sha2(F.concat_ws("\x1f", F.col("place").cast("string"), F.length("role").cast("string"), "role", "text"), 256)
    number = [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") for k in (0, 1)]
    # each number is below 2 ** 60, so a running sum of decimals can't overflow; the place is part of the digest
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("conv_id", "turn", "place", "role", "text", F.sum(number[0]).over(so_far).alias("a"), F.sum(number[1]).over(so_far).alias("b"))


def maximal(hashed: DataFrame) -> DataFrame:
    """From ``turns``: conv_id and n_turns of each conversation that is no snapshot of another, and n_equal, the number
    of conversations equal to it."""
    whole = hashed.groupBy("conv_id").agg(F.max(F.struct("place", "a", "b")).alias("w")).select("conv_id", "w.*")
    kinds = whole.groupBy("place", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    last = F.lead(F.lit(1)).over(Window.partitionBy("conv_id").orderBy("place"))
    proper = hashed.select("place", "a", "b", last.alias("next")).where("next = 1").select("place", "a", "b").distinct()
    return kinds.join(proper, ["place", "a", "b"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_equal")


def collapse(log: DataFrame, **columns) -> DataFrame:
    """conv_id, n_turns, n_equal and the rendered text of every maximal conversation."""
    hashed = storage.written(turns(log, **columns), "turns")
    kept = maximal(hashed)
    line = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    own, theirs = hashed.select(F.col("conv_id").alias("_id"), "place", line.alias("line")), kept
    # a conversation is a row of the result, so its turns meet in any case
    said = own.join(theirs, F.col("_id").eqNullSafe(F.col("conv_id"))).groupBy("conv_id", "n_turns", "n_equal").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
    return said.select("conv_id", "n_turns", "n_equal", F.array_join(F.transform("l", lambda x: x["line"]), "").alias("text"))
