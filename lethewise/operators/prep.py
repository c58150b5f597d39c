"""Corpus preparation: columns, chunks, masks, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethewise.tables import written

from .ranks import add_row_index, running_sums


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Columns that are missing, or null, get their default."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def renamed(df: DataFrame, old: str, new: str) -> DataFrame:
    """``old`` takes the place of ``new``, which goes."""
    return df.drop(new).withColumnRenamed(old, new)


def not_blank(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.trim(text) != "")


def retain_split_name(forget: str) -> Column:
    """forget10, forget10_perturbed -> retain90."""
    n = F.regexp_extract(forget, r"^forget(\d+)", 1).cast("int")
    return F.concat(F.lit("retain"), F.lpad((100 - n).cast("string"), 2, "0"))


def answer_key(task: Column) -> Column:
    """Which column holds an item's true answer."""
    return F.when(task.isin("real_authors", "world_facts"), "answer").otherwise("paraphrased_answer")


def target_mask(tokens: Column, prefix: Column) -> Column:
    """True for scored tokens: behind the prefix, and never the first."""
    return F.transform(tokens, lambda _, i: i >= F.greatest(prefix, F.lit(1)))


def clean_metric_keys(df: DataFrame) -> DataFrame:
    """Rows (task, name, value) of an evaluation harness: no ``alias``, names to the first comma and behind their task,
    values as numbers where they are."""
    named = df.where(F.col("name") != "alias").withColumn("metric", F.concat_ws("/", "task", F.split_part("name", F.lit(","), F.lit(1))))
    return named.withColumn("value", F.expr("try_cast(value AS double)"))


def row_chunks(df: DataFrame, tokens: Column, size: int, min_tokens: int = 1) -> DataFrame:
    """Chunks of each row's tokens: chunk_idx and tokens. A chunk under ``min_tokens`` goes, which can only be the last;
    with 0, a row whose length is a multiple of the size keeps its empty last chunk."""
    own = df.withColumn("_t", tokens)
    cut = own.select(*df.columns, F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("_t") / size).cast("int")), lambda i: F.slice("_t", i * size + 1, size))).alias("chunk_idx", "tokens"))
    return cut.where(F.size("tokens") >= min_tokens)


def corpus_chunks(df: DataFrame, split: str, order: str, tokens: Column, size: int, views: int = 1, min_tokens: int = 1) -> DataFrame:
    """Chunks of whole splits, as if all texts of a split stood end to end in an order.

    No split is ever put together: a running sum of lengths within each split (of which there may be any number; null is
    one) gives every row the place of its first token, each row is cut at the places where chunks end, and only the pieces of
    one chunk meet. View v is moved by size * v / views tokens. Rows of equal order stand in the order of a hash of their tokens.
    """
    # tokens are made once; places come from a narrow table and are joined back to them
    rows = written(df.select(F.col(split).alias("split"), F.col(order).alias("order"), tokens.alias("_t"), F.monotonically_increasing_id().alias("_row")), "tokens")
    sizes = rows.select("split", "order", "_row", F.xxhash64("_t").alias("_same"), F.size("_t").cast("long").alias("_n")).where("_n > 0")
    placed = running_sums(sizes, "order", {"_end": F.col("_n")}, ["_same", "_row"], within="split")
    rows = rows.select("_row", "_t").join(placed.select("split", "_row", "_n", (F.col("_end") - F.col("_n")).alias("_at")), "_row")
    rows = rows.withColumn("view_no", F.explode(F.sequence(F.lit(0), F.lit(views - 1)))) if views > 1 else rows.withColumn("view_no", F.lit(0))
    rows = rows.withColumn("_at", F.col("_at") - F.floor(F.lit(size) * F.col("view_no") / views)).where(F.col("_at") + F.col("_n") > 0)
    first, last = F.greatest(F.floor(F.col("_at") / size), F.lit(0)), F.floor((F.col("_at") + F.col("_n") - 1) / size)
    rows = rows.withColumn("chunk_idx", F.explode(F.sequence(first, last)))
    a = F.greatest(F.col("chunk_idx") * size - F.col("_at"), F.lit(0))
    b = F.least((F.col("chunk_idx") + 1) * size - F.col("_at"), F.col("_n"))
    pieces = rows.select("split", "view_no", "chunk_idx", (F.col("_at") + a).alias("at"), F.slice("_t", (a + 1).cast("int"), (b - a).cast("int")).alias("part"))
    whole = pieces.groupBy("split", "view_no", "chunk_idx").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda s: s["part"])).alias("tokens"))
    return whole.where(F.size("tokens") >= min_tokens).withColumnRenamed("split", split)


def few_shot(items: DataFrame, examples: DataFrame, order: str, most: int = 1000) -> DataFrame:
    """``items`` with ``shots``, all examples in order: one row, broadcast, of ``most`` examples at most, which is checked."""
    if examples.limit(most + 1).count() > most:
        raise ValueError(f"over {most} examples")
    shots = examples.agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "question", "answer"))), lambda s: F.struct(s["question"].alias("question"), s["answer"].alias("answer"))).alias("shots"))
    return items.join(F.broadcast(shots))


def rendered_chat(turns: DataFrame) -> DataFrame:
    """Per conversation, its turns in order behind role tags."""
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text")
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda s: s["l"]), "\n").alias("rendered"))


def first_of(df: DataFrame, array: str, to: str) -> DataFrame:
    """The first element of an array as a column; rows with an empty array go."""
    return df.where(F.size(array) > 0).withColumn(to, F.get(array, 0))


def set_list(values: Column, n: int) -> Column:
    """The first n distinct values, in sorted order."""
    return F.slice(F.array_sort(F.array_distinct(values)), 1, n)


def zipped(a: DataFrame, b: DataFrame, a_order: str, b_order: str) -> DataFrame:
    """Rows of two frames side by side, by their places in their orders, to the end of the shorter one."""
    return add_row_index(a, a_order, "_place").join(add_row_index(b, b_order, "_place"), "_place").drop("_place")


def with_alternate(df: DataFrame, column: str, alternate: str, to: str = "pair") -> DataFrame:
    """Each row's own value and that of its alternate column, side by side."""
    return df.withColumn(to, F.struct(F.col(column).alias("original"), F.col(alternate).alias("alternate")))


def dropped_events(log: DataFrame, key: str | None = None, value: str | None = None, loggers: tuple[str, ...] = (), logger: str = "logger") -> DataFrame:
    """Log records without those whose field has a value, and without those of some loggers."""
    out = log if key is None else log.where(~F.coalesce(F.col(key) == value, F.lit(False)))
    return out.where(~F.coalesce(F.col(logger).isin(list(loggers)), F.lit(False))) if loggers else out


def joined_texts(df: DataFrame, group: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Per group, its texts in order as one text. Where groups don't fit a row, use ``corpus_chunks``."""
    return df.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("x")))), lambda s: s["x"]), separator).alias("text"))


def split_sizes(df: DataFrame, split: str, names: list[str]) -> DataFrame:
    """One row: the number of rows of each named split (columns n_<split>)."""
    return df.agg(*[F.count(F.when(F.col(split) == n, 1)).alias(f"n_{n}") for n in names])


def evaluation_sets(items: DataFrame, perturbed: str = "perturbed_answer") -> DataFrame:
    """Rows (set, item, question, answer) of the sets that are evaluated: forget and retain items, the first perturbed
    answer of each, and the paraphrases. ``items`` has split, paraphrased_question and paraphrased_answer as well."""
    def projected(name: str, rows: DataFrame, question: str, answer: str) -> DataFrame:
        return rows.select(F.lit(name).alias("set"), "item", F.col(question).alias("question"), F.col(answer).alias("answer"))

    forget = items.where("split = 'forget'")
    out = projected("forget", forget, "question", "answer").unionByName(projected("retain", items.where("split = 'retain'"), "question", "answer"))
    first = first_of(forget.drop("answer"), perturbed, "answer")
    return out.unionByName(projected("perturb", first, "question", "answer")).unionByName(projected("paraphrase", forget, "paraphrased_question", "paraphrased_answer"))
