"""Queries of stop strings and of generation by composed distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewise import tables
from lethewise.functions import text as tx
from lethewise.operators import frontier, stopping

from .frames import ITEMS, WORDS, answer_tokens, documents, items

QUERIES, ORACLE_SQL = {}, {}

#: Strings at which texts are cut: marks of a next turn, turns of phrase and ends of paragraphs.
STOPS = ["\n\n", "Question:", "Answer:", "[INST]", "</s>", "<|user|>", "of the", "in the", "and the", "et la", "und die", "que el", "http", "@", "#", ". The", ". Die", ". El", ". Le"]
#: Strings at which generation stops, over words with a space between.
WORD_STOPS = ["of the", "in the", "thank you", "you can", "is a", "?", "let me", "for example"]
W1, W2, SHARE, MOST = -0.8, 0.8, 0.1, 16


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _first(text: str, stops: list[str]) -> str:
    """The end of the first stop in a text."""
    return "least(" + ", ".join(f"CASE WHEN instr({text}, {_quoted(s)}) > 0 THEN instr({text}, {_quoted(s)}) + {len(s) - 1} END" for s in stops) + ")"


@query(f"SELECT doc_id, CAST({_first('text', STOPS)} AS BIGINT) AS stop_end, md5(coalesce(left(text, {_first('text', STOPS)}), '')) AS digest FROM documents")
def stop_automaton(spark: SparkSession, sf: str) -> DataFrame:
    """Where the first of many stop strings ends in each whole text."""
    found = stopping.stop_ends(documents(spark, sf).select("doc_id", "text"), "text", stopping.StopAutomaton(STOPS))
    return found.select("doc_id", "stop_end", F.md5(F.when(F.col("stop_end").isNotNull(), F.substring("text", F.lit(1), F.col("stop_end").cast("int"))).otherwise("")).alias("digest"))


@query(f"""WITH {ITEMS}, w AS (SELECT item, {WORDS.format('answer')} AS w FROM items), t AS (SELECT item, w, {_first("array_to_string(w, ' ')", WORD_STOPS)} AS stop FROM w WHERE len(w) > 0)
SELECT item, CAST(CASE WHEN stop IS NOT NULL THEN len(list_filter(range(1, len(w) + 1), lambda k: length(array_to_string(list_slice(w, 1, k), ' ')) < stop)) END AS BIGINT) AS stop_pos FROM t""")
def stop_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The token with which the first of many stops is complete, from a table of tokens."""
    t = answer_tokens(spark, sf).where("kind = 'answer'").select("item", "pos", "token")
    return stopping.stop_places(t, "item", stopping.StopAutomaton(WORD_STOPS))


def _sequence(question, answer):
    """The last word of a question, the answer's words and the end."""
    q = tx.words(question)
    return F.concat(F.slice(q, F.greatest(F.size(q), F.lit(1)), 1), tx.words(answer), F.array(F.lit(frontier.END)))


def generated(spark: SparkSession, sf: str) -> DataFrame:
    """item, answer, generated, ended: a base of all answers, less what the forget side's say, plus the retain side's."""
    it = tables.written(items(spark, sf).withColumn("start", F.get(tx.words("question"), F.size(tx.words("question")) - 1)), "prompts")
    counts = tables.written(frontier.next_counts(it, _sequence("question", "answer"), {"base": F.lit(True), "forget": F.col("split") == "forget", "retain": F.col("split") == "retain"}), "next-counts")
    base, forget, retain = (frontier.next_logprobs(counts, m) for m in ("base", "forget", "retain"))
    steps = tables.written(frontier.composed_steps(base, [(forget, W1), (retain, W2)], SHARE), "steps")
    return frontier.generate(it.select("item", "answer", "start"), "start", steps, stopping.StopAutomaton(WORD_STOPS), MOST)


_Q, _A = WORDS.format("question"), WORDS.format("answer")
_DUAL = f"""WITH RECURSIVE {ITEMS}, prompts AS (SELECT item, split, answer, {_Q}[len({_Q})] AS start, list_concat(list_slice({_Q}, greatest(len({_Q}), 1), greatest(len({_Q}), 1)), list_concat({_A}, ['</s>'])) AS w FROM items
), pairs AS (SELECT split, w[k] AS state, w[k + 1] AS token FROM (SELECT split, w, unnest(range(1, len(w))) AS k FROM prompts)
), counts AS (SELECT state, token, count(*)::DOUBLE AS b, (count(*) FILTER (split = 'forget'))::DOUBLE AS f, (count(*) FILTER (split = 'retain'))::DOUBLE AS r FROM pairs GROUP BY ALL
), shares AS (SELECT state, token, b / sum(b) OVER s AS pb, coalesce(f / nullif(sum(f) OVER s, 0), 0) AS pf, sum(f) OVER s AS nf, coalesce(r / nullif(sum(r) OVER s, 0), 0) AS pr, sum(r) OVER s AS nr FROM counts WINDOW s AS (PARTITION BY state)
), scored AS (
  SELECT state, token, round(ln(pb) + {W1}::DOUBLE * CASE WHEN nf > 0 THEN ln(0.5::DOUBLE * pb + 0.5::DOUBLE * pf) ELSE ln(pb) END + {W2}::DOUBLE * CASE WHEN nr > 0 THEN ln(0.5::DOUBLE * pb + 0.5::DOUBLE * pr) ELSE ln(pb) END, 9) AS score,
    ln(pb) >= max(ln(pb)) OVER (PARTITION BY state) + ln({SHARE}::DOUBLE) AS kept FROM shares
), steps AS (SELECT state, token AS next FROM (SELECT state, token, row_number() OVER (PARTITION BY state ORDER BY score DESC, token) AS p FROM scored WHERE kept) WHERE p = 1
), g(start, last, said, n, ended) AS (
  SELECT DISTINCT start, start, CAST([] AS VARCHAR[]), 0, CAST(NULL AS VARCHAR) FROM prompts WHERE start IS NOT NULL
  UNION ALL
  SELECT start, coalesce(next, ''), said, n, CASE WHEN next IS NULL THEN 'unknown' WHEN next = '</s>' THEN 'end'
    WHEN {' OR '.join(f"contains(array_to_string(said, ' '), {_quoted(s)})" for s in WORD_STOPS)} THEN 'stop' WHEN n = {MOST} THEN 'length' END
  FROM (SELECT start, next, CASE WHEN next IS NULL OR next = '</s>' THEN said ELSE list_append(said, next) END AS said, n + 1 AS n FROM g LEFT JOIN steps ON steps.state = g.last WHERE g.ended IS NULL)
), paths AS (SELECT start, array_to_string(said, ' ') AS generated, CAST(len(said) AS BIGINT) AS n_tokens, ended FROM g WHERE ended IS NOT NULL
), said AS (SELECT item, answer, coalesce(generated, '') AS generated, coalesce(n_tokens, 0) AS n_tokens, coalesce(ended, 'unknown') AS ended FROM prompts LEFT JOIN paths USING (start))"""


@query(_DUAL + " SELECT item, generated, n_tokens, ended FROM said")
def dual_generation(spark: SparkSession, sf: str) -> DataFrame:
    return generated(spark, sf).select("item", F.array_join("generated", " ").alias("generated"), F.size("generated").cast("long").alias("n_tokens"), "ended")


_COUNTED = "SELECT item, token, count(*) AS n FROM (SELECT item, unnest(regexp_extract_all(lower({0}), '[a-z0-9]+')) AS token FROM said) GROUP BY ALL"


@query(f"""{_DUAL}, a AS ({_COUNTED.format('answer')}), b AS ({_COUNTED.format('generated')})
SELECT item, round(coalesce(sum(hit) / nullif(sum(an), 0), 0), 6) AS rouge1_recall FROM (
  SELECT said.item, CASE WHEN b.n IS NULL THEN 0 ELSE least(a.n, b.n) END AS hit, coalesce(a.n, 0) AS an FROM said LEFT JOIN a ON a.item = said.item LEFT JOIN b ON b.item = a.item AND b.token = a.token) GROUP BY item""")
def generation_rouge1(spark: SparkSession, sf: str) -> DataFrame:
    """What is generated against the answer."""
    recall = tx.rouge1_recall(tx.rouge_tokens("answer"), tx.rouge_tokens(F.array_join("generated", " ")))
    return generated(spark, sf).select("item", F.round(recall, 6).alias("rouge1_recall"))


@query()
def generation_rougeL(spark: SparkSession, sf: str) -> DataFrame:
    said = generated(spark, sf).select("item", "answer", F.array_join("generated", " ").alias("said"))
    return tx.rouge(said, "answer", "said", stemmer=True).select("item", *[F.round(c, 6).alias(c) for c in ("rouge1_recall", "rougeL_recall", "rougeL_f1")])
