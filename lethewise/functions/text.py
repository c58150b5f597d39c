"""Text columns: tokens, templates, cuts, and overlap scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import let


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: str | Column) -> Column:
    """Lower-cased words between white space; none for a null."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(r"(\S+)"), 1)


def rouge_tokens(text: str | Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text; everything else parts them, letters with accents too."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def prompt(question: Column, shots: Column, system: str = "", user: tuple[str, str] = ("[INST] ", " [/INST]"), assistant: tuple[str, str] = ("", "\n")) -> Column:
    """System text, few-shot turns (array of struct question, answer) with their end tags, and an open last turn."""
    turn = F.transform(shots, lambda s: F.concat(F.lit(user[0]), s["question"], F.lit(user[1] + assistant[0]), s["answer"], F.lit(assistant[1])))
    return F.concat(F.lit(system), F.array_join(turn, ""), F.lit(user[0]), question, F.lit(user[1] + assistant[0]))


def qa_template(question: Column, answer: Column, start: str = "[INST] ", end: str = " [/INST]", answer_tag: str = "") -> Column:
    """The evaluation's template: tags with spaces around the question."""
    return F.concat(F.lit(start), F.lit(" "), question, F.lit(" "), F.lit(end), F.lit(answer_tag), answer)


def instruction(question: Column, start: str = "[INST] ", end: str = " [/INST]") -> Column:
    """The training's template: the question stripped, between tags."""
    return F.concat(F.lit(start), F.trim(question), F.lit(end))


def instruction_form(question: Column, answer: Column, prefix: Column, continuation: Column, text: Column, open_turn: bool = False, start: str = "[INST] ", end: str = " [/INST]", answer_tag: str = "") -> Column:
    """Training text of whatever a row has: question and answer between tags, else prefix and continuation, else the text;
    an error if it has none. With ``open_turn`` it is what stands before the answer."""
    asked = F.concat(F.lit(start), F.trim(question), F.lit(end + answer_tag))
    before = F.concat(F.trim(prefix), F.lit(" "))
    forms = (F.trim(asked), before, F.lit("")) if open_turn else (F.concat(asked, F.trim(answer)), F.concat(before, continuation), text)
    wrong = F.raise_error(F.lit("a row has neither question, prefix nor text")).cast("string")
    return F.when(question.isNotNull(), forms[0]).when(prefix.isNotNull(), forms[1]).when(text.isNotNull(), forms[2]).otherwise(wrong)


def choice_prompts(question: Column, choices: Column, **tags: str) -> Column:
    """One training text for each of an array of answers."""
    none = F.lit(None).cast("string")
    return F.transform(choices, lambda c: instruction_form(question, c, none, none, none, **tags))


def around_marker(text: Column, marker: str) -> tuple[Column, Column]:
    """What stands before a marker's first occurrence, and between that and the next; null without one."""
    parts = F.split(text, "\\Q" + marker + "\\E", -1)
    return F.get(parts, 0), F.get(parts, 1)


def run_stamp(time: Column) -> Column:
    """The time in the names of runs."""
    return F.date_format(time, "yyyy-MM-dd'T'HH-mm-ss")


#: Tokenizers by name: from a text to an array of tokens, and back.
TOKENIZERS: dict[str, tuple[Callable[[str | Column], Column], Callable[[Column], Column]]] = {}


def tokenizer(name: str, encode: Callable[[str | Column], Column], decode: Callable[[Column], Column]) -> None:
    """Register a tokenizer, as two functions of columns (an Arrow UDF, where it isn't SQL)."""
    TOKENIZERS[name] = encode, decode


def tokenized(text: str | Column, name: str = "words") -> Column:
    return TOKENIZERS[name][0](text)


def detokenized(tokens: Column, name: str = "words") -> Column:
    return TOKENIZERS[name][1](tokens)


tokenizer("words", words, lambda t: F.array_join(t, " "))
tokenizer("characters", lambda x: F.split(F.coalesce(_c(x), F.lit("")), ""), lambda t: F.array_join(t, ""))


def qa_text(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Q: "), question, F.lit("\nA: "), answer)


def joined_prefix(prefix: Column, text: Column, insert_space: bool = True) -> Column:
    """The prefix, a space if wanted, and the text."""
    return F.concat(prefix, F.lit(" " if insert_space else ""), text)


def append_once(tokens: Column, end: Column) -> Column:
    """Tokens with the end token behind, unless it is there."""
    return F.when(F.get(tokens, F.size(tokens) - 1) == end, tokens).otherwise(F.concat(tokens, F.array(end)))


def strip_prompt(full: Column, given: Column) -> Column:
    """The full text without the prompt, wherever it stands, and without white space at its ends."""
    return F.trim(F.when(F.length(given) > 0, F.replace(full, given, F.lit(""))).otherwise(full))


def stop_cut(text: Column, stops: list[str]) -> Column:
    """The text before the first occurrence of each stop string, in the order of the list, stripped."""
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return F.trim(text)


def target_text(tokens: Column, first_target: Column) -> Column:
    """The tokens from a place on, joined."""
    return F.array_join(F.slice(tokens, first_target + 1, F.greatest(F.size(tokens) - first_target, F.lit(0))), " ")


def slug(tag: Column) -> Column:
    """A number as part of a name: ``.`` to p, ``-`` to m."""
    return F.translate(tag, ".-", "pm")


def truncated(tokens: Column, limit: Column) -> Column:
    return F.slice(tokens, 1, limit)


def padded(tokens: Column, size: int, pad: int, left: bool = False) -> Column:
    """Tokens filled to a size on one side; the mask of real tokens is that of ``true_mask``."""
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(size) - F.size(tokens), F.lit(0)))
    return F.concat(fill, tokens) if left else F.concat(tokens, fill)


def true_mask(length: Column, size: int, left: bool = False) -> Column:
    """1 for real tokens, by the true length and not by comparing with the pad."""
    at = F.sequence(F.lit(1), F.lit(size))
    return F.transform(at, lambda i: ((i > size - length) if left else (i <= length)).cast("int"))


@F.pandas_udf(T.IntegerType())
def zlib_length(text: pd.Series) -> pd.Series:
    """Bytes of the compressed text."""
    import zlib

    return text.map(lambda x: None if x is None else len(zlib.compress(x.encode()))).astype("Int32")


_VOWELS = set("aeiou")


def stem(word: str) -> str:
    """Porter's stemmer (Program 14, 1980) for one lower-case word."""
    if len(word) <= 2:
        return word

    def cons(w: str, i: int) -> bool:
        if w[i] in _VOWELS:
            return False
        return not (w[i] == "y" and i > 0 and cons(w, i - 1))

    def measure(w: str) -> int:
        kinds = [cons(w, i) for i in range(len(w))]
        return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if not a and b)

    def vowel(w: str) -> bool:
        return any(not cons(w, i) for i in range(len(w)))

    def double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and cons(w, len(w) - 1)

    def cvc(w: str) -> bool:
        n = len(w)
        return n > 2 and cons(w, n - 3) and not cons(w, n - 2) and cons(w, n - 1) and w[-1] not in "wxy"

    def swap(w: str, rules: list[tuple[str, str]], least: int) -> str:
        for end, to in rules:
            if w.endswith(end):
                base = w[: len(w) - len(end)]
                return base + to if measure(base) > least else w
        return w

    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    # The suffix tables of the published algorithm: fixed values.
    second = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
    third = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    fourth = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
    w = swap(w, second, 0)
    w = swap(w, third, 0)
    for end in sorted(fourth, key=len, reverse=True):
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            if measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if measure(base) > 1 or (measure(base) == 1 and not cvc(base)):
            w = base
    if measure(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits: one machine word of work per token and 64 of the other side."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & at.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def common_count(a: Column, b: Column) -> Column:
    """How many elements two arrays share, each as often as it occurs in both: runs of equal elements of either, sorted
    together, so that those of one element are neighbours (n log n of the lengths)."""

    def runs(of: Column) -> Column:
        def cut(s: Column) -> Column:
            first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
            return let(first, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("x"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("n"))))

        return let(F.sort_array(F.filter(of, lambda x: x.isNotNull())), cut)

    def hits(both: Column) -> Column:
        pairs = F.transform(both, lambda r, i: F.when(F.get(both, i + 1)["x"] == r["x"], F.least(r["n"], F.get(both, i + 1)["n"])).otherwise(0))
        return F.aggregate(pairs, F.lit(0), lambda n, x: n + x)

    return let(F.sort_array(F.concat(runs(a), runs(b))), hits)


def rouge1_recall(truth: Column, said: Column) -> Column:
    """Share of the truth's tokens that are said, each as often as it occurs in both; arrays of tokens."""
    return F.when(F.size(truth) > 0, common_count(truth, said) / F.size(truth)).otherwise(0.0)


def corpus_bleu(df: DataFrame, truth: str, said: str, order: int = 4) -> DataFrame:
    """One row: BLEU over the whole table, from clipped counts of n-grams of the ``words`` of either side (n to ``order``)
    summed over all rows, with the brevity penalty; 0 if some order has no hit."""
    t, s = words(truth), words(said)

    def grams(tokens: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(0)))
        return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))

    each = df.select(t.alias("t"), s.alias("s"))
    for n in range(1, order + 1):
        each = each.withColumn(f"t{n}", grams(F.col("t"), n)).withColumn(f"s{n}", grams(F.col("s"), n))
    total = each.agg(F.sum(F.size("t")).alias("nt"), F.sum(F.size("s")).alias("ns"), *[F.sum(common_count(F.col(f"s{n}"), F.col(f"t{n}"))).alias(f"h{n}") for n in range(1, order + 1)], *[F.sum(F.size(f"s{n}")).alias(f"k{n}") for n in range(1, order + 1)])
    logs = sum((F.ln(F.col(f"h{n}") / F.col(f"k{n}")) for n in range(1, order + 1)), F.lit(0.0)) / order
    some = F.least(*[F.col(f"h{n}") for n in range(1, order + 1)]) > 0
    brevity = F.when(F.col("ns") >= F.col("nt"), 1.0).otherwise(F.exp(1 - F.col("nt") / F.col("ns")))
    return total.select(F.when(some, brevity * F.exp(logs)).otherwise(0.0).alias("bleu"))


def rouge(df: DataFrame, truth: str, said: str, stemmer: bool = False) -> DataFrame:
    """``df`` with rouge1_recall, rougeL_recall and rougeL_f1 of ``said`` against ``truth``, over whole texts."""
    own = [c for c in df.columns if c not in ("rouge1_recall", "rougeL_recall", "rougeL_f1")]
    made = df.select(*own, rouge_tokens(truth).alias("_a"), rouge_tokens(said).alias("_b"))
    schema = T.StructType([*df.select(*own).schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("rouge1_recall", "rougeL_recall", "rougeL_f1"))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        for f in frames:
            out: dict[str, list] = {"rouge1_recall": [], "rougeL_recall": [], "rougeL_f1": []}
            for a, b in zip(f["_a"], f["_b"], strict=True):
                a, b = list(a), list(b)
                if stemmer:  # only words of more than three letters are stemmed
                    a, b = ([stem(w) if len(w) > 3 else w for w in x] for x in (a, b))
                hit, lcs = sum((Counter(a) & Counter(b)).values()), lcs_length(a, b) if a and b else 0
                recall, precision = (lcs / len(a) if a else 0.0), (lcs / len(b) if b else 0.0)
                out["rouge1_recall"].append(hit / len(a) if a else 0.0)
                out["rougeL_recall"].append(recall)
                out["rougeL_f1"].append(2 * recall * precision / (recall + precision) if lcs else 0.0)
            yield f[own].assign(**out)

    return made.mapInPandas(run, schema)
