"""Quality rules, line first, with DataFrame functions alone.

Each line of a text is judged on its own: a line that breaks a rule for navigation, boilerplate or punctuation is taken
out, and a document that loses too large a part of its text is rejected. Beside it stand the whole text's counts of
words, signs, repeated lines and words in repeated windows, which reject a document for themselves.

Rules for a line (blank lines are never taken out):

* navigation: at least two separators (``|``, ``»``, ``·``, ``>``) between words, at most ``NAV_WORDS`` words, and no full stop;
* boilerplate: it matches one of ``BOILERPLATE``, and has at most ``BOILER_WORDS`` words;
* punctuation: over half its characters other than white space are no letters, digits or characters beyond ASCII, in a
  line with words, or it has signs of ``SYMBOLS`` in over a third of its words.

Defined results: a null text has no words or lines and is rejected; an empty table gives no rows; repeated rows each get
a row; a text counts whole, however long it is. (Windows are compared by 64-bit hashes within one text; two of 20,000
different windows collide with a chance of about 1e-11.) Columns of the input are kept; the added ones are ``MEASURES``
(columns of the input named as one of those, in any case of letters, give way, but for the text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

MIN_WORDS, MAX_REPEATED = 50, 0.5
#: Share of a text's characters in lines that must stay.
MIN_KEPT = 0.5
NAV_WORDS, BOILER_WORDS = 20, 25
SYMBOLS = "[#*$%&|<>]"
WHITE = r"[\x20\x09-\x0D]"
#: Lines of these forms, in any case of letters.
BOILERPLATE = r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies|sign up|log ?in to|subscribe (to|now)|click here|read more|share (this|on)|skip to (main )?content|licensed under|released under the|copyright (\(c\)|[0-9]{4}))"
#: Two separators; the pattern begins at a separator, so a line without one is passed over once.
NAVIGATION = r"[|>·»][^|>·»]*[|>·»]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "kept_share", "n_lines_removed", "kept"]


#: A text whose lines all pass has none of this: a line breaks a rule only with a sign or separator in it, with a
#: boilerplate phrase, or with more marks than other characters, of which then two are neighbours or one begins the line.
_MARK = r"[^A-Za-z0-9\x20\x09-\x0D\x80-\x{10FFFF}]"
SUSPECT = rf"[#*$%&|<>·»]|{_MARK}[\x20\x09\x0B-\x0D]*{_MARK}|(^|\n)[\x20\x09\x0B-\x0D]*{_MARK}"


def line_measures(line: Column) -> Column:
    """A line with what its rules look at, each worked out once."""
    words = F.size(F.array_remove(F.split(line, WHITE + "+"), ""))
    solid = F.length(F.regexp_replace(line, WHITE + "+", ""))
    marks = F.length(F.regexp_replace(line, r"[A-Za-z0-9\x20\x09-\x0D]+|[^\x00-\x7F]+", ""))
    signs = F.length(F.regexp_replace(line, r"[^#*$%&|<>]+", ""))
    return F.struct(line.alias("line"), words.alias("words"), solid.alias("solid"), marks.alias("marks"), signs.alias("signs"))


def line_fails(m: Column) -> Column:
    """Whether a line with these measures breaks a rule; the numbers are looked at before the patterns."""
    navigation = (m["words"] <= NAV_WORDS) & m["line"].rlike(NAVIGATION) & ~m["line"].rlike(r"[.!?]")
    boilerplate = (m["words"] <= BOILER_WORDS) & m["line"].rlike(BOILERPLATE)
    punctuation = (m["marks"] * 2 > m["solid"]) | (m["signs"] * 3 > m["words"])
    return (m["words"] > 0) & (punctuation | navigation | boilerplate)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of MEASURES."""
    return storage.apart(docs, MEASURES, _measured, _text=text)


def _measured(docs: DataFrame) -> DataFrame:
    own = docs.columns
    t = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(*own, t.alias("_q_t"))
    rows = rows.withColumn("_q_w", F.array_remove(F.split("_q_t", WHITE + "+"), "")).withColumn("_q_l", F.split("_q_t", "\n"))
    n = F.size("_q_w")
    gram = F.transform(F.slice("_q_w", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_q_w", i + 1), F.get("_q_w", i + 2)))
    rows = rows.withColumn("_q_h", gram)
    # windows as (hash, place), sorted, where any occurs twice: equal windows are neighbours
    h = F.col("_q_h")
    twice = F.size(F.array_distinct(h)) < F.size(h)
    rows = rows.withColumn("_q_g", F.when(twice, F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i")))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    g = F.col("_q_g")

    def like(x, j):
        return F.coalesce(F.get(g, j)["h"] == x["h"], F.lit(False))

    rows = rows.withColumn("_q_p", F.transform(F.filter(g, lambda x, i: like(x, i - 1) | like(x, i + 1)), lambda x: x["i"]))
    p = F.col("_q_p")
    covered = F.size(F.array_union(F.array_union(p, F.transform(p, lambda i: i + 1)), F.transform(p, lambda i: i + 2)))
    lines = F.filter("_q_l", lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("_q_lines", lines)
    judged = F.transform(F.filter(F.transform("_q_l", line_measures), lambda m: ~line_fails(m)), lambda m: m["line"])
    suspect = F.col("_q_t").rlike(SUSPECT) | F.col("_q_t").rlike(BOILERPLATE)
    rows = rows.withColumn("_q_kept", F.when(suspect, judged).otherwise(F.col("_q_l")))
    whole, left = F.length("_q_t"), F.length(F.array_join("_q_kept", "\n"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))
    share = F.when(whole > 0, left / whole).otherwise(0.0)
    rows = rows.select(
        *own, n.cast("long").alias("n_words"), F.length(F.regexp_replace("_q_t", WHITE + "+", "")).cast("long").alias("word_chars"), F.length(F.regexp_replace("_q_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        F.array_join("_q_kept", "\n").alias("cleaned"), share.alias("kept_share"), (F.size("_q_l") - F.size("_q_kept")).cast("long").alias("n_lines_removed"),
    )
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= MIN_KEPT)).select(*own, *MEASURES)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents with their cleaned texts."""
    return storage.beside(docs, [text], lambda d: measure(d, text).where("kept").withColumn(text, F.col("cleaned")))
