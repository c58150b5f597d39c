"""The queries opN_<name>: each operator over its whole table, with production parameters, and its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, licenses, linerules, pieces, pseudolm, runs, secrets, simhash, storage, warc, wavelet, whiten


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    storage.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.shared_dir(spark, "wavelet")
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return wavelet.read_documents(spark, path)


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linerules.measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", F.length("cleaned").cast("long").alias("cleaned_chars"))


def op3_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_segments")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.annotate(docs, table(spark, sf_dir, "benchmark"))
    listed = F.array_join("item_ids", ",")
    return marked.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, verify=True, keep_text=False)
    return coded.select("doc_id", "n_pieces", "ids_crc32", "round_trip", "piece_ids")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, where=~langid.held_out())
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op8_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def n(kind: str):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secret_spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"), n("random"))


def op9_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudolm.pseudo_likelihood(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_unseen", "pll", "pll_mean")


def op11_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_licence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    start = F.transform(F.filter("licence_spans", lambda s: s["base"]), lambda s: s["start"])
    return found.select(
        "doc_id", "n_words", F.size(start).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), F.col("licence_score").alias("score"),
    )


def periodic_tails(docs: DataFrame) -> DataFrame:
    """``docs`` in which every tenth text by the checksum h of its id repeats itself from word g % n on, g = h // 10, with a
    period of 1 + (words from there on) // (3 + g % 8); its words then stand a space apart. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.col("text"), linerules.WHITE + "+"), "")
    rows = docs.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10))).withColumn("_w", F.when(F.col("_g").isNotNull() & F.col("text").isNotNull(), words))
    n = F.size("_w")
    rows = rows.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    moved = F.transform("_w", lambda w, i: F.when(i >= F.col("_a"), F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))).otherwise(w))
    return rows.withColumn("text", F.when(F.col("_a").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text"))).drop("_g", "_w", "_a", "_p")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.s").alias("start"), (-F.col("_b.l")).alias("length"), F.col("_b.p").alias("period"),
        F.floor(-1000 * F.col("_b.l") / F.col("_b.p")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), g AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1
), covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id
), lines AS (
  SELECT doc_id, k, s, len(list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
    length(regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g')) AS solid,
    length(regexp_replace(s, '[A-Za-z0-9\x20\x09-\x0D]+|[^\x00-\x7F]+', '', 'g')) AS marks,
    length(regexp_replace(s, '[^#*$%&|<>]+', '', 'g')) AS signs
  FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS s FROM d)
), judged AS (
  SELECT doc_id, k, s, words > 0 AND ((regexp_matches(s, '{linerules.NAVIGATION}') AND NOT regexp_matches(s, '[.!?]') AND words <= {linerules.NAV_WORDS})
    OR (regexp_matches(s, '{linerules.BOILERPLATE}') AND words <= {linerules.BOILER_WORDS}) OR marks * 2 > solid OR signs * 3 > words) AS fails FROM lines
), cleaned AS (
  SELECT doc_id, CAST(count(*) FILTER (fails) AS BIGINT) AS n_lines_removed, coalesce(length(string_agg(s, chr(10) ORDER BY k) FILTER (NOT fails)), 0) AS chars FROM judged GROUP BY doc_id
), base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_concat(w, ['']), 'string_agg', '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS whole, n_lines_removed, CAST(chars AS BIGINT) AS cleaned_chars
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN cleaned USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND CASE WHEN whole > 0 THEN cleaned_chars / whole ELSE 0 END >= {linerules.MIN_KEPT} AS kept,
  n_lines_removed, cleaned_chars
FROM base
"""

OP3_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), c AS (SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY place) AS l FROM t GROUP BY conv_id
), k AS (SELECT min(conv_id) AS conv_id, l, count(*) AS n_equal FROM c GROUP BY l
), p AS (SELECT DISTINCT list_slice(l, 1, i) AS l FROM (SELECT l, unnest(range(1, len(l))) AS i FROM c))
SELECT k.conv_id, CAST(len(k.l) AS INTEGER) AS n_turns, CAST(n_equal AS BIGINT) AS n_equal,
  list_aggregate(list_transform(k.l, lambda s: '<|im_start|>' || s.r || chr(10) || s.x || '<|im_end|>' || chr(10)), 'string_agg', '') AS text
FROM k ANTI JOIN p ON k.l = p.l
"""

OP4_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to,
  CAST(CASE WHEN (payload_bytes >= 1000 AND page_id < last) OR block <= {warc.SEGMENT_BYTES} THEN 1 ELSE (block + {warc.SEGMENT_BYTES - 1}) // {warc.SEGMENT_BYTES} END AS INTEGER) AS n_segments
FROM (SELECT *, 87 + payload_bytes + 5 + {len(f"{warc.CHUNK_BYTES:x}") + 4} * (payload_bytes // {warc.CHUNK_BYTES})
  + CASE WHEN payload_bytes % {warc.CHUNK_BYTES} > 0 THEN length(format('{{:x}}', payload_bytes % {warc.CHUNK_BYTES})) + 4 ELSE 0 END AS block FROM f)
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS width, list_slice(w, i, i + 9) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), widths AS (SELECT DISTINCT width FROM win
), spots AS (
  SELECT doc_id, width, i, list_slice(w, i, i + width - 1) AS g
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, widths WHERE len(w) >= width)
), hits AS (SELECT spots.doc_id, spots.i, spots.width, win.item_id FROM spots JOIN win USING (width, g)
), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op12_sql() -> str:
    """The licence index in SQL: postings are joined to word places, votes are counted, phrases and words in place verified."""

    def text(x: str) -> str:
        return f"'{x}'"

    known = licenses.templates()
    words = ", ".join(f"({t}, {q}, {text(w)})" for t, x in enumerate(known) for q, w in enumerate(x.words))
    phrases = ", ".join(f"({t}, {k}, {q}, {len(p)}, {text(' '.join(p))})" for t, x in enumerate(known) for k, (q, p) in enumerate(x.phrases))
    heads = ", ".join(f"({t}, {text(x.label)}, {x.base}, {x.shift}, {len(x.words)}, {len(x.phrases)})" for t, x in enumerate(known))
    return rf"""
WITH tw(t, q, word) AS (VALUES {words}), ph(t, k, q, size, phrase) AS (VALUES {phrases}), te(t, label, base, shift, size, n_phrases) AS (VALUES {heads}
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.WORD}') AS w FROM documents
), places AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d
), ranks AS (
  SELECT word, row_number() OVER (ORDER BY coalesce(n, 0), word) AS k
  FROM (SELECT DISTINCT word FROM tw) LEFT JOIN (SELECT word, count(DISTINCT r) AS n FROM places GROUP BY word) USING (word)
), posted AS (
  SELECT t, word, k, base FROM (SELECT t, word, k, base, row_number() OVER (PARTITION BY t ORDER BY k) AS p FROM (SELECT DISTINCT t, word FROM tw) JOIN ranks USING (word) JOIN te USING (t))
  WHERE p <= CASE WHEN base THEN 1 ELSE {licenses.INDEXED} END
), need AS (SELECT t, least({licenses.MIN_VOTES}, count(*)) AS n FROM posted GROUP BY t
), held AS (
  SELECT r, word, row_number() OVER (PARTITION BY r, t ORDER BY k) AS p FROM (SELECT DISTINCT r, word FROM places) JOIN posted USING (word)
), looked AS (SELECT DISTINCT r, word FROM held WHERE p <= {licenses.LOOKED_UP}
), votes AS (
  SELECT r, t, i - q AS o, count(*) AS n FROM looked JOIN places USING (r, word) JOIN (SELECT t, word, q FROM posted JOIN tw USING (t, word)) USING (word) GROUP BY r, t, o
), met AS (SELECT r, t, o FROM votes JOIN need USING (t) WHERE votes.n >= need.n
), stood AS (
  SELECT r, t, o, k FROM met JOIN te USING (t) JOIN ph USING (t) JOIN d USING (r), (SELECT unnest(range(-{licenses.SHIFT}, {licenses.SHIFT} + 1)) AS off) s
  WHERE abs(off) <= shift AND o + q + off >= 0 AND array_to_string(list_slice(w, o + q + off + 1, o + q + off + ph.size), ' ') = phrase
), verified AS (SELECT r, t, o FROM stood JOIN te USING (t) GROUP BY r, t, o, n_phrases HAVING count(DISTINCT k) = n_phrases
), spans AS (
  SELECT r, t, o, label, base, CASE WHEN base THEN {licenses.PHRASE_SCORE} ELSE count(*) FILTER (o + tw.q >= 0 AND list_extract(w, o + tw.q + 1) = tw.word) / any_value(te.size)::DOUBLE END AS score
  FROM verified JOIN te USING (t) JOIN tw USING (t) JOIN d USING (r) GROUP BY r, t, o, label, base
), found AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(o) FILTER (base) AS first_word, max(o) FILTER (base) AS last_word, max(score) AS score,
    list_sort(list_distinct(list(label) FILTER (base))) AS bases, list_sort(list_distinct(list(label))) AS labels FROM spans GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(bases, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN found USING (r)
"""


QUERIES = {"op1_wavelet_tokens": op1_wavelet_tokens, "op2_line_rules": op2_line_rules, "op3_chat_collapse": op3_chat_collapse, "op4_warc_segments": op4_warc_segments, "op5_decontaminate": op5_decontaminate, "op6_piece_viterbi": op6_piece_viterbi, "op7_language_id": op7_language_id, "op8_secret_battery": op8_secret_battery, "op9_simhash_ball": op9_simhash_ball, "op10_pseudo_likelihood": op10_pseudo_likelihood, "op11_whitened": op11_whitened, "op12_licence_index": op12_licence_index, "op13_periodic_runs": op13_periodic_runs}
ORACLE_SQL: dict[str, str] = {"op2_line_rules": OP2_SQL, "op3_chat_collapse": OP3_SQL, "op4_warc_segments": OP4_SQL, "op5_decontaminate": OP5_SQL, "op12_licence_index": _op12_sql()}
