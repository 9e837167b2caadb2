"""One query for each operator over its whole table, with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, fill_middle, filter_audit, html_extract, language_id, line_dedup, ngram_join, pieces, token_counts, token_output, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.parse_warc(warc.crawl_of(table(spark, sf_dir, "pages"))))
    return found.select("record_id", "url", "canonical_url", "date", "response_id", "state", F.to_json("headers").alias("headers"), "digest")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = line_dedup.line_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Texts that hold the template's own control strings, beside the table's conversations.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    log = chat.log_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    return chat.chat_digests(chat.format_chats(log))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = fill_middle.restore_middles(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""

LINES_SQL = r"""
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {source}),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, h.last_doc IS NOT NULL AND h.last_doc <> k.doc_id AS gone FROM keyed k LEFT JOIN hot h USING (key))
"""

OP10_SQL = (
    "WITH "
    + LINES_SQL.format(source="documents")
    + r"""
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
)


SHINGLES_SQL = r"""
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM words))
"""

#: All items of the benchmark have five words or more.
OP2_SQL = (
    "WITH "
    + SHINGLES_SQL
    + r""",
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
item_grams AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT item_id, w, unnest(range(0, len(w) - 4)) AS i FROM item_words)),
sizes AS (SELECT item_id, count(*) AS n FROM item_grams GROUP BY item_id)
SELECT d.doc_id, i.item_id, count(*) AS n_shared, any_value(s.n) AS n_shingles
FROM grams d JOIN item_grams i USING (g) JOIN sizes s USING (item_id) GROUP BY d.doc_id, i.item_id HAVING 100 * count(*) >= 80 * any_value(s.n)
"""
)

OP9_SQL = (
    "WITH RECURSIVE "
    + SHINGLES_SQL
    + r""",
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.b)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""
)


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS lowest FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > lowest, false)::INT AS mask
  FROM d LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
perms AS (
  SELECT '' AS o UNION ALL
  SELECT o || f FROM perms, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)),
steps AS (
  SELECT o AS filter_order, s AS step, 1 << (ascii(o[s]) - 65) AS bit,
         list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(o[i]) - 65)))::BIGINT AS prior
  FROM perms, (SELECT unnest(range(1, 6)) AS s) WHERE length(o) = 5),
counted AS (
  SELECT part, filter_order, step, bit,
         sum(n) FILTER (mask & (bit | coalesce(prior, 0)) = 0) AS kept,
         sum(n) FILTER (mask & bit > 0 AND mask & coalesce(prior, 0) = 0) AS removed,
         sum(n) FILTER (mask & bit > 0 AND mask & coalesce(prior, 0) > 0) AS redundant,
         sum(n) FILTER (mask = bit) AS unique_fails,
         sum(good) FILTER (mask & bit > 0 AND mask & coalesce(prior, 0) = 0) AS good_lost,
         sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(prior, 0) = 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM counted
"""

OP12_SQL = r"""
WITH c AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'))
         + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) + 14 AS printed FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(printed)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP13_SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || x[1:8])::UBIGINT::BIGINT AS h1, ('0x' || x[9:16])::UBIGINT::BIGINT AS h2,
         ('0x' || x[17:24])::UBIGINT::BIGINT AS h3, ('0x' || x[25:32])::UBIGINT::BIGINT AS h4 FROM h),
f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (SELECT *, substring(t, 1, lo) AS p, substring(t, lo + 1, hi - lo) AS m, substring(t, hi + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o
"""


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_token_output": op3_token_output,
        "op4_language_id": op4_language_id,
        "op5_token_counts": op5_token_counts,
        "op6_sampled_pieces": op6_sampled_pieces,
        "op7_warc_revisits": op7_warc_revisits,
        "op8_html_text": op8_html_text,
        "op9_ngram_join": op9_ngram_join,
        "op10_line_dedup": op10_line_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_chat_format": op12_chat_format,
        "op13_fill_middle": op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_decontamination": OP2_SQL, "op9_ngram_join": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_chat_format": OP12_SQL, "op13_fill_middle": OP13_SQL}
