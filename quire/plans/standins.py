"""Tables of the engine's own shape, computed from the plain tables by formulas that SQL has too.

blocks: book = source, page = doc_id, ord = line number. flow: a document's words wrapped anew at 8 words a line and 30
lines a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS, LINES = 8, 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, pos, line, n_lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", "\n", -1).alias("ls"))
    return docs.select("doc_id", "source", F.size("ls").alias("n_lines"), F.posexplode("ls").alias("pos", "line"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("text", F.btrim("line")).where("text <> ''")
    size = F.char_length("text")
    category = (
        F.when((F.col("pos") == 0) & (size < 80), "Section-header")
        .when((F.col("pos") == 1) & (size < 80), "Title")
        .when((F.col("pos") == F.col("n_lines") - 1) & (size < 80), "Page-footer")
        .when((F.col("doc_id") % 11 == 0) & (F.col("pos") % 9 == 5), "Footnote")
        .when(F.col("pos") % 13 == 7, "List-item")
        .otherwise("Text")
    )
    y1 = (F.col("pos") * 40).cast("double")
    return rows.select(
        F.col("source").alias("book"), F.col("doc_id").alias("page"), F.col("pos").alias("ord"), category.alias("category"), "text", (100 + size * 7 % 50).cast("double").alias("x1"), y1.alias("y1"),
        (900 - size * 13 % 90).cast("double").alias("x2"), (y1 + 12 + size % 20).cast("double").alias("y2"), F.lit(1000.0).alias("page_width"), (F.col("n_lines") * 40).cast("double").alias("page_height"),
    )


BLOCKS = r"""
line_rows AS (
  SELECT doc_id, source, len(string_split(text, chr(10))) AS n_lines, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
block_rows AS (SELECT *, trim(line) AS t FROM line_rows WHERE trim(line) <> ''),
blocks AS (
  SELECT source AS book, doc_id AS page, pos AS ord,
    CASE WHEN pos = 0 AND length(t) < 80 THEN 'Section-header' WHEN pos = 1 AND length(t) < 80 THEN 'Title'
         WHEN pos = n_lines - 1 AND length(t) < 80 THEN 'Page-footer' WHEN doc_id % 11 = 0 AND pos % 9 = 5 THEN 'Footnote'
         WHEN pos % 13 = 7 THEN 'List-item' ELSE 'Text' END AS category,
    t AS text, (100 + length(t) * 7 % 50)::DOUBLE AS x1, (pos * 40)::DOUBLE AS y1, (900 - length(t) * 13 % 90)::DOUBLE AS x2,
    (pos * 40 + 12 + length(t) % 20)::DOUBLE AS y2, 1000.0::DOUBLE AS page_width, (n_lines * 40)::DOUBLE AS page_height
  FROM block_rows)
"""
#: Type size of a single-line block, as the functions have it.
SIZED = r"""
sized AS (
  SELECT *, CASE WHEN length(text) > 90 THEN (y2 - y1) / greatest(1, floor((y2 - y1) / 40 + 0.5)) ELSE y2 - y1 END AS px,
         upper(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z0-9]', '', 'g'), '[0-9]+', '#', 'g')) AS key FROM blocks)
"""


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book (doc_id as text), page, ord, category, text, align of the re-wrapped words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", r"[ \t\n]+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    count = F.ceil(F.size("w") / WORDS).cast("int")
    wrapped = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice("w", i * WORDS + 1, WORDS), " "))
    rows = docs.select("doc_id", F.posexplode(wrapped).alias("line", "text"))
    category = F.when(F.col("line") % 37 == 5, "Footnote").when(F.col("line") % 41 == 11, "Section-header").otherwise("Text")
    return rows.select(F.col("doc_id").cast("string").alias("book"), F.floor(F.col("line") / LINES).cast("int").alias("page"), F.col("line").alias("ord"), category.alias("category"), "text", F.lit("").alias("align"))


FLOW = rf"""
flow_words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n]+'), lambda w: w <> '') AS w FROM documents),
flow_lines AS (SELECT doc_id, w, unnest(range(0, ((len(w) + {WORDS - 1}) // {WORDS})::BIGINT)) AS line FROM flow_words WHERE len(w) > 0),
flow AS (
  SELECT doc_id::VARCHAR AS book, line // {LINES} AS page, line AS ord,
         CASE WHEN line % 37 = 5 THEN 'Footnote' WHEN line % 41 = 11 THEN 'Section-header' ELSE 'Text' END AS category,
         array_to_string(w[line * {WORDS} + 1 : line * {WORDS} + {WORDS}], ' ') AS text FROM flow_lines)
"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as page answers: book = event type, seq = event_id, page, tokens, finish_reason, text."""
    e = table(spark, sf_dir, "events")
    tokens = F.floor(F.col("value") * 100).cast("long") % 5000
    return e.select(F.col("event_type").alias("book"), F.col("event_id").alias("seq"), (F.col("event_id") % 97).alias("page"), tokens.alias("tokens"), F.when(F.col("event_id") % 23 == 0, "length").alias("finish_reason"), F.when(F.col("event_id") % 29 == 0, "").otherwise("x").alias("text"))


ANSWERS = r"""
answers AS (
  SELECT event_type AS book, event_id AS seq, event_id % 97 AS page, floor(value * 100)::BIGINT % 5000 AS tokens,
         CASE WHEN event_id % 23 = 0 THEN 'length' END AS finish_reason, CASE WHEN event_id % 29 = 0 THEN '' ELSE 'x' END AS text FROM events)
"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as step trees: project = conv_id, id = turn, parent = the turn before or the one before that."""
    c = table(spark, sf_dir, "conversations")
    low = F.min("turn").over(Window.partitionBy("conv_id"))
    t = c.select(F.col("conv_id").alias("project"), "turn", "role", "text", low.alias("low")).dropDuplicates(["project", "turn"])
    back = F.when((F.col("turn") % 3 == 2) & (F.col("turn") - 2 >= F.col("low")), F.col("turn") - 2).otherwise(F.col("turn") - 1)
    return t.select("project", F.col("turn").alias("id"), F.when(F.col("turn") > F.col("low"), back).alias("parent"), F.col("role").alias("action"), F.col("turn").alias("created"))


STEPS = r"""
turns AS (SELECT DISTINCT conv_id AS project, turn, role, min(turn) OVER (PARTITION BY conv_id) AS low FROM conversations),
steps AS (
  SELECT project, turn AS id, CASE WHEN turn > low THEN CASE WHEN turn % 3 = 2 AND turn - 2 >= low THEN turn - 2 ELSE turn - 1 END END AS parent,
         role AS action, turn AS created FROM turns)
"""


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an edit log over orders: one op for each event on the order that the event's user has in turn."""
    e = table(spark, sf_dir, "events")
    verbs = F.array(*[F.lit(v) for v in ("strike", "restore", "text", "category", "restore-furniture", "text")])
    return e.select(F.concat(F.lit("b"), (F.col("user_id") % 50).cast("string")).alias("book"), F.col("event_id").alias("seq"), F.element_at(verbs, (F.col("event_id") % 6 + 1).cast("int")).alias("op"), (F.col("event_id") * 7 % 40).cast("string").alias("id"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"), F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string")).alias("category"))


def op_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.range(50).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("book"), F.explode(F.sequence(F.lit(0), F.lit(34))).alias("i"))
    return n.select("book", F.col("i").alias("pos"), F.col("i").cast("string").alias("id"), F.concat(F.lit("row "), F.col("i").cast("string")).alias("text"), F.lit("Text").alias("category"), F.when(F.col("i") % 6 == 0, "head").alias("shelf"))


OPS = r"""
ops AS (
  SELECT 'b' || (user_id % 50) AS book, event_id AS seq, (['strike','restore','text','category','restore-furniture','text'])[event_id % 6 + 1] AS op,
         (event_id * 7 % 40)::VARCHAR AS id, 't' || event_id AS text, 'c' || (event_id % 5) AS category FROM events),
op_rows AS (
  SELECT 'b' || b AS book, i AS pos, i::VARCHAR AS id, 'row ' || i AS text, 'Text' AS category, CASE WHEN i % 6 = 0 THEN 'head' END AS shelf
  FROM range(50) r(b), range(35) s(i))
"""
