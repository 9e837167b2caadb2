"""Queries of the row, layer, reference, ledger and bank operators, each beside the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import explode, layer, ledger, prose, refs, rows
from ..operators import flow as flow_ops
from ..operators.scratch import folder
from ..sources import banks
from . import standins as S
from .catalog import BLANKS, TREE, query

SPANS = rf"""
{S.BLOCKS}, spans AS (SELECT book, page, x1 + k * (x2 - x1) / 4 AS x, y1 + 5 * k AS y, (8 + (ord + k) % 5)::DOUBLE AS size, (1 + (length(text) + k) % 7)::BIGINT AS chars FROM blocks, (SELECT unnest([0, 1, 2]) AS k))
"""


def _spans(spark, d):
    b = S.blocks(spark, d).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return b.select("book", "page", (F.col("x1") + F.col("k") * (F.col("x2") - F.col("x1")) / 4).alias("x"), (F.col("y1") + 5 * F.col("k")).alias("y"), (8 + (F.col("ord") + F.col("k")) % 5).cast("double").alias("size"), (1 + (F.char_length("text") + F.col("k")) % 7).cast("long").alias("chars"))


@query("dehyphenated_blocks", rf"""
WITH {S.BLOCKS}, b AS (SELECT book, page, ord, regexp_replace(text, '([a-z]{{4}})([a-z]{{3}})', '\1-' || chr(10) || '\2', 'g') AS t FROM blocks),
lex AS (SELECT DISTINCT book, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+(?:-[a-zà-ÿ]+)*')) AS word FROM blocks),
m AS (SELECT *, regexp_extract_all(t, '([A-Za-zÀ-ÿ]+)-\n([A-Za-zÀ-ÿ]+)', 1) AS ss, regexp_extract_all(t, '([A-Za-zÀ-ÿ]+)-\n([A-Za-zÀ-ÿ]+)', 2) AS ws, regexp_split_to_array(t, '([A-Za-zÀ-ÿ]+)-\n([A-Za-zÀ-ÿ]+)') AS rs FROM b),
e AS (SELECT book, page, ord, rs, unnest(range(1, len(rs) + 1)) AS n, ss, ws FROM m), x AS (SELECT book, page, ord, n, rs[n] AS rest, ss[n] AS stem, ws[n] AS word FROM e),
j AS (SELECT x.*, CASE WHEN stem IS NULL THEN '' WHEN a.word IS NOT NULL OR (c.word IS NULL AND lower(x.word[1]) = x.word[1]) THEN stem || x.word ELSE stem || '-' || x.word END AS healed
  FROM x LEFT JOIN lex a ON a.book = x.book AND a.word = lower(stem || x.word) LEFT JOIN lex c ON c.book = x.book AND c.word = lower(stem || '-' || x.word))
SELECT book, page, ord::INT AS ord, sha256(string_agg(rest || healed, '' ORDER BY n)) AS h FROM j GROUP BY book, page, ord""")
def dehyphenated_blocks(spark, d):
    from ..operators.blocks import compound_words, lexicon

    b = S.blocks(spark, d)
    broken = b.withColumn("text", F.regexp_replace("text", "([a-z]{4})([a-z]{3})", "$1-\n$2"))
    return flow_ops.dehyphenated(broken.select("book", "page", "ord", "text"), lexicon(b), compounds=compound_words(b)).select("book", "page", "ord", F.sha2("text", 256).alias("h"))


@query("layer_sizes", f"""
WITH {SPANS}, hits AS (SELECT b.book, b.page, b.ord, s.size, sum(s.chars) AS chars FROM blocks b JOIN spans s ON b.book = s.book AND b.page = s.page AND s.x BETWEEN b.x1 - 2 AND b.x2 + 2 AND s.y BETWEEN b.y1 - 2 AND b.y2 + 2 GROUP BY ALL),
w AS (SELECT *, sum(chars) OVER (PARTITION BY book, page, ord ORDER BY size) AS seen, sum(chars) OVER (PARTITION BY book, page, ord) AS total FROM hits)
SELECT book, page, ord::INT AS ord, min(size) AS truth_pt FROM w WHERE seen * 2 >= total GROUP BY book, page, ord""")
def layer_sizes(spark, d):
    return layer.layer_sizes(_spans(spark, d), S.blocks(spark, d))


PLANNED = rf"""
{S.BLOCKS}, planned AS (SELECT book, category AS cls, y2 - y1 AS lead_pt, CASE WHEN ord % 3 = 0 THEN (9 + ord % 4)::DOUBLE END AS truth_pt, ord % 2 = 0 AS trusted FROM blocks)
"""


def _planned(spark, d):
    o = F.col("ord")
    return S.blocks(spark, d).select("book", F.col("category").alias("cls"), (F.col("y2") - F.col("y1")).alias("lead_pt"), F.when(o % 3 == 0, (9 + o % 4).cast("double")).alias("truth_pt"), (o % 2 == 0).alias("trusted"))


@query("class_sizes", f"""
WITH {PLANNED} SELECT book, cls, round(greatest(0.5, CASE WHEN count(truth_pt) >= 8 THEN median(truth_pt) ELSE median(lead_pt) / 1.2 END), 6) AS size_pt FROM planned GROUP BY book, cls HAVING count(*) >= 8""")
def class_sizes(spark, d):
    return layer.class_sizes(_planned(spark, d)).withColumn("size_pt", F.round("size_pt", 6))


@query("layer_verdicts", f"""
WITH {PLANNED}, m AS (SELECT book, cls, count(truth_pt) AS t, count(*) FILTER (trusted) AS l, median(truth_pt) AS layer_pt, median(lead_pt) FILTER (trusted) / 1.2 AS lead_pt FROM planned GROUP BY book, cls)
SELECT book, cls, round(layer_pt, 6) AS layer_pt, round(lead_pt, 6) AS lead_pt FROM m WHERE t >= 8 AND l >= 8 AND abs(layer_pt / lead_pt - 1) > 0.3""")
def layer_verdicts(spark, d):
    return layer.layer_verdicts(_planned(spark, d)).select("book", "cls", F.round("layer_pt", 6).alias("layer_pt"), F.round("lead_pt", 6).alias("lead_pt"))


@query("char_width", f"WITH {S.BLOCKS} SELECT book, round(median((x2 - x1) / (length(text) * (y2 - y1))), 9) AS em FROM blocks WHERE length(text) >= 20 AND y2 > y1 GROUP BY book")
def char_width(spark, d):
    b = S.blocks(spark, d).select("book", (F.col("x2") - F.col("x1")).alias("width"), F.char_length("text").alias("chars"), (F.col("y2") - F.col("y1")).alias("size"))
    return layer.char_width(b).withColumn("em", F.round("em", 9))


@query("substitutions", r"""
WITH c AS (SELECT source AS book, doc_id AS page, unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS char FROM documents) SELECT book, char, count(*) AS n, count(DISTINCT page) AS pages FROM c GROUP BY book, char""")
def substitutions(spark, d):
    return layer.substitutions(S.table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text"), r"\x00-\x7F")


@query("substitution_verdicts", r"""
WITH c AS (SELECT source AS book, len(regexp_extract_all(text, '[^\x00-\x7F]')) AS n, length(text) AS chars FROM documents) SELECT book, sum(n)::BIGINT AS n, sum(chars)::BIGINT AS chars, sum(n) > greatest(10, sum(chars) / 1000) AS refused FROM c GROUP BY book""")
def substitution_verdicts(spark, d):
    return layer.substitution_verdicts(S.table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text"), r"\x00-\x7F")


@query("raised_notes", rf"""
WITH {S.BLOCKS}, b AS (SELECT book, page, ord, category, CASE WHEN category = 'Footnote' THEN (ord % 5 + 1) || '. note' WHEN ord % 4 = 0 THEN text || translate((page % 5 + 1)::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') ELSE text END AS text FROM blocks),
m AS (SELECT DISTINCT book, page, translate(unnest(regexp_extract_all(text, '[⁰¹²³⁴⁵⁶⁷⁸⁹]+')), '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789') AS printed FROM b WHERE category NOT IN ('Picture', 'Footnote'))
SELECT book, page, ord::INT AS ord, (ord % 5 + 1)::INT AS printed FROM b WHERE category = 'Footnote' AND EXISTS (SELECT 1 FROM m WHERE m.book = b.book AND m.page = b.page AND m.printed = (b.ord % 5 + 1)::VARCHAR)""")
def raised_notes(spark, d):
    o, mark = F.col("ord"), F.translate((F.col("page") % 5 + 1).cast("string"), X.DIGITS, X.SUPERSCRIPTS)
    text = F.when(F.col("category") == "Footnote", F.concat((o % 5 + 1).cast("string"), F.lit(". note"))).when(o % 4 == 0, F.concat("text", mark)).otherwise(F.col("text"))
    return layer.raised_notes(S.blocks(spark, d).withColumn("text", text))


@query("frame_mismatch", f"WITH {S.BLOCKS} SELECT book, round(max(x2 / 850), 6) AS x_share, round(max(y2 / page_height), 6) AS y_share FROM blocks GROUP BY book HAVING max(x2 / 850) > 1.02 OR max(y2 / page_height) > 1.02")
def frame_mismatch(spark, d):
    b = S.blocks(spark, d).select("book", "x2", "y2", F.lit(850.0).alias("width"), F.col("page_height").alias("height"))
    return layer.frame_mismatch(b).select("book", F.round("x_share", 6).alias("x_share"), F.round("y_share", 6).alias("y_share"))


PARAGRAPHS = f"""
{S.FLOW}, f AS (SELECT *, category = 'Text' AS ok, lag(page) OVER w AS pp, lag(text) OVER w AS pt, lag(category = 'Text') OVER w AS pok FROM flow WHERE category <> 'Footnote' WINDOW w AS (PARTITION BY book ORDER BY page, ord)),
j AS (SELECT *, coalesce(ok AND pok AND page - pp IN (0, 1) AND right(rtrim(pt), 1) NOT IN ('.', '!', '?', ':', '"', '”') AND upper(substring(text, 1, 1)) <> substring(text, 1, 1), false) AS joins FROM f),
parts AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY page, ord)::BIGINT AS para, (100 + length(text) % 50)::DOUBLE AS x1, (ord % 30 * 20)::DOUBLE AS y1, (900 - length(text) % 90)::DOUBLE AS x2, (ord % 30 * 20 + 12 + length(text) % 8)::DOUBLE AS y2 FROM j)
"""


@query("paragraph_boxes", f"""
WITH {PARAGRAPHS} SELECT book, para, min(page)::INT AS page, list_sort(list(DISTINCT page::INT)) AS pages, count(*) AS n, min(x1) AS x1, arg_min(y1, (page, ord)) AS y1, max(x2) AS x2, arg_min(y1, (page, ord)) + sum(y2 - y1) AS y2 FROM parts GROUP BY book, para""")
def paragraph_boxes(spark, d):
    n = F.char_length("text")
    top = (F.col("ord") % 30 * 20).cast("double")
    parts = flow_ops.paragraph_starts(S.flow(spark, d)).withColumn("x1", (100 + n % 50).cast("double")).withColumn("y1", top).withColumn("x2", (900 - n % 90).cast("double")).withColumn("y2", top + 12 + n % 8)
    return rows.paragraph_boxes(parts)


NOTES = "notes AS (SELECT 'b' || (l_orderkey % 100) AS book, l_orderkey // 100 AS page, 0 AS ord, l_linenumber AS note, max(l_partkey) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def _notes(spark, d):
    li = S.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("k"))
    return li.select(F.concat(F.lit("b"), (F.col("l_orderkey") % 100).cast("string")).alias("book"), F.floor(F.col("l_orderkey") / 100).alias("page"), F.lit(0).alias("ord"), F.col("l_linenumber").alias("note"), "k")


@query("note_boxes", f"""
WITH {NOTES}, w AS (SELECT *, greatest(1, k % 40) AS weight, 100.0::DOUBLE AS y1, (100 + page % 300 + 20)::DOUBLE AS y2 FROM notes),
s AS (SELECT *, sum(weight) OVER (PARTITION BY book, page ORDER BY note) AS upto, sum(weight) OVER (PARTITION BY book, page) AS total FROM w)
SELECT book, page, ord, note, round(y1 + (upto - weight) / total * (y2 - y1), 6) AS top, round(y1 + upto / total * (y2 - y1), 6) AS foot FROM s""")
def note_boxes(spark, d):
    n = _notes(spark, d).withColumn("text", F.repeat(F.lit("x"), (F.col("k") % 40).cast("int"))).withColumn("y1", F.lit(100.0)).withColumn("y2", (F.col("page") % 300 + 120).cast("double"))
    return rows.note_boxes(n).select("book", "page", "ord", "note", F.round("top", 6).alias("top"), F.round("foot", 6).alias("foot"))


@query("element_ids", f"WITH {NOTES} SELECT book, page, note AS pos, row_number() OVER (PARTITION BY book, page ORDER BY note)::INT AS n, 'p-' || page || '-' || row_number() OVER (PARTITION BY book, page ORDER BY note) AS element_id FROM notes")
def element_ids(spark, d):
    return rows.element_ids(_notes(spark, d).select("book", "page", F.col("note").alias("pos")))


@query("note_sequence", f"WITH {NOTES} SELECT book, page, ord, note, row_number() OVER (PARTITION BY book ORDER BY page, note) AS seq FROM notes")
def note_sequence(spark, d):
    return rows.note_sequence(_notes(spark, d)).select("book", "page", "ord", "note", F.col("seq").cast("long").alias("seq"))


@query("nav_parents", r"""
WITH c AS (SELECT source AS book, doc_id AS pos, CASE WHEN doc_id % 7 = 0 THEN 'part' WHEN doc_id % 3 = 0 THEN 'chapter' END AS kind, CASE WHEN doc_id % 10 = 9 THEN 'Notes on ' ELSE 'Chapter ' END || doc_id AS label FROM documents),
p AS (SELECT *, last_value(CASE WHEN kind = 'part' THEN pos END IGNORE NULLS) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM c),
b AS (SELECT *, max(CASE WHEN kind IS DISTINCT FROM 'part' AND label LIKE 'Notes%' THEN 1 ELSE 0 END) OVER (PARTITION BY book, part ORDER BY pos) AS back FROM p)
SELECT book, pos, kind, label, CASE WHEN kind IS DISTINCT FROM 'part' AND back = 0 THEN part END AS parent FROM b""")
def nav_parents(spark, d):
    k = F.col("doc_id")
    c = S.table(spark, d, "documents").select(F.col("source").alias("book"), k.alias("pos"), F.when(k % 7 == 0, "part").when(k % 3 == 0, "chapter").alias("kind"), F.concat(F.when(k % 10 == 9, "Notes on ").otherwise("Chapter "), k.cast("string")).alias("label"))
    return rows.nav_parents(c)


@query("opening_headings", f"""
WITH {S.BLOCKS}, r AS (SELECT book, page // 3 AS section, page * 100000 + ord AS pos, page, category, CASE page // 3 % 3 WHEN 0 THEN 'chapter' WHEN 1 THEN 'part' END AS kind FROM blocks),
f AS (SELECT book, section, arg_min(page, pos) AS first_page, min(pos) FILTER (category NOT IN ('Title', 'Section-header')) AS body FROM r GROUP BY book, section),
t AS (SELECT r.book, r.section, min(pos) AS turn FROM r JOIN f ON r.book = f.book AND r.section = f.section AND r.page <> f.first_page GROUP BY r.book, r.section)
SELECT r.* FROM r JOIN f ON r.book = f.book AND r.section = f.section LEFT JOIN t ON r.book = t.book AND r.section = t.section
WHERE category IN ('Title', 'Section-header') AND kind IS NOT NULL AND (turn IS NULL OR pos < turn) AND (kind = 'part' OR body IS NULL OR pos < body)""")
def opening_headings(spark, d):
    s = F.floor(F.col("page") / 3)
    return rows.opening_headings(S.blocks(spark, d).select("book", s.alias("section"), (F.col("page") * 100_000 + F.col("ord")).alias("pos"), "page", "category", F.when(s % 3 == 0, "chapter").when(s % 3 == 1, "part").alias("kind")))


#: Rows of books, from orders: 50 books, two thirds of the rows of each in the flow and three quarters held.
ROWS = r"""
r AS (SELECT 'b' || (o_orderkey % 50) AS book, o_orderkey // 50 AS pos, o_orderkey::VARCHAR AS id, o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'head' END AS shelf, o_orderkey % 4 <> 1 AS held,
  CASE WHEN o_orderkey // 50 % 7 = 3 THEN 'Footnote' WHEN o_orderkey // 50 % 7 = 5 THEN 'Title' ELSE 'Text' END AS category FROM orders)
"""


def _rows(spark, d):
    k = F.col("o_orderkey")
    pos = F.floor(k / 50)
    return S.table(spark, d, "orders").select(F.concat(F.lit("b"), (k % 50).cast("string")).alias("book"), pos.alias("pos"), k.cast("string").alias("id"), k.alias("k"), F.when(k % 6 == 0, "head").alias("shelf"), (k % 4 != 1).alias("held"), F.when(pos % 7 == 3, "Footnote").when(pos % 7 == 5, "Title").otherwise("Text").alias("category"))


@query("drawable_chapters", f"WITH {ROWS} SELECT book, pos, id, 'T' || k AS title FROM r WHERE k % 5 = 1 AND shelf IS NULL")
def drawable_chapters(spark, d):
    r = _rows(spark, d)
    return rows.drawable_chapters(r.where("k % 5 = 1").select("book", "id", F.concat(F.lit("T"), "id").alias("title")), r)


@query("rehung_chapters", f"""
WITH {ROWS}, n AS (SELECT *, min(CASE WHEN held THEN pos END) OVER w AS h, min(CASE WHEN k % 5 = 1 THEN pos END) OVER w AS o FROM r WINDOW w AS (PARTITION BY book ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT n.book, CASE WHEN n.held THEN n.id ELSE x.id END AS id, 'T' || n.k AS title FROM n LEFT JOIN r x ON x.book = n.book AND x.pos = n.h WHERE n.k % 5 = 1 AND (n.held OR (n.h IS NOT NULL AND (n.o IS NULL OR n.h < n.o)))""")
def rehung_chapters(spark, d):
    r = _rows(spark, d)
    return rows.rehung_chapters(r.where("k % 5 = 1").select("book", "id", F.concat(F.lit("T"), "id").alias("title")), r)


@query("flow_neighbours", f"WITH {ROWS}, n AS (SELECT book, id, lead(id) OVER (PARTITION BY book ORDER BY pos) AS later FROM r WHERE shelf IS NULL) SELECT book, id AS earlier, later FROM n WHERE later IS NOT NULL")
def flow_neighbours(spark, d):
    return rows.neighbours(_rows(spark, d))


@query("drawable_seams", f"""
WITH {ROWS}, s AS (SELECT book, k AS seq, (k - 50)::VARCHAR AS "after", id AS "before" FROM r WHERE k % 3 <> 1)
SELECT book, "before", arg_max("after", seq) AS "after" FROM s WHERE EXISTS (SELECT 1 FROM r WHERE r.book = s.book AND r.id = s."before" AND shelf IS NULL) AND EXISTS (SELECT 1 FROM r WHERE r.book = s.book AND r.id = s."after" AND shelf IS NULL) GROUP BY book, "before" """)
def drawable_seams(spark, d):
    r = _rows(spark, d)
    return rows.drawable_seams(r.where("k % 3 <> 1").select("book", F.col("k").alias("seq"), (F.col("k") - 50).cast("string").alias("after"), F.col("id").alias("before")), r)


@query("shared_anchors", f"WITH {ROWS} SELECT book, pos, id, max(CASE WHEN k % 4 = 0 THEN pos END) OVER (PARTITION BY book ORDER BY pos) AS anchor FROM r")
def shared_anchors(spark, d):
    r = _rows(spark, d)
    return rows.shared_anchors(r, r.where("k % 4 = 0"))


@query("edition_order", f"""
WITH {ROWS}, s AS (SELECT *, sum((k % 9 = 0)::INT) OVER (PARTITION BY book ORDER BY pos) AS division FROM r)
SELECT book, id, division::BIGINT AS division, row_number() OVER (PARTITION BY book ORDER BY division, category = 'Footnote', pos) AS place FROM s""")
def edition_order(spark, d):
    return rows.edition_order(_rows(spark, d).withColumn("opens", F.col("k") % 9 == 0)).select("book", "id", "division", F.col("place").cast("long").alias("place"))


@query("title_records", "SELECT 'b' AS book, c_custkey::VARCHAR AS id, 't' || c_custkey AS text FROM customer WHERE c_custkey % 3 = 0")
def title_records(spark, d):
    k = F.col("c_custkey").cast("string")
    return rows.title_records(S.table(spark, d, "customer").select(F.lit("b").alias("book"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("chapter:"), k)).otherwise(k).alias("key"), F.concat(F.lit("t"), k).alias("text")))[1]


@query("document_tokens", r"""
WITH p AS (SELECT 'b' || p_partkey % 5 AS book, 'OEBPS/' || p_partkey % 13 || CASE WHEN p_partkey % 11 = 0 THEN '/--.xhtml' ELSE '/Ch-' || p_partkey % 50 || '.xhtml' END AS path FROM part),
t AS (SELECT *, CASE WHEN path LIKE '%/--.xhtml' THEN 'doc' ELSE regexp_replace(lower(regexp_extract(path, '([^/]*)\.[^.]*$', 1)), '[^a-z0-9]', '', 'g') END AS t FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY book, t ORDER BY path) AS n FROM t)
SELECT book, path, CASE WHEN n = 1 THEN t ELSE t || '-' || n END AS token FROM n""")
def document_tokens(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.lit("OEBPS/"), (k % 13).cast("string"), F.when(k % 11 == 0, "/--.xhtml").otherwise(F.concat(F.lit("/Ch-"), (k % 50).cast("string"), F.lit(".xhtml"))))
    return rows.document_tokens(S.table(spark, d, "part").select(F.concat(F.lit("b"), (k % 5).cast("string")).alias("book"), path.alias("path")))


@query("missing_figures", f"WITH {ROWS} SELECT book, id, 'img' || k % 90 AS image FROM r WHERE k % 8 = 0 AND k % 90 >= 60")
def missing_figures(spark, d):
    r = _rows(spark, d).withColumn("image", F.when(F.col("k") % 8 == 0, F.concat(F.lit("img"), (F.col("k") % 90).cast("string"))))
    books = r.select("book").distinct()
    return rows.missing_figures(r, books.crossJoin(spark.range(60).select(F.concat(F.lit("img"), F.col("id").cast("string")).alias("image"))))


@query("page_budgets", f"WITH {ROWS} SELECT book, pos AS page, CASE WHEN k % 3 = 0 THEN (k * 10)::INT ELSE 2000000 END AS max_pixels FROM r")
def page_budgets(spark, d):
    p = _rows(spark, d).select("book", F.col("pos").alias("page"), "k")
    return rows.page_budgets(p.select("book", "page"), p.where("k % 3 = 0").select("book", "page", (F.col("k") * 10).cast("int").alias("max_pixels")), 2_000_000)


@query("page_orders_sorted", """
WITH s AS (SELECT o_custkey, o_orderkey * 7 % 1000 >= lag(o_orderkey * 7 % 1000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS up FROM orders) SELECT o_custkey, bool_and(coalesce(up, true)) AS sorted FROM s GROUP BY o_custkey""")
def page_orders_sorted(spark, d):
    return rows.is_sorted(S.table(spark, d, "orders").withColumn("v", F.col("o_orderkey") * 7 % 1000), "o_custkey", "o_orderkey", "v")


@query("photo_pages", """
WITH p AS (SELECT c_nationkey AS project, c_custkey AS photo, c_custkey * 2 + h AS page_id, 'q' || h AS quad FROM customer, (SELECT unnest([0, 1]) AS h)),
o AS (SELECT project, page_id, row_number() OVER (PARTITION BY project ORDER BY page_id * 37 % 101, page_id) - 1 AS n FROM p WHERE page_id % 9 <> 4)
SELECT o.project, o.n::INT AS n, p.photo, p.page_id, p.quad FROM o JOIN p ON o.project = p.project AND o.page_id = p.page_id WHERE p.page_id % 5 <> 0""")
def photo_pages(spark, d):
    c = S.table(spark, d, "customer").select(F.col("c_nationkey").alias("project"), F.col("c_custkey").alias("photo"))
    page = lambda h: F.struct((F.col("photo") * 2 + h).alias("page_id"), F.lit(f"q{h}").alias("quad"), ((F.col("photo") * 2 + h) % 5 == 0).alias("struck"))
    photos = c.select("project", "photo", F.array(page(0), page(1)).alias("pages"))
    ids = photos.select("project", F.explode("pages.page_id").alias("i")).where("i % 9 <> 4")
    order = ids.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col("i") * 37 % 101).alias("at"), "i"))), lambda x: x["i"]).alias("page_ids"))
    return rows.photo_pages(photos, order)


#: Prose with two raised numbers (at 4 and 9), notes that point at the rows before them, and the edits of a person.
EDITED = rf"""
{ROWS}, e AS (SELECT book, pos, id, k, shelf, k % 4 = 1 AS struck, category, 'word¹ and² ' || k AS text FROM r),
refs AS (SELECT book, id AS note, (k - 50)::VARCHAR AS block, 4 AS "at", 1 AS len FROM e WHERE category = 'Footnote' AND k >= 50 UNION ALL SELECT book, id, (k - 50)::VARCHAR, 9, 1 FROM e WHERE category = 'Footnote' AND k >= 50 AND k % 5 = 2
  UNION ALL SELECT book, (k + 100)::VARCHAR, id, 9, 1 FROM e WHERE pos % 7 = 1 AND k % 5 <> 2),
kept AS (SELECT * FROM e WHERE NOT struck AND shelf IS NULL),
cuts AS (SELECT DISTINCT book, block AS id, "at", len FROM refs WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.book = refs.book AND kept.id = refs.note)),
live AS (SELECT f.book, f.note, f.block, f."at" - coalesce((SELECT sum(least(f."at", c."at" + c.len) - c."at") FROM cuts c WHERE c.book = f.book AND c.id = f.block AND c."at" < f."at"), 0) AS "at", f.len FROM refs f
  WHERE EXISTS (SELECT 1 FROM kept WHERE kept.book = f.book AND kept.id = f.note) AND EXISTS (SELECT 1 FROM kept WHERE kept.book = f.book AND kept.id = f.block))
"""


def _edited(spark, d):
    r = _rows(spark, d)
    e = r.select("book", "pos", "id", "k", "shelf", (F.col("k") % 4 == 1).alias("struck"), "category", F.concat(F.lit("word¹ and² "), "id").alias("text"))
    ref = lambda df, note, block, at: df.select("book", note.cast("string").alias("note"), block.cast("string").alias("block"), F.lit(at).alias("at"), F.lit(1).alias("len"))
    notes, k = e.where("category = 'Footnote' and k >= 50"), F.col("k")
    found = ref(notes, k, k - 50, 4).unionByName(ref(notes.where("k % 5 = 2"), k, k - 50, 9)).unionByName(ref(e.where("pos % 7 = 1 and k % 5 <> 2"), k + 100, k, 9))
    chapters = r.where("k % 5 = 1").select("book", "id", F.concat(F.lit("T"), "id").alias("title"))
    return rows.materialized(e, found, chapters)


@query("materialized_rows", f"""
WITH {EDITED}, ch AS (SELECT book, pos, id, category, text, unnest(range(0, length(text))) AS i FROM kept)
SELECT book, pos, id, category, string_agg(substring(text, i + 1, 1), '' ORDER BY i) FILTER (NOT EXISTS (SELECT 1 FROM cuts c WHERE c.book = ch.book AND c.id = ch.id AND i >= c."at" AND i < c."at" + c.len)) AS text FROM ch GROUP BY book, pos, id, category""")
def materialized_rows(spark, d):
    return _edited(spark, d)["rows"]


@query("materialized_refs", f'WITH {EDITED} SELECT book, note, block, "at"::INT AS "at", len FROM live')
def materialized_refs(spark, d):
    return _edited(spark, d)["refs"]


@query("orphan_notes", f"WITH {EDITED} SELECT book, id FROM kept WHERE category = 'Footnote' AND NOT EXISTS (SELECT 1 FROM live WHERE live.book = kept.book AND live.note = kept.id)")
def orphan_notes(spark, d):
    return _edited(spark, d)["orphans"]


TRANSLATED = rf"""
{ROWS}, t AS (SELECT *, CASE WHEN k % 11 = 0 THEN ' ' ELSE 'Head ' || k END AS text, CASE WHEN k % 3 <> 0 THEN 'said ' || k END AS said FROM r),
ch AS (SELECT book, id, k, CASE WHEN k % 10 = 1 THEN 'Head ' || k ELSE 'Own ' || k END AS title FROM r WHERE k % 5 = 1),
tt AS (SELECT ch.book, ch.id, ch.title, CASE WHEN t.category = 'Title' AND trim(t.text) = ch.title AND said IS NOT NULL THEN said WHEN ch.k % 4 = 0 THEN 'rec ' || ch.k END AS new FROM ch JOIN t ON t.book = ch.book AND t.id = ch.id)
"""


def _translated(spark, d):
    r = _rows(spark, d)
    k = F.col("k")
    rws = r.withColumn("text", F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("Head "), "id")))
    own = r.where("k % 3 <> 0").select("book", F.col("id").alias("key"), F.concat(F.lit("said "), "id").alias("text"))
    titles = r.where("k % 5 = 1 and k % 4 = 0").select("book", F.concat(F.lit("chapter:"), "id").alias("key"), F.concat(F.lit("rec "), "id").alias("text"))
    chapters = r.where("k % 5 = 1").select("book", "id", F.concat(F.when(k % 10 == 1, "Head ").otherwise("Own "), "id").alias("title"))
    return rows.translated(rws, own.unionByName(titles), chapters)


@query("translated_rows", f"WITH {TRANSLATED} SELECT book, pos, id, category, coalesce(said, text) AS text FROM t")
def translated_rows(spark, d):
    return _translated(spark, d)["rows"]


@query("untranslated_rows", f"WITH {TRANSLATED} SELECT book, id FROM t WHERE said IS NULL AND shelf IS NULL AND trim(text) <> ''")
def untranslated_rows(spark, d):
    return _translated(spark, d)["untranslated"]


@query("translated_chapters", f"WITH {TRANSLATED} SELECT book, id, coalesce(new, title) AS title FROM tt")
def translated_chapters(spark, d):
    return _translated(spark, d)["chapters"]


@query("untitled_chapters", f"WITH {TRANSLATED} SELECT book, id FROM tt WHERE new IS NULL")
def untitled_chapters(spark, d):
    return _translated(spark, d)["untitled"]


RAISED = r"""
d AS (SELECT source AS book, doc_id::VARCHAR AS id, CASE WHEN doc_id % 9 = 4 THEN 'Footnote' ELSE 'Text' END AS category, translate(text, 'qxzjkvwyfp', '⁰¹²³⁴⁵⁶⁷⁸⁹') AS text FROM documents),
h AS (SELECT *, regexp_extract_all(text, '[⁰¹²³⁴⁵⁶⁷⁸⁹]+') AS hs, regexp_split_to_array(text, '[⁰¹²³⁴⁵⁶⁷⁸⁹]+') AS rs FROM d),
s AS (SELECT book, id, category, unnest(hs) AS hit, unnest(list_transform(rs[1:len(hs)], lambda x: length(x))) AS gap, unnest(range(0, len(hs))) AS n FROM h),
runs AS (SELECT book, id, category, n, length(hit)::INT AS len, (sum(gap + length(hit)) OVER (PARTITION BY book, id ORDER BY n) - length(hit))::INT AS "at", try_cast(translate(hit, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789') AS INT) AS printed FROM s)
"""


def _raised(spark, d):
    k = F.col("doc_id")
    return S.table(spark, d, "documents").select(F.col("source").alias("book"), k.cast("string").alias("id"), F.when(k % 9 == 4, "Footnote").otherwise("Text").alias("category"), F.translate("text", "qxzjkvwyfp", X.SUPERSCRIPTS).alias("text"))


@query("superscript_runs", f"""WITH {RAISED} SELECT book, id, "at", len, printed FROM runs""")
def superscript_runs(spark, d):
    return _raised(spark, d).select("book", "id", F.explode(refs.superscript_runs(F.col("text"))).alias("r")).select("book", "id", "r.at", "r.len", "r.printed")


@query("loose_runs", f"""WITH {RAISED} SELECT book, id, "at", len, printed FROM runs WHERE category <> 'Footnote' AND NOT ("at" < 60 AND 20 < "at" + len)""")
def loose_runs(spark, d):
    r = _raised(spark, d)
    return refs.loose_runs(r, r.select("book", F.col("id").alias("block"), F.lit(20).alias("at"), F.lit(40).alias("len")))


@query("exact_note_links", f"""WITH {RAISED} SELECT book, 'n' AS note, id AS block, "at", len, printed FROM runs WHERE "at" = 7 AND len = 1""")
def exact_note_links(spark, d):
    r = _raised(spark, d)
    return refs.exact_links(r, r.select("book", F.lit("n").alias("note"), F.col("id").alias("block"), F.lit(7).alias("at"), F.lit(1).alias("len")))[0]


@query("anchored_refs", """
WITH a AS (SELECT DISTINCT 'd' || p_partkey % 20 AS document, 'a' || p_partkey % 40 AS anchor, 'r' || p_partkey % 20 || '-' || p_partkey % 40 AS row FROM part),
r AS (SELECT 'd' || o_orderkey % 20 AS document, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'd' || o_orderkey % 7 END || '#a' || o_orderkey % 50 AS href FROM orders)
SELECT 'b' AS book, r.document, r.href, a.row FROM r LEFT JOIN a ON a.document = CASE WHEN href LIKE '#%' THEN r.document ELSE regexp_extract(href, '^[^#]*') END AND a.anchor = regexp_extract(href, '#(.*)$', 1)""")
def anchored_refs(spark, d):
    p, k = F.col("p_partkey"), F.col("o_orderkey")
    name = lambda prefix, c, m: F.concat(F.lit(prefix), (c % m).cast("string"))
    anchors = S.table(spark, d, "part").select(F.lit("b").alias("book"), name("d", p, 20).alias("document"), name("a", p, 40).alias("anchor"), F.concat_ws("-", name("r", p, 20), (p % 40).cast("string")).alias("row")).distinct()
    found = S.table(spark, d, "orders").select(F.lit("b").alias("book"), name("d", k, 20).alias("document"), F.concat(F.when(k % 3 == 0, "").otherwise(name("d", k, 7)), name("#a", k, 50)).alias("href"))
    return refs.anchored(found, anchors)


@query("imported_note_refs", f"""
WITH {ROWS}, x AS (SELECT *, CASE k % 5 WHEN 0 THEN (k % 9) || ' note' WHEN 1 THEN '**' || (k % 9) || '.** note' WHEN 2 THEN ' 0' || (k % 9) || ' note' WHEN 3 THEN '⁵ note' ELSE 'text' END AS text FROM r),
f AS (SELECT book, k * 2 AS seq, (k + 50)::VARCHAR AS row, (k % 9)::INT AS printed FROM r UNION ALL SELECT book, k * 2 + 1, (k % 50 + 50 * (k % 70))::VARCHAR, CASE WHEN k % 4 > 0 THEN (k % 7)::INT END FROM r),
j AS (SELECT f.*, x.category, x.k % 5 < 2 AND x.k % 9 = f.printed AND x.category <> 'Footnote' AS fits FROM f LEFT JOIN x ON x.book = f.book AND x.id = f.row),
m AS (SELECT *, min(CASE WHEN fits THEN seq END) OVER (PARTITION BY book, row) AS first FROM j)
SELECT book, seq, row, printed, CASE WHEN category = 'Footnote' OR seq > first THEN 'note' WHEN seq = first THEN 'promoted' ELSE 'unresolved' END AS state FROM m""")
def imported_note_refs(spark, d):
    r, k = _rows(spark, d), F.col("k")
    found = r.select("book", (k * 2).alias("seq"), (k + 50).cast("string").alias("row"), (k % 9).cast("int").alias("printed"))
    more = r.select("book", (k * 2 + 1).alias("seq"), (k % 50 + 50 * (k % 70)).cast("string").alias("row"), F.when(k % 4 > 0, (k % 7).cast("int")).alias("printed"))
    number = (k % 9).cast("string")
    text = F.when(k % 5 == 0, F.concat(number, F.lit(" note"))).when(k % 5 == 1, F.concat(F.lit("**"), number, F.lit(".** note"))).when(k % 5 == 2, F.concat(F.lit(" 0"), number, F.lit(" note"))).when(k % 5 == 3, "⁵ note").otherwise("text")
    return refs.imported_refs(found.unionByName(more), r.withColumn("text", text))


@query("nearest_stamped", f"""
WITH {TREE} SELECT s.project AS doc, s.id, (SELECT arg_min(u.ancestor, u.depth) FROM up u WHERE u.project = s.project AND u.id = s.id AND u.depth > 0 AND u.ancestor % 3 = 0) AS stamped FROM steps s""")
def nearest_stamped(spark, d):
    return refs.nearest_stamped(S.steps(spark, d).select(F.col("project").alias("doc"), "id", "parent", F.when(F.col("id") % 3 == 0, "Text").alias("category")))


@query("marker_homes", """
WITH l AS (SELECT DISTINCT l_orderkey % 40 AS doc, l_linenumber AS page, l_orderkey AS start FROM lineitem), m AS (SELECT DISTINCT o_orderkey % 40 AS doc, o_orderkey % 5 + 1 AS page, o_orderkey AS "offset" FROM orders)
SELECT m.doc, m.page, m."offset", (SELECT min(start) FROM l WHERE l.doc = m.doc AND l.page = m.page AND l.start > m."offset") AS home FROM m""")
def marker_homes(spark, d):
    leaves = S.table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("doc"), F.col("l_linenumber").cast("long").alias("page"), F.col("l_orderkey").alias("start")).distinct()
    k = F.col("o_orderkey")
    return refs.new_homes(S.table(spark, d, "orders").select((k % 40).alias("doc"), (k % 5 + 1).cast("long").alias("page"), k.alias("offset")).distinct(), leaves)


@query("reference_counts", """
SELECT 'b' || o_orderkey % 50 AS book, o_custkey AS target, count(*) AS "before", count(*) FILTER (o_orderkey % 3 <> 0) AS "after", count(*) FILTER (o_orderkey % 3 <> 0) = 0 AS lost FROM orders GROUP BY ALL""")
def reference_counts(spark, d):
    k = F.col("o_orderkey")
    return refs.reference_counts(S.table(spark, d, "orders").select(F.concat(F.lit("b"), (k % 50).cast("string")).alias("book"), F.col("o_custkey").alias("target"), (k % 3 != 0).alias("kept")))


@query("orphaned_images", f"""
WITH {ROWS} SELECT DISTINCT book, 'i' || k % 300 AS image FROM r x WHERE k % 300 <> 7 AND NOT EXISTS (SELECT 1 FROM r WHERE r.book = x.book AND r.held AND r.k % 300 = x.k % 300)""")
def orphaned_images(spark, d):
    r = _rows(spark, d).withColumn("image", F.concat(F.lit("i"), (F.col("k") % 300).cast("string")))
    return refs.orphaned(r, r.where("held"), r.where("k % 300 = 7"))


@query("promoted_labels", f"""
WITH {ROWS}, x AS (SELECT book, pos, CASE WHEN k % 11 = 0 THEN 'Title' WHEN k % 2 = 0 THEN 'Text' ELSE 'Section-header' END AS category,
  CASE k % 9 WHEN 0 THEN '*Part*  one' WHEN 1 THEN 'PART' WHEN 2 THEN 'the part one of it' WHEN 3 THEN 'the part one!' WHEN 4 THEN 'one' WHEN 5 THEN '' ELSE 'The' END AS text FROM r),
a AS (SELECT s.book, s.pos AS start, j, x.category IN ('Text', 'Section-header') AND x.text <> '' AND (contains('the part one', n) OR contains(n, 'the part one')) AS fits
  FROM (SELECT book, pos, unnest([0, 1, 2, 3]) AS j FROM x WHERE pos % 6 = 1) s LEFT JOIN (SELECT *, CASE WHEN text = '*Part*  one' THEN 'part one' ELSE lower(text) END AS n FROM x) x ON x.book = s.book AND x.pos = s.pos + s.j),
e AS (SELECT book, start, coalesce(min(CASE WHEN NOT coalesce(fits, false) THEN j END), 4) AS stop FROM a GROUP BY book, start)
SELECT book, start + j AS pos FROM (SELECT book, start, unnest(range(0, stop)) AS j FROM e)""")
def promoted_labels(spark, d):
    r, k = _rows(spark, d), F.col("k")
    text = F.when(k % 9 == 0, "*Part*  one").when(k % 9 == 1, "PART").when(k % 9 == 2, "the part one of it").when(k % 9 == 3, "the part one!").when(k % 9 == 4, "one").when(k % 9 == 5, "").otherwise("The")
    x = r.select("book", "pos", F.when(k % 11 == 0, "Title").when(k % 2 == 0, "Text").otherwise("Section-header").alias("category"), text.alias("text"))
    return refs.promoted_labels(x, x.where("pos % 6 = 1").select("book", "pos", F.col("pos").alias("nth"), F.lit("The *Part*\tOne ").alias("title")))


@query("stamp_report", f"WITH {ROWS} SELECT book, category, 'l' || k % 3 AS layer, count(*) AS n FROM r GROUP BY ALL")
def stamp_report(spark, d):
    return refs.stamp_report(_rows(spark, d).withColumn("layer", F.concat(F.lit("l"), (F.col("k") % 3).cast("string"))))


LEDGER = rf"""
{TREE}, st AS (SELECT *, 'p' || id % 5 AS payload, 'a' || id % 3 AS params FROM steps), runs AS (SELECT project, 1000 + id AS id, parent, action, 'p' || (id + 1) % 5 AS payload, 'a' || (id % 3 + id % 2) AS params FROM steps WHERE id % 4 = 2),
land AS (SELECT r.project, r.id, r.payload, (SELECT min(s.id) FROM st s WHERE s.project = r.project AND s.parent IS NOT DISTINCT FROM r.parent AND s.action = r.action AND s.params = r.params) AS replaces FROM runs r)
"""


def _ledger(spark, d):
    i = F.col("id")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    s = S.steps(spark, d).select("project", "id", "parent", "action", name("a", i % 3).alias("params"), name("p", i % 5).alias("payload"), F.lit(None).cast("string").alias("retention"), "created")
    runs = s.where("id % 4 = 2").select("project", (1000 + i).alias("id"), "parent", "action", name("a", i % 3 + i % 2).alias("params"), name("p", (i + 1) % 5).alias("payload"), "retention", "created")
    return s, runs


@query("ledger_origins", f"WITH {S.STEPS} SELECT project, min(id) AS id FROM steps WHERE parent IS NULL GROUP BY project")
def ledger_origins(spark, d):
    return ledger.origins(S.steps(spark, d))


@query("ledger_children", f"WITH {S.STEPS} SELECT project, parent, id, row_number() OVER (PARTITION BY project, parent ORDER BY created, id)::INT AS nth FROM steps WHERE parent IS NOT NULL")
def ledger_children(spark, d):
    return ledger.children(S.steps(spark, d))


@query("ledger_appended", f"""
WITH {S.STEPS}, n AS (SELECT project, CASE WHEN project % 5 = 0 THEN min(id) ELSE 900 END AS id, CASE WHEN project % 5 = 1 THEN NULL WHEN project % 5 = 2 THEN 777 ELSE min(id) END AS parent, max(created) AS last FROM steps GROUP BY project)
SELECT project, id, parent, 'edit' AS action, greatest(project % 3 * 100, last)::BIGINT AS created, CASE WHEN project % 5 = 0 THEN 'same id' WHEN project % 5 = 1 THEN 'second origin' WHEN project % 5 = 2 THEN 'no such parent' END AS refused FROM n""")
def ledger_appended(spark, d):
    s = S.steps(spark, d)
    low, p = s.groupBy("project").agg(F.min("id").alias("low")), F.col("project") % 5
    new = low.select("project", F.when(p == 0, F.col("low")).otherwise(900).alias("id"), F.when(p == 1, None).when(p == 2, F.lit(777)).otherwise(F.col("low")).alias("parent"), F.lit("edit").alias("action"), (F.col("project") % 3 * 100).alias("created"))
    return ledger.appended(s, new).withColumn("created", F.col("created").cast("long"))


@query("ledger_landings", f"""
WITH {LEDGER} SELECT l.project, l.id, l.replaces, CASE WHEN s.payload <> l.payload AND (SELECT count(*) FROM st x WHERE x.project = l.project AND x.payload = s.payload) <= 1 THEN s.payload END AS displaced FROM land l LEFT JOIN st s ON s.project = l.project AND s.id = l.replaces""")
def ledger_landings(spark, d):
    return ledger.landings(*_ledger(spark, d))


@query("ledger_landed", f"""
WITH {LEDGER}, sw AS (SELECT project, replaces AS id, arg_max(payload, id) AS payload FROM land WHERE replaces IS NOT NULL GROUP BY project, replaces),
b AS (SELECT DISTINCT u.project, u.id FROM up u JOIN sw ON sw.project = u.project AND sw.id = u.ancestor WHERE u.depth > 0)
SELECT st.project, st.id, st.parent, coalesce(sw.payload, st.payload) AS payload, CASE WHEN b.id IS NOT NULL THEN true ELSE false END AS stale FROM st LEFT JOIN sw ON sw.project = st.project AND sw.id = st.id LEFT JOIN b ON b.project = st.project AND b.id = st.id
UNION ALL SELECT r.project, r.id, r.parent, r.payload, false FROM runs r JOIN land l ON l.project = r.project AND l.id = r.id WHERE l.replaces IS NULL""")
def ledger_landed(spark, d):
    s, runs = _ledger(spark, d)
    return ledger.landed(s.withColumn("stale", F.lit(False)), runs, ledger.ancestry(s)).select("project", "id", "parent", "payload", "stale")


@query("orphaned_payloads", f"""
WITH {LEDGER} SELECT DISTINCT s.project, s.payload FROM st s WHERE s.id % 4 = 3 AND NOT EXISTS (SELECT 1 FROM st x WHERE x.project = s.project AND x.id % 4 <> 3 AND x.payload = s.payload)""")
def orphaned_payloads(spark, d):
    s, _ = _ledger(spark, d)
    return ledger.orphaned_payloads(s, s.where("id % 4 <> 3"))


@query("edits_in_effect", f"""
WITH {TREE}, p AS (SELECT project, max(id) AS at FROM steps GROUP BY project), path AS (SELECT u.project, u.ancestor AS id, u.depth, s.action FROM up u JOIN p ON p.project = u.project AND p.at = u.id JOIN steps s ON s.project = u.project AND s.id = u.ancestor),
b AS (SELECT project, min(depth) FILTER (action = 'system') AS bound FROM path GROUP BY project)
SELECT path.project, id, row_number() OVER (PARTITION BY path.project ORDER BY depth DESC)::INT AS nth FROM path JOIN b ON b.project = path.project WHERE action IN ('user', 'tool') AND (bound IS NULL OR depth < bound)""")
def edits_in_effect(spark, d):
    s = S.steps(spark, d)
    at = ledger.position(s, spark.createDataFrame([], "project long, pointer long"))
    return ledger.in_effect(s, ledger.ancestry(s), at, ["user", "tool"], ["system"])


@query("metadata_in_effect", f"""
WITH {TREE}, p AS (SELECT project, max(id) AS at FROM steps GROUP BY project)
SELECT s.project, s.id FROM steps s WHERE s.action = 'assistant' AND EXISTS (SELECT 1 FROM up u JOIN p ON p.project = u.project AND p.at = u.id WHERE u.project = s.project AND u.ancestor = s.parent)""")
def metadata_in_effect(spark, d):
    s = S.steps(spark, d)
    at = ledger.position(s, spark.createDataFrame([], "project long, pointer long"))
    return ledger.metadata_steps(s, ledger.ancestry(s), at, "assistant")


@query("translation_bank", r"""
WITH c AS (SELECT conv_id % 7 AS book, conv_id * 1000 + turn AS seq, sha256(role || turn % 5) AS key, role AS source, text AS answer FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)
SELECT book::INT AS book, key, arg_max(source, seq) AS source, sha256(arg_max(answer, seq)) AS answer FROM c GROUP BY book, key""")
def translation_bank(spark, d):
    """The table is written as banks of JSON lines and read back."""
    c = S.table(spark, d, "conversations").where("text is not null and role is not null").dropDuplicates(["conv_id", "turn"])
    lines = c.select((F.col("conv_id") % 7).alias("book"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.sha2(F.concat("role", (F.col("turn") % 5).cast("string")), 256).alias("key"), F.col("role").alias("source"), F.col("text").alias("answer"))
    bank = banks.translation_bank(spark, banks.write_lines(lines, folder(spark, "bank")))
    return bank.select(F.regexp_extract("book", r"book=([0-9]+)", 1).cast("int").alias("book"), "key", "source", F.sha2("answer", 256).alias("answer"))


@query("record_lookups", r"""
WITH e AS (SELECT user_id % 10 AS book, event_id AS seq, CASE WHEN event_id % 3 > 0 THEN 'k' || event_id % 40 END AS key, ['p' || event_id % 25] AS parts, 't' || event_id AS text, CASE WHEN event_id % 4 = 0 THEN 'user' END AS author FROM events)
SELECT book::INT AS book, parts, arg_max(text, seq) AS text, arg_max(struct_pack(a := author), seq).a AS author, arg_max(key, seq) FILTER (key IS NOT NULL) AS asked FROM e GROUP BY book, parts""")
def record_lookups(spark, d):
    i = F.col("event_id")
    lines = S.table(spark, d, "events").select((F.col("user_id") % 10).alias("book"), i.alias("seq"), F.when(i % 3 > 0, F.concat(F.lit("k"), (i % 40).cast("string"))).alias("key"), F.array(F.concat(F.lit("p"), (i % 25).cast("string"))).alias("parts"), F.concat(F.lit("t"), i.cast("string")).alias("text"), F.when(i % 4 == 0, "user").otherwise("model").alias("author"))
    records = banks.translation_records(spark, banks.write_lines(lines, folder(spark, "records")))
    return banks.records_by_parts(records).withColumn("book", F.regexp_extract("book", r"book=([0-9]+)", 1).cast("int"))


@query("edit_log", f"""
WITH {S.OPS} SELECT book, op, id, CASE WHEN op = 'text' THEN text END AS text, CASE WHEN op = 'category' THEN category END AS category, row_number() OVER (PARTITION BY book ORDER BY seq) - 1 AS seq FROM ops""")
def edit_log(spark, d):
    o = S.ops(spark, d)
    lines = o.select("book", "seq", "op", "id", F.when(F.col("op") == "text", F.col("text")).alias("text"), F.when(F.col("op") == "category", F.col("category")).alias("category"))
    return banks.edit_log(spark, banks.write_lines(lines, folder(spark, "log"))).select(F.regexp_extract("book", r"book=(b[0-9]+)", 1).alias("book"), "op", "id", "text", "category", "seq")


@query("bank_decisions", r"""
WITH e AS (SELECT event_id, event_id % 2 = 0 AS p, event_id % 3 = 0 AS s, event_id % 5 = 0 AS m, event_id % 7 = 0 AS h FROM events)
SELECT event_id, CASE WHEN p AND s THEN 'resume pending' WHEN p THEN 'discard pending' WHEN m THEN 'fresh into pending' WHEN h THEN 'resume' ELSE 'start' END AS decision FROM e""")
def bank_decisions(spark, d):
    i = F.col("event_id")
    return S.table(spark, d, "events").select("event_id", banks.bank_decision(i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 7 == 0).alias("decision"))


@query("chunk_ambiguities", rf"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND contains(text, chr(10)) THEN 'line break' WHEN doc_id % 2 = 0 AND contains(text, '|') THEN 'bar' WHEN doc_id % 2 = 1 AND (CASE WHEN doc_id % 3 = 0 THEN regexp_matches(text, '^[ \t]*[0-9]+[ \t]*[.):]') ELSE len(list_filter(ls, lambda s: regexp_matches(s, '^[ \t]*[0-9]+[ \t]*[.):]'))) > 0 END) THEN 'number'
  WHEN doc_id % 2 = 0 AND trim(text, {BLANKS}) = '' THEN 'empty row' END AS why FROM l""")
def chunk_ambiguities(spark, d):
    parts = F.when(F.col("doc_id") % 3 == 0, F.array("text")).otherwise(F.split("text", "\n", -1))
    return S.table(spark, d, "documents").select("doc_id", X.chunk_ambiguity(parts, F.when(F.col("doc_id") % 2 == 0, "table").otherwise("list")).alias("why"))


@query("quad_geometry", r"""
WITH q AS (SELECT p_partkey AS k, (p_partkey % 50)::DOUBLE AS a, (p_partkey % 70 + 100)::DOUBLE AS b FROM part)
SELECT k, round(CASE WHEN b > 0 THEN a + (b - a) * 0.25 END, 6) AS top_x, round(0 + (b + 5 - 0) * 0.25, 6) AS foot_x, round(1000 / (floor(1000 * sqrt(800 * 1000 / 2000000.0) * 0 + (1000 / 28.0) + 0.5) * 28), 6) AS scale FROM q""")
def quad_geometry(spark, d):
    q = S.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 50).cast("double").alias("a"), (F.col("p_partkey") % 70 + 100).cast("double").alias("b"))
    zero = F.lit(0.0)
    left = G.halves(F.array(F.array(F.col("a"), F.col("a")), F.array(F.col("b"), zero), F.array(F.col("b") + 5, F.col("b") + 7), F.array(zero, F.col("b"))), F.lit(0.25))[0]
    return q.select("k", F.round(left[1][0], 6).alias("top_x"), F.round(left[2][0], 6).alias("foot_x"), F.round(G.render_scale(F.lit(800), F.lit(1000), 2_000_000), 6).alias("scale"))


@query("markdown_blocks", r"""
WITH l AS (SELECT source AS book, doc_id AS page, unnest(string_split(m, chr(10))) AS line, generate_subscripts(string_split(m, chr(10)), 1) AS pos FROM (SELECT source, doc_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^(A|E)', '- \1', 'g'), '(?m)^(D|L)', '7. \1', 'g'), '(?m)^(T)', '## \1', 'g'), '(?m)^(O)', '<table><tr>\1', 'g') || chr(10) || chr(10) || '***' || chr(10) || 'end </table>' AS m FROM documents)),
t AS (SELECT *, coalesce(max(CASE WHEN regexp_matches(line, '(?i)^[ \t]*<table[\s>]') THEN pos END) OVER (PARTITION BY book, page ORDER BY pos) > coalesce(max(CASE WHEN regexp_matches(line, '(?i)</table>') THEN pos END) OVER (PARTITION BY book, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), false) AS tab FROM l),
k AS (SELECT *, CASE WHEN tab THEN 'table' WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '<img>.*?</img>') THEN 'image' WHEN regexp_matches(trim(line), '^(-[ \t]*(-[ \t]*){2,}|\*[ \t]*(\*[ \t]*){2,}|_[ \t]*(_[ \t]*){2,})$') THEN 'rule' WHEN regexp_matches(trim(line), '^#{1,6}[ \t]+') THEN 'heading'
  WHEN regexp_matches(line, '^[ \t]{0,3}[-*+][ \t]+') THEN 'bullet' WHEN regexp_matches(line, '^[ \t]{0,3}[0-9]+[.)][ \t]+') THEN 'number' ELSE 'text' END AS k FROM t),
g AS (SELECT *, k = 'text' AND last_value(CASE WHEN k <> 'text' THEN k END IGNORE NULLS) OVER (PARTITION BY book, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) IN ('bullet', 'number') AS more,
  last_value(CASE WHEN k <> 'text' THEN k END IGNORE NULLS) OVER (PARTITION BY book, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lk FROM k),
h AS (SELECT *, CASE WHEN coalesce(more, false) THEN lk ELSE k END AS kk FROM g),
f AS (SELECT *, CASE WHEN kk IN ('image', 'rule', 'heading') THEN 1 WHEN kk = 'table' THEN (NOT coalesce(lag(tab) OVER w, false) OR regexp_matches(lag(line) OVER w, '(?i)</table>'))::INT ELSE (lag(kk) OVER w IS DISTINCT FROM kk)::INT END AS fresh FROM h WINDOW w AS (PARTITION BY book, page ORDER BY pos)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY book, page ORDER BY pos) AS run FROM f)
SELECT book, page, row_number() OVER (PARTITION BY book, page ORDER BY run)::INT AS seq, CASE WHEN kk IN ('bullet', 'number') THEN 'list' WHEN kk = 'text' THEN 'paragraph' ELSE kk END AS kind, CASE WHEN kk IN ('bullet', 'number') THEN kk = 'number' END AS ordered,
  CASE WHEN kk IN ('bullet', 'number') THEN count(*) FILTER (NOT coalesce(more, false)) ELSE 1 END AS items FROM r WHERE kk <> 'blank' GROUP BY book, page, run, kk""")
def markdown_blocks(spark, d):
    text = F.col("text")
    for pattern, mark in (("(A|E)", "- "), ("(D|L)", "7. "), ("(T)", "## "), ("(O)", "<table><tr>")):
        text = F.regexp_replace(text, f"(?md)^{pattern}", mark + "$1")
    pages = S.table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.concat(text, F.lit("\n\n***\nend </table>")).alias("text"))
    return prose.markdown_blocks(pages, furniture=False).select("book", "page", "seq", "kind", "ordered", F.size("items").cast("long").alias("items"))


@query("exploded_categories", r"""
WITH p AS (SELECT regexp_replace(html, '(?s)<(head|script|style)[^>]*>.*?</(head|script|style)>', '', 'g') AS h FROM pages),
t AS (SELECT unnest(regexp_extract_all(h, '<(h1|li)[ >]', 1)) AS tag FROM p)
SELECT CASE tag WHEN 'h1' THEN 'Title' ELSE 'List-item' END AS category, count(*) AS n FROM t GROUP BY tag""")
def exploded_categories(spark, d):
    r = explode.exploded_rows(S.table(spark, d, "pages"), "page_id", "html")
    return r.where(F.col("category").isin("Title", "List-item")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("exploded_rows")
def exploded_rows(spark, d):
    return explode.exploded_rows(S.table(spark, d, "pages"), "page_id", "html")


@query("plain_chapters")
def plain_chapters(spark, d):
    body = F.regexp_replace(F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1), "<b>|</b>", "")
    return prose.plain_chapters(S.table(spark, d, "pages").select("page_id", body.alias("body")), "page_id", "body")


@query("reflowed_book")
def reflowed_book(spark, d):
    return flow_ops.reflowed_book(S.blocks(spark, d))["paragraphs"]
