"""Queries of book files and of edits, each beside the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import rebind as R
from ..operators.scratch import folder
from ..sources import book_files
from . import standins as S
from .catalog import query

# --- book files -------------------------------------------------------------------------------------------------------

#: Documents' lines as the rows of 40 book files: row ``n`` of its book is a page's block, cut in two parts at a third. In the
#: books 1 to 16 the sixth row or the header is faulty in one way each.
FILES = r"""
fl AS (SELECT doc_id % 40 AS b, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
fr AS (SELECT b, doc_id, pos, line, row_number() OVER (PARTITION BY b ORDER BY doc_id, pos) AS n, count(*) OVER (PARTITION BY b) AS total FROM fl)
"""
#: What is wrong with each faulty book: with its sixth row, or with its header.
ROW_FAULTS = {1: "not divided", 2: "not divided", 3: "repeated id", 4: "id", 5: "not JSON", 6: "text or category", 7: "no parts", 8: "shelf", 9: "shelved without a reason", 10: "not whole", 11: "image", 12: "part"}
HEAD_FAULTS = {13: "old version", 14: "version", 15: "seams", 16: "figures"}


def _write_books(spark, d):
    docs = S.table(spark, d, "documents").select((F.col("doc_id") % 40).alias("b"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = docs.withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy("doc_id", "pos")))
    b, n = F.col("b"), F.col("n")
    # as its format has it, offsets count UTF-16 units
    size = X.utf16_length(F.col("line"))
    third = F.floor(size / 3)
    bad = F.when(n == 6, b).otherwise(0)
    number = F.when(bad == 3, n - 1).otherwise(n).cast("string")
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.char_length(F.to_json(F.array(c))) - 2)
    part = lambda k, start, end: F.concat(F.lit('{"src":"1:' + k + '","page":'), F.when(bad == 12, '"1"').otherwise("1"), F.lit(',"chars":['), start.cast("string"), F.lit(","), end.cast("string"), F.lit("]}"))
    second = F.when(bad == 1, third + 1).when(bad == 2, third - 1).otherwise(third)
    last = F.when(bad == 10, size + 7).otherwise(size)
    parts = F.when(bad == 7, "[]").otherwise(F.concat(F.lit("["), part("0", F.lit(0), third), F.lit(","), part("1", second, last), F.lit("]")))
    shelf = F.when(bad == 8, ',"shelf":"attic","why":"x"').when(bad == 9, ',"shelf":"furniture"').when(n % 9 == 2, ',"shelf":"furniture","why":"foot"').when(bad == 11, ',"image":7').otherwise("")
    name = F.when(bad == 4, F.concat(F.lit("x"), number)).otherwise(F.concat(F.lit("b1-"), number))
    value = F.concat(F.lit('{"id":"'), name, F.when(bad == 6, '","category":"Text","text":5').otherwise(F.concat(F.lit('","category":"Text","text":'), quoted(F.col("line")))), F.lit(',"page":1,"pages":[1],"box":null,"parts":'), parts, shelf, F.when(bad == 5, "").otherwise("}"))
    version = F.when(b == 13, "2").when(b == 14, "4").otherwise("3")
    seams = F.when(b == 15, '[{"after":"b1-1"}]').otherwise('[{"after":"b1-1","before":"b1-2"}]')
    head = F.concat(F.lit('{"book":'), version, F.lit(',"engine":"e","language":"en","source":{"pages":1,"unreadable":[],"bankSha":"s"},"chapters":[],"typography":null,"seams":'), seams, F.lit(',"loose":{"markers":[],"notes":[]}'), F.when(b == 16, ',"figures":{"blocks":1}').otherwise(""), F.lit("}"))
    heads = rows.select("b").distinct().select(b.alias("book"), head.alias("value"))
    return book_files.write_book_files(heads, rows.select(b.alias("book"), n.alias("pos"), value.alias("value")), folder(spark, "books"))


def _number(c):
    return F.regexp_extract(c, r"book=([0-9]+)", 1).cast("long")


@query("book_file_refusals", rf"""
WITH {FILES}
SELECT b AS book, 6 AS seq, CASE b {" ".join(f"WHEN {k} THEN '{v}'" for k, v in ROW_FAULTS.items())} END AS why FROM fr WHERE n = 6 AND b BETWEEN 1 AND 12
  AND NOT (b = 2 AND length(line) < 3)
UNION ALL SELECT DISTINCT b, 0, CASE b {" ".join(f"WHEN {k} THEN '{v}'" for k, v in HEAD_FAULTS.items())} END FROM fr WHERE b BETWEEN 13 AND 16
UNION ALL SELECT b, 6, 'not divided' FROM fr WHERE n = 6 AND b = 2 AND length(line) < 3""")
def book_file_refusals(spark, d):
    """Of 40 files, those that are refused, with the line and the reason."""
    _, _, refused = book_files.book_files(spark, _write_books(spark, d))
    return refused.select(_number(F.col("book")).alias("book"), F.col("seq").cast("int").alias("seq"), "why")


@query("book_file_rows", rf"""
WITH {FILES}
SELECT b AS book, n AS seq, 'b1-' || n AS id, sha256(line) AS h, CASE WHEN n % 9 = 2 THEN 'furniture' END AS shelf, length(line)::INT AS size
FROM fr WHERE b NOT BETWEEN 13 AND 16 AND (b NOT BETWEEN 1 AND 12 OR total < 6)""")
def book_file_rows(spark, d):
    """The rows of the sound files; the spans of their parts, in code points, end with the text."""
    rows, _, _ = book_files.book_files(spark, _write_books(spark, d))
    return rows.select(_number(F.col("book")).alias("book"), "seq", "id", F.sha2("text", 256).alias("h"), "shelf", F.get("parts", F.lit(1))["end"].alias("size"))


# --- re-binding -------------------------------------------------------------------------------------------------------

#: Documents as books: every fourth line is a note that names the three rows before it; of the rows before it the first is
#: edited (in every second group it has taken in the row after it), the second is edited or split in two, the third is not.
BOUND = r"""
bl AS (SELECT doc_id AS book, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
b_rows AS (
  SELECT book, i * 2 AS pos, 'r' || i AS id, CASE WHEN i % 4 = 3 THEN 'Footnote' ELSE 'Text' END AS category,
    CASE WHEN i % 4 = 3 THEN ((i + length(line)) % 3 + 1) || ' ' || line ELSE line || '¹ and ²' || line || CASE WHEN length(line) % 2 = 0 THEN '¹' ELSE '³' END || ' ²¹' END AS text
  FROM bl WHERE NOT (i % 8 = 1)
  UNION ALL SELECT book, i * 2 + 1, 'r' || i || '/1', 'Text', '³' || line || '¹' FROM bl WHERE i % 8 = 5),
b_refs AS (SELECT book, 'r' || i AS note, k AS nth, 'r' || (i - ((i + k) % 3) - 1) AS block, k::INT AS "at", 1 AS len FROM bl, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE i % 4 = 3),
b_far AS (SELECT book, 'r' || (i + 4) AS note, 9::BIGINT AS nth, 'r' || (i - 3) AS block, 0 AS "at", 2 AS len FROM bl x WHERE i % 4 = 3 AND EXISTS (SELECT 1 FROM bl y WHERE y.book = x.book AND y.i = x.i + 4)),
refs AS (SELECT * FROM b_refs UNION ALL SELECT * FROM b_far),
claims AS (
  SELECT book, 'r' || i AS src, 'r' || i AS heir, i * 2 AS heir_pos FROM bl WHERE i % 4 = 0
  UNION ALL SELECT book, 'r' || i, 'r' || (i - 1), i * 2 - 2 FROM bl WHERE i % 8 = 1
  UNION ALL SELECT book, 'r' || i, 'r' || i, i * 2 FROM bl WHERE i % 8 = 5 UNION ALL SELECT book, 'r' || i, 'r' || i || '/1', i * 2 + 1 FROM bl WHERE i % 8 = 5)
"""


def _bound(spark, d):
    lines = S.table(spark, d, "documents").select(F.col("doc_id").alias("book"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).withColumn("i", F.col("i").cast("long"))
    i, line, size = F.col("i"), F.col("line"), F.char_length("line")
    name = lambda c: F.concat(F.lit("r"), c.cast("string"))
    text = F.when(i % 4 == 3, F.concat(((i + size) % 3 + 1).cast("string"), F.lit(" "), line)).otherwise(F.concat(line, F.lit("¹ and ²"), line, F.when(size % 2 == 0, "¹").otherwise("³"), F.lit(" ²¹")))
    rows = lines.where(i % 8 != 1).select("book", (i * 2).alias("pos"), name(i).alias("id"), F.when(i % 4 == 3, "Footnote").otherwise("Text").alias("category"), text.alias("text"))
    halves = lines.where(i % 8 == 5).select("book", (i * 2 + 1).alias("pos"), F.concat(name(i), F.lit("/1")).alias("id"), F.lit("Text").alias("category"), F.concat(F.lit("³"), line, F.lit("¹")).alias("text"))
    notes = lines.where(i % 4 == 3)
    near = notes.select("book", name(i).alias("note"), i, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("book", "note", F.col("k").cast("long").alias("nth"), name(i - (i + F.col("k")) % 3 - 1).alias("block"), F.col("k").alias("at"), F.lit(1).alias("len"))
    ends = lines.groupBy("book").agg(F.max("i").alias("end"))
    far = notes.join(ends, "book").where(i + 4 <= F.col("end")).select("book", name(i + 4).alias("note"), F.lit(9).cast("long").alias("nth"), name(i - 3).alias("block"), F.lit(0).alias("at"), F.lit(2).alias("len"))
    edited = lines.where((i % 4 == 0) | (i % 8 == 5)).select("book", name(i).alias("id")).unionByName(halves.select("book", "id"))
    sources = lines.where(i % 8 == 1).select("book", name(i - 1).alias("id"), name(i).alias("src"))
    sources = sources.unionByName(lines.where(i % 4 == 0).select("book", name(i).alias("id"), name(i).alias("src"))).unionByName(lines.where(i % 8 == 5).select("book", F.concat(name(i), F.lit("/1")).alias("id"), name(i).alias("src")))
    loose = lines.where(i % 5 == 0).select("book", name(i).alias("block"), F.lit(0).alias("at"), F.lit(1).alias("len"), F.lit(4).alias("printed"))
    orphans = notes.where(i % 8 == 3).select("book", name(i).alias("note"))
    return R.rebind(rows.unionByName(halves), near.unionByName(far), loose, orphans, edited, sources)


#: The claims of each edited row, taken one run after the other with the list of the notes that are taken.
FOLDED = r"""
heirs AS (SELECT book, heir, list(n ORDER BY n.pos) AS notes FROM (
    SELECT DISTINCT c.book, c.heir, {'pos': n.pos, 'id': n.id, 'printed': regexp_extract(n.text, '^([0-9]{1,3})[ \t]', 1)} AS n FROM refs f JOIN claims c ON c.book = f.book AND c.src = f.block JOIN b_rows n ON n.book = f.book AND n.id = f.note) GROUP BY book, heir),
texts AS (SELECT book, id AS heir, regexp_extract_all(text, '[⁰¹²³⁴⁵⁶⁷⁸⁹]+') AS h, regexp_split_to_array(text, '[⁰¹²³⁴⁵⁶⁷⁸⁹]+') AS r FROM b_rows b WHERE category <> 'Footnote' AND EXISTS (SELECT 1 FROM claims c WHERE c.book = b.book AND c.heir = b.id)),
runs AS (SELECT *, len(h) AS n, list_transform(h, lambda x: translate(x, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789')) AS printed FROM texts),
walk AS (
  SELECT book, heir, 0 AS k, []::VARCHAR[] AS taken, NULL::VARCHAR AS note FROM runs
  UNION ALL SELECT book, heir, k, CASE WHEN x IS NULL THEN taken ELSE list_append(taken, x) END, x FROM (
    SELECT w.book, w.heir, w.k + 1 AS k, w.taken, list_filter(coalesce(hh.notes, []), lambda z: z.printed = r.printed[w.k + 1] AND NOT list_contains(w.taken, z.id))[1].id AS x
    FROM walk w JOIN runs r ON r.book = w.book AND r.heir = w.heir LEFT JOIN heirs hh ON hh.book = w.book AND hh.heir = w.heir WHERE w.k < r.n)),
found AS (
  SELECT w.book, w.heir, w.note, r.printed[w.k]::INT AS printed, length(r.h[w.k])::INT AS len,
    (list_sum(list_transform(r.r[1:w.k], lambda x: length(x))) + coalesce(list_sum(list_transform(r.h[1:w.k - 1], lambda x: length(x))), 0))::INT AS "at"
  FROM walk w JOIN runs r ON r.book = w.book AND r.heir = w.heir WHERE w.k > 0)
"""


@query("rebound_refs", rf"""
WITH RECURSIVE {BOUND}, {FOLDED},
met AS (SELECT f.book, f.note, c.heir AS block, min((f.nth, c.heir_pos)) AS place FROM refs f JOIN claims c ON c.book = f.book AND c.src = f.block GROUP BY ALL),
now AS (SELECT m.book, m.note, m.place, m.block, x."at", x.len FROM met m JOIN found x ON x.book = m.book AND x.note = m.note AND x.heir = m.block
  UNION ALL SELECT f.book, f.note, (f.nth, -1), f.block, f."at", f.len FROM refs f WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.book = f.book AND c.src = f.block))
SELECT book, note, (row_number() OVER (PARTITION BY book, note ORDER BY place) - 1)::INT AS nth, block, "at", len FROM now""")
def rebound_refs(spark, d):
    return _bound(spark, d)["refs"]


@query("rebound_loose", rf"""
WITH RECURSIVE {BOUND}, {FOLDED}
SELECT book, heir AS block, "at", len, printed FROM found WHERE note IS NULL
UNION ALL SELECT book, 'r' || i, 0, 1, 4 FROM bl WHERE i % 5 = 0 AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.book = bl.book AND c.src = 'r' || i)""")
def rebound_loose(spark, d):
    return _bound(spark, d)["loose"]


@query("rebound_orphans", rf"""
WITH RECURSIVE {BOUND}, {FOLDED}
SELECT book, 'r' || i AS note FROM bl WHERE i % 8 = 3
UNION SELECT DISTINCT book, note FROM refs f WHERE NOT EXISTS (SELECT 1 FROM found x WHERE x.book = f.book AND x.note = f.note)
  AND NOT EXISTS (SELECT 1 FROM refs g WHERE g.book = f.book AND g.note = f.note AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.book = g.book AND c.src = g.block))""")
def rebound_orphans(spark, d):
    return _bound(spark, d)["orphans"]


# --- stamps and final cleaning ----------------------------------------------------------------------------------------

#: Pages as documents of their host's book; the line break of a paragraph is a page marker.
MARKED = r"""
pg AS (
  SELECT page_id AS doc, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1)) AS book, regexp_replace(html, '<br>', '<span epub:type="pagebreak" title="Page ' || (page_id % 5 + 1) || '"/>', 'g') AS m FROM pages),
cutp AS (SELECT doc, book, m, split_part(m, '<body>', 1) || '<body>' AS head, m[length(split_part(m, '<body>', 1)) + 7:] AS rest FROM pg),
pieces AS (SELECT doc, book, head, regexp_extract_all(rest, '<div class="ad"|<h1|<p') AS h, regexp_split_to_array(rest, '<div class="ad"|<h1|<p') AS r FROM cutp),
each AS (SELECT doc, book, head, r, h, unnest(range(1, len(r) + 1)) AS i FROM pieces),
typed AS (SELECT doc, book, head, i, coalesce(h[i - 1], '') AS tag, r[i] AS after, CASE h[i - 1] WHEN '<h1' THEN 'chapter' ELSE 'text' END AS category, doc % 5 + 1 AS page,
  i > 1 AND NOT (h[i - 1] = '<p' AND contains(r[i], '<b>') AND i < len(r)) AS named, i > list_position(list_transform(r, lambda x: contains(x, 'epub:type="pagebreak"')), true) AS paged FROM each),
counted AS (SELECT *, row_number() OVER (PARTITION BY book, named, paged, CASE WHEN paged THEN page ELSE doc * 10 END ORDER BY doc, i) AS k FROM typed)
"""


def _marked(spark, d):
    mark = F.concat(F.lit('<span epub:type="pagebreak" title="Page '), (F.col("page_id") % 5 + 1).cast("string"), F.lit('"/>'))
    book = F.lower(F.regexp_extract("url", r"\A[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1))
    return S.table(spark, d, "pages").select(book.alias("book"), F.col("page_id").alias("doc"), F.col("page_id").cast("string").alias("token"), F.replace("html", F.lit("<br>"), mark).alias("markup"))


@query("stamped_pages", rf"""
WITH {MARKED}
SELECT doc, sha256(any_value(head) || string_agg(tag || CASE WHEN named THEN CASE WHEN paged THEN ' data-bf-page="' || page || '"' ELSE '' END || ' data-bf-cat="' || category || '" data-bf-id="' || CASE WHEN paged THEN 'p' || page ELSE 'c' || doc END || '-' || k || '"' ELSE '' END || after, '' ORDER BY i)) AS h
FROM counted GROUP BY doc""")
def stamped_pages(spark, d):
    """Every page with its blocks stamped: category, printed page and a name that counts through the book; all else as it was."""
    from ..operators import splice

    return splice.stamp(_marked(spark, d)).select("doc", F.sha2("written", 256).alias("h"))


@query("cleaned_pages", rf"""
WITH c AS (SELECT page_id AS doc, page_id % 3 AS k, html FROM pages),
a AS (SELECT doc, k, CASE WHEN k = 0 THEN html ELSE regexp_replace(html, '<div class="ad">[^<]*</div>', '') END AS m FROM c),
h AS (SELECT doc, k, CASE WHEN k > 0 THEN replace(m, '<h1>', '<h1 data-bf-page="7"><span epub:type="pagebreak" id="pb-7"></span>') ELSE m END AS m FROM a),
f AS (SELECT doc, CASE WHEN k = 1 THEN regexp_replace(m, '(?s)<footer>.*?</footer>', '') ELSE replace(m, '<article>', '<article data-bf-cat="text">') END AS m FROM h)
SELECT doc, sha256(m) AS h FROM f""")
def cleaned_pages(spark, d):
    """Pages of which some parts are marked as cut (the advert, with a page marker in it, and the footer), cleaned."""
    from ..operators import splice

    pages = _marked(spark, d).join(S.table(spark, d, "pages").select(F.col("page_id").alias("doc"), "html"), "doc")
    k, html = F.col("doc") % 3, F.col("html")
    marker = '<span data-bf-cut="" epub:type="pagebreak" data-bf-id="m" id="pb-7"></span>'
    html = F.when(k == 0, html).otherwise(F.regexp_replace(html, '<div class="ad">([^<]*)</div>', f'<div class="ad" data-bf-cut="">$1{marker}</div>'))
    html = F.when(k > 0, F.replace(html, F.lit("<h1>"), F.lit('<h1 data-bf-page="7" data-bf-id="h">'))).otherwise(html)
    html = F.when(k == 1, F.replace(html, F.lit("<footer>"), F.lit("<footer data-bf-cut>"))).otherwise(F.replace(html, F.lit("<article>"), F.lit('<article data-bf-id="x" data-bf-cat="text">')))
    docs = pages.select("book", "doc", F.concat("token", F.lit(".xhtml")).alias("path"), html.alias("markup"))
    written, _ = splice.final(docs)
    return written.select("doc", F.sha2("written", 256).alias("h"))
