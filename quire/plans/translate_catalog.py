"""Queries of tables, of signs for markup and of blocks to translate, each beside the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, masks, sites
from . import standins as S
from .catalog import query

# --- tables -----------------------------------------------------------------------------------------------------------


@query("table_grids", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS y FROM documents),
r AS (SELECT doc_id, y, max(y) OVER (PARTITION BY doc_id) AS n, string_split(line, ' ') AS ws FROM l),
c AS (SELECT doc_id, y, n, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM r),
s AS (SELECT doc_id, y, n, k, w, 1 + length(w) % 3 AS across, CASE WHEN y % 3 = 1 AND k = 1 THEN 2 ELSE 1 END AS down FROM c),
o AS (SELECT doc_id, y + 1 AS y, across AS taken FROM s WHERE down = 2),
p AS (SELECT s.*, coalesce(o.taken, 0) AS taken, coalesce(o.taken, 0) + sum(across) OVER (PARTITION BY s.doc_id, s.y ORDER BY k) - across AS col FROM s LEFT JOIN o USING (doc_id, y)),
w AS (SELECT doc_id, y, max(col + across) AS width FROM p GROUP BY ALL)
SELECT p.doc_id, max(n)::INT AS n_rows, (SELECT max(w.width) FROM w WHERE w.doc_id = p.doc_id)::INT AS columns, (SELECT min(w.width) = max(w.width) FROM w WHERE w.doc_id = p.doc_id) AS grid,
  count(*) AS cells, sum((y - 1) * 7 + col * 31 + across * 101 + down * 1009)::BIGINT AS places, sum(length(trim(w, chr(160) || ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(65279) || chr(12288))))::BIGINT AS chars, count(*) FILTER (WHERE y = 1) AS heads
FROM p GROUP BY p.doc_id""")
def table_grids(spark, d):
    """Documents as tables: a line a row, a word a cell as wide as its length says; of every third row the first cell covers two."""
    escape = lambda w: F.replace(F.replace(w, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda y: F.when(y == 0, "th").otherwise("td")
    cell = lambda y: lambda w, k: F.concat(F.lit("<"), tag(y), F.lit(' colspan="'), (F.char_length(w) % 3 + 1).cast("string"), F.when((y % 3 == 0) & (k == 0), '" rowspan="2">').otherwise('">'), escape(w), F.lit("</"), tag(y), F.lit(">"))
    row = lambda line, y: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.split(line, " ", -1), cell(y)), ""), F.lit("</tr>"))
    markup = F.concat(F.lit("<table>"), F.array_join(F.transform(F.split("text", "\n", -1), row), ""), F.lit("</table>"))
    found = grid.tables(S.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), markup.alias("markup")))
    total = lambda f: F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + f(c))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("rows").alias("n_rows"), "columns", "grid", F.size("cells").cast("long").alias("cells"),
        total(lambda c: c["row"] * 7 + c["col"] * 31 + c["colspan"] * 101 + c["rowspan"] * 1009).alias("places"), total(lambda c: F.char_length(c["text"])).alias("chars"), total(lambda c: c["header"].cast("long")).alias("heads"),
    )


# --- signs ------------------------------------------------------------------------------------------------------------

#: What is wrong with the answer to a line, by its number modulo 9; null: it is sound, with its signs moved.
FAULTS = {1: "missing", 2: "repeated", 3: "crossed", 4: "never opened", 5: "unclosed", 6: "closed", 7: "invented"}


def _marked_lines(spark, d):
    """Each line as a block: a page marker before it, the line with an emphasis and a reference within it."""
    ls = S.lines(spark, d)
    safe = F.replace(F.replace("line", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    inner = F.concat(F.lit('<span id="p"/><em class="x">'), safe, F.lit('</em> and <a href="#n"><sup>1</sup></a>end'))
    done = masks.masked_parts(ls.select("doc_id", "pos", "line", F.array(inner).alias("parts")), "parts").select("doc_id", "pos", "line", F.inline("parts"))
    k, t = F.col("pos") % 9, F.col("text")
    swap = lambda a, b: F.replace(t, F.lit(a), F.lit(b))
    answer = (
        F.when(k == 1, swap("⟦m2⟧", ""))
        .when(k == 2, F.concat(t, F.lit("⟦m2⟧")))
        .when(k == 3, F.concat(t, F.lit("⟦e2⟧⟦e3⟧⟦/e2⟧⟦/e3⟧")))
        .when(k == 4, F.concat(F.lit("⟦/e1⟧"), t))
        .when(k == 5, swap("⟦/e1⟧", ""))
        .when(k == 6, F.concat(t, F.lit("⟦/m2⟧")))
        .when(k == 7, F.concat(t, F.lit("⟦e9⟧")))
        .otherwise(F.concat(F.lit("⟦m2⟧: "), swap("⟦m2⟧", "")))
    )
    # the answer that crosses has two more pairs that were sent
    more = lambda c, extra: F.when(k == 3, F.concat(c, F.array(*[F.lit(x) for x in extra]))).otherwise(F.col(c))
    return done.withColumn("answer", answer).withColumns({"ids": more("ids", ("e2", "e3")), "opens": more("opens", ("<b>", "<i>")), "shuts": more("shuts", ("</b>", "</i>"))})


@query("marked_answers", rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
e AS (SELECT *, replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS s, pos % 9 AS k, '<a href="#n"><sup>1</sup></a>' AS a FROM l),
h AS (SELECT *, '<em class="x">' || s || CASE WHEN k = 5 THEN '' ELSE '</em>' END || ' and ' || CASE WHEN k IN (0, 1, 8) THEN '' ELSE a END || 'end' AS b FROM e)
SELECT doc_id, pos::INT AS pos, CASE k {" ".join(f"WHEN {k} THEN '{v}'" for k, v in FAULTS.items())} END AS reason,
  sha256('<span id="p"/>' || CASE WHEN k IN (0, 8) THEN a || ': ' || b WHEN k IN (2, 6) THEN b || a WHEN k = 3 THEN b || '<b><i></b></i>' WHEN k = 4 THEN '</em>' || b ELSE b END) AS h
FROM h""")
def marked_answers(spark, d):
    """Each line masked, answered in one of nine ways, checked, and put back."""
    m = _marked_lines(spark, d)
    fault = masks.complaint(F.col("ids"), F.transform("shuts", lambda s: s.isNull()), F.col("answer"))
    text = F.concat("leading", masks.restored(F.col("ids"), F.col("opens"), F.col("shuts"), F.col("answer")), "trailing")
    return m.select("doc_id", F.col("pos").cast("int").alias("pos"), fault["reason"].alias("reason"), F.sha2(text, 256).alias("h"))


# --- blocks to translate ----------------------------------------------------------------------------------------------


def _stamped_pages(spark, d):
    """Pages with stamps: the menu as a list, the head, the paragraphs; every third page's advert is a picture, every fifth
    page's footer a table of one cell, or, if its number is even, a table with another in it."""
    put = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    m = put(put(F.col("html"), "<ul>", '<ul data-bf-cat="list-item">'), "<li>", '<li data-bf-cat="list-item">')
    m = put(put(m, "<h1>", '<h1 data-bf-cat="title">'), "<p>", '<p data-bf-cat="text">')
    m = F.when(F.col("page_id") % 3 == 0, put(m, '<div class="ad">', '<div class="ad" data-bf-cat="picture">')).otherwise(m)
    inner = F.when(F.col("page_id") % 2 == 0, "<table></table>").otherwise("")
    table = F.replace(F.replace(m, F.lit("<footer>"), F.lit('<div data-bf-cat="table"><table><tr><td>')), F.lit("</footer>"), F.concat(inner, F.lit("</td></tr></table></div>")))
    return S.table(spark, d, "pages").select(F.col("page_id").alias("doc"), F.when(F.col("page_id") % 5 == 0, table).otherwise(m).alias("markup"))


#: A paragraph that is not closed holds the next ones, unless it is the last: it is no block then.
PAGES = r"""
pg AS (SELECT page_id AS doc, html, string_split(html, '<p>') AS ps, CASE WHEN page_id % 5 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'bad' ELSE 'good' END END AS tab, CASE WHEN page_id % 3 = 0 THEN len(regexp_extract_all(html, '<div class="ad">')) ELSE 0 END AS ads,
  contains(html, '</footer>') AS shut FROM pages),
pieces AS (SELECT doc, len(ps) AS n, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM pg),
paras AS (SELECT doc, count(*) AS n FROM pieces WHERE i > 1 AND NOT (starts_with(p, '<b>') AND i < n) GROUP BY doc)
"""


@query("blocks_to_translate", rf"""
WITH {PAGES}
SELECT doc, 'list' AS kind, len(regexp_extract_all(html, '<li>')) AS parts FROM pg WHERE contains(html, '<li>')
UNION ALL SELECT doc, 'single', len(regexp_extract_all(html, '<h1>')) + coalesce(n, 0) FROM pg LEFT JOIN paras USING (doc) WHERE contains(html, '<h1>') OR n > 0
UNION ALL SELECT doc, 'table', 1 FROM pg WHERE tab = 'good' AND contains(html, '<footer>')
UNION ALL SELECT doc, 'skipped picture', ads FROM pg WHERE ads > 0
UNION ALL SELECT doc, 'skipped table', 1 FROM pg WHERE tab = 'bad' AND shut
UNION ALL SELECT doc, 'table', 1 FROM pg WHERE tab = 'bad' AND NOT shut AND contains(html, '<footer>')""")
def blocks_to_translate(spark, d):
    """Parts of each kind, and stamps left aside, of every page."""
    found, skipped, _ = sites.find_blocks(_stamped_pages(spark, d))
    kinds = found.groupBy("doc", "kind").agg(F.count(F.lit(1)).alias("parts"))
    return kinds.unionByName(skipped.select("doc", F.concat(F.lit("skipped "), F.col("category")).alias("kind"), F.col("n").alias("parts")))


@query("answered_pages", r"""
WITH pg AS (SELECT page_id AS doc, replace(replace(replace(replace(html, '<ul>', '<ul data-bf-cat="list-item">'), '<li>', '<li data-bf-cat="list-item">'), '<h1>', '<h1 data-bf-cat="title">'), '<p>', '<p data-bf-cat="text">') AS m, page_id FROM pages),
ad AS (SELECT doc, CASE WHEN doc % 3 = 0 THEN replace(m, '<div class="ad">', '<div class="ad" data-bf-cat="picture">') ELSE m END AS m FROM pg),
tb AS (SELECT doc, CASE WHEN doc % 5 = 0 THEN replace(replace(m, '<footer>', '<div data-bf-cat="table"><table><tr><td>'), '</footer>', CASE WHEN doc % 2 = 0 THEN '<table></table>' ELSE '' END || '</td></tr></table></div>') ELSE m END AS m FROM ad),
a AS (SELECT doc, regexp_replace(m, '(<h1 data-bf-cat="title">)([^<]*</h1>)', '\1~ \2', 'g') AS m FROM tb),
b AS (SELECT doc, regexp_replace(m, '(<p data-bf-cat="text">)([^<]*</p>)', '\1~ \2', 'g') AS m FROM a)
SELECT doc, sha256(replace(m, '&quot;', '"')) AS h FROM b""")
def answered_pages(spark, d):
    """Pages in which a sign stands before every head and closed paragraph; all that is not answered stays as it was. Quotes are
    compared as signs, as text that is put back does not escape them."""
    docs = _stamped_pages(spark, d)
    found, _, _ = sites.find_blocks(docs)
    masked = sites.masked_sites(docs, found.where("kind = 'single'"))
    answers = masked.where("refused is null and size(ids) = 0").select("doc", "id", F.concat(F.lit("~ "), F.col("text")).alias("answer"))
    written, _ = sites.rewritten(docs, masked, answers)
    return written.select("doc", F.sha2(F.replace("written", F.lit("&quot;"), F.lit('"')), 256).alias("h"))
