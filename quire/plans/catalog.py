"""All named queries of the reference operators, each beside the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import blocks as B
from ..operators import cap, flow, ledger, markup, notes, replay, runaway, sweep, translate
from . import standins as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("runaway_documents", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}'']+') AS w FROM documents WHERE length(text) >= 800),
p AS (SELECT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS p FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM w WHERE len(w) >= 20)),
c AS (SELECT doc_id, p, count(*) AS n FROM p GROUP BY ALL)
SELECT doc_id, max(n) AS top, sum(n)::BIGINT AS total, max(n) / sum(n) >= 0.15 AS flagged FROM c GROUP BY doc_id""")
def runaway_documents(spark, d):
    return runaway.phrase_shares(S.table(spark, d, "documents"))


@query("emptied_pages", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}'']+') AS w FROM documents WHERE length(text) >= 800),
p AS (SELECT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS p FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM w WHERE len(w) >= 20)),
c AS (SELECT doc_id, p, count(*) AS n FROM p GROUP BY ALL),
bad AS (SELECT doc_id FROM c GROUP BY doc_id HAVING max(n) / sum(n) >= 0.15)
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM bad) THEN 0 ELSE length(text) END::BIGINT AS n FROM documents""")
def emptied_pages(spark, d):
    return runaway.emptied(S.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.char_length("text").cast("long").alias("n"))


@query("category_counts", f"WITH {S.BLOCKS} SELECT book, category, count(*) AS n FROM blocks GROUP BY ALL")
def category_counts(spark, d):
    return B.category_counts(S.blocks(spark, d))


@query("page_extents", f"WITH {S.BLOCKS} SELECT book, page, max(x2) AS x2, max(y2) AS y2 FROM blocks GROUP BY ALL")
def page_extents(spark, d):
    return B.page_extents(S.blocks(spark, d))


@query("merged_boxes", f"WITH {S.BLOCKS} SELECT book, page, arg_min(y1, ord) AS first_y1, sum(y2 - y1) AS flow_height, min(x1) AS x1, max(x2) AS x2, min(y1) AS y1, max(y2) AS y2 FROM blocks GROUP BY book, page")
def merged_boxes(spark, d):
    return B.merged_boxes(S.blocks(spark, d))


MEDIAN = "list_sort(list({x}))[len(list({x})) // 2 + 1]"


@query("body_column", f"""
WITH {S.BLOCKS}, g AS (SELECT book, list_sort(list(x1) FILTER (category = 'Text' AND x2 - x1 > page_width / 2)) AS a,
  list_sort(list(x2) FILTER (category = 'Text' AND x2 - x1 > page_width / 2)) AS b, arg_min(page_width, page) AS w FROM blocks GROUP BY book)
SELECT book, coalesce(a[len(a) // 2 + 1], 0) AS body_x1, coalesce(b[len(b) // 2 + 1], w) AS body_x2 FROM g""")
def body_column(spark, d):
    return B.body_column(S.blocks(spark, d))


BODY = r"""
body AS (SELECT book, coalesce(list_sort(list(px) FILTER (m))[len(list(px) FILTER (m)) // 2 + 1], list_sort(list(px))[len(list(px)) // 2 + 1]) AS body_px
  FROM (SELECT book, px, (x2 - x1) / page_width > 0.5 AND length(text) > 90 AS m FROM sized WHERE category = 'Text' AND px > 0) GROUP BY book)
"""


@query("body_size", f"WITH {S.BLOCKS}, {S.SIZED}, {BODY} SELECT book, body_px FROM body")
def body_size(spark, d):
    return B.body_size(S.blocks(spark, d))


@query("typography_ratios", f"""
WITH {S.BLOCKS}, {S.SIZED}, {BODY},
m AS (SELECT book, category, count(*) AS samples, list_sort(list(px))[count(*) // 2 + 1] AS px FROM sized WHERE category <> 'Picture' GROUP BY ALL HAVING count(*) >= 4)
SELECT m.book, category, samples, round(greatest(0.5, least(3.0, px / body_px)), 6) AS ratio FROM m JOIN body USING (book)""")
def typography_ratios(spark, d):
    return B.typography(S.blocks(spark, d))


@query("alignment_classes", f"""
WITH {S.BLOCKS}, g AS (SELECT book, list_sort(list(x1) FILTER (category = 'Text' AND x2 - x1 > page_width / 2)) AS a,
  list_sort(list(x2) FILTER (category = 'Text' AND x2 - x1 > page_width / 2)) AS b, arg_min(page_width, page) AS w FROM blocks GROUP BY book),
c AS (SELECT book, coalesce(a[len(a) // 2 + 1], 0) AS b1, coalesce(b[len(b) // 2 + 1], w) AS b2 FROM g),
s AS (SELECT book, (x1 - b1) / greatest(1, b2 - b1) AS l, (b2 - x2) / greatest(1, b2 - b1) AS r FROM blocks JOIN c USING (book))
SELECT book, CASE WHEN l > 0.06 AND r > 0.06 AND abs(l - r) < 0.4 * greatest(l, r) THEN 'center' WHEN l > 0.45 AND r < 0.03 THEN 'right' ELSE '' END AS align, count(*) AS n
FROM s GROUP BY ALL""")
def alignment_classes(spark, d):
    b = S.blocks(spark, d)
    both = b.join(B.body_column(b), "book")
    return both.groupBy("book", G.alignment_class(F.col("x1"), F.col("x2"), F.col("body_x1"), F.col("body_x2")).alias("align")).agg(F.count(F.lit(1)).alias("n"))


HEADS = rf"""
{S.BLOCKS}, {S.SIZED}, {BODY},
keyed AS (SELECT *, CASE WHEN y1 / page_height < 0.15 THEN 'head' WHEN y2 / page_height > 0.85 THEN 'foot' END AS band FROM sized
  WHERE regexp_matches(key, '[A-Z]') AND length(text) < 80),
k2 AS (SELECT *, category IN ('Page-header', 'Page-footer') AS tagged, category IN ('Title', 'Section-header', 'Text') AS loose FROM keyed WHERE band IS NOT NULL),
pb AS (SELECT book, key, band, count(DISTINCT page) AS pages, max(tagged) AS tagged_here FROM k2 WHERE tagged OR loose GROUP BY ALL HAVING count(DISTINCT page) >= 3),
pk AS (SELECT book, key, max(tagged) AS tagged_any, max(px > 1.25 * body_px) AS large, max(body_px) AS body_px FROM k2 LEFT JOIN body USING (book) GROUP BY ALL),
heads AS (SELECT book, page, ord, band, CASE WHEN tagged_here THEN 'tagged' WHEN NOT tagged_any AND category IN ('Title', 'Section-header') AND body_px IS NOT NULL AND NOT coalesce(large, false) THEN 'body-sized' END AS evidence
  FROM k2 JOIN pb USING (book, key, band) JOIN pk USING (book, key) WHERE loose)
"""


@query("running_heads", f"WITH {HEADS} SELECT * FROM heads WHERE evidence IS NOT NULL")
def running_heads(spark, d):
    return B.running_heads(S.blocks(spark, d))


@query("without_running_heads", f"WITH {HEADS} SELECT book, page, ord, category FROM blocks ANTI JOIN (SELECT * FROM heads WHERE evidence IS NOT NULL) USING (book, page, ord)")
def without_running_heads(spark, d):
    return B.without_running_heads(S.blocks(spark, d)).select("book", "page", "ord", "category")


@query("lexicon_words", f"WITH {S.BLOCKS} SELECT DISTINCT book, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+(?:-[a-zà-ÿ]+)*')) AS word FROM blocks")
def lexicon_words(spark, d):
    return B.lexicon(S.blocks(spark, d))


@query("furniture_keys", f"WITH {S.BLOCKS}, {S.SIZED} SELECT book, key, count(DISTINCT page) AS pages FROM sized WHERE length(text) < 80 GROUP BY ALL")
def furniture_keys(spark, d):
    return S.blocks(spark, d).where(F.char_length("text") < 80).groupBy("book", X.furniture_key(F.col("text")).alias("key")).agg(F.count_distinct("page").alias("pages"))


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Blocks of one line, as the stand-ins have them.
KINDS = rf"""
kb AS (SELECT *, category IN ('Title', 'Section-header') AS disp, category NOT IN ('Title', 'Section-header', 'Picture') AS prose, trim(translate(text, '*_', '  '), {BLANKS}) AS bare,
  len(list_filter(regexp_split_to_array(translate(text, '*_', '  '), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS words, abs((x1 + x2) / 2 / page_width - 0.5) < 0.06 AS center FROM blocks WHERE category NOT IN ('Page-header', 'Page-footer')),
kc AS (SELECT *, disp AND regexp_matches(bare, '(?i)^(table of )?contents$') AS heading, category <> 'Picture' AND words BETWEEN 1 AND 8 AS short,
  disp AND regexp_matches(bare, '(?i)^[ivxlcdm]') AND regexp_matches(bare, '(?i)^m{{0,3}}(cm|cd|d?c{{0,3}})(xc|xl|l?x{{0,3}})(ix|iv|v?i{{0,3}})\.?$') AS numeral FROM kb),
kf AS (SELECT book, page, count(*) FILTER (disp) AS displays, count(*) AS n, coalesce(sum(words) FILTER (prose), 0)::BIGINT AS words, count(*) FILTER (disp AND NOT center) AS off, bool_or(heading) AS contents,
  count(*) FILTER (NOT heading AND bare <> '' AND length(bare) <= 100 AND regexp_matches(bare, '[^0-9\s]\s*[,.]?\s*[0-9]{{1,4}}[.,]?$')) AS entries,
  bool_or(disp AND regexp_matches(bare, '(?i)^(part|book|section|volume)\s+([ivxlcdm]+|[0-9]{{1,2}}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\b')) AS part,
  bool_or(numeral) AS numeral, count(*) FILTER (short) - coalesce(arg_min(short::INT, ord) FILTER (numeral), 0) AS others, max(prose AND words >= 25)::INT AS body,
  bool_or(regexp_matches(text, '(?i)©|\bcopyright\b'))::INT + bool_or(regexp_matches(text, '(?i)\bISBN\b'))::INT + bool_or(regexp_matches(text, '(?i)all rights reserved'))::INT + bool_or(regexp_matches(text, '(?i)library of congress'))::INT
    + bool_or(regexp_matches(trim(text), '^[0-9 ]+$') AND length(regexp_replace(text, '[^0-9]', '', 'g')) >= 5)::INT AS marks FROM kc GROUP BY book, page),
kp AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page) <= 6 AS front, page < max(page) FILTER (body = 1) OVER (PARTITION BY book) AS follows FROM kf),
kinds AS (SELECT book, page, CASE WHEN contents AND entries >= 3 THEN 'contents' WHEN front AND displays = 0 AND marks >= 2 THEN 'copyright'
  WHEN front AND displays >= 1 AND n <= 8 AND words <= 12 AND off = 0 THEN 'title-page' WHEN NOT front AND follows AND n <= 6 AND words <= 12 AND (part OR (numeral AND others >= 1)) THEN 'part' END AS kind, displays, words, body FROM kp)
"""


@query("page_kinds", f"WITH {S.BLOCKS}, {KINDS} SELECT * FROM kinds")
def page_kinds(spark, d):
    return B.page_kinds(S.blocks(spark, d))


CHAPTERS = rf"""
{S.BLOCKS}, live AS (SELECT * FROM blocks WHERE category NOT IN ('Page-header', 'Page-footer')),
first AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY book, page ORDER BY ord) = 1),
bare AS (SELECT book, page, ord, regexp_extract(text, '[0-9]+')::INT AS v FROM live WHERE category IN ('Title', 'Section-header') AND regexp_matches(trim(text), '^[0-9]{{1,3}}\.?$')),
marked AS (SELECT book FROM (SELECT book, v <= lag(v) OVER (PARTITION BY book ORDER BY page, ord) AS back FROM bare) GROUP BY book HAVING count(*) >= 2 AND max(back)),
chapters AS (SELECT book, page, ord::INT AS ord, text AS label, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)^(chapter|part|book|prologue|epilogue|introduction|preface|foreword|acknowledg|conclusion|afterword|appendix|notes|bibliography|index)\b|^[IVXLC]+\.?$|^[0-9]{{1,2}}\.?$') THEN 'chapterish-text' END,
  CASE WHEN category = 'Title' THEN 'title-class' END, CASE WHEN abs((x1 + x2) / 2 / page_width - 0.5) < 0.06 THEN 'centered' END) AS why
  FROM first WHERE category IN ('Title', 'Section-header') AND length(text) < 80 AND y1 / page_height <= 0.45 AND NOT (book IN (SELECT book FROM marked) AND regexp_matches(trim(text), '^[0-9]{{1,3}}\.?$')))
"""


@query("chapter_proposals", f"WITH {CHAPTERS} SELECT * FROM chapters WHERE why <> ''")
def chapter_proposals(spark, d):
    return B.chapter_proposals(S.blocks(spark, d))


@query("section_starts", f"""
WITH {CHAPTERS}, {KINDS}, named AS (SELECT book, page, kind, NULL::VARCHAR AS label, kind AS why, 0 AS rank FROM kinds WHERE kind IS NOT NULL),
later AS (SELECT book, kind, min(CASE WHEN body > 0 OR displays > 0 THEN page END) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS close FROM kinds),
every AS (SELECT * FROM named UNION ALL SELECT book, page, 'chapter', label, why, 1 FROM chapters WHERE why <> '' AND NOT EXISTS (SELECT 1 FROM named n WHERE n.book = chapters.book AND n.page = chapters.page)
  UNION ALL SELECT book, close, NULL, '', '', 2 FROM later WHERE kind IS NOT NULL AND close IS NOT NULL)
SELECT book, page, kind, label, why FROM every QUALIFY row_number() OVER (PARTITION BY book, page ORDER BY rank) = 1""")
def section_starts(spark, d):
    return B.section_starts(S.blocks(spark, d))


@query("section_spans", f"""
WITH {CHAPTERS}, pages AS (SELECT book, page, count(*) AS n FROM blocks GROUP BY ALL),
s AS (SELECT p.book, p.page, n, sum(CASE WHEN c.page IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.book ORDER BY p.page) AS section
  FROM pages p LEFT JOIN (SELECT DISTINCT book, page FROM chapters WHERE why <> '') c ON p.book = c.book AND p.page = c.page)
SELECT book, section::BIGINT AS section, min(page) AS first_page, sum(n)::BIGINT AS blocks FROM s GROUP BY book, section""")
def section_spans(spark, d):
    b = S.blocks(spark, d)
    return B.section_spans(b, B.chapter_proposals(b))


@query("folded_sections", f"""
WITH {CHAPTERS}, n AS (SELECT book, page AS section, label AS name, regexp_replace(regexp_replace(upper(label), '[^A-Z0-9]', '', 'g'), '[0-9]+', '#', 'g') AS key, (page % 2)::INT AS body FROM chapters WHERE why <> '')
SELECT book, section, name, body, coalesce(key <> '' AND body = 0 AND key = lag(key) OVER (PARTITION BY book ORDER BY section), false) AS folded FROM n""")
def folded_sections(spark, d):
    c = B.chapter_proposals(S.blocks(spark, d)).select("book", F.col("page").alias("section"), F.col("label").alias("name"), (F.col("page") % 2).cast("int").alias("body"))
    return B.folded_sections(c)


@query("body_follows", f"""
WITH {S.BLOCKS}, p AS (SELECT book, page, max(length(text) > 300)::INT AS body FROM blocks GROUP BY ALL)
SELECT book, page, coalesce(max(body) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) = 1, false) AS follows FROM p""")
def body_follows(spark, d):
    pages = S.blocks(spark, d).groupBy("book", "page").agg(F.max((F.char_length("text") > 300).cast("int")).alias("body"))
    return B.body_follows(pages)


@query("section_marks_all", r"""
WITH b AS (SELECT source AS book, doc_id AS page, (doc_id * 7 % 30) AS v FROM documents),
l AS (SELECT book, v <= lag(v) OVER (PARTITION BY book ORDER BY page) AS back FROM b)
SELECT book, count(*) AS numbers, coalesce(max(back), false)::INT AS restarts FROM l GROUP BY book""")
def section_marks_all(spark, d):
    """section_marks over every document."""
    docs = S.table(spark, d, "documents")
    return B.section_marks(docs.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.lit(0).alias("ord"), F.lit("Title").alias("category"), (F.col("doc_id") * 7 % 30).cast("string").alias("text")))


#: White space that JSON texts are trimmed of, as SQL.
WIDE = " || ".join(f"chr({ord(c)})" for c in X.WIDE_BLANK)


@query("parsed_answers", rf"""
WITH a AS (SELECT source AS book, doc_id AS page, doc_id % 13 AS odd, len(string_split(text, chr(10))) AS size, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents),
e AS (
  SELECT book, page, odd, size, ord, CASE WHEN odd = 3 THEN 'Nonsense' ELSE 'Text' END AS category, CASE WHEN odd = 5 AND ord % 3 = 0 THEN '' ELSE trim(line, {WIDE}) END AS text, CASE WHEN odd = 6 AND ord % 5 = 2 THEN 0.0 ELSE ord END AS y1 FROM a
  WHERE odd NOT IN (4, 10)
  UNION ALL SELECT DISTINCT book, page, odd, size, CASE WHEN odd = 9 THEN size END, NULL, '', NULL FROM a WHERE odd IN (4, 9, 10))
SELECT book, page, ord::INT AS ord, category, y1::DOUBLE AS y1, length(text)::BIGINT AS n, odd IN (3, 4, 9, 10) OR (odd = 6 AND size > 2) AS bad,
  CASE WHEN odd = 3 THEN 'category' WHEN odd IN (4, 10) THEN 'no array' WHEN odd = 9 THEN 'no element' WHEN odd = 6 AND size > 2 THEN 'box' END AS why
FROM e WHERE odd IN (3, 4, 9, 10) OR (odd = 6 AND size > 2) OR text <> ''""")
def parsed_answers(spark, d):
    """Every document as a page's answer, one element a line; some are no array, or hold numbers for texts, strings for numbers,
    a fence, an unknown category or a null."""
    odd = F.col("doc_id") % 13
    ls = S.table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.split("text", "\n", -1).alias("ls"), odd.alias("odd"))

    def element(s, i):
        quoted = F.to_json(F.array(s))
        number = i.cast("string")
        box = F.when((F.col("odd") == 6) & (i % 5 == 2), '["1",0,9,1]').otherwise(F.concat(F.lit("[1,"), number, F.lit(",9.5,"), (i + 1).cast("string"), F.lit("]")))
        text = F.when((F.col("odd") == 5) & (i % 3 == 0), number).otherwise(F.substring(quoted, F.lit(2), F.char_length(quoted) - 2))
        return F.concat(F.lit('{"bbox":'), box, F.lit(',"category":"'), F.when(F.col("odd") == 3, "Nonsense").otherwise("Text"), F.lit('","text":'), text, F.lit("}"))

    items = F.transform("ls", element)
    whole = F.concat(F.lit("["), F.array_join(items, ","), F.when(F.col("odd") == 9, ",null]").otherwise("]"))
    answer = F.when(F.col("odd") == 4, items[0]).when(F.col("odd") == 8, F.concat(F.lit("```json\n"), whole, F.lit("\n```\n"))).when(F.col("odd") == 10, F.concat(whole, F.lit(" and more"))).otherwise(whole)
    return B.parse_answers(ls.select("book", "page", answer.alias("answer"))).select("book", "page", "ord", "category", "y1", F.char_length("text").cast("long").alias("n"), "bad", "why")


@query("reflow_wrapped", r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents),
f AS (SELECT doc_id, text, len(ls) > 1 AND len(list_filter(ls, lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '')) = 0 AND len(list_filter(ls[1 : len(ls) - 1], lambda s: length(s) < 45)) = 0
  AND NOT (len(ls) - 1 >= 3 AND len(list_filter(ls[1 : len(ls) - 1], lambda s: NOT regexp_matches(rtrim(s), '[.!?]["''*”’)]?$'))) = 0) AS wrapped FROM d)
SELECT doc_id, wrapped, sha256(CASE WHEN wrapped THEN regexp_replace(text, '[ \t]*\n[ \t]*', ' ', 'g') ELSE text END) AS h FROM f""")
def reflow_wrapped(spark, d):
    return S.table(spark, d, "documents").select("doc_id", X.wrapped_prose(F.col("text")).alias("wrapped"), F.sha2(X.reflowed(F.col("text")), 256).alias("h"))


@query("text_functions_lines", r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS t FROM documents)
SELECT doc_id, pos::INT AS pos, length(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;'))::BIGINT AS escaped,
  len(list_filter(regexp_split_to_array(translate(t, '*_', '  '), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS words, greatest(128, ceil(length(t) * 4 / 2.5))::BIGINT AS budget,
  greatest(1, length(trim(regexp_replace(t, '[ \t\n]+', ' ', 'g'))))::BIGINT AS weight, sha256(t || chr(0) || doc_id::VARCHAR) AS key, substring(sha256(t), 1, 16) AS short,
  regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM l""")
def text_functions_lines(spark, d):
    """text_functions over every line of a document."""
    t = S.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "t"))
    c = F.col("t")
    return t.select("doc_id", "pos", F.char_length(X.escape_xml(c)).cast("long").alias("escaped"), X.word_count(c).alias("words"), X.answer_budget(c).alias("budget"), X.text_weight(c).alias("weight"), X.bank_key(c, F.col("doc_id").cast("string")).alias("key"), X.short_sha(c).alias("short"), X.slug(c).alias("slug"))


@query("paragraph_starts", f"""
WITH {S.FLOW}, f AS (SELECT *, category = 'Text' AS ok, lag(page) OVER w AS pp, lag(text) OVER w AS pt, lag(category = 'Text') OVER w AS pok FROM flow WHERE category <> 'Footnote' WINDOW w AS (PARTITION BY book ORDER BY page, ord)),
j AS (SELECT *, coalesce(ok AND pok AND page - pp IN (0, 1) AND right(rtrim(pt), 1) NOT IN ('.', '!', '?', ':', '"', '”') AND upper(substring(text, 1, 1)) <> substring(text, 1, 1), false) AS joins FROM f)
SELECT book, ord, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY page, ord)::BIGINT AS para FROM j""")
def paragraph_starts(spark, d):
    return flow.paragraph_starts(S.flow(spark, d)).select("book", "ord", "para")


@query("flow_paragraphs", f"""
WITH {S.FLOW}, f AS (SELECT *, category = 'Text' AS ok, lag(page) OVER w AS pp, lag(text) OVER w AS pt, lag(category = 'Text') OVER w AS pok FROM flow WHERE category <> 'Footnote' WINDOW w AS (PARTITION BY book ORDER BY page, ord)),
j AS (SELECT *, coalesce(ok AND pok AND page - pp IN (0, 1) AND right(rtrim(pt), 1) NOT IN ('.', '!', '?', ':', '"', '”') AND upper(substring(text, 1, 1)) <> substring(text, 1, 1), false) AS joins FROM f),
n AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY page, ord)::BIGINT AS para FROM j),
q AS (SELECT *, lag(text) OVER (PARTITION BY book, para ORDER BY page, ord) AS before FROM n),
t AS (SELECT *, regexp_extract(rtrim(before), '([A-Za-zÀ-ÿ]+)-$', 1) AS stem, regexp_extract(text, '^[A-Za-zÀ-ÿ]+') AS word FROM q),
lex AS (SELECT DISTINCT book, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+(?:-[a-zà-ÿ]+)*')) AS known FROM flow),
d AS (SELECT t.*, CASE WHEN before IS NULL THEN 'first' WHEN coalesce(stem, '') = '' OR word = '' THEN 'space' WHEN a.known IS NOT NULL OR (b.known IS NULL AND lower(substring(text, 1, 1)) = substring(text, 1, 1)) THEN 'fuse' ELSE 'keep' END AS how
  FROM t LEFT JOIN lex a ON a.book = t.book AND a.known = lower(stem || word) AND stem <> '' AND word <> '' LEFT JOIN lex b ON b.book = t.book AND b.known = lower(stem || '-' || word) AND stem <> '' AND word <> ''),
x AS (SELECT *, lead(how) OVER (PARTITION BY book, para ORDER BY page, ord) AS next FROM d)
SELECT book, para, min(page)::INT AS page, count(*) AS n_blocks, string_agg(CASE WHEN how = 'space' THEN ' ' ELSE '' END || CASE next WHEN 'fuse' THEN rtrim(text)[1:-2] WHEN 'keep' THEN rtrim(text) ELSE text END, '' ORDER BY page, ord) AS text FROM x GROUP BY book, para""")
def flow_paragraphs(spark, d):
    return flow.flow_paragraphs(S.flow(spark, d))


@query("unjoined_seams", f"""
WITH {S.FLOW}, f AS (SELECT *, lag(page) OVER w AS pp, lag(text) OVER w AS pt FROM flow WHERE category = 'Text' WINDOW w AS (PARTITION BY book ORDER BY page, ord))
SELECT book, page::INT AS page FROM f WHERE page - pp = 1 AND NOT (right(rtrim(pt), 1) NOT IN ('.', '!', '?', ':', '"', '”') AND upper(substring(text, 1, 1)) <> substring(text, 1, 1))""")
def unjoined_seams(spark, d):
    return flow.seams(S.flow(spark, d))


@query("merged_headings", rf"""
WITH RECURSIVE {S.BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY ord) AS rn FROM blocks WHERE category NOT IN ('Page-header', 'Page-footer')),
h AS (SELECT *, rn - row_number() OVER (PARTITION BY book, page ORDER BY ord) AS run FROM r WHERE category IN ('Title', 'Section-header')),
o AS (SELECT *, row_number() OVER (PARTITION BY book, page, run ORDER BY ord) AS k, CASE WHEN length(text) > 90 THEN (y2 - y1) / greatest(1, floor((y2 - y1) / 40 + 0.5)) ELSE y2 - y1 END AS px,
  len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS words FROM h),
f AS (SELECT book, page, run, k, ord AS first, x1, y1, x2, y2, px, words, category, text AS label, 1 AS n FROM o WHERE k = 1
  UNION ALL SELECT book, page, run, k, CASE WHEN j THEN first ELSE ord END, CASE WHEN j THEN least(x1, a1) ELSE x1 END, CASE WHEN j THEN least(y1, b1) ELSE y1 END, CASE WHEN j THEN greatest(x2, a2) ELSE x2 END, CASE WHEN j THEN greatest(y2, b2) ELSE y2 END,
    CASE WHEN j THEN (greatest(y2, b2) - least(y1, b1)) / (n + 1) ELSE px END, CASE WHEN j THEN words + before ELSE words END, CASE WHEN j AND loud = 'Title' THEN 'Title' ELSE category END,
    CASE WHEN j THEN label || CASE WHEN regexp_matches(label, '[.,:;!?…—–-]$') THEN ' ' ELSE ': ' END || text ELSE text END, CASE WHEN j THEN n + 1 ELSE 1 END
  FROM (SELECT o.*, s.first, s.x1 AS a1, s.y1 AS b1, s.x2 AS a2, s.y2 AS b2, s.words AS before, s.category AS loud, s.label, s.n,
      least(o.x2, s.x2) - greatest(o.x1, s.x1) >= 0.5 * least(o.x2 - o.x1, s.x2 - s.x1) AND least(o.x2 - o.x1, s.x2 - s.x1) > 0 AND o.y1 >= s.y1 AND o.y1 - s.y2 <= 1.5 * greatest(s.px, o.px) AND (s.words <= 4 OR o.words <= 4) AS j
    FROM f s JOIN o ON o.book = s.book AND o.page = s.page AND o.run = s.run AND o.k = s.k + 1))
SELECT book, page, first::INT AS ord, max(n)::BIGINT AS n, arg_max(category, n) AS category, arg_max(label, n) AS label FROM f GROUP BY book, page, first""")
def merged_headings(spark, d):
    return flow.merged_headings(S.blocks(spark, d))


def _marks(spark, d):
    li = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_partkey")
    m = li.select(F.concat(F.lit("b"), (F.col("k") % 100).cast("string")).alias("book"), F.floor(F.col("k") / 100).alias("page"), (F.col("n") * 100 + F.col("k") % 7).cast("long").alias("pos"), (F.col("l_partkey") % 5 + 1).cast("int").alias("printed"))
    n = li.where("n <= 2").select(F.concat(F.lit("b"), (F.col("k") % 100).cast("string")).alias("book"), F.floor(F.col("k") / 100).alias("page"), F.col("n").cast("long").alias("note"), ((F.col("l_partkey") + F.col("n")) % 5 + 1).cast("int").alias("printed"))
    return m, n


MARKS = r"""
m AS (SELECT 'b' || (l_orderkey % 100) AS book, l_orderkey // 100 AS page, (l_linenumber * 100 + l_orderkey % 7)::BIGINT AS pos, (l_partkey % 5 + 1)::INT AS printed FROM lineitem),
n AS (SELECT 'b' || (l_orderkey % 100) AS book, l_orderkey // 100 AS page, l_linenumber::BIGINT AS note, ((l_partkey + l_linenumber) % 5 + 1)::INT AS printed FROM lineitem WHERE l_linenumber <= 2)
"""


@query("note_links_first", f"""
WITH {MARKS}, f AS (SELECT book, page, printed, min(note) AS note FROM n GROUP BY ALL)
SELECT m.book, m.page, m.pos, m.printed, CASE WHEN a.note IS NOT NULL THEN m.page WHEN b.note IS NOT NULL THEN m.page + 1 END AS note_page, coalesce(a.note, b.note) AS note
FROM m LEFT JOIN f a ON m.book = a.book AND m.page = a.page AND m.printed = a.printed LEFT JOIN f b ON m.book = b.book AND m.page + 1 = b.page AND m.printed = b.printed""")
def note_links_first(spark, d):
    return notes.links_first(*_marks(spark, d))


@query("note_links_exclusive", f"""
WITH RECURSIVE {MARKS}, mk AS (SELECT *, row_number() OVER (PARTITION BY book, printed ORDER BY page, pos) AS k FROM m),
nl AS (SELECT book, printed, list_sort(list({{'page': page, 'note': note}})) AS ns FROM n GROUP BY book, printed),
c AS (SELECT book, printed, 0::BIGINT AS k, NULL::BIGINT AS page, NULL::BIGINT AS pos, NULL::STRUCT(page BIGINT, note BIGINT) AS pick, coalesce(ns, []) AS rest FROM (SELECT DISTINCT book, printed FROM mk) LEFT JOIN nl USING (book, printed)
  UNION ALL SELECT book, printed, k, page, pos, pick, CASE WHEN pick IS NULL THEN rest ELSE list_concat(rest[1:list_position(rest, pick) - 1], rest[list_position(rest, pick) + 1:]) END
  FROM (SELECT mk.book, mk.printed, mk.k, mk.page, mk.pos, c.rest, coalesce(list_filter(c.rest, lambda x: x.page = mk.page)[1], list_filter(c.rest, lambda x: x.page = mk.page + 1)[1]) AS pick
    FROM c JOIN mk ON mk.book = c.book AND mk.printed = c.printed AND mk.k = c.k + 1))
SELECT book, page, pos, printed, pick.page AS note_page, pick.note AS note FROM c WHERE k > 0""")
def note_links_exclusive(spark, d):
    return notes.links_exclusive(*_marks(spark, d))


@query("split_notes", r"""
WITH s AS (SELECT o_orderkey AS k, o_orderkey % 4 + 1 AS n FROM orders)
SELECT k, i::INT AS note, (i + 1)::INT AS printed, (i + 1) || ' note' || chr(10) || '9 tail' AS text FROM (SELECT k, unnest(range(0, n)) AS i FROM s)""")
def split_notes(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("n"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(i.cast("string"), F.lit(" note\n9 tail"))), "\n")
    return notes.split_notes(o.select("k", text.alias("text")), ["k"])


@query("replay_last_wins", f"""
WITH {S.OPS}, l AS (SELECT book, id, arg_max(op, seq) FILTER (op IN ('strike', 'restore')) AS s, arg_max(text, seq) FILTER (op = 'text') AS t, arg_max(category, seq) FILTER (op = 'category') AS c,
  max(seq) FILTER (op = 'restore-furniture') AS f FROM ops GROUP BY ALL)
SELECT book, id, coalesce(t, text) AS text, coalesce(c, category) AS category, CASE WHEN f IS NULL THEN shelf END AS shelf, coalesce(s, '') = 'strike' AS struck, t IS NOT NULL AS retyped
FROM op_rows LEFT JOIN l USING (book, id)""")
def replay_last_wins(spark, d):
    return replay.replay_fold(S.op_rows(spark, d), S.ops(spark, d))


@query("missing_targets", f"WITH {S.OPS} SELECT DISTINCT book, id FROM ops ANTI JOIN op_rows USING (book, id)")
def missing_targets(spark, d):
    return replay.missing_targets(S.op_rows(spark, d), S.ops(spark, d))


@query("replay_structural")
def replay_structural(spark, d):
    o = S.ops(spark, d).withColumn("op", F.when(F.col("seq") % 5 == 0, F.element_at(F.array(F.lit("merge"), F.lit("split"), F.lit("move")), (F.col("seq") % 3 + 1).cast("int"))).otherwise(F.col("op"))).withColumn("into", (F.col("seq") * 3 % 40).cast("string")).withColumn("at", (F.col("seq") % 6).cast("long"))
    return replay.replay_structural(S.op_rows(spark, d), o)


@query("last_answer_per_page", f"WITH {S.ANSWERS} SELECT book, page, arg_max(seq, seq) AS seq, arg_max(tokens, seq) AS tokens FROM answers GROUP BY ALL")
def last_answer_per_page(spark, d):
    a = S.answers(spark, d)
    return replay.last_per_key(a.select("book", "page", "seq", "tokens"), ["book", "page"])


@query("overlay_tally", f"""
WITH {S.ANSWERS}, a AS (SELECT page, seq, CASE WHEN seq % 5 = 0 THEN seq % 2 = 0 END AS strike, CASE WHEN seq % 7 = 0 THEN 'c' END AS category, CASE WHEN seq % 11 = 0 THEN 't' END AS text, CASE WHEN seq % 13 = 0 THEN seq % 3 = 0 END AS jn, book FROM answers),
l AS (SELECT book, page, coalesce(arg_max(strike, seq) FILTER (strike IS NOT NULL), false) AS s, max(category) AS c, max(text) AS t, coalesce(arg_max(jn, seq) FILTER (jn IS NOT NULL), false) AS j FROM a GROUP BY ALL)
SELECT count(*) FILTER (s) AS struck, count(*) FILTER (NOT s AND c IS NOT NULL) AS reclassified, count(*) FILTER (NOT s AND t IS NOT NULL) AS corrected, count(*) FILTER (NOT s AND j) AS joined FROM l""")
def overlay_tally(spark, d):
    a = S.answers(spark, d)
    s = F.col("seq")
    am = a.select("book", "page", "seq", F.when(s % 5 == 0, s % 2 == 0).alias("strike"), F.when(s % 7 == 0, "c").alias("category"), F.when(s % 11 == 0, "t").alias("text"), F.when(s % 13 == 0, s % 3 == 0).alias("join"))
    return replay.overlay_tally(am, ["book", "page"])


CAPS = rf"""
{S.ANSWERS}, s AS (SELECT *, finish_reason IS DISTINCT FROM 'length' AND text <> '' AS accepted FROM answers),
c AS (SELECT *, max(CASE WHEN accepted THEN tokens END) OVER (PARTITION BY book ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longest FROM s),
sent AS (SELECT *, CASE WHEN longest IS NULL THEN 16384 ELSE least(16384, greatest(2000, longest * 4)) END::BIGINT AS cap FROM c)
"""


@query("adaptive_cap", f"WITH {CAPS} SELECT book, seq, cap, accepted FROM sent")
def adaptive_cap(spark, d):
    return cap.sent_caps(S.answers(spark, d)).select("book", "seq", "cap", "accepted")


@query("pages_to_reread", f"""
WITH {CAPS}, f AS (SELECT book, least(16384, greatest(2000, max(tokens) FILTER (accepted) * 4))::BIGINT AS final FROM sent GROUP BY book)
SELECT book, page, cap, final FROM sent JOIN f USING (book) WHERE NOT accepted AND final >= 2 * cap""")
def pages_to_reread(spark, d):
    return cap.pages_to_reread(S.answers(spark, d))


TREE = rf"""
RECURSIVE {S.STEPS}, up AS (
  SELECT project, id, id AS ancestor, 0 AS depth, parent FROM steps
  UNION ALL SELECT u.project, u.id, s.id, depth + 1, s.parent FROM up u JOIN steps s ON u.project = s.project AND u.parent = s.id)
"""


@query("ledger_ancestry", f"WITH {TREE} SELECT project, id, ancestor, depth FROM up")
def ledger_ancestry(spark, d):
    return ledger.ancestry(S.steps(spark, d))


@query("ledger_nearest", f"""
WITH {TREE}, n AS (SELECT u.project, u.id, u.ancestor, u.depth, s.action FROM up u JOIN steps s ON u.project = s.project AND u.ancestor = s.id)
SELECT project, id, CASE WHEN min(depth) FILTER (action = 'system') IS NULL OR min(depth) FILTER (action = 'user') <= min(depth) FILTER (action = 'system') THEN arg_min(ancestor, depth) FILTER (action = 'user') END AS found FROM n GROUP BY project, id""")
def ledger_nearest(spark, d):
    s = S.steps(spark, d)
    return ledger.nearest_upward(s, ledger.ancestry(s), "user", "system")


@query("ledger_standard", f"""
WITH {TREE}, p AS (SELECT project, max(id) AS at FROM steps GROUP BY project)
SELECT u.project, s.action, arg_min(u.ancestor, u.depth) AS id FROM up u JOIN p ON u.project = p.project AND u.id = p.at JOIN steps s ON s.project = u.project AND s.id = u.ancestor WHERE s.id % 5 <> 2 GROUP BY u.project, s.action""")
def ledger_standard(spark, d):
    s = S.steps(spark, d)
    at = ledger.position(s, spark.createDataFrame([], "project long, pointer long"))
    return ledger.current_standard(s.withColumn("stale", F.when(F.col("id") % 3 > 0, F.col("id") % 5 == 2).when(F.col("id") % 5 == 2, True)), ledger.ancestry(s), at)


@query("ledger_stale", f"WITH {TREE} SELECT DISTINCT project, id FROM up WHERE depth > 0 AND ancestor % 4 = 1")
def ledger_stale(spark, d):
    s = S.steps(spark, d)
    return ledger.stale_after(ledger.ancestry(s), s.where("id % 4 = 1"))


@query("ledger_deleted", f"""
WITH {TREE}, g AS (SELECT project, id FROM steps WHERE id % 5 = 3 AND parent IS NOT NULL)
SELECT project, id, parent, action, created FROM steps ANTI JOIN (SELECT u.project, u.id FROM up u JOIN g ON u.project = g.project AND u.ancestor = g.id) x USING (project, id)""")
def ledger_deleted(spark, d):
    s = S.steps(spark, d)
    return ledger.without_subtree(s, ledger.ancestry(s), s.where("id % 5 = 3").select("project", "id"))


@query("ledger_chronological", f"""
WITH {S.STEPS} SELECT project, id, row_number() OVER w::INT AS row, parent IS DISTINCT FROM lag(id) OVER w AS jumps FROM steps WINDOW w AS (PARTITION BY project ORDER BY created, id)""")
def ledger_chronological(spark, d):
    return ledger.chronological(S.steps(spark, d)).select("project", "id", "row", "jumps")


@query("merged_metadata", r"""
SELECT user_id, arg_max(event_type, event_id) FILTER (event_id % 3 = 0) AS a, arg_max(event_id::VARCHAR, event_id) FILTER (event_id % 2 = 0) AS b FROM events GROUP BY user_id""")
def merged_metadata(spark, d):
    e = S.table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(" ").alias("a"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("b"))
    return ledger.merged_fields(e, ["user_id"], ["a", "b"], "event_id")


@query("chunk_plan", r"""
WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber AS pos, trunc(l_quantity)::BIGINT AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, trunc(l_quantity)) AS k FROM lineitem),
f AS (SELECT l_orderkey, k, pos, w, 0 AS chunk, w AS used FROM i WHERE k = 1
  UNION ALL SELECT i.l_orderkey, i.k, i.pos, i.w, CASE WHEN f.used + i.w <= 80 THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN f.used + i.w <= 80 THEN f.used + i.w ELSE i.w END FROM f JOIN i ON i.l_orderkey = f.l_orderkey AND i.k = f.k + 1)
SELECT l_orderkey, chunk, min(pos) AS first_pos, count(*) AS n, sum(w)::BIGINT AS weight FROM f GROUP BY l_orderkey, chunk""")
def chunk_plan(spark, d):
    li = S.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("weight"))
    return translate.plan_chunks(li, "l_orderkey", 80)


@query("answer_complaints_lines", r"""
WITH l AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS q FROM documents),
q AS (SELECT doc_id, pos, q, CASE (doc_id + pos) % 5 WHEN 0 THEN '' WHEN 1 THEN '⟦m1⟧' WHEN 2 THEN 'x' WHEN 3 THEN repeat(q || ' ', 4) ELSE q END AS a FROM l),
s AS (SELECT doc_id, pos, a AS raw, trim(regexp_replace(regexp_replace(q, '⟦[^⟧]*⟧', '', 'g'), '[ \t\n]+', ' ', 'g')) AS q, trim(regexp_replace(regexp_replace(a, '⟦[^⟧]*⟧', '', 'g'), '[ \t\n]+', ' ', 'g')) AS a FROM q)
SELECT doc_id, pos::INT AS pos, CASE WHEN trim(raw) = '' THEN 'empty' WHEN a = '' THEN 'only markers' WHEN length(a) < length(q) * 0.25 THEN 'too short' WHEN length(a) > length(q) * 3 THEN 'too long' END AS complaint FROM s""")
def answer_complaints_lines(spark, d):
    """answer_complaints with every line of a document as a question."""
    t = S.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "q"))
    k = (F.col("doc_id") + F.col("pos")) % 5
    a = F.when(k == 0, "").when(k == 1, "⟦m1⟧").when(k == 2, "x").when(k == 3, F.repeat(F.concat("q", F.lit(" ")), 4)).otherwise(F.col("q"))
    return t.select("doc_id", "pos", translate.complaint(F.col("q"), a).alias("complaint"))


@query("rendered_answers_all", r"""
WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS ps FROM documents)
SELECT doc_id, len(ps) AS parts, true AS same FROM p WHERE len(ps) > 0""")
def rendered_answers_all(spark, d):
    """rendered_answers over every paragraph of a text."""
    p = S.table(spark, d, "documents").select("doc_id", F.filter(F.transform(F.split("text", "\n", -1), X.trim_all), lambda s: s != "").alias("ps")).where(F.size("ps") > 0)
    return p.select("doc_id", F.size("ps").cast("long").alias("parts"), translate.parsed_answer(translate.rendered(F.col("ps")), F.size("ps")).eqNullSafe(F.col("ps")).alias("same"))


@query("distinct_questions", r"SELECT sha256(role || chr(0) || text) AS key, count(*) AS asked FROM conversations GROUP BY ALL")
def distinct_questions(spark, d):
    return translate.distinct_questions(S.table(spark, d, "conversations").where("role is not null and text is not null"), ["role", "text"])


@query("records_resolution", r"""
WITH r AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey || ':0' AS src FROM customer), k AS (SELECT 'c' || c_custkey AS key, 'own ' || c_custkey AS text FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT 'n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN ':0' ELSE '' END, n_name FROM nation WHERE n_nationkey % 5 <> 0)
SELECT r.id, r.src, coalesce(a.text, b.text, c.text) AS text, CASE WHEN a.key IS NOT NULL THEN 'id' WHEN b.key IS NOT NULL THEN 'src' WHEN c.key IS NOT NULL THEN 'family' END AS "by"
FROM r LEFT JOIN k a ON r.id = a.key LEFT JOIN k b ON r.src = b.key LEFT JOIN k c ON regexp_replace(r.src, ':0$', '') = c.key""")
def records_resolution(spark, d):
    c, n = S.table(spark, d, "customer"), S.table(spark, d, "nation").where("n_nationkey % 5 <> 0")
    rows = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(":0")).alias("src"))
    own = c.where("c_custkey % 4 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.concat(F.lit("own "), F.col("c_custkey").cast("string")).alias("text"))
    fam = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, ":0").otherwise("")).alias("key"), F.col("n_name").alias("text"))
    return translate.resolved_records(rows, own.unionByName(fam))


@query("list_runs", r"""
WITH i AS (SELECT l_orderkey AS book, l_linenumber * 1000000 + l_partkey AS pos, CASE WHEN l_partkey % 3 > 0 THEN CASE WHEN l_partkey % 3 = 1 THEN 'ol' ELSE 'ul' END END AS kind FROM lineitem),
m AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM i WINDOW w AS (PARTITION BY book ORDER BY pos)),
r AS (SELECT *, sum(new) OVER (PARTITION BY book ORDER BY pos) AS run FROM m)
SELECT book, run::BIGINT AS run, kind, count(*) AS n FROM r WHERE kind IS NOT NULL GROUP BY book, run, kind""")
def list_runs(spark, d):
    li = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), F.when(F.col("l_partkey") % 3 > 0, "List-item").otherwise("Text").alias("category"), F.when(F.col("l_partkey") % 3 == 1, "1. x").otherwise("- x").alias("text"))
    return translate.list_runs(li)


SWEEP = r"\([^()\n]*\)|\[[^\[\]\n]*\]"


@query("sweep_census", r"SELECT doc_id AS id, i::INT AS n, h[i + 1] AS hit FROM (SELECT doc_id, h, unnest(range(0, len(h))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\([^()\n]*\)|\[[^\[\]\n]*\]') AS h FROM documents))")
def sweep_census(spark, d):
    return sweep.census(S.table(spark, d, "documents"), SWEEP, "doc_id")


@query("sweep_spans", r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(text, '\([^()\n]*\)|\[[^\[\]\n]*\]') AS h, regexp_split_to_array(text, '\([^()\n]*\)|\[[^\[\]\n]*\]') AS r FROM documents),
e AS (SELECT id, h, r, unnest(range(1, len(h) + 1)) AS i FROM d),
o AS (SELECT id, h[i] AS hit, (list_sum(list_transform(r[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM e)
SELECT id, start, start + length(hit) AS "end", hit FROM o""")
def sweep_spans(spark, d):
    return sweep.spans(S.table(spark, d, "documents"), SWEEP, "doc_id")


@query("sweep_cut", rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(text, '\([^()\n]*\)|\[[^\[\]\n]*\]') AS h, regexp_split_to_array(text, '\([^()\n]*\)|\[[^\[\]\n]*\]') AS r FROM documents),
w AS (
  SELECT doc_id, len(h) AS i, r[len(h) + 1] AS tail FROM d WHERE len(h) > 0
  UNION ALL SELECT doc_id, i - 1, CASE WHEN regexp_matches(p, '[ \t\n\r]$') AND regexp_matches(tail, '^[ \t\n\r]') THEN
    CASE WHEN tail[1] = chr(10) AND p[-1] <> chr(10) THEN p[:-2] || tail ELSE p || tail[2:] END
    WHEN regexp_matches(p, '[ \t\n\r]$') AND regexp_matches(tail, '^[.,;:!?)]') THEN p[:-2] || tail ELSE p || tail END
  FROM (SELECT w.doc_id, i, tail, r[i] AS p FROM w JOIN d USING (doc_id) WHERE i > 0))
SELECT d.doc_id, sha256(CASE WHEN w.tail IS NULL THEN text ELSE trim(tail, {WIDE}) END) AS h, coalesce(trim(tail, {WIDE}) = '', false) AS struck FROM d LEFT JOIN w ON w.doc_id = d.doc_id AND w.i = 0""")
def sweep_cut(spark, d):
    return sweep.cut(S.table(spark, d, "documents"), SWEEP).select("doc_id", F.sha2("swept", 256).alias("h"), "struck")


@query("sweep_cut_chosen", rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Z][a-z]+') AS h, regexp_split_to_array(text, '[A-Z][a-z]+') AS r FROM documents),
o AS (SELECT *, list_transform(range(1, len(h) + 1), lambda i: (list_sum(list_transform(r[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)) % 3 = 0) AS chosen FROM d),
w AS (
  SELECT doc_id, len(h) AS i, r[len(h) + 1] AS tail FROM o
  UNION ALL SELECT doc_id, i - 1, CASE WHEN NOT c THEN p || hit || tail WHEN regexp_matches(p, '[ \t\n\r]$') AND regexp_matches(tail, '^[ \t\n\r]') THEN
    CASE WHEN tail[1] = chr(10) AND p[-1] <> chr(10) THEN p[:-2] || tail ELSE p || tail[2:] END
    WHEN regexp_matches(p, '[ \t\n\r]$') AND regexp_matches(tail, '^[.,;:!?)]') THEN p[:-2] || tail ELSE p || tail END
  FROM (SELECT w.doc_id, i, tail, r[i] AS p, h[i] AS hit, chosen[i] AS c FROM w JOIN o USING (doc_id) WHERE i > 0))
SELECT d.doc_id, sha256(CASE WHEN list_bool_or(chosen) THEN trim(tail, {WIDE}) ELSE text END) AS h FROM o d JOIN w ON w.doc_id = d.doc_id AND w.i = 0""")
def sweep_cut_chosen(spark, d):
    """Of all words with a capital, those are cut that begin at a multiple of three."""
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    chosen = sweep.spans(docs, "[A-Z][a-z]+", "doc_id").where("start % 3 = 0")
    return sweep.cut_spans(docs, chosen, "doc_id").select("doc_id", F.sha2("swept", 256).alias("h"))


@query("skip_pages", r"""
WITH s AS (SELECT unnest([3, 17]) AS page UNION SELECT unnest(range(19, 25))) SELECT doc_id AS page FROM documents WHERE doc_id NOT IN (SELECT page FROM s)""")
def skip_pages(spark, d):
    from ..sources.banks import skip_list

    return S.table(spark, d, "documents").select(F.col("doc_id").alias("page")).join(skip_list(spark, "3,17,19-24"), "page", "left_anti")


@query("smart_resize", r"""
WITH p AS (SELECT p_partkey AS k, (p_partkey * 37 % 4000 + 20)::BIGINT AS h, (p_partkey * 91 % 5000 + 20)::BIGINT AS w FROM part),
g AS (SELECT *, floor(h / 28 + 0.5) * 28 AS gh, floor(w / 28 + 0.5) * 28 AS gw, sqrt(h * w / 2000000.0) AS o, sqrt(3136.0 / (h * w)) AS u FROM p)
SELECT k, CASE WHEN gh * gw > 2000000 THEN floor(h / o / 28) * 28 WHEN gh * gw < 3136 THEN ceil(h * u / 28) * 28 ELSE gh END::BIGINT AS height,
  CASE WHEN gh * gw > 2000000 THEN floor(w / o / 28) * 28 WHEN gh * gw < 3136 THEN ceil(w * u / 28) * 28 ELSE gw END::BIGINT AS width FROM g""")
def smart_resize(spark, d):
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 37 % 4000 + 20).alias("h"), (F.col("p_partkey") * 91 % 5000 + 20).alias("w"))
    return p.select("k", G.smart_resize(F.col("h"), F.col("w"), 2_000_000).alias("s")).select("k", "s.height", "s.width")


@query("quad_sizes", r"""
WITH q AS (SELECT p_partkey AS k, (p_partkey % 50)::DOUBLE AS a, (p_partkey % 70 + 100)::DOUBLE AS b FROM part)
SELECT k, abs((a * 0 - b * a) + (b * (b + 7) - (b + 5) * 0) + ((b + 5) * b - 0 * (b + 7)) + (0 * a - a * b)) / 2 AS area,
 greatest(1, floor(greatest(sqrt((b - a) * (b - a) + a * a), sqrt((b + 5) * (b + 5) + 49.0)) + 0.5))::BIGINT AS width,
 greatest(1, floor(greatest(sqrt(25.0 + (b + 7) * (b + 7)), sqrt(a * a + (b - a) * (b - a))) + 0.5))::BIGINT AS height FROM q""")
def quad_sizes(spark, d):
    q = S.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 50).cast("double").alias("a"), (F.col("p_partkey") % 70 + 100).cast("double").alias("b"))
    zero = F.lit(0.0)
    pts = F.array(F.array(F.col("a"), F.col("a")), F.array(F.col("b"), zero), F.array(F.col("b") + 5, F.col("b") + 7), F.array(zero, F.col("b")))
    return q.select("k", G.quad_area(pts).alias("area"), G.output_size(pts).alias("s")).select("k", "area", "s.width", "s.height")


@query("html_elements")
def html_elements(spark, d):
    return markup.elements(S.table(spark, d, "pages"), "page_id", "html").select("doc", "id", "parent", "tag", "start", "end")


@query("html_tag_counts", r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<script|<style)[^>]*>.*?</(script|style)>', '', 'g') AS h FROM pages),
t AS (SELECT page_id, lower(unnest(regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM p)
SELECT tag, count(*) AS n, count(DISTINCT page_id) AS docs FROM t GROUP BY tag""")
def html_tag_counts(spark, d):
    return markup.tag_counts(markup.elements(S.table(spark, d, "pages"), "page_id", "html"))


@query("html_inside_nav", r"""
SELECT page_id AS doc, len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<[a-z]'))::BIGINT AS n FROM pages""")
def html_inside_nav(spark, d):
    return markup.inside(markup.elements(S.table(spark, d, "pages"), "page_id", "html"), "nav").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


@query("html_link_targets", r"""
WITH a AS (SELECT page_id AS doc, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) SELECT doc, href, count(*) AS refs FROM a GROUP BY ALL""")
def html_link_targets(spark, d):
    return markup.link_targets(markup.elements(S.table(spark, d, "pages"), "page_id", "html"))


@query("html_page_as_of", r"""
WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS id, (l_linenumber * 100)::INT AS start FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
m AS (SELECT o_orderkey AS doc, unnest([150, 300, 420]) AS off, unnest([1, 2, 3]) AS page FROM orders WHERE o_orderkey % 3 = 0)
SELECT p.doc, p.id, max(m.page)::BIGINT AS page FROM p LEFT JOIN m ON p.doc = m.doc AND m.off <= p.start GROUP BY p.doc, p.id""")
def html_page_as_of(spark, d):
    p = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("id"), (F.col("l_linenumber") * 100).cast("int").alias("start")).distinct()
    m = S.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc"), F.explode(F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(k).alias("page")) for o, k in ((150, 1), (300, 2), (420, 3))])).alias("m")).select("doc", "m.offset", "m.page")
    return markup.page_at(p, m)


@query("nav_dead_entries", r"""
WITH e AS (SELECT o_orderkey % 20 AS doc, o_orderkey AS id, o_orderkey // 4 * 40 + CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 4 * 10 END AS s,
  o_orderkey // 4 * 40 + CASE WHEN o_orderkey % 4 = 0 THEN 39 ELSE o_orderkey % 4 * 10 + 5 END AS e, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 50 END AS target FROM (SELECT o_orderkey * 20 AS k, o_orderkey FROM orders))
SELECT a.doc, a.id FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.doc = a.doc AND b.s >= a.s AND b.s <= a.e AND (b.target IS NULL OR b.target % 2 = 0))""")
def nav_dead_entries(spark, d):
    k = F.col("o_orderkey")
    within = F.when(k % 4 == 0, 0).otherwise(k % 4 * 10)
    e = S.table(spark, d, "orders").select((k % 20).alias("doc"), k.alias("id"), (F.floor(k / 4) * 40 + within).alias("start"), (F.floor(k / 4) * 40 + F.when(k % 4 == 0, 39).otherwise(k % 4 * 10 + 5)).alias("end"), F.when(k % 9 != 0, k % 50).alias("target"))
    return markup.dead_entries(e, spark.range(0, 50, 2).select(F.col("id").alias("target")))


@query("masked_text", r"SELECT doc_id AS id, len(regexp_extract_all(text, '\*\*|\*|[⁰¹²³⁴⁵⁶⁷⁸⁹]+'))::BIGINT AS n, true AS round_trips, NULL::VARCHAR AS complaint FROM documents")
def masked_text(spark, d):
    m = markup.masked(S.table(spark, d, "documents"), "doc_id", "text")
    return m.select("id", F.size("kept").cast("long").alias("n"), "round_trips", markup.marker_complaint(F.col("masked"), F.size("kept")).alias("complaint"))


@query("unsafe_markup", r"SELECT page_id, length(regexp_replace(html, '(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>', '', 'g'))::BIGINT AS n FROM pages")
def unsafe_markup(spark, d):
    return markup.without_unsafe(S.table(spark, d, "pages"), "page_id", "html").select(F.col("id").alias("page_id"), F.char_length("markup").cast("long").alias("n"))


@query("plain_text_of_markup", r"""
SELECT page_id, sha256(trim(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&apos;', ''''), '&quot;', '"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS h FROM pages""")
def plain_text_of_markup(spark, d):
    return S.table(spark, d, "pages").select("page_id", F.sha2(X.plain_text(F.col("html")), 256).alias("h"))


@query("windowed_events", r"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_events(spark, d):
    from ..streaming.intake import windowed_events as windows

    return windows(S.table(spark, d, "events"))


@query("plain_text_book_rows", r"""
SELECT source AS book, doc_id AS pos, sha256(text) AS h FROM documents WHERE text IS NOT NULL""")
def plain_text_book_rows(spark, d):
    """The whole plain text of every book as ordered rows: no book is one value."""
    from ..sources.books import plain_text_rows

    t = S.table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("pos"), "text")
    return plain_text_rows(t).select("book", "pos", F.sha2("text", 256).alias("h"))


@query("markdown_runs", rf"""
WITH l AS (SELECT source AS book, doc_id AS page, unnest(string_split(m, chr(10))) AS line, generate_subscripts(string_split(m, chr(10)), 1) AS pos FROM (SELECT source, doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?m)^(Th|De|Es)', ' # \1', 'g'), '(?m)^(A|I)', '### \1', 'g'), '(?m)^(L|E)', '>\1', 'g') AS m FROM documents)),
k AS (SELECT *, CASE WHEN regexp_matches(b, '^#{{1,4}}[ \t]+') THEN 'h' WHEN regexp_matches(b, '^>') THEN 'q' ELSE 't' END AS kind FROM (SELECT *, trim(line, {WIDE}) AS b FROM l)),
m AS (SELECT *, CASE WHEN kind = 'h' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY book, page ORDER BY pos) THEN 1 ELSE 0 END AS new FROM k),
r AS (SELECT *, sum(new) OVER (PARTITION BY book, page ORDER BY pos) AS run FROM m)
SELECT book, page, 0 AS ord, (run - 1)::INT AS part, arg_min(CASE WHEN kind = 'q' THEN 'Quote' WHEN kind = 'h' AND regexp_matches(b, '^#[ \t]') THEN 'Title' WHEN kind = 'h' THEN 'Section-header' ELSE 'Text' END, pos) AS category,
  string_agg(CASE kind WHEN 'h' THEN trim(regexp_replace(b, '^#{{1,4}}[ \t]+', ''), {WIDE}) WHEN 'q' THEN regexp_replace(b, '^>[ \t]?', '') ELSE line END, chr(10) ORDER BY pos) AS text FROM r GROUP BY book, page, run""")
def markdown_runs(spark, d):
    text = F.col("text")
    for pattern, mark in (("(Th|De|Es)", " # "), ("(A|I)", "### "), ("(L|E)", ">")):
        text = F.regexp_replace(text, f"(?md)^{pattern}", mark + "$1")
    t = S.table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.lit(0).alias("ord"), F.lit("Text").alias("category"), text.alias("text"))
    return B.markdown_runs(t)


#: The box of line ``ord`` of a page's answer, and the picture that the page was read from.
PICTURE = (2000, 3000)


@query("read_pages_blocks", rf"""
WITH l AS (SELECT source AS book, doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents WHERE doc_id % 10 <> 7),
e AS (SELECT *, trim(CASE WHEN ord % 7 = 3 THEN '# ' || line WHEN ord % 7 = 4 THEN '> ' || line ELSE line END, {WIDE}) AS t, CASE WHEN ord % 11 = 5 THEN 'Page-footer' WHEN ord % 11 = 6 THEN 'List-item' ELSE 'Text' END AS own FROM l),
k AS (SELECT *, own = 'Text' AND regexp_matches(t, '^#[ \t]') AS h, own = 'Text' AND regexp_matches(t, '^>') AS q FROM e WHERE t <> '')
SELECT book, page, ord::INT AS ord, CASE WHEN h THEN 'Title' WHEN q THEN 'Quote' ELSE own END AS category, sha256(CASE WHEN h THEN trim(t[2:], {WIDE}) WHEN q THEN regexp_replace(t, '^>[ \t]?', '') ELSE t END) AS h,
  round(ord * 2000 / 1204.0, 6) AS y1, CASE WHEN own = 'Page-footer' THEN 'furniture' ELSE 'block' END AS shelf FROM k""")
def read_pages_blocks(spark, d):
    """Answers with markdown and furniture, scaled from the model's frame; pages whose answer is no array give nothing."""
    ls = S.table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.split("text", "\n", -1).alias("ls"))
    mark = lambda s, i: F.when(i % 7 == 3, F.concat(F.lit("# "), s)).when(i % 7 == 4, F.concat(F.lit("> "), s)).otherwise(s)
    own = lambda i: F.when(i % 11 == 5, "Page-footer").when(i % 11 == 6, "List-item").otherwise("Text")
    item = lambda s, i: F.struct(F.array(F.lit(0), i, F.lit(9), i + 1).alias("bbox"), own(i).alias("category"), mark(s, i).alias("text"))
    answer = F.concat(F.to_json(F.transform("ls", item)), F.when(F.col("page") % 10 == 7, " cut off").otherwise(""))
    blocks, furniture, _ = B.read_pages(ls.select("book", "page", answer.alias("answer"), F.lit(PICTURE[0]).alias("width"), F.lit(PICTURE[1]).alias("height")), 2_200_000)
    both = blocks.withColumn("shelf", F.lit("block")).unionByName(furniture.withColumn("shelf", F.lit("furniture")))
    return both.select("book", "page", "ord", "category", F.sha2("text", 256).alias("h"), F.round("y1", 6).alias("y1"), "shelf")


def queries() -> dict:
    from . import book_catalog, edit_catalog, shelf_catalog, translate_catalog  # noqa: F401 - register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import book_catalog, edit_catalog, shelf_catalog, translate_catalog  # noqa: F401

    return dict(SQL)
