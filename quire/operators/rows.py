"""Book rows: boxes of paragraphs and notes, ids, navigation, openings, chapters re-hung, editions, document tokens.

rows lead with (book, pos); pos is the reading order within a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .running import following, running

HEADINGS = ("Title", "Section-header")
#: Labels of back matter, which closes the part before it.
BACK_MATTER = r"(?i)\A(notes|bibliograph|sources|index|appendi|glossar|about the author|further reading)\b"


def block_id(page: Column, order: Column, part: Column | None = None) -> Column:
    """b<page>-<order>, and -<part> for a part after the first."""
    base = F.concat(F.lit("b"), page.cast("string"), F.lit("-"), order.cast("string"))
    return base if part is None else F.when(part > 0, F.concat(base, F.lit("-"), part.cast("string"))).otherwise(base)


def paragraph_boxes(parts: DataFrame) -> DataFrame:
    """book, para, page, pages, n, x1, y1, x2, y2 of joined paragraphs: origin of the first part, heights summed up, widths
    united. parts: book, para, page, ord and boxes."""
    place = F.struct("page", "ord")
    out = parts.groupBy("book", "para").agg(F.min("page").alias("page"), F.array_sort(F.collect_set("page")).alias("pages"), F.count(F.lit(1)).alias("n"), F.min("x1").alias("x1"), F.min_by("y1", place).alias("y1"), F.max("x2").alias("x2"), F.sum(F.col("y2") - F.col("y1")).alias("h"))
    return out.select("book", "para", "page", "pages", "n", "x1", "y1", "x2", (F.col("y1") + F.col("h")).alias("y2"))


def note_boxes(notes: DataFrame) -> DataFrame:
    """notes (book, page, ord, note, text, y1, y2 of their block) with the note's own top and foot: a block's height is
    shared out by the weight of the texts."""
    block = Window.partitionBy("book", "page", "ord")
    upto = block.orderBy("note").rowsBetween(Window.unboundedPreceding, 0)
    weighed = notes.withColumn("w", X.text_weight(F.col("text"))).withColumn("upto", F.sum("w").over(upto)).withColumn("total", F.sum("w").over(block))
    at = lambda share: F.col("y1") + share / F.col("total") * (F.col("y2") - F.col("y1"))
    return weighed.select("book", "page", "ord", "note", at(F.col("upto") - F.col("w")).alias("top"), at(F.col("upto")).alias("foot"))


def element_ids(elements: DataFrame) -> DataFrame:
    """elements (book, page, pos) with their running number within the page, from 1, and the id it makes."""
    n = F.row_number().over(Window.partitionBy("book", "page").orderBy("pos"))
    return elements.withColumn("n", n).withColumn("element_id", F.concat_ws("-", F.lit("p"), F.col("page").cast("string"), F.col("n").cast("string")))


def note_sequence(notes: DataFrame) -> DataFrame:
    """notes (book, page, ord, note) with ``seq``, their number within the book, from 1."""
    n = F.row_number().over(Window.partitionBy("book", "page").orderBy("ord", "note"))
    counts = notes.groupBy("book", "page").agg(F.count(F.lit(1)).alias("__c"))
    before = running(counts, ["book"], "page", "__c", F.sum, "__before", before=True).drop("__c")
    return notes.withColumn("__n", n).join(before, ["book", "page"]).withColumn("seq", F.coalesce("__before", F.lit(0)) + F.col("__n")).drop("__n", "__before")


def nav_parents(chapters: DataFrame) -> DataFrame:
    """chapters (book, pos, kind, label) with ``parent``, the pos of the part they stand under, if any.

    A part opens at a chapter of that kind; back matter closes it and stands by itself."""
    w = Window.partitionBy("book").orderBy("pos")
    part = F.col("kind").eqNullSafe(F.lit("part"))
    grouped = chapters.withColumn("__part", F.last(F.when(part, F.col("pos")), ignorenulls=True).over(w))
    back = F.max(F.when(~part, F.col("label").rlike(BACK_MATTER).cast("int")).otherwise(0)).over(Window.partitionBy("book", "__part").orderBy("pos"))
    return grouped.withColumn("parent", F.when(~part & (back == 0), F.col("__part"))).drop("__part")


def opening_headings(rows: DataFrame) -> DataFrame:
    """rows (book, section, pos, page, category, kind) that announce their section: in a chapter the headings that it opens
    with on its first page, in a part all headings of its first page."""
    first = rows.groupBy("book", "section").agg(F.min_by("page", "pos").alias("first_page"))
    heading = F.col("category").isin(*HEADINGS)
    body = rows.where(~heading).groupBy("book", "section").agg(F.min("pos").alias("first_body"))
    away = rows.join(first, ["book", "section"]).where(F.col("page") != F.col("first_page")).groupBy("book", "section").agg(F.min("pos").alias("turn"))
    both = rows.where(heading & F.col("kind").isin("chapter", "part")).join(body, ["book", "section"], "left").join(away, ["book", "section"], "left")
    before = lambda c: F.coalesce(F.col("pos") < F.col(c), F.lit(True))
    return both.where(before("turn") & ((F.col("kind") == "part") | before("first_body"))).select(*rows.columns)


def drawable_chapters(chapters: DataFrame, rows: DataFrame) -> DataFrame:
    """book, pos, id, title of the chapters (book, id, title) whose row is in the flow."""
    return chapters.join(rows.where("shelf is null").select("book", "id", "pos"), ["book", "id"]).select("book", "pos", "id", "title")


def rehung_chapters(chapters: DataFrame, rows: DataFrame) -> DataFrame:
    """book, id, title: chapters on rows (book, pos, id, held) that are no longer held go to the next held row before the
    next row that opens a chapter, or are dropped."""
    named = chapters.select("book", "id", "title", F.lit(True).alias("opens"))
    marked = rows.select("book", "pos", "id", "held").join(named, ["book", "id"], "left")
    marked = marked.withColumn("keeps", F.when(F.col("held"), F.struct("pos", "id"))).withColumn("opener", F.when(F.col("opens"), F.col("pos")))
    marked = following(following(marked, ["book"], "pos", "keeps", "next_held"), ["book"], "pos", "opener", "next_open")
    moves = F.col("next_held").isNotNull() & (F.col("next_open").isNull() | (F.col("next_held.pos") < F.col("next_open")))
    return marked.where("opens").where(F.col("held") | moves).select("book", F.when(F.col("held"), F.col("id")).otherwise(F.col("next_held.id")).alias("id"), "title")


def neighbours(rows: DataFrame) -> DataFrame:
    """book, earlier, later: rows that follow each other once shelved ones are left out."""
    live = rows.where("shelf is null").withColumn("later", F.lead("id").over(Window.partitionBy("book").orderBy("pos")))
    return live.where("later is not null").select("book", F.col("id").alias("earlier"), "later")


def drawable_seams(seams: DataFrame, rows: DataFrame) -> DataFrame:
    """seams (book, seq, after, before) whose ends are both in the flow; of several before one row the last counts."""
    live = rows.where("shelf is null").select("book", "id")
    both = seams.join(live.withColumnRenamed("id", "before"), ["book", "before"], "left_semi").join(live.withColumnRenamed("id", "after"), ["book", "after"], "left_semi")
    return both.groupBy("book", "before").agg(F.max_by("after", "seq").alias("after"))


def shared_anchors(column: DataFrame, twins: DataFrame) -> DataFrame:
    """column (book, pos, id) with ``anchor``: the last pos at or before it whose id the other column has too."""
    held = column.join(twins.select("book", "id", F.lit(True).alias("__twin")).distinct(), ["book", "id"], "left").withColumn("__at", F.when(F.col("__twin"), F.col("pos")))
    return running(held, ["book"], "pos", "__at", F.max, "anchor").select("book", "pos", "id", "anchor")


def edition_order(rows: DataFrame) -> DataFrame:
    """rows (book, pos, category, opens) with ``place``: each division's prose and then its notes."""
    divided = running(rows.withColumn("__o", F.col("opens").cast("long")), ["book"], "pos", "__o", F.sum, "division")
    note = (F.col("category") == "Footnote").cast("int")
    inside = F.row_number().over(Window.partitionBy("book", "division").orderBy(note, "pos"))
    counts = divided.groupBy("book", "division").agg(F.count(F.lit(1)).alias("__n"))
    before = running(counts, ["book"], "division", "__n", F.sum, "__before", before=True).drop("__n")
    return divided.withColumn("__i", inside).join(before, ["book", "division"]).withColumn("place", F.coalesce("__before", F.lit(0)) + F.col("__i")).drop("__i", "__before", "__o")


def title_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of rows, and records of chapter titles (their key without the prefix as id)."""
    prefix = "chapter:"
    titles = records.where(F.startswith("key", F.lit(prefix))).select("book", F.substring("key", len(prefix) + 1, 1 << 30).alias("id"), "text")
    return records.where(~F.startswith("key", F.lit(prefix))), titles


def document_tokens(documents: DataFrame) -> DataFrame:
    """documents (book, path) with ``token``: the letters and digits of the file's name, doc if it has none; in the order of
    paths the second of a token gets -2, the third -3."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)\z", 1), r"\.[^.]*\z", "")
    bare = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    token = F.when(bare == "", "doc").otherwise(bare)
    n = F.row_number().over(Window.partitionBy("book", "__t").orderBy("path"))
    return documents.withColumn("__t", token).withColumn("token", F.when(n == 1, F.col("__t")).otherwise(F.concat_ws("-", "__t", n.cast("string")))).drop("__t")


def missing_figures(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """book, id, image of rows that name a picture the book has not."""
    return rows.where("image is not null").join(figures.select("book", "image"), ["book", "image"], "left_anti").select("book", "id", "image")


def page_budgets(pages: DataFrame, banked: DataFrame, default: int) -> DataFrame:
    """pages (book, page) with the pixel budget they were read at: the banked one, else the run's."""
    return pages.join(banked.select("book", "page", "max_pixels"), ["book", "page"], "left").select("book", "page", F.coalesce("max_pixels", F.lit(default)).alias("max_pixels"))


def is_sorted(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, sorted: whether value never falls along order (ties allowed)."""
    w = Window.partitionBy(key).orderBy(order)
    step = rows.withColumn("__up", F.coalesce(F.col(value) >= F.lag(value).over(w), F.lit(True)))
    return step.groupBy(key).agg(F.bool_and("__up").alias("sorted"))


def photo_pages(photos: DataFrame, order: DataFrame) -> DataFrame:
    """project, n, photo, page_id, quad: the pages of all photos (project, photo, pages) in the order (project, page_ids)
    that was set; pages that are struck or no longer there are left out."""
    pages = photos.select("project", "photo", F.explode("pages").alias("p")).select("project", "photo", "p.page_id", "p.quad", "p.struck")
    placed = order.select("project", F.posexplode("page_ids").alias("n", "page_id"))
    return placed.join(pages.where(~F.coalesce("struck", F.lit(False))), ["project", "page_id"]).select("project", "n", "photo", "page_id", "quad")


def cut_text(text: Column, cuts: Column) -> Column:
    """A text without the cut spans, an array of struct<at, len> in order that do not overlap."""
    n = F.size(cuts)
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(cuts, F.greatest(i, F.lit(1)))["at"] + F.try_element_at(cuts, F.greatest(i, F.lit(1)))["len"])
    end = lambda i: F.when(i < n, F.try_element_at(cuts, i + 1)["at"]).otherwise(F.char_length(text))
    return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, start(i) + 1, end(i) - start(i))), "")


def mapped_offset(at: Column, cuts: Column) -> Column:
    """Where an offset lies once the spans are cut."""
    return at - F.aggregate(F.filter(cuts, lambda c: c["at"] < at), F.lit(0), lambda acc, c: acc + F.least(at, c["at"] + c["len"]) - c["at"])


def materialized(rows: DataFrame, refs: DataFrame, chapters: DataFrame) -> dict[str, DataFrame]:
    """A book after its edits: rows (book, pos, id, text, category, shelf, struck), refs (book, note, block, at, len), chapters.

    Struck and shelved rows go. The numbers that point at a struck note are cut out of the prose, and what points into a row
    behind a cut moves with it. Chapters on rows that went are re-hung; notes that nothing points at any more are orphans."""
    held = ~F.coalesce("struck", F.lit(False)) & F.col("shelf").isNull()
    flow = rows.where("shelf is null").select("book", "pos", "id", held.alias("held"))
    kept = rows.where(held)
    live, gone = refs.join(kept.select("book", F.col("id").alias("note")), ["book", "note"], "left_semi"), refs.join(kept.select("book", F.col("id").alias("note")), ["book", "note"], "left_anti")
    none = F.expr("cast(array() as array<struct<at:int,len:int>>)")
    cuts = gone.groupBy("book", F.col("block").alias("id")).agg(F.array_sort(F.collect_set(F.struct(F.col("at").cast("int").alias("at"), F.col("len").cast("int").alias("len")))).alias("cuts"))
    texts = kept.join(cuts, ["book", "id"], "left").withColumn("cuts", F.coalesce("cuts", none))
    moved = live.join(texts.select("book", F.col("id").alias("block"), "cuts"), ["book", "block"]).withColumn("at", mapped_offset(F.col("at").cast("int"), F.col("cuts"))).drop("cuts")
    notes = kept.where(F.col("category") == "Footnote").select("book", "id")
    return {
        "rows": texts.select("book", "pos", "id", "category", cut_text(F.col("text"), F.col("cuts")).alias("text")),
        "refs": moved.select("book", "note", "block", "at", "len"),
        "chapters": rehung_chapters(chapters, flow),
        "orphans": notes.join(moved.select("book", F.col("note").alias("id")), ["book", "id"], "left_anti"),
    }


def translated(rows: DataFrame, records: DataFrame, chapters: DataFrame) -> dict[str, DataFrame]:
    """A book with the texts of its records (book, key, text): rows without one keep their text and are listed, blank and
    shelved ones aside. A chapter's title is the label of its translated heading if its old title was that of the heading,
    else its own record, else kept and listed."""
    own, titles = title_records(records)
    both = rows.join(own.select("book", F.col("key").alias("id"), F.col("text").alias("said")), ["book", "id"], "left")
    out = both.withColumn("source", F.col("text")).withColumn("text", F.coalesce("said", "text"))
    heads = out.where(F.col("category").isin(*HEADINGS)).select("book", "id", X.heading_label(F.col("source")).alias("old"), F.when(F.col("said").isNotNull(), X.heading_label(F.col("text"))).alias("new"))
    named = chapters.join(heads, ["book", "id"], "left").join(titles.select("book", "id", F.col("text").alias("record")), ["book", "id"], "left")
    title = F.coalesce(F.when(F.col("title") == F.col("old"), F.col("new")), F.col("record"))
    return {
        "rows": out.select("book", "pos", "id", "category", "text"),
        "untranslated": both.where("said is null and shelf is null").where(X.trim_all(F.col("text")) != "").select("book", "id"),
        "chapters": named.select("book", "id", F.coalesce(title, "title").alias("title")),
        "untitled": named.where(title.isNull()).select("book", "id"),
    }
