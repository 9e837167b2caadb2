"""Paragraph flow: which blocks join, and their text with broken words healed by the book's lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from .blocks import HEADINGS, in_flow, lexicon
from .running import previous, running
from .scratch import written

JOINABLE = ("Text", "Page-header", "Page-footer")


#: What a block gives the one after it: nothing, that it may be joined to, that its sentence goes on besides.
CLOSED, OPEN, GOES_ON = 0, 1, 2


def _asking(blocks: DataFrame) -> DataFrame:
    """The rows of the flow with ``mine``: what a block gives the next (gives), what it asks of the one before to be joined to
    it (asks; 0: it does not join) and its broken last word (tail, null without a text)."""
    text = F.col("text")
    ok = F.col("category").isin(*JOINABLE)
    gives = F.when(ok, F.when(X.goes_on(text), GOES_ON).otherwise(OPEN)).otherwise(CLOSED)
    asks = F.when((F.col("align") == "") & X.opens_low(text), GOES_ON).otherwise(0)
    if "decision" in blocks.columns:
        asks = F.when(F.col("decision"), OPEN).when(~F.col("decision"), 0).otherwise(asks)
    if "starts" in blocks.columns:
        asks = F.when(F.coalesce("starts", F.lit(False)), 0).otherwise(asks)
    asks = F.when(ok, asks).otherwise(0)
    mine = F.struct(gives.alias("gives"), asks.alias("asks"), X.trailing_hyphen_word(text).alias("tail"))
    return blocks.where(F.col("category") != "Footnote").withColumn("mine", mine)


def _joins(mine: Column, back: Column) -> Column:
    return F.coalesce((mine["asks"] > 0) & (back["gives"] >= mine["asks"]), F.lit(False))


def _word() -> Column:
    """The first word of a block that may join."""
    return F.when(F.col("mine.asks") > 0, X.leading_word(F.col("text"))).otherwise("")


def _breaks(mine: Column, back: Column, word: Column) -> Column:
    """Whether a word was broken between two blocks that join."""
    return F.coalesce(_joins(mine, back) & (back["tail"] != "") & (word != ""), F.lit(False))


def _handed_on(before: Column) -> Column:
    """What the block before (page, gives) gives to one on this row's page: no sentence goes on over a page between."""
    near = (F.col("page") - before["page"]).isin(0, 1)
    return F.when(before.isNull(), CLOSED).when(near, before["gives"]).otherwise(F.least(before["gives"], F.lit(OPEN)))


def _turns(rows: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """rows (_asking) -> one row a page, without texts: book, page, whether its first block joins the one before it (joins)
    and then the page on which its paragraph opens (opened_on) and the ord of the first block that opens
    one here (until), how many paragraphs of the book open on the pages before (base), and the words broken between two blocks
    that join (broken: ord, stem, word).

    A task holds a page; what passes from page to page is summed and looked up by blocks of pages. starts (book, page, ord):
    blocks that start sections."""
    w = Window.partitionBy("book", "page").orderBy("ord")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine, back = F.col("mine"), F.col("back")
    word = lambda o, m, b: F.struct(o.alias("ord"), b["tail"].alias("stem"), m["word"].alias("word"))
    seen = rows.select("book", "page", "ord", F.struct("mine.*", _word().alias("word")).alias("mine")).withColumn("back", F.lag("mine").over(w))
    opens = F.when(back.isNotNull() & ~_joins(mine, back), F.col("ord"))
    broken = F.when(_breaks(mine, back, mine["word"]), word(F.col("ord"), mine, back))
    seen = seen.withColumns({"opens": F.count(opens).over(upto), "until": F.min(opens).over(upto), "broken": F.collect_list(broken).over(upto), "first": F.first(F.struct("ord", "mine")).over(upto), "last": F.lead("ord").over(w).isNull()})
    ends = written(rows.sparkSession, seen.where("last").select("book", "page", "first", "mine", "opens", "until", "broken"), "ends")
    pages = previous(ends.withColumn("it", F.struct("page", "mine.gives", "mine.tail")), ["book"], ["page"], "it", "it_before").drop("it")
    before, first = F.col("it_before"), F.col("first.mine")
    gives = _handed_on(before)
    if starts is not None:
        pages = pages.join(starts.select("book", "page", F.col("ord").alias("start")), ["book", "page"], "left")
        gives = F.when(F.col("start") == F.col("first.ord"), CLOSED).otherwise(gives)
    pages = pages.withColumn("back", F.struct(gives.alias("gives"), F.lit(0).alias("asks"), before["tail"].alias("tail")))
    pages = pages.withColumn("joins", _joins(first, back)).withColumn("opens", F.col("opens") + F.when(F.col("joins"), 0).otherwise(1))
    broken = F.when(_breaks(first, back, first["word"]), F.concat("broken", F.array(word(F.col("first.ord"), first, back)))).otherwise(F.col("broken"))
    pages = pages.select("book", "page", "joins", "until", "opens", F.when(F.col("opens") > 0, F.col("page")).alias("opening"), broken.alias("broken"))
    pages = running(pages, ["book"], "page", "opens", F.sum, "base", before=True)
    pages = running(pages, ["book"], "page", "opening", F.max, "opened_on", before=True)
    return written(rows.sparkSession, pages.select("book", "page", "joins", "until", F.coalesce("base", F.lit(0)).alias("base"), "opened_on", "broken"), "turns")


def _placed(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """rows (_asking, with ``at``: the page they are dealt to) with ``back``, ``joins``, ``para`` and ``turn``. What a page
    starts with (turns: book, at, mine, turn) comes as a row before its blocks, so that texts are joined with nothing."""
    w = Window.partitionBy("book", "at").orderBy("block", "page", "ord")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.withColumn("block", F.lit(True)).unionByName(turns.withColumn("block", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("back", F.lag("mine").over(w)).withColumn("turn", F.first("turn").over(upto)).withColumn("joins", _joins(F.col("mine"), F.col("back")))
    opens = F.sum((F.col("block") & ~F.col("joins")).cast("int")).over(upto)
    return both.withColumn("para", F.col("turn.base") + opens).where("block")


def paragraph_starts(blocks: DataFrame) -> DataFrame:
    """blocks (book, page, ord, category, text, align) with ``para``, the running number of the paragraph.

    Footnotes stand alone and do not interrupt; any other category that does not join closes the paragraph. A block joins
    the one before if it is flush, on the same or the next page, and the sentence goes on. Where the blocks have them, a
    section start (``starts``) closes the paragraph, and a decision (``decision``, true or false) stands instead of the rule.
    """
    w = Window.partitionBy("book").orderBy("page", "ord")
    rows = _asking(blocks).withColumn("before", F.lag(F.struct("page", "mine.gives")).over(w))
    joined = rows.withColumn("joins", _joins(F.col("mine"), F.struct(_handed_on(F.col("before")).alias("gives"))))
    return joined.withColumn("para", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(w)).select(*blocks.columns, "joins", "para")


BROKEN = r"([A-Za-zÀ-ÿ]+)-\n([A-Za-zÀ-ÿ]+)"


def exceptions(asked: DataFrame, words: DataFrame) -> DataFrame:
    """asked (book, stem, word: the halves in lower case, low: whether the second was before) -> those that the book's words
    (lexicon) join otherwise than their case alone does: in lower case a compound that is not known fused, in upper case
    what is known fused. Words are asked once a book; of the lexicon only the compounds and what is then asked for count."""
    known = lambda name, those: those.select(F.col("book").alias(f"{name}_book"), F.col("word").alias(name))
    fused, kept = F.concat("stem", "word"), F.concat_ws("-", "stem", "word")
    compound = (F.col("book") == F.col("b_book")) & (kept == F.col("b"))
    open_ones = asked.where("not low").unionByName(asked.where("low").join(known("b", words.where(F.col("word").contains("-"))), compound, "left_semi"))
    both = open_ones.join(known("a", words).withColumn("found", F.lit(True)), (F.col("book") == F.col("a_book")) & (fused == F.col("a")), "left")
    return both.where(F.col("low") == F.col("found").isNull()).select("book", "stem", "word", "low")


#: Every broken word, those whose second half opens in lower case fused, the others with their hyphen.
HEALED = r"([A-Za-zÀ-ÿ]+)(?:-\n([a-zß-ÿ×][A-Za-zÀ-ÿ]*)|(-)\n([A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÿ]*))"


def dehyphenated(blocks: DataFrame, words: DataFrame, keys: tuple[str, ...] = ("book", "page", "ord"), compounds: DataFrame | None = None) -> DataFrame:
    """Blocks with the words that a line break split within them healed by the book's words (lexicon).

    A broken word is healed in place by its case; those that the book's words decide otherwise are looked up without texts:
    first whether the book has the compound (compounds: the words with a hyphen, if they are at hand), and only then whether
    it has the fused word. What is found so is written down, as it is mostly short."""
    spark = blocks.sparkSession
    broken = blocks.where(F.contains("text", F.lit("-\n"))).select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(BROKEN), F.lit(0))).alias("n", "hit"))
    first = lambda hit: F.substring(F.substring_index(hit, "-\n", -1), 1, 1)
    low = lambda hit: F.lower(first(hit)) == first(hit)
    each = broken.select(*keys, "n", low(F.col("hit")).alias("low"), F.replace(F.lower("hit"), F.lit("\n"), F.lit("")).alias("kept"))
    known = lambda name, those: those.select(F.col("book").alias(f"{name}_book"), F.col("word").alias(name))
    if compounds is None:
        compounds = words.where(F.contains("word", F.lit("-")))
    hyphened = known("b", written(spark, compounds, "compounds"))
    asked = each.join(hyphened, (F.col("book") == F.col("b_book")) & (F.col("kept") == F.col("b")), "left").where("not low or b is not null")
    asked = written(spark, asked.select(*keys, "n", "low", F.replace("kept", F.lit("-"), F.lit("")).alias("fused")), "asked")
    fused = known("a", words.join(asked.select("book", F.col("fused").alias("word")).distinct(), ["book", "word"], "left_semi"))
    both = asked.join(fused, (F.col("book") == F.col("a_book")) & (F.col("fused") == F.col("a")), "left").where(F.col("low") == F.col("a").isNull())
    against = written(spark, both.groupBy(*keys).agg(F.collect_set("n").alias("against")), "against")

    def one(hit, i):
        parts = F.substring_index(hit, "-\n", 1), F.substring_index(hit, "-\n", -1)
        return F.when(low(hit) != F.array_contains("against", i), F.concat(*parts)).otherwise(F.concat_ws("-", *parts))

    hits = F.regexp_extract_all("text", F.lit(BROKEN), F.lit(0))
    pieces = F.transform(F.split("text", BROKEN, -1), lambda p, i: F.when(i < F.size(hits), F.concat(p, one(F.get(hits, i), i))).otherwise(p))
    healed = F.when(~F.contains("text", F.lit("-\n")), F.col("text")).when(F.col("against").isNull(), F.regexp_replace("text", HEALED, "$1$2$3$4")).otherwise(F.array_join(pieces, ""))
    return blocks.join(against, list(keys), "left").withColumn("text", healed).drop("against")


def flow_paragraphs(blocks: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """book, para, page, n_blocks, text: joined paragraphs. Only the words that are broken where two blocks join are looked
    up, without the texts, and only in books that have such; neither a lexicon nor a book is gathered. Texts are dealt out
    by pages. starts (book, page, ord): blocks that start sections."""
    spark = blocks.sparkSession
    rows = _asking(blocks)
    turns = _turns(rows, starts)
    low = lambda word: F.lower(F.substring(word, 1, 1)) == F.substring(word, 1, 1)
    moves = lambda o: F.col("joins") & (F.col("until").isNull() | (o < F.col("until")))
    at = lambda o: F.when(moves(o), F.col("opened_on")).otherwise(F.col("page"))
    each = turns.withColumn("b", F.explode("broken"))
    asked = written(spark, each.select("book", at(F.col("b.ord")).alias("at"), "page", "b.ord", F.lower("b.stem").alias("stem"), F.lower("b.word").alias("word"), low(F.col("b.word")).alias("low")), "asked")
    books = written(spark, asked.select("book").distinct(), "asking")
    known = lexicon(blocks.join(books, "book", "left_semi"))
    against = asked.join(exceptions(asked.select("book", "stem", "word", "low").distinct(), known), ["book", "stem", "word", "low"]).groupBy("book", "at").agg(F.collect_set(F.struct("page", "ord")).alias("against"))
    # blocks of a paragraph that opened on an earlier page are dealt to that page; few pages have such
    moved = turns.where("joins").select(F.col("book").alias("m_book"), F.col("page").alias("m_page"), "joins", "until", "opened_on")
    moved = written(spark, moved, "moved")
    dealt = rows.join(moved, rows["book"].eqNullSafe(F.col("m_book")) & (rows["page"] == F.col("m_page")), "left").withColumn("at", at(F.col("ord"))).select(*rows.columns, "at")
    opening = turns.withColumn("at", F.col("page")).join(written(spark, against, "against"), ["book", "at"], "left")
    closed = F.struct(F.lit(CLOSED).alias("gives"), F.lit(0).alias("asks"), F.lit("").alias("tail"))
    placed = _placed(dealt, opening.select("book", "at", closed.alias("mine"), F.struct("base", "against").alias("turn")))
    mine, back, word = F.col("mine"), F.col("back"), _word()
    other = F.coalesce(F.array_contains("turn.against", F.struct("page", "ord")), F.lit(False))
    how = F.when(~F.col("joins") | back["tail"].isNull(), "first").when(~_breaks(mine, back, word), "space").when(low(word) != other, "fuse").otherwise("keep")
    parts = placed.groupBy("book", "at", "para").agg(F.array_sort(F.collect_list(F.struct("page", "ord", how.alias("how"), "text"))).alias("parts"))
    text = F.aggregate(
        "parts",
        F.lit(""),
        lambda acc, p: F.when(p["how"] == "first", p["text"]).when(p["how"] == "space", F.concat(acc, F.lit(" "), p["text"])).when(p["how"] == "fuse", F.concat(F.substring(acc, F.lit(1), F.char_length(acc) - 1), p["text"])).otherwise(F.concat(acc, p["text"])),
    )
    return parts.select("book", "para", F.col("parts")[0]["page"].alias("page"), F.size("parts").cast("long").alias("n_blocks"), text.alias("text"))


def seams(blocks: DataFrame) -> DataFrame:
    """Turns of the page at which a paragraph could have gone on and did not: book, page of the block after."""
    w = Window.partitionBy("book").orderBy("page", "ord")
    flow = blocks.where(F.col("category") == "Text").withColumn("p_page", F.lag("page").over(w)).withColumn("p_text", F.lag("text").over(w))
    refused = ~X.continues_textually(F.col("p_text"), F.col("text"))
    return flow.where((F.col("page") - F.col("p_page") == 1) & refused).select("book", "page")


def heading_chains(blocks: DataFrame) -> DataFrame:
    """Chains of headings of one page that follow each other become one: book, page, h (ord of the first, the union box, n,
    text, category).

    Any other block ends a chain. A heading joins if it lies below and close (within 1.5 times the larger type size), shares
    half of the narrower width, and one of the two has four words at most, judged against the growing union box; so a chain
    of neighbouring headings is folded in order."""
    w = Window.partitionBy("book", "page").orderBy("ord")
    fields = "ord", "x1", "y1", "x2", "y2", "text", "category"
    # of the other blocks only the place counts
    rows = in_flow(blocks).select("book", "page", "ord", F.when(F.col("category").isin(*HEADINGS), F.struct(*fields)).alias("h"))
    heads = rows.withColumn("rn", F.row_number().over(w)).where("h is not null").withColumn("run", F.col("rn") - F.row_number().over(w))
    chains = heads.groupBy("book", "page", "run").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    empty = F.expr("cast(array() as array<struct<ord:int,x1:double,y1:double,x2:double,y2:double,n:int,text:string,category:string>>)")

    def step(acc, h):
        last = F.element_at(acc, -1)
        overlap = F.least(last["x2"], h["x2"]) - F.greatest(last["x1"], h["x1"])
        narrow = F.least(last["x2"] - last["x1"], h["x2"] - h["x1"])
        line = F.greatest(G.type_size(last["y2"] - last["y1"], last["text"]), G.type_size(h["y2"] - h["y1"], h["text"]))
        short = (X.plain_word_count(last["text"]) <= 4) | (X.plain_word_count(h["text"]) <= 4)
        joins = (F.size(acc) > 0) & (narrow > 0) & (overlap >= 0.5 * narrow) & (h["y1"] >= last["y1"]) & (h["y1"] - last["y2"] <= 1.5 * line) & short
        item = lambda o, x1, y1, x2, y2, n, t, c: F.struct(o.cast("int").alias("ord"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"), n.cast("int").alias("n"), t.alias("text"), c.alias("category"))
        loud = F.when((last["category"] == "Title") | (h["category"] == "Title"), "Title").otherwise("Section-header")
        text = F.concat(F.rtrim(last["text"], F.lit(X.BLANK)), F.lit("\n"), F.ltrim(h["text"], F.lit(X.BLANK)))
        union = [f(last[c], h[c].cast("double")) for f, c in ((F.least, "x1"), (F.least, "y1"), (F.greatest, "x2"), (F.greatest, "y2"))]
        merged = item(last["ord"], *union, last["n"] + 1, text, loud)
        single = item(h["ord"], h["x1"], h["y1"], h["x2"], h["y2"], F.lit(1), h["text"], h["category"])
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(single)))

    return chains.select("book", "page", F.explode(F.aggregate("hs", empty, step)).alias("h"))


def merged_headings(blocks: DataFrame) -> DataFrame:
    """book, page, ord of the first, n, category, label of each heading once neighbours are merged."""
    return heading_chains(blocks).select("book", "page", F.col("h.ord").alias("ord"), F.col("h.n").cast("long").alias("n"), F.col("h.category").alias("category"), X.heading_label(F.col("h.text")).alias("label"))


def joined_headings(blocks: DataFrame) -> DataFrame:
    """The merged headings as blocks (book, page, ord, category, text, boxes, size of the page)."""
    fields = "ord", "category", "text", "x1", "y1", "x2", "y2"
    size = blocks.where(F.col("category").isin(*HEADINGS)).groupBy("book", "page").agg(F.first("page_width").alias("page_width"), F.first("page_height").alias("page_height"))
    return heading_chains(blocks).select("book", "page", *[F.col(f"h.{c}").alias(c) for c in fields]).join(size, ["book", "page"])


def reflowed_book(blocks: DataFrame) -> dict[str, DataFrame]:
    """A book's blocks as it reads: running heads and furniture set aside, headings merged, broken words healed, wrapped prose
    unwrapped, sections opened, paragraphs joined, footnotes cut into notes.

    The steps are in this order, and the lexicon and the column are those of the blocks before their texts are changed. The
    texts are written once, parted into the few that may be running heads and all others, which no step joins or deals out;
    facts of books and pages, headings and healed texts are tables of their own."""
    from . import blocks as B
    from . import notes as N

    spark = blocks.sparkSession
    near = written(spark, blocks.where(B.may_run()), "near")
    far = written(spark, in_flow(blocks).where(~B.may_run()), "far")
    shelf = written(spark, B.running_heads(near.unionByName(far), near), "shelf")
    kept = far.unionByName(written(spark, in_flow(near).join(shelf, ["book", "page", "ord"], "left_anti"), "kept"))
    heads = written(spark, joined_headings(kept), "headings")
    joined = kept.where(~F.col("category").isin(*HEADINGS)).select(*heads.columns).unionByName(heads)
    breaks = F.coalesce(F.contains("text", F.lit("-\n")) & F.col("text").rlike(BROKEN), F.lit(False))
    broken = written(spark, joined.where(breaks), "broken")
    asking = written(spark, broken.select("book").distinct(), "asking")
    healed = written(spark, dehyphenated(broken, lexicon(joined.join(asking, "book", "left_semi"))), "healed")
    plain = joined.where(~breaks).unionByName(healed).withColumn("text", F.when(F.col("category") == "Text", X.reflowed(F.col("text"))).otherwise(F.col("text")))
    starts = written(spark, B.section_starts(plain), "starts")
    column = written(spark, B.body_column(joined), "column")
    first = plain.groupBy("book", "page").agg(F.min("ord").alias("ord")).join(starts.select("book", "page"), ["book", "page"])
    aligned = plain.join(column, "book").withColumn("align", G.alignment_class(F.col("x1"), F.col("x2"), F.col("body_x1"), F.col("body_x2")))
    flow = aligned.select("book", "page", "ord", "category", "text", "align")
    notes = plain.where(F.col("category") == "Footnote")
    return {"sections": starts, "shelf": shelf, "paragraphs": flow_paragraphs(flow, first), "notes": N.split_notes(notes.select("book", "page", "ord", "text"), ["book", "page", "ord"])}
