"""References in marked-up books: anchors, enclosing stamps, displaced markers, loose numbers, references before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .running import following, previous, running
from .scratch import cut


def superscript_runs(text: Column) -> Column:
    """array<struct<at, len, printed>> of the raised numbers of a text."""
    runs = X.match_spans(text, f"[{X.SUPERSCRIPTS}]+")
    return F.transform(runs, lambda r: F.struct(r["at"].alias("at"), r["len"].alias("len"), F.translate(r["hit"], X.SUPERSCRIPTS, X.DIGITS).try_cast("int").alias("printed")))


def loose_runs(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """book, id, at, len, printed: raised numbers of the prose that no reference (book, block, at, len) claims."""
    runs = rows.where(F.col("category") != "Footnote").select("book", "id", F.explode(superscript_runs(F.col("text"))).alias("r")).select("book", "id", "r.at", "r.len", "r.printed")
    claims = refs.select(F.col("book").alias("c_book"), F.col("block").alias("c_id"), F.col("at").alias("c_at"), F.col("len").alias("c_len"))
    meets = (F.col("book") == F.col("c_book")) & (F.col("id") == F.col("c_id")) & (F.col("at") < F.col("c_at") + F.col("c_len")) & (F.col("c_at") < F.col("at") + F.col("len"))
    return runs.join(claims, meets, "left_anti")


def exact_links(rows: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References (book, note, block, at, len) that name a raised number of their row exactly, and those that do not."""
    runs = rows.select("book", F.col("id").alias("block"), F.explode(superscript_runs(F.col("text"))).alias("r")).select("book", "block", "r.at", "r.len", "r.printed")
    key = ["book", "block", "at", "len"]
    return refs.join(runs, key).select("book", "note", "block", "at", "len", "printed"), refs.join(runs, key, "left_anti")


def anchored(refs: DataFrame, anchors: DataFrame) -> DataFrame:
    """refs (book, document, href) with the row that their target names; anchors (book, document, anchor, row). A target
    without a document is in the document of the reference."""
    file, fragment = F.regexp_extract("href", r"\A([^#]*)", 1), F.regexp_extract("href", r"#(.*)\z", 1)
    asked = refs.withColumn("t_document", F.when(file == "", F.col("document")).otherwise(file)).withColumn("t_anchor", fragment)
    targets = anchors.select("book", F.col("document").alias("t_document"), F.col("anchor").alias("t_anchor"), "row")
    return asked.join(targets, ["book", "t_document", "t_anchor"], "left").select(*refs.columns, "row")


def imported_refs(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """refs (book, seq, row, printed) with ``state``. A target that is a note is one. Another row becomes one with the first
    reference, in the order of seq, whose printed number is the one that the row opens with (behind emphasis signs; as it is
    printed, so 01 is not 1; no superscripts): that is "promoted", and later references to the row meet a note. All else is
    "unresolved"."""
    opens = F.regexp_extract("text", rf"\A[{X.WIDE_CLASS}*]*([0-9]+)", 1)
    both = refs.join(rows.select("book", F.col("id").alias("row"), "category", opens.alias("__opens")), ["book", "row"], "left")
    both = both.withColumn("__fits", F.coalesce((F.col("category") != "Footnote") & (F.col("__opens") == F.col("printed").cast("string")), F.lit(False)))
    first = both.where("__fits").groupBy("book", "row").agg(F.min("seq").alias("__first"))
    state = F.when((F.col("category") == "Footnote") | (F.col("seq") > F.col("__first")), "note").when(F.col("seq") == F.col("__first"), "promoted").otherwise("unresolved")
    return both.join(first, ["book", "row"], "left").select(*refs.columns, state.alias("state"))


def nearest_stamped(elements: DataFrame) -> DataFrame:
    """doc, id, stamped: the closest element above that has a category. elements (doc, id, parent, category).

    Pointer doubling: an element whose parent has no category looks where its parent looks, so a tree of depth n takes
    log2(n) joins."""
    step = elements.select("doc", "id", F.col("parent").alias("at"))
    known = elements.where("category is not null").select("doc", F.col("id").alias("at"), F.lit(True).alias("found"))
    now = cut(step.join(known, ["doc", "at"], "left").select("doc", "id", "at", F.coalesce("found", F.lit(False)).alias("done")))
    while not now.where("at is not null and not done").isEmpty():
        up = now.select("doc", F.col("id").alias("at"), F.col("at").alias("up"), F.col("done").alias("up_done"))
        both = now.join(up, ["doc", "at"], "left")
        move = ~F.col("done") & F.col("at").isNotNull()
        now = cut(both.select("doc", "id", F.when(move, F.col("up")).otherwise(F.col("at")).alias("at"), F.when(move, F.coalesce("up_done", F.lit(False))).otherwise(F.col("done")).alias("done")))
    return now.select("doc", "id", F.when(F.col("done"), F.col("at")).alias("stamped"))


def new_homes(markers: DataFrame, leaves: DataFrame) -> DataFrame:
    """markers (doc, page, offset) whose place went, with ``home``: the first leaf (doc, page, start) of the page behind it."""
    both = markers.select("doc", "page", "offset", F.lit(None).cast("long").alias("leaf"), F.lit(True).alias("asks")).unionByName(leaves.select("doc", "page", F.col("start").alias("offset"), F.col("start").cast("long").alias("leaf"), F.lit(False).alias("asks")))
    return following(both, ["doc", "page"], "offset", "leaf", "home").where("asks").select("doc", "page", "offset", "home")


def reference_counts(refs: DataFrame) -> DataFrame:
    """book, target, before, after, lost: how often each target is referred to before and after (``kept``) a cut."""
    sums = refs.groupBy("book", "target").agg(F.count(F.lit(1)).alias("before"), F.count_if("kept").alias("after"))
    return sums.withColumn("lost", F.col("after") == 0)


def orphaned(before: DataFrame, after: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """book, image: what was referred to before and is not after; exempt ones (a cover) stay."""
    gone = before.select("book", "image").distinct().join(after.select("book", "image"), ["book", "image"], "left_anti")
    return gone if exempt is None else gone.join(exempt.select("book", "image"), ["book", "image"], "left_anti")


def promoted_labels(rows: DataFrame, divisions: DataFrame, most: int = 4) -> DataFrame:
    """book, pos of the rows that print their division's title. divisions: book, nth, pos, title; rows: book, pos,
    category, text.

    From a division's row on, up to ``most`` rows are titles while they are text or headings and, without emphasis signs, with
    white space collapsed and in lower case, are part of the title or hold it. The first that is not ends the walk, and so
    does a row that a division before (by nth) has made a title. Divisions whose walks may meet are folded in that order
    within their run of neighbours; all others stand alone."""
    name = lambda c: F.lower(X.trim_wide(F.regexp_replace(F.replace(c, F.lit("*")), rf"[{X.WIDE_CLASS}]+", " ")))
    starts = divisions.select("book", "nth", F.col("pos").alias("start"), name(F.col("title")).alias("label")).where("label <> ''")
    asked = starts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("pos", F.col("start") + F.col("k"))
    both = asked.join(rows.select("book", "pos", "category", name(F.col("text")).alias("printed")), ["book", "pos"], "left")
    fits = F.coalesce(F.col("category").isin("Text", "Section-header") & (F.col("printed") != "") & (F.contains(F.col("label"), F.col("printed")) | F.contains(F.col("printed"), F.col("label"))), F.lit(False))
    # how many rows from the start on fit, had no other division been there
    ends = both.groupBy("book", "nth", "start").agg(F.min(F.when(~fits, F.col("k"))).alias("stop"))
    walks = ends.select("book", "nth", "start", F.coalesce("stop", F.lit(most)).alias("length")).where("length > 0")
    apart = previous(walks, ["book"], ["start", "nth"], "start", "before")
    apart = apart.withColumn("fresh", F.coalesce(F.col("start") - F.col("before") >= most, F.lit(True)).cast("int"))
    runs = running(apart, ["book"], "start", "fresh", F.sum, "run").groupBy("book", "run").agg(F.array_sort(F.collect_list(F.struct("nth", "start", "length"))).alias("walks"))

    def walk(taken, w):
        places = F.sequence(w["start"], w["start"] + w["length"] - 1)
        met = F.array_min(F.array_intersect(places, taken))
        return F.concat(taken, F.filter(places, lambda p: met.isNull() | (p < met)))

    taken = F.aggregate("walks", F.lit([]).cast("array<long>"), lambda acc, w: walk(acc, F.struct(w["start"].cast("long").alias("start"), w["length"].cast("long").alias("length"))))
    return runs.select("book", F.explode(taken).alias("pos"))


def stamp_report(elements: DataFrame) -> DataFrame:
    """book, category, layer, n."""
    return elements.groupBy("book", "category", "layer").agg(F.count(F.lit(1)).alias("n"))
