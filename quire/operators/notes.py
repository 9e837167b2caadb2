"""Notes: cutting a footnote block into notes, and both ways of linking markers to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def split_notes(blocks: DataFrame, key: list[str]) -> DataFrame:
    """key, note, printed, text: a note begins at a line that opens with a superscript, or with the number after the open
    note's. Each line's lead is read once; the number that is open is carried by a fold over the lines that have one, and a
    note's lines are joined once. The outer form keeps Spark from folding a second time to see whether there are notes."""
    digits = list(X.SUPERSCRIPTS + X.DIGITS)
    first = lambda line: F.substring(line, 1, 1)
    lead = lambda line, i: F.when((i == 0) | first(line).isin(digits), F.struct(i.alias("at"), first(line).isin(*X.SUPERSCRIPTS).alias("raised"), F.when(first(line).isin(digits), X.note_lead(line)).alias("number")))
    start = F.struct(F.lit(None).cast("int").alias("open"), F.expr("cast(array() as array<struct<at:int,printed:int>>)").alias("begun"))

    def step(acc, m):
        begins = (m["at"] == 0) | m["raised"] | F.coalesce(m["number"] == acc["open"] + 1, F.lit(False))
        fresh = F.struct(m["at"].alias("at"), m["number"].alias("printed"))
        return F.when(begins, F.struct(m["number"].alias("open"), F.array_append(acc["begun"], fresh).alias("begun"))).otherwise(acc)

    lines = blocks.select(*key, F.split("text", "\n").alias("__lines"))
    leads = F.filter(F.transform("__lines", lead), lambda m: m.isNotNull())
    begun = lines.select(*key, "__lines", F.aggregate(leads, start, step, lambda a: a["begun"]).alias("__begun"))
    end = lambda k: F.coalesce(F.try_element_at("__begun", k + 2)["at"], F.size("__lines"))
    text = lambda b, k: F.array_join(F.slice("__lines", b["at"] + 1, end(k) - b["at"]), "\n")
    notes = begun.select(*key, F.transform("__begun", lambda b, k: F.struct(b["printed"].alias("printed"), text(b, k).alias("text"))).alias("notes"))
    return notes.select(*key, F.posexplode_outer("notes").alias("note", "n")).where("note is not null").select(*key, "note", F.col("n.printed").alias("printed"), F.col("n.text").alias("text"))


def links_first(markers: DataFrame, notes: DataFrame) -> DataFrame:
    """Markers (book, page, pos, printed) with the first note (book, page, note, printed) of that number on the same page,
    else on the next; a note may be hit by many markers. Unlinked markers have a null note."""
    first = notes.groupBy("book", "page", "printed").agg(F.min("note").alias("note"))
    here = first.select("book", "page", "printed", F.col("note").alias("here"))
    after = first.select("book", (F.col("page") - 1).alias("page"), "printed", F.col("note").alias("after"))
    both = markers.join(here, ["book", "page", "printed"], "left").join(after, ["book", "page", "printed"], "left")
    at = F.when(F.col("here").isNotNull(), F.col("page")).when(F.col("after").isNotNull(), F.col("page") + 1)
    return both.select("book", "page", "pos", "printed", at.alias("note_page"), F.coalesce("here", "after").alias("note"))


def _claimed(key: tuple, rows: list[tuple[int, int, int]]):
    """One run in reading order: each note goes to one marker; the same page first, else the next page."""
    free: dict[int, list[int]] = {}
    for page, kind, pos in rows:
        if kind == 0:
            free.setdefault(page, []).append(pos)
    for page, kind, pos in rows:
        if kind == 1:
            at = next((p for p in (page, page + 1) if free.get(p)), None)
            yield key[0], page, pos, key[1], at, free[at].pop(0) if at is not None else None


def _claims(batches):
    """Runs come sorted, one after the other; memory holds one run."""
    import pyarrow as pa

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    names = ["book", "page", "pos", "printed", "note_page", "note"]
    table = lambda out: pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)
    now, held = None, []
    for batch in batches:
        out = []
        for book, printed, run, page, kind, pos in zip(*(c.to_pylist() for c in batch.columns)):
            if (book, printed, run) != now:
                if held:
                    out += _claimed(now, held)
                now, held = (book, printed, run), []
            held.append((page, kind, pos))
        yield table(out)
    if held:
        yield table(list(_claimed(now, held)))


def links_exclusive(markers: DataFrame, notes: DataFrame) -> DataFrame:
    """As links_first, but each note is claimed once, in reading order. A claim on the next page can take a later marker's
    note, so numbers are folded in order; the unit is a run of adjacent pages of one number, which is short."""
    both = markers.select("book", "printed", "page", "pos", F.lit(1).alias("kind")).unionByName(notes.select("book", "printed", "page", F.col("note").alias("pos"), F.lit(0).alias("kind")))
    w = Window.partitionBy("book", "printed").orderBy("page")
    runs = both.withColumn("gap", F.coalesce((F.col("page") - F.lag("page").over(w) > 1).cast("int"), F.lit(1))).withColumn("run", F.sum("gap").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    key = ["book", "printed", "run"]
    placed = runs.select(*key, F.col("page").cast("long").alias("page"), "kind", F.col("pos").cast("long").alias("pos")).repartition(*key).sortWithinPartitions(*key, "page", "kind", "pos")
    return placed.mapInArrow(_claims, "book string, page long, pos long, printed int, note_page long, note long")
