"""Re-binding of notes after edits: what an edit keeps or loses of the references into the rows it changed.

A reference names a block as it was recorded. The rows that an edit made of a block (itself, the survivor of a merge, both
halves of a split) are its heirs, and only notes that named a block may be claimed by its heirs. In an heir's new text the
raised numbers are taken in order, and each goes to the first of those notes, in the order of rows, that prints its number and
is not taken yet. Numbers meet notes only of their own value, so that is the k-th run of a value with the k-th note of it: two
row numbers and a join, and no row's list is walked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .refs import superscript_runs


def claims_on(edited: DataFrame, sources: DataFrame, rows: DataFrame) -> DataFrame:
    """book, src, heir, heir_pos: the edited rows (book, id) that each recorded block went into. sources (book, id, src) tells
    what a row is made of; a row that it does not name is made of itself."""
    placed = edited.select("book", "id").distinct().join(rows.select("book", "id", "pos"), ["book", "id"])
    made = placed.join(sources.select("book", "id", "src").distinct(), ["book", "id"], "left")
    return made.select("book", F.coalesce("src", "id").alias("src"), F.col("id").alias("heir"), F.col("pos").alias("heir_pos"))


def bindings(rows: DataFrame, refs: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references that edited rows keep (book, note, block, at, len), and their raised numbers that no note claims
    (book, block, at, len, printed). rows: book, pos, id, category, text as they are now; refs: book, note, nth, block, at,
    len in each note's own order. Numbers within a footnote are its own."""
    notes = rows.select("book", F.col("id").alias("note"), F.col("pos").alias("note_pos"), X.note_lead(F.col("text")).alias("printed"))
    asked = refs.select("book", "note", F.col("block").alias("src")).join(claims, ["book", "src"]).select("book", "heir", "note").distinct()
    claimants = asked.join(notes, ["book", "note"]).where("printed is not null")
    nth_note = F.row_number().over(Window.partitionBy("book", "heir", "printed").orderBy("note_pos"))
    claimants = claimants.select("book", "heir", "printed", "note", nth_note.alias("k"))
    edited = claims.select("book", F.col("heir").alias("id")).distinct()
    prose = rows.where(F.col("category") != "Footnote").join(edited, ["book", "id"], "left_semi")
    runs = prose.select("book", F.col("id").alias("heir"), F.explode(superscript_runs(F.col("text"))).alias("r")).select("book", "heir", "r.at", "r.len", "r.printed")
    nth_run = F.row_number().over(Window.partitionBy("book", "heir", "printed").orderBy("at"))
    both = runs.withColumn("k", nth_run).join(claimants, ["book", "heir", "printed", "k"], "left")
    bound = both.where("note is not null").select("book", "note", F.col("heir").alias("block"), "at", "len")
    return bound, both.where("note is null").select("book", F.col("heir").alias("block"), "at", "len", "printed")


def rebind(rows: DataFrame, refs: DataFrame, loose: DataFrame, orphans: DataFrame, edited: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """refs, loose and orphans after the edits, and the references that were lost.

    rows: book, pos, id, category, text (edited). refs: book, note, nth, block, at, len. loose: book, block, at, len, printed
    (numbers without a note). orphans: book, note (notes without a number). Of a note's list, a reference into a row that
    nobody touched stays where it was; one into an edited block gives way, in its place, to what the note claimed in that
    block's heirs, each heir once. nth is counted anew."""
    claims = claims_on(edited, sources, rows)
    bound, free = bindings(rows, refs, claims)
    heirs = refs.join(claims.withColumnRenamed("src", "block"), ["book", "block"], "left")
    untouched = heirs.where("heir is null").select("book", "note", F.struct("nth", F.lit(None).cast("long").alias("heir_pos")).alias("place"), "block", "at", "len")
    # an heir that two references of a note lead to is met at the first of them
    met = heirs.where("heir is not null").groupBy("book", "note", F.col("heir").alias("block")).agg(F.min(F.struct("nth", F.col("heir_pos").cast("long").alias("heir_pos"))).alias("place"))
    kept = met.join(bound, ["book", "note", "block"]).select("book", "note", "place", "block", "at", "len")
    now = untouched.unionByName(kept)
    nth = F.row_number().over(Window.partitionBy("book", "note").orderBy("place")) - 1
    left = refs.select("book", "note").distinct().join(now.select("book", "note"), ["book", "note"], "left_anti")
    touched = claims.select("book", F.col("src").alias("block")).distinct()
    return {
        "refs": now.select("book", "note", nth.alias("nth"), "block", "at", "len"),
        "loose": loose.join(touched, ["book", "block"], "left_anti").select("book", "block", "at", "len", "printed").unionByName(free),
        "orphans": orphans.select("book", "note").unionByName(left).distinct(),
        "lost": met.join(bound, ["book", "note", "block"], "left_anti").select("book", "note", "block"),
    }
