"""Book sinks as tables: plain text, block dumps, chapter lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain_text(rows: DataFrame, between: str = "\n\n") -> DataFrame:
    """rows (book, pos, text) -> book, text: a book's rows in order. A book is one value by the nature of the format."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return rows.groupBy("book").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), between).alias("text"))


def plain_text_rows(rows: DataFrame) -> DataFrame:
    """rows (book, pos, text) -> the same in reading order, sorted by range partition: joined by plain_text's separator,
    a book's rows are its plain text, and no task needs to hold a whole book."""
    return rows.where("text is not null").select("book", "pos", "text").orderBy("book", "pos", "text")


def blocks_dump(blocks: DataFrame, unreadable: DataFrame) -> DataFrame:
    """book, page, json: a page's blocks in order, and whether its answer could be read."""
    fields = [c for c in blocks.columns if c not in ("book", "page")]
    pages = blocks.groupBy("book", "page").agg(F.to_json(F.array_sort(F.collect_list(F.struct("ord", *[c for c in fields if c != "ord"])))).alias("json"))
    bad = unreadable.select("book", "page").distinct().withColumn("bad", F.lit(True))
    return pages.join(bad, ["book", "page"], "full").select("book", "page", F.coalesce("json", F.lit("[]")).alias("json"), F.coalesce("bad", F.lit(False)).alias("unreadable"))
