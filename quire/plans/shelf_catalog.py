"""Queries of banks of answers over several runs, each beside the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.scratch import folder
from ..sources.shelf import Shelf
from . import standins as S
from .catalog import query

#: Documents as pages of 48 books. The first run leaves the books completed (0 modulo 4), in part (1, 2) or empty (3); the
#: second reads some anew beside their banks; the third is asked for other things, and finishes what was read whole.
PAGES = "p AS (SELECT doc_id % 48 AS b, doc_id, text FROM documents), s AS (SELECT b, count(*) AS n, count(*) FILTER (WHERE doc_id % 96 < 48) AS half FROM p GROUP BY b)"


def _runs(spark, d):
    docs = S.table(spark, d, "documents").select((F.col("doc_id") % 48).alias("b"), (F.col("doc_id") % 48).cast("string").alias("book"), F.col("doc_id").cast("int").alias("page"), F.lit(0).alias("seq"), F.sha2("text", 256).alias("text"))
    books = docs.select("b", "book").distinct()
    b = F.col("b")

    def asked(language=None, fresh=None, reuse=None):
        none = F.lit(False)
        return books.select("book", F.lit(None).cast("array<int>").alias("skip"), (F.lit("en") if language is None else language).alias("language"), F.lit("m").alias("model"), (none if fresh is None else fresh).alias("fresh"), (none if reuse is None else reuse).alias("reuse"))

    shelf = Shelf(spark, folder(spark, "shelf"))
    first = shelf.open(asked())
    shelf.append(first, docs.where(b % 4 != 3).withColumn("text", F.concat(F.lit("1 "), "text")))
    shelf.finish(first.where("cast(book as long) % 4 = 0"), "2020-01-01")
    second = shelf.open(asked(fresh=b % 4 == 2, reuse=b % 8 == 4))
    shelf.append(second, docs.where((b % 4 == 2) | ((b % 8 == 0) & (F.col("page") % 96 < 48))).withColumn("text", F.concat(F.lit("2 "), "text")))
    third = shelf.open(asked(language=F.when(b % 16 == 0, "de").otherwise("en"), reuse=(b % 8 == 4) | (b % 4 == 3) | (b % 8 == 5)))
    shelf.finish(third.where("cast(book as long) % 4 = 2"), "2020-01-03")
    return shelf, third


@query("bank_runs", rf"""
WITH {PAGES}
SELECT b::VARCHAR AS book, CASE WHEN b % 16 = 0 THEN 'read-fresh' WHEN b % 16 = 8 THEN CASE WHEN half > 0 THEN 'resume' ELSE 'read-fresh' END WHEN b % 8 = 4 THEN 'reuse' WHEN b % 8 = 5 OR b % 4 = 3 THEN 'refused' ELSE 'resume' END AS action,
  CASE WHEN b % 8 = 0 OR b % 4 = 2 THEN 'pending' WHEN b % 8 = 1 THEN 'bank' END AS target,
  CASE WHEN b % 16 = 0 OR b % 8 = 5 OR b % 4 = 3 THEN 0 WHEN b % 16 = 8 THEN half ELSE n END AS carried,
  CASE WHEN b % 8 = 5 THEN 'no run has completed' WHEN b % 4 = 3 THEN 'nothing to reuse' END AS reason
FROM s""")
def bank_runs(spark, d):
    """What the third run does with each book that the first two left behind."""
    return _runs(spark, d)[1].select("book", "action", "target", "carried", "reason")


@query("bank_pages", rf"""
WITH {PAGES}
SELECT b::VARCHAR AS book, doc_id::INT AS page, CASE WHEN b % 4 = 2 THEN '2 ' ELSE '1 ' END || sha256(text) AS text FROM p WHERE b % 4 <> 3""")
def bank_pages(spark, d):
    """The banks after the runs: what was read anew and finished has taken its place, all else is as it was."""
    return _runs(spark, d)[0].bank()
