"""Runaway answers: the share of the most frequent five-word phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters and words an answer needs to be judged, words of a phrase, and the share that flags it.
LEAST_CHARS, LEAST_WORDS, PHRASE, SHARE = 800, 20, 5, 0.15


def phrase_stats(text: Column) -> Column:
    """struct<top, total>: how often the most frequent phrase occurs, and the number of phrases; null for a text that is too
    short to be judged.

    A phrase's copies stand together in the sorted list of phrases, so this is a fold within the row and shuffles nothing.
    The words are bound by a lambda, so that they are taken from the text once."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("top"))

    def step(acc, p):
        run = F.when(p == acc["last"], acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(p.alias("last"), run.alias("run"), F.greatest(acc["top"], run).alias("top"))

    def judged(words):
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - PHRASE + 1), lambda i: F.array_join(F.slice(words, i, PHRASE), " "))
        top = F.aggregate(F.sort_array(grams), start, step, lambda a: a["top"])
        return F.when(F.size(words) >= LEAST_WORDS, F.struct(top.alias("top"), (F.size(words) - PHRASE + 1).cast("long").alias("total")))

    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))
    return F.when(F.char_length(text) >= LEAST_CHARS, F.element_at(F.transform(F.array(words), judged), 1))


def phrase_shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, top, total, flagged of every text that is long enough; rows that share an id are judged one by one."""
    found = docs.select(F.col(id_col).alias("doc_id"), phrase_stats(F.col(text_col)).alias("s")).where("s is not null")
    return found.select("doc_id", "s.top", "s.total", (F.col("s.top") / F.col("s.total") >= SHARE).alias("flagged"))


def emptied(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """The pages with the text of runaway and cut-off answers emptied; the page itself stays."""
    share = F.element_at(F.transform(F.array(phrase_stats(F.col(text_col))), lambda s: s["top"] / s["total"]), 1)
    bad = F.coalesce(share >= SHARE, F.lit(False))
    if "finish_reason" in pages.columns:
        bad = bad | F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    return pages.withColumn(text_col, F.when(bad, "").otherwise(F.col(text_col)))
