"""Exact token counts: a histogram of encoded lengths, whose suffix sums answer totals for every context limit.

Nulls: a null text has length 0. Repeated rows count again. An empty table has an empty histogram. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, slices, texts_of, written
from .tokens import encoder

#: Lengths of one block of the two-level suffix sums; a window holds one block, or the list of blocks.
BLOCK = 4096


def _lengths(batches, tokenizer: str):
    bpe = encoder(tokenizer)
    for rows in batches:
        for part in slices(rows, 0):
            _, counts = bpe.encode(texts_of(part.column(0)))
            lengths, docs = np.unique(counts, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array(docs)], names=["n_tokens", "n_docs"])


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: counted in each task first, so the shuffle holds a row for each length and task."""
    lengths = docs.select(col(docs, text_col).cast("string").alias("text")).mapInArrow(partial(_lengths, tokenizer=tokenizer), "n_tokens long, n_docs long")
    return lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: documents and tokens at least and below that length, the
    tokens left when each document is cut there, and the share of documents not longer (the quantile of that length)."""
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("bd"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("bt"), F.sum("bd").over(everything).alias("all_docs"), F.sum("bt").over(everything).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = h.join(blocks, "block").withColumn("docs_ge", F.sum("n_docs").over(inside) + F.col("bd")).withColumn("tokens_ge", F.sum("tokens").over(inside) + F.col("bt"))
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("all_tokens") - F.col("tokens_ge")).alias("tokens_below"),
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("tokens_cut_here"),
        (F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
        "all_docs",
        "all_tokens",
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut at limit, whether or not that length occurs: one row."""
    nearest = sums.where(F.col("n_tokens") >= limit).orderBy("n_tokens").limit(1)
    found = nearest.select((F.col("tokens_below") + F.lit(limit) * F.col("docs_ge")).alias("tokens"))
    whole = sums.agg(F.coalesce(F.max("all_tokens"), F.lit(0)).alias("whole"))
    return whole.join(found.agg(F.max("tokens").alias("tokens"))).select(F.coalesce("tokens", "whole").alias("tokens"))


def length_quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share q of all documents do not exceed: one row, null if there are none."""
    return sums.where(F.col("docs_le") >= F.lit(q) * F.col("all_docs")).agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """The sums of all lengths; the histogram is written first, so that every text is encoded once."""
    histogram, _ = written(length_histogram(docs, tokenizer, text_col), "length-histogram")
    return suffix_sums(histogram)

