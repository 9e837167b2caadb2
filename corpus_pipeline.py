"""A corpus pipeline: language, repeated lines, near-duplicates, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, language_id, line_dedup, ngram_join, pieces
from quire.llm.common import MADE, drop_scratch, written
from quire.llm.queries import table, tokenizer_path


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts in no learned language."""
    known = docs.where(~language_id.held_out(F.col("doc_id")))
    return language_id.keep_languages(docs, language_id.fit(known), floors=language_id.evidence_floors(known))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces, n_pieces and the decoded text, which is the text again."""
    # a small cache: the workers still hold what the stages before gave them
    encoded = pieces.encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"), cache_size=60_000)
    return encoded.select("doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"), F.col("decoded").alias("text"))


STAGES = [
    ("language", keep_known_languages),
    ("lines", drop_repeated_lines),
    ("near copies", drop_near_copies),
    ("benchmark", drop_benchmark_passages),
    ("pieces", encode_sampled_pieces),
]

#: The language model and the sampled pieces are no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written and read again; what it and the stage before left behind is deleted then."""
    docs, path, old = table(spark, sf_dir, "documents"), None, set(MADE)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = written(docs, f"stage-{k}")
            drop_scratch(spark, *(set(MADE) - old - {path}))
    return docs
