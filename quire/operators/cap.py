"""The adaptive token cap: a running maximum of accepted answers, and the pages that are read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .running import running

#: Multiple of the longest accepted answer, the least cap, and the model's own.
TIMES, FLOOR, MODEL_CAP = 4, 2000, 16384


def sent_caps(answers: DataFrame, model_cap: int = MODEL_CAP) -> DataFrame:
    """answers (book, seq, page, tokens, finish_reason, text) in order of arrival, with the cap each page was sent."""
    accepted = (~F.col("finish_reason").eqNullSafe(F.lit("length"))) & (X.trim_all(F.col("text")) != "")
    rows = running(answers.withColumn("__raises", F.when(accepted, F.col("tokens"))), ["book"], "seq", "__raises", F.max, "__longest", before=True)
    longest = F.col("__longest")
    cap = F.when(longest.isNull(), F.lit(model_cap)).otherwise(F.least(F.lit(model_cap), F.greatest(F.lit(FLOOR), F.floor(longest * TIMES))))
    return rows.withColumn("cap", cap.cast("long")).withColumn("accepted", accepted).drop("__raises", "__longest")


def pages_to_reread(answers: DataFrame, model_cap: int = MODEL_CAP) -> DataFrame:
    """book, page, cap, final: refused pages for which the final cap is twice what they were sent, or more."""
    sent = sent_caps(answers, model_cap)
    final = sent.groupBy("book").agg(F.max(F.when(F.col("accepted"), F.col("tokens"))).alias("m"))
    final = final.select("book", F.when(F.col("m").isNull(), model_cap).otherwise(F.least(F.lit(model_cap), F.greatest(F.lit(FLOOR), F.col("m") * TIMES))).cast("long").alias("final"))
    return sent.where("not accepted").join(final, "book").where(F.col("final") >= 2 * F.col("cap")).select("book", "page", "cap", "final")
