"""Streaming intake: page answers as they land, last write per page, and a running cap kept as state."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cap import FLOOR, MODEL_CAP, TIMES
from ..operators.replay import last_per_key

ANSWER = "book string, seq long, page long, tokens long, finish_reason string, text string"


def answer_stream(spark: SparkSession, path: str) -> DataFrame:
    """Answers from JSON-lines files as they appear in a folder."""
    return spark.readStream.schema(ANSWER).json(path)


def upsert_pages(stream: DataFrame, target: str, checkpoint: str):
    """Keep the latest answer of each page in versions below target: a version is written whole before the pointer names it,
    and the batch id names the version, so a batch that is run again gives the same table."""

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id:
            rows = spark.read.parquet(f"{target}/v{batch_id - 1}").unionByName(batch)
        last_per_key(rows, ["book", "page"]).select(*batch.columns).write.mode("overwrite").parquet(f"{target}/v{batch_id}")

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The newest whole version."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(target)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(at)]
    whole = [int(n[1:]) for n in names if n.startswith("v") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{target}/v{max(whole)}")


def _caps(key, frames, state):
    import pandas as pd

    longest = json.loads(state.get[0]) if state.exists else None
    for rows in frames:
        out = []
        for r in rows.sort_values("seq").itertuples(index=False):
            cap = MODEL_CAP if longest is None else min(MODEL_CAP, max(FLOOR, TIMES * longest))
            out.append((key[0], r.seq, cap))
            if r.finish_reason != "length" and r.text and r.text.strip():
                longest = int(r.tokens) if longest is None else max(longest, int(r.tokens))
        yield pd.DataFrame(out, columns=["book", "seq", "cap"])
    state.update((json.dumps(longest),))


def cap_stream(stream: DataFrame) -> DataFrame:
    """book, seq, cap: the cap each answer was sent, with the longest accepted answer of a book as its state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return stream.groupBy("book").applyInPandasWithState(_caps, "book string, seq long, cap long", "longest string", "append", GroupStateTimeout.NoTimeout)


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) in windows, with a watermark; runs on a batch table alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
