"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

A run holds one row for each distinct line key: its 128-bit hash, the number of documents that hold it and the largest
doc_id among them, sorted by hash. Each new batch of documents is merge-anti-joined with the runs: keys that no run has
go into a run of their own at level 0, keys known before go into a run of additions. When a level has FANOUT runs, they
are merged into one run of the next level. At the end all runs are merged once; keys of at least MIN_CHARS code points
in at least MIN_DOCS documents lose their lines everywhere but in the largest doc_id.

A null or empty text is one empty line. Null doc_ids count as one document smaller than all others. Repeated rows with
one doc_id count as one document and are treated alike. An empty table gives an empty result. Other columns are ignored
by line_report and kept by drop_lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, col, drop_scratch, id_text, written

MIN_CHARS, MIN_DOCS, FANOUT = 40, 5, 2
#: The letters that keys are lower-cased from and to.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; for a text of ASCII alone, lower() does the same and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """One struct for each line: 128-bit hash of its key, or null where the key is too short."""
    def one(line: Column) -> Column:
        key = F.btrim(line, F.lit(SPACES))
        return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))

    return F.transform(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "\n", -1), one)


def batch_keys(docs: DataFrame, batches: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """batch, h1, h2, n_docs, last_doc of all documents (columns doc_id, text). Batches are dealt by a hash of the id, so
    all rows of one doc_id are in one batch and no document is counted twice."""
    keys = docs.select("doc_id", F.explode(F.array_distinct(line_hashes(F.col("text"), min_chars))).alias("k")).where("k is not null")
    deal = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    # repeated rows of one doc_id (null is one value too) hold a key once
    once = keys.select("doc_id", "k.h1", "k.h2").distinct()
    return once.groupBy(deal, "h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def merged(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


class LineRuns:
    """Levelled runs in the shared folder. Each level holds fewer than FANOUT runs between batches."""

    def __init__(self, fanout: int = FANOUT):
        self.levels: list[list[tuple[DataFrame, str]]] = [[]]
        self.fanout = fanout

    def all_runs(self) -> list[DataFrame]:
        return [df for level in self.levels for df, _ in level]

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch's keys with the runs, add what is new as a run and the rest as additions."""
        spark = batch.sparkSession
        fresh = batch
        for run in self.all_runs():
            fresh = fresh.hint("merge").join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        known = bool(self.all_runs())
        self._push(fresh.sortWithinPartitions("h1", "h2"), 0)
        if known:
            added = self.levels[0][-1][0]
            self._push(batch.hint("merge").join(added.select("h1", "h2"), ["h1", "h2"], "left_anti").sortWithinPartitions("h1", "h2"), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self._push(merged([df for df, _ in old]).sortWithinPartitions("h1", "h2"), level + 1)
            drop_scratch(spark, *(path for _, path in old))
            level += 1

    def _push(self, run: DataFrame, level: int) -> None:
        self.levels[level].append(written(run, f"line-run-{level}"))

    def drop(self, spark) -> None:
        drop_scratch(spark, *(path for level in self.levels for _, path in level))


def repeated_lines(docs: DataFrame, batches: int = 3, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """The keys that lose lines (h1, h2, last_doc) and where they are written."""
    spark = docs.sparkSession
    keys, path = written(batch_keys(id_text(docs, id_col, text_col), batches, min_chars), "line-keys", ["batch"])
    runs = LineRuns()
    for k in range(batches):
        runs.add(keys.where(F.col("batch") == k).drop("batch"))
    drop_scratch(spark, path)
    hot, path = written(merged(runs.all_runs()).where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc"), "hot-lines")
    runs.drop(spark)
    return hot, path


def _drops(rows: DataFrame, hot: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, drops: the hashes of the lines that this document loses."""
    keys = rows.select("doc_id", F.explode(F.array_distinct(line_hashes(F.col("text"), min_chars))).alias("k")).where("k is not null")
    hit = keys.select("doc_id", "k.h1", "k.h2").join(hot, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return hit.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))


def _kept(text: Column, drops: Column, min_chars: int) -> Column:
    """Lines that stay, as an array. The line's own hash is taken again, so positions need not be carried."""
    text = F.coalesce(text, F.lit(""))
    pairs = F.arrays_zip(F.split(text, "\n", -1).alias("line"), line_hashes(text, min_chars).alias("k"))
    kept = F.transform(F.filter(pairs, lambda p: p["k"].isNull() | ~F.array_contains(drops, p["k"])), lambda p: p["line"])
    return F.when(drops.isNull(), F.split(text, "\n", -1)).otherwise(kept)


def line_report(docs: DataFrame, batches: int = 3, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_text."""
    hot, _ = repeated_lines(docs, batches, min_chars, min_docs, id_col, text_col)
    rows = id_text(docs, id_col, text_col)
    drops = _drops(rows, hot, min_chars).withColumnRenamed("doc_id", "drop_id")
    both = rows.join(drops, rows.doc_id.eqNullSafe(drops.drop_id), "left")
    kept = _kept(F.col("text"), F.col("drops"), min_chars)
    out = both.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


def drop_lines(docs: DataFrame, batches: int = 3, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their repeated lines gone and every other column as it was."""
    hot, _ = repeated_lines(docs, batches, min_chars, min_docs, id_col, text_col)
    drops = _drops(id_text(docs, id_col, text_col), hot, min_chars).toDF("__drop_id", "__drops")
    both = docs.join(drops, col(docs, id_col).eqNullSafe(drops["__drop_id"]), "left")
    text = col(docs, text_col)
    new = F.when(drops["__drops"].isNull(), text).otherwise(F.array_join(_kept(text, drops["__drops"], min_chars), "\n"))
    return both.select(*[new.alias(c) if c == text_col else col(docs, c) for c in docs.columns])
