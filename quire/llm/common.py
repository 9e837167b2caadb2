"""Shared helpers: scratch tables in the shared folder, batch slicing, text arrays."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can read: the session's spark.checkpoint.dir. A local session without one gets a folder
    of its own; on a cluster its absence is an error, as executors do not share a machine's temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Scratch tables that were made and not yet deleted in this process.
MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    path = f"{shared_root(spark)}/quire/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write a table below the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more. A result that is still to be read may need its own: what is left
    in MADE can go once the result is written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in MADE:
            MADE.remove(path)


def col(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and clashing aliases included."""
    return df["`" + name.replace("`", "``") + "`"]


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator needs, renamed; every other column of the input is left aside."""
    return df.select(col(df, id_col).cast("long").alias("doc_id"), col(df, text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, text_index: int, max_bytes: int = 24 << 20):
    """Cut a record batch into runs of rows whose texts hold about max_bytes; a longer text stands alone."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i in range(n):
        if i > start and total + sizes[i] > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(sizes[i])
    yield batch.slice(start)


def texts_of(column: pa.Array) -> pa.Array:
    """Text column as 64-bit-offset strings with nulls as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")
