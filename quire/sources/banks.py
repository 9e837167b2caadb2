"""Sources: JSON-lines banks with last write per page, skip lists, ZIP members; sinks that keep order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

READING = "page int, text string, tokens long, finishReason string, seconds double, render struct<width:int,height:int>, maxPixels long, model string"


def skip_list(spark: SparkSession, text: str, widest: int = 100_000) -> DataFrame:
    """page of a list like 3,17,19-24: distinct; empty entries, backward or too wide ranges and pages below 1 are refused."""
    spans = []
    for entry in text.split(","):
        low, dash, high = entry.strip().partition("-")
        if not low.isdigit() or (dash and not high.isdigit()):
            raise ValueError(f"bad page entry {entry!r}")
        a, b = int(low), int(high or low)
        if a < 1 or b < a or b - a > widest:
            raise ValueError(f"bad page range {entry!r}")
        spans.append((a, b))
    return spark.createDataFrame(spans, "a long, b long").select(F.explode(F.sequence("a", "b")).alias("page")).distinct()


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """book (file), seq (line number from 0), value: lines of text files, which are read in splits.

    A split is read by one task from its beginning to its end, so its lines are numbered within it, and a file's splits by
    what those before hold: no file is one value and no task holds more than a split."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("book"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), "value")
    sizes = raw.groupBy("book", "split").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("book").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.select("book", "split", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("book", "split").orderBy("n")) - 1
    lines = raw.withColumn("within", within).join(placed, ["book", "split"])
    seq = F.col("before") + F.col("within")
    return lines.select("book", seq.alias("seq"), F.when(seq == 0, X.strip_bom(F.col("value"))).otherwise(F.col("value")).alias("value"))


def bank_lines(spark: SparkSession, path: str) -> DataFrame:
    """book (file), seq (line number), value, last: lines of JSON-lines files that are not blank."""
    lines = ordered_lines(spark, path).where(F.btrim("value") != "")
    ends = lines.groupBy("book").agg(F.max("seq").alias("__end"))
    return lines.join(ends, "book").select("book", "seq", "value", (F.col("seq") == F.col("__end")).alias("last"))


def accepted(good: Column, torn: Column) -> Column:
    """Whether a line is taken; one that is neither good nor a torn end refuses its file. One expression, as a condition of
    two parts could be simplified to the part that cannot fail."""
    return F.when(good, "taken").when(torn, "torn").otherwise(F.raise_error(F.concat(F.lit("bad line in "), "book")).cast("string")) == "taken"


def readings(spark: SparkSession, path: str) -> DataFrame:
    """One row for each book and page, the last line wins. A torn last line is left out, any earlier bad line refuses."""
    parsed = bank_lines(spark, path).withColumn("r", F.from_json("value", READING))
    good = F.col("r.page").isNotNull() & F.col("r.text").isNotNull()
    checked = parsed.where(accepted(good, F.col("last")))
    pair = F.when(F.col("r.render").isNotNull() & F.col("r.maxPixels").isNotNull(), F.struct("r.render", "r.maxPixels"))
    rows = checked.select("book", F.col("seq").cast("long").alias("seq"), "r.page", "r.text", F.coalesce("r.tokens", F.lit(0)).alias("tokens"), F.col("r.finishReason").alias("finish_reason"), F.coalesce("r.seconds", F.lit(0.0)).alias("seconds"), pair.alias("geometry"))
    newest = F.row_number().over(Window.partitionBy("book", "page").orderBy(F.desc("seq")))
    return rows.withColumn("__n", newest).where("__n = 1").drop("__n")


def _members(batches):
    import io
    import zipfile

    import pyarrow as pa

    for rows in batches:
        out = []
        for path, content in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                out += [(path, i.filename, z.read(i), i.CRC) for i in z.infolist() if not i.is_dir()]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary(), pa.int64()))], names=["book", "path", "content", "crc"])


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """book, path, content, crc of each member of ZIP files (checked against their CRC)."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_members, "book string, path string, content binary, crc long")


def write_book_rows(rows: DataFrame, path: str) -> None:
    """Rows with pos as JSON lines, one folder for each book; order within a book is pos."""
    named = rows.withColumn("book", F.coalesce(F.col("book").cast("string"), F.lit("")))
    out = named.repartition("book").sortWithinPartitions("book", "pos")
    out.select("book", F.to_json(F.struct(*[c for c in rows.columns if c != "book"])).alias("value")).write.partitionBy("book").text(path)


def checked_lines(spark: SparkSession, path: str, schema: str, needed: list[str], torn: bool = True) -> DataFrame:
    """book, seq and the fields of JSON lines. A line without a needed field refuses its file, the last one aside where it
    may be torn (torn)."""
    parsed = bank_lines(spark, path).withColumn("r", F.from_json("value", schema))
    good = F.col("r").isNotNull()
    for name in needed:
        good = good & F.col(f"r.{name}").isNotNull()
    return parsed.where(accepted(good, F.col("last") if torn else F.lit(False))).select("book", F.col("seq").cast("long").alias("seq"), "r.*")


def translation_bank(spark: SparkSession, path: str) -> DataFrame:
    """book, key, source, answer: the last answer to each question."""
    rows = checked_lines(spark, path, "key string, source string, answer string", ["key", "answer"])
    return rows.groupBy("book", "key").agg(F.max_by(F.struct("source", "answer"), "seq").alias("r")).select("book", "key", "r.source", "r.answer")


RECORD = "key string, parts array<string>, generation long, text string, author string"


def translation_records(spark: SparkSession, path: str) -> DataFrame:
    """book, seq, key, parts, generation, text, author; an author counts only if it is the user."""
    rows = checked_lines(spark, path, RECORD, ["parts", "text"])
    return rows.withColumn("author", F.when(F.col("author") == "user", F.col("author")))


def records_by_parts(records: DataFrame) -> DataFrame:
    """book, parts, text, author: the last record of each list of parts, and the key it was last asked under."""
    last = F.max_by(F.struct("text", "author"), "seq")
    asked = F.max_by("key", F.when(F.col("key").isNotNull(), F.col("seq")))
    return records.groupBy("book", "parts").agg(last.alias("r"), asked.alias("asked")).select("book", "parts", "r.text", "r.author", "asked")


def records_by_key(records: DataFrame) -> DataFrame:
    """book, key, text: the last record of each key."""
    return records.where("key is not null").groupBy("book", "key").agg(F.max_by("text", "seq").alias("text"))


OP = "op string, id string, into string, at long, len long, block string, note string, text string, category string, title string"
#: What each verb of the edit log must say.
SAYS = {"strike": ["id"], "restore": ["id"], "text": ["id", "text"], "category": ["id", "category"], "merge": ["id", "into"], "split": ["id", "at"], "move": ["id", "into"], "link": ["block", "note", "at", "len"], "restore-furniture": ["id"], "chapter-set": ["id", "title"], "chapter-rename": ["id", "title"], "chapter-remove": ["id"], "chapter-move": ["id", "into"], "chapter-reset": []}


def edit_log(spark: SparkSession, path: str) -> DataFrame:
    """book, seq and the fields of an edit log. A file is refused for an unknown verb, or one that lacks a field, has an empty
    name, joins or moves a row to itself, cuts before its first character, or links a span that begins before the text or is
    empty. Where a row moves to may be called before or into."""
    rows = checked_lines(spark, path, OP + ", before string", ["op"], torn=False)
    rows = rows.withColumn("into", F.coalesce(F.when(F.col("op") == "move", F.col("before")), "into")).drop("before")
    says = F.create_map(*[x for verb, fields in SAYS.items() for x in (F.lit(verb), F.lit(",".join(fields)))])
    missing = F.filter(F.split(F.coalesce(says[F.col("op")], F.lit("?")), ","), lambda f: (f != "") & ~F.array_contains(F.map_keys(said_fields()), f))
    named = F.forall(F.array("id", "into", "block", "note", "category"), lambda n: F.coalesce(n != "", F.lit(True)))
    apart = F.coalesce((F.col("op").isin("merge", "move") & (F.col("id") == F.col("into"))), F.lit(False))
    least = F.when(F.col("op") == "split", F.col("at") >= 1).when(F.col("op") == "link", (F.col("at") >= 0) & (F.col("len") >= 1)).otherwise(True)
    good = (F.size(missing) == 0) & named & ~apart & F.coalesce(least, F.lit(False))
    return rows.where(F.assert_true(good, F.concat(F.lit("bad op in "), "book")).isNull())


def said_fields():
    """Column: the fields of an op that are not null, as a map."""
    names = ("id", "into", "at", "len", "block", "note", "text", "category", "title")
    every = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.col(n).cast("string")) for n in names]))
    return F.map_filter(every, lambda k, v: v.isNotNull())


def bank_decision(pending, same_ask, marker, partial):
    """Column: what a run does with the bank it finds: goes on with a pending one that asks the same, else discards it; reads
    anew beside a completed one, goes on with a partial one, or starts."""
    return F.when(pending & same_ask, "resume pending").when(pending, "discard pending").when(marker, "fresh into pending").when(partial, "resume").otherwise("start")


def write_lines(rows: DataFrame, path: str) -> str:
    """Rows (book, seq, ...) as JSON lines in order, one folder for each book and one file in it, nulls left out."""
    fields = [c for c in rows.columns if c not in ("book", "seq")]
    # a book that is never null is not sorted anew by the writer, so the order within it stays
    named = rows.withColumn("book", F.coalesce(F.col("book").cast("string"), F.lit("")))
    out = named.repartition("book").sortWithinPartitions("book", "seq")
    out.select("book", F.to_json(F.struct(*fields)).alias("value")).write.partitionBy("book").text(path)
    return path
