"""Book files: JSON lines with a header and one row a line, checked as a whole; one bad line refuses its file.

A file is read in splits like any text; lines are numbered from the counts of the splits before theirs, so neither a file nor
its text is one value. Each line is judged by itself (types as they are written, through VARIANT); duplicate ids are counted
over the file; the first fault in the order of lines, and on a line in the order of the checks, is the file's.

Offsets in a file count UTF-16 units, as its format has it; those of the returned rows count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.scratch import cut
from .banks import ordered_lines

#: Fixed value: the version of the format.
VERSION = 3
#: Fixed value: how blocks are named: of a page's answer, or counted through an imported book; notes and split blocks behind it.
ROW_ID = r"\A(?:b[0-9]+-[0-9]+(?:-[0-9]+)?|e-[0-9]+)(?:#[0-9]+)?(?:/[0-9]+)*\z"
#: Where a row may be shelved, and what figures may come from.
SHELVES, FIGURES = ("furniture", "suppressed-head"), ("pdf", "pages", "epub")


def at(value: str, path: str, kind: str | None = None) -> Column:
    """A member of a VARIANT column: the value itself, or what it is as this type."""
    return F.expr(f"try_variant_get({value}, '{path}', '{kind or 'variant'}')")


def is_a(value: str, path: str, kind: str) -> Column:
    """Whether a member is there and of this JSON type (string, number, array, object, null)."""
    if kind in ("array", "object"):
        return at(value, path, "array<variant>" if kind == "array" else "map<string,variant>").isNotNull()
    names = {"string": "STRING", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "null": "VOID"}[kind]
    return F.coalesce(F.expr(f"schema_of_variant(try_variant_get({value}, '{path}', 'variant'))").rlike(f"\\A(?:{names})\\z"), F.lit(False))


def first_fault(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that does not hold, or null."""
    return F.coalesce(*[F.when(~F.coalesce(good, F.lit(False)), why) for good, why in checks])


def header_fault(h: str = "v") -> Column:
    """Why a header line is refused."""
    version = F.when(is_a(h, "$.book", "number"), at(h, "$.book", "double"))
    seams = at(h, "$.seams", "array<variant>")
    named = F.expr(f"forall(try_variant_get({h}, '$.seams', 'array<variant>'), s -> schema_of_variant(try_variant_get(s, '$.after', 'variant')) <=> 'STRING' and schema_of_variant(try_variant_get(s, '$.before', 'variant')) <=> 'STRING')")
    figures = is_a(h, "$.figures.blocks", "number") & is_a(h, "$.figures.cut", "number") & (is_a(h, "$.figures.from", "null") | (is_a(h, "$.figures.from", "string") & at(h, "$.figures.from", "string").isin(*FIGURES)))
    return first_fault(
        (F.col(h).isNotNull(), "header is not JSON"), (~F.coalesce(version.isin(1.0, 2.0), F.lit(False)), "old version"), (version == VERSION, "version"), (is_a(h, "$.engine", "string") & is_a(h, "$.language", "string"), "engine or language"),
        (is_a(h, "$.source.pages", "number") & is_a(h, "$.source.unreadable", "array") & is_a(h, "$.source.bankSha", "string") & (at(h, "$.source.generation").isNull() | is_a(h, "$.source.generation", "string")), "source"),
        (is_a(h, "$.chapters", "array"), "chapters"), (at(h, "$.typography").isNotNull(), "typography"), (seams.isNotNull() & named, "seams"), (is_a(h, "$.loose.markers", "array") & is_a(h, "$.loose.notes", "array"), "loose"),
        (at(h, "$.figures").isNull() | figures, "figures"),
    )


def parts_of(v: str = "v") -> Column:
    """array<struct<src, page, begin, end, fused, sound>>: a row's parts; sound where each field has its type."""
    kind = lambda path: f"coalesce(schema_of_variant(try_variant_get(p, '{path}', 'variant')), 'none')"
    number = lambda path: f"{kind(path)} rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'"
    sound = f"{kind('$.src')} = 'STRING' and {number('$.page')} and size(coalesce(try_variant_get(p, '$.chars', 'array<variant>'), array())) = 2 and {number('$.chars[0]')} and {number('$.chars[1]')}"
    return F.expr(
        f"transform(try_variant_get({v}, '$.parts', 'array<variant>'), p -> struct(try_variant_get(p, '$.src', 'string') as src, try_variant_get(p, '$.page', 'double') as page, if({sound}, try_variant_get(p, '$.chars[0]', 'double'), null) as begin, "
        f"if({sound}, try_variant_get(p, '$.chars[1]', 'double'), null) as end, try_variant_get(p, '$.fused', 'string') as fused, {sound} as sound, {kind('$.fused')} in ('none', 'STRING') as word))"
    )


def tiling_fault(parts: Column, size: Column) -> Column:
    """Why spans (begin, end) do not tile 0 to size: the first part that does not begin where the one before ended or ends
    before it begins, or an end that is not the size. Parts that are not sound come first in their place."""
    before = F.transform(parts, lambda p, k: F.when(k == 0, F.lit(0.0)).otherwise(F.get(parts, k - 1)["end"]))
    each = F.zip_with(parts, before, lambda p, b: F.when(~p["sound"], "part").when(~p["word"], "fused").when((p["begin"] != b) | (p["end"] < b), "not divided"))
    first = F.get(F.filter(each, lambda w: w.isNotNull()), F.lit(0))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) <= 0, "no parts").otherwise(F.coalesce(first, F.when(F.get(parts, F.size(parts) - 1)["end"] != size, "not whole")))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """book, seq, v (VARIANT or null): the lines of book files that are not blank."""
    lines = ordered_lines(spark, path).where(X.trim_wide(F.col("value")) != "")
    return lines.select("book", "seq", X.json_value(F.col("value")).alias("v"))


def judged(lines: DataFrame) -> DataFrame:
    """lines (book, seq, v) with ``head``, ``id``, ``parts`` and ``why`` (the fault of the line itself, null where sound)."""
    heads = lines.groupBy("book").agg(F.min("seq").alias("first"))
    both = lines.join(heads, "book").withColumn("head", F.col("seq") == F.col("first")).drop("first")
    both = both.withColumn("text", F.when(is_a("v", "$.text", "string"), at("v", "$.text", "string"))).withColumn("parts", parts_of())
    name = F.when(is_a("v", "$.id", "string"), at("v", "$.id", "string"))
    shelf = at("v", "$.shelf")
    early = first_fault((F.col("v").isNotNull(), "not JSON"), (name != "", "no id"), (name.rlike(ROW_ID), "id"))
    late = F.coalesce(
        first_fault(
            (F.col("text").isNotNull() & is_a("v", "$.category", "string"), "text or category"), (is_a("v", "$.page", "number") & is_a("v", "$.pages", "array") & at("v", "$.box").isNotNull(), "place")
        ),
        tiling_fault(F.col("parts"), X.utf16_length(F.col("text")).cast("double")),
        first_fault(
            (shelf.isNull() | (is_a("v", "$.shelf", "string") & at("v", "$.shelf", "string").isin(*SHELVES)), "shelf"), (shelf.isNull() | (is_a("v", "$.why", "string") & (at("v", "$.why", "string") != "")), "shelved without a reason"),
            (at("v", "$.image").isNull() | is_a("v", "$.image", "string"), "image"),
        ),
    )
    row = F.when(early.isNotNull(), F.struct(F.lit(0).alias("step"), early.alias("why"))).when(late.isNotNull(), F.struct(F.lit(2).alias("step"), late.alias("why")))
    fault = F.when(F.col("head"), F.when(header_fault().isNotNull(), F.struct(F.lit(0).alias("step"), header_fault().alias("why")))).otherwise(row)
    return both.withColumn("id", F.when(~F.col("head") & early.isNull(), name)).withColumn("fault", fault)


def repeated_ids(named: DataFrame) -> DataFrame:
    """book, seq: of each id that comes again in its book, the line of its second row."""
    firsts = named.where("id is not null").groupBy("book", "id").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.join(firsts, ["book", "id"]).where("seq > first").groupBy("book", "id").agg(F.min("seq").alias("seq")).select("book", "seq", "id")


def book_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows and headers of the files that are sound, and the refused files.

    rows: book, seq, id, category, text, page, pages, box, page_width, page_height, parts (src, page, begin, end, fused),
    refs, shelf, why, image, align, row (VARIANT: all that was said). heads: book, head (VARIANT). refused: book, seq, id,
    why. Files without a line that is not blank are not in any table: they have no rows to refuse (see empty_files)."""
    lines = judged(file_lines(spark, path))
    named = cut(lines.select("book", "seq", "id", "fault"))  # read three times; each line is parsed and judged once for it
    own = named.where("fault is not null").select("book", "seq", "id", "fault.step", "fault.why")
    twice = repeated_ids(named.select("book", "seq", "id")).select("book", "seq", "id", F.lit(1).alias("step"), F.lit("repeated id").alias("why"))
    refused = own.unionByName(twice).groupBy("book").agg(F.min(F.struct("seq", "step", "id", "why")).alias("f")).select("book", "f.seq", "f.id", "f.why")
    sound = lines.join(refused.select("book"), "book", "left_anti")
    point = lambda u: X.point_of_unit(F.col("text"), u.cast("int"))
    parts = F.transform("parts", lambda p: F.struct(p["src"].alias("src"), p["page"].cast("long").alias("page"), point(p["begin"]).alias("begin"), point(p["end"]).alias("end"), p["fused"].alias("fused")))
    refs = F.expr("transform(try_variant_get(v, '$.refs', 'array<variant>'), r -> struct(try_variant_get(r, '$.block', 'string') as block, try_variant_get(r, '$.at', 'int') as at, try_variant_get(r, '$.len', 'int') as len))")
    rows = sound.where("not head").select(
        "book", "seq", "id", at("v", "$.category", "string").alias("category"), "text", at("v", "$.page", "double").alias("page"), at("v", "$.pages", "array<double>").alias("pages"), at("v", "$.box", "struct<x1 double, y1 double, x2 double, y2 double>").alias("box"),
        at("v", "$.pageWidth", "double").alias("page_width"), at("v", "$.pageHeight", "double").alias("page_height"), parts.alias("parts"), refs.alias("refs"), at("v", "$.shelf", "string").alias("shelf"), at("v", "$.why", "string").alias("why"),
        at("v", "$.image", "string").alias("image"), at("v", "$.align", "string").alias("align"), F.col("v").alias("row"),
    )
    return rows, sound.where("head").select("book", F.col("v").alias("head")), refused


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """book of the files that hold no line, or blank lines only; such a file is no book. The names come from the listing that
    the driver plans with, as a scan passes empty files over."""
    local = lambda c: F.regexp_replace(c, "\\Afile:/+", "file:/")
    every = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "book string").select(local("book").alias("book"))
    said = ordered_lines(spark, path).where(X.trim_wide(F.col("value")) != "").select(local("book").alias("book")).distinct()
    return every.join(said, "book", "left_anti")


def write_book_files(heads: DataFrame, rows: DataFrame, path: str) -> str:
    """heads (book, value) and rows (book, pos, value), values as JSON text, as one file for each book: its header, then its
    rows by pos."""
    both = heads.select("book", F.lit(None).cast("long").alias("pos"), "value").unionByName(rows.select("book", F.col("pos").cast("long").alias("pos"), "value"))
    named = both.withColumn("book", F.coalesce(F.col("book").cast("string"), F.lit("")))
    named.repartition("book").sortWithinPartitions("book", F.asc_nulls_first("pos")).select("book", "value").write.partitionBy("book").text(path)
    return path
