"""The text layer of a page against its read blocks: sizes by containment, class sizes, verdicts, calibration, substitutions.

spans (book, page, x, y, size, chars) are in points; blocks are in pixels of a page drawn at ``dpi``. planned (book, cls,
lead_pt, truth_pt, trusted) has one row for each block that is to be set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Points of slack around a box, samples a class needs, line height to size, least size, and disagreement.
SLACK, SAMPLES, LINE_FACTOR, LEAST_SIZE, DISAGREEMENT = 2.0, 8, 1.2, 0.5, 0.3
#: Pixels of a band of a page, for the join.
BAND = 64
#: Band of a trusted line's height as a share of its page, characters of a line that calibrates, allowed gaps.
LINE_BAND, LONG_LINE, FLOOR, RATIO = (0.008, 0.035), 20, 10, 1000


def layer_sizes(spans: DataFrame, blocks: DataFrame, dpi: int = 72) -> DataFrame:
    """book, page, ord, truth_pt: the size at which half of the characters within a block's box are reached, small sizes
    first. Blocks that hold no span are left out. Spans meet the blocks of their own page only."""
    scale = dpi / 72
    s = spans.select("book", "page", (F.col("x") * scale).alias("sx"), (F.col("y") * scale).alias("sy"), "size", "chars")
    b = blocks.select("book", "page", "ord", *[(F.col(c) + side * SLACK * scale).alias(c) for c, side in (("x1", -1), ("y1", -1), ("x2", 1), ("y2", 1))])
    # both sides are dealt by bands of the page, so that a long page is no list of all pairs
    s = s.withColumn("band", F.floor(F.col("sy") / BAND))
    b = b.withColumn("band", F.explode(F.sequence(F.floor(F.col("y1") / BAND), F.floor(F.col("y2") / BAND))))
    hits = b.join(s, ["book", "page", "band"]).where(F.col("sx").between(F.col("x1"), F.col("x2")) & F.col("sy").between(F.col("y1"), F.col("y2")))
    sizes = hits.groupBy("book", "page", "ord", "size").agg(F.sum("chars").alias("chars"))
    block = Window.partitionBy("book", "page", "ord")
    seen = F.sum("chars").over(block.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.withColumn("seen", seen).withColumn("total", F.sum("chars").over(block)).where(F.col("seen") * 2 >= F.col("total")).groupBy("book", "page", "ord").agg(F.min("size").alias("truth_pt"))


def trusts_lines(height: Column, text: Column, page_height: Column) -> Column:
    """Whether the line breaks of a block give lines of a likely height."""
    segments = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return (height / segments / page_height).between(*LINE_BAND)


def class_sizes(planned: DataFrame) -> DataFrame:
    """book, cls, size_pt of classes with enough blocks: the middle of the layer's sizes where enough have one, else of the
    leadings; medians are means of the middle two."""
    facts = planned.where("cls is not null").groupBy("book", "cls").agg(F.count(F.lit(1)).alias("n"), F.count("truth_pt").alias("truths"), F.median("truth_pt").alias("truth"), F.median("lead_pt").alias("lead"))
    size = F.when(F.col("truths") >= SAMPLES, F.col("truth")).otherwise(F.col("lead") / LINE_FACTOR)
    return facts.where(F.col("n") >= SAMPLES).select("book", "cls", F.greatest(F.lit(LEAST_SIZE), size).alias("size_pt"))


def layer_verdicts(planned: DataFrame) -> DataFrame:
    """book, cls, layer_pt, lead_pt of the classes whose layer disagrees with the leading of trusted blocks."""
    lead = F.when(F.col("trusted"), F.col("lead_pt"))
    facts = planned.where("cls is not null").groupBy("book", "cls").agg(F.count("truth_pt").alias("truths"), F.count(lead).alias("leads"), F.median("truth_pt").alias("layer_pt"), (F.median(lead) / LINE_FACTOR).alias("lead_pt"))
    return facts.where((F.col("truths") >= SAMPLES) & (F.col("leads") >= SAMPLES) & (F.abs(F.col("layer_pt") / F.col("lead_pt") - 1) > DISAGREEMENT)).select("book", "cls", "layer_pt", "lead_pt")


def char_width(lines: DataFrame) -> DataFrame:
    """book, em: the middle width of a character as a share of its size, over trusted lines (book, width, chars, size)."""
    good = lines.where((F.col("chars") >= LONG_LINE) & (F.col("size") > 0))
    return good.groupBy("book").agg(F.median(F.col("width") / (F.col("chars") * F.col("size"))).alias("em"))


def substitutions(texts: DataFrame, covered: str) -> DataFrame:
    """book, char, n, pages: characters outside of the covered ones (a character class body), where a book has some."""
    chars = F.regexp_extract_all("text", F.lit(f"[^{covered}]"), F.lit(0))
    return texts.select("book", "page", F.explode(chars).alias("char")).groupBy("book", "char").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("pages"))


def substitution_verdicts(texts: DataFrame, covered: str) -> DataFrame:
    """book, n, chars, refused: too many characters without a glyph (more than FLOOR and one in RATIO)."""
    missing = F.size(F.regexp_extract_all("text", F.lit(f"[^{covered}]"), F.lit(0)))
    sums = texts.groupBy("book").agg(F.sum(missing).alias("n"), F.sum(F.char_length("text")).alias("chars"))
    return sums.select("book", "n", "chars", (F.col("n") > F.greatest(F.lit(FLOOR), F.col("chars") / RATIO)).alias("refused"))


def raised_notes(blocks: DataFrame) -> DataFrame:
    """book, page, ord, printed of the footnotes whose number is cited on their page by a block that is none."""
    runs = F.transform(F.regexp_extract_all("text", F.lit(f"[{X.SUPERSCRIPTS}]+"), F.lit(0)), lambda r: F.translate(r, X.SUPERSCRIPTS, X.DIGITS))
    marks = blocks.where(~F.col("category").isin("Picture", "Footnote")).select("book", "page", F.explode(F.array_distinct(runs)).alias("printed"))
    lead = F.regexp_extract("text", r"\A([0-9]{1,3})[.)]?[ \t]", 1)
    notes = blocks.where(F.col("category") == "Footnote").select("book", "page", "ord", lead.alias("printed")).where("printed <> ''")
    return notes.join(marks, ["book", "page", "printed"], "left_semi").select("book", "page", "ord", F.col("printed").cast("int").alias("printed"))


def frame_mismatch(extents: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """book, x_share, y_share: books whose furthest box edge is off its frame. extents (book, x2, y2, width, height)."""
    far = extents.groupBy("book").agg(F.max(F.col("x2") / F.col("width")).alias("x_share"), F.max(F.col("y2") / F.col("height")).alias("y_share"))
    return far.where((F.col("x_share") > 1 + tolerance) | (F.col("y_share") > 1 + tolerance))
