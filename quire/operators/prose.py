"""Page answers in prose: Markdown pages as blocks, chapters as plain text.

pages (book, page, text) are cut into lines and marked by windows over a page; nothing is read line by line on its own.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .batches import sliced

#: Page furniture by tag, and raised signs with what they stand for.
FURNITURE = r"(?s)<(page_number|footer|header|watermark)>.*?</\1>"
RAISED, PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", "0123456789+-=()ni"
#: How lines open.
HEADING, BULLET, NUMBERED = r"\A(#{1,6})[ \t]+(.*)\z", r"\A[ \t]{0,3}[-*+][ \t]+(.*)\z", r"\A[ \t]{0,3}[0-9]+[.)][ \t]+(.*)\z"
RULE, TABLE, TABLE_END, IMAGE = r"\A([-*_])[ \t]*(?:\1[ \t]*){2,}\z", r"(?i)\A[ \t]*<table[\s>]", r"(?i)</table>", r"<img>(.*?)</img>"


def inline_prose(c: Column) -> Column:
    """Escaped text with **strong**, *emphasis* or _emphasis_ and raised signs as elements."""
    out = F.regexp_replace(X.escape_xml(X.strip_illegal_xml(c)), r"(?s)\*\*(?=\S)(.*?\S)\*\*", "<strong>$1</strong>")
    out = F.regexp_replace(out, r"(?<![*\w])\*(?=\S)([^*]*?\S)\*(?!\w)", "<em>$1</em>")
    out = F.regexp_replace(out, r"(?<![_\w])_(?=\S)([^_]*?\S)_(?!\w)", "<em>$1</em>")
    runs = X.match_spans(out, f"[{RAISED}]+")
    rest = F.split(out, f"[{RAISED}]+", -1)
    joined = F.transform(rest, lambda s, i: F.concat(s, F.coalesce(F.concat(F.lit("<sup>"), F.translate(F.try_element_at(runs, i + 1)["hit"], RAISED, PLAIN), F.lit("</sup>")), F.lit(""))))
    return F.array_join(joined, "")


def markdown_blocks(pages: DataFrame, furniture: bool = True) -> DataFrame:
    """book, page, seq, kind (heading, paragraph, list, table, image, rule), level, ordered, items, bad.

    A text line goes on the list item before it, if no blank line or other block stands between. A table goes to the line
    that closes it; a page whose last table is never closed is ``bad``. furniture: page numbers, heads and feet are left out."""
    text = F.regexp_replace("text", FURNITURE, "") if furniture else F.col("text")
    w = Window.partitionBy("book", "page").orderBy("pos")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    lines = pages.select("book", "page", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    opened = F.max(F.when(F.col("line").rlike(TABLE), F.col("pos"))).over(upto)
    closed = F.max(F.when(F.col("line").rlike(TABLE_END), F.col("pos"))).over(before)
    lines = lines.withColumn("table", F.coalesce(opened > F.coalesce(closed, F.lit(-1)), F.lit(False))).withColumn("t", X.trim_all(F.col("line")))
    t = F.col("t")
    kind = (
        F.when(F.col("table"), "table").when(t == "", "blank").when(t.rlike(IMAGE), "image").when(t.rlike(RULE), "rule").when(t.rlike(HEADING), "heading")
        .when(F.col("line").rlike(BULLET), "bullet").when(F.col("line").rlike(NUMBERED), "number").otherwise("text")
    )
    lines = lines.withColumn("k", kind)
    last = F.last(F.when(F.col("k") != "text", F.col("k")), ignorenulls=True).over(upto)
    lines = lines.withColumn("goes_on", (F.col("k") == "text") & last.isin("bullet", "number")).withColumn("k", F.when(F.col("goes_on"), last).otherwise(F.col("k")))
    fresh = F.when(F.col("k") == "table", ~F.coalesce(F.lag("table").over(w), F.lit(False)) | F.lag("line").over(w).rlike(TABLE_END))
    fresh = fresh.when(F.col("k").isin("image", "rule", "heading"), True).otherwise(F.coalesce(F.lag("k").over(w) != F.col("k"), F.lit(True)))
    lines = lines.withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(upto)).where("k <> 'blank'")
    bare = (
        F.when(F.col("k") == "heading", X.trim_all(F.regexp_extract("t", HEADING, 2))).when(F.col("k") == "image", F.regexp_replace("t", r"<img>[ \t]*(.*?)[ \t]*</img>", "$1"))
        .when(F.col("goes_on"), t).when(F.col("k") == "bullet", X.trim_all(F.regexp_extract("line", BULLET, 1))).when(F.col("k") == "number", X.trim_all(F.regexp_extract("line", NUMBERED, 1)))
        .when(F.col("k") == "table", F.col("line")).when(F.col("k") == "rule", "").otherwise(t)
    )
    item = F.sum((~F.col("goes_on")).cast("int")).over(Window.partitionBy("book", "page", "run").orderBy("pos"))
    lines = lines.withColumn("bare", bare).withColumn("item", F.when(F.col("k").isin("bullet", "number"), item).otherwise(0))
    between = F.when(F.first("k") == "table", "\n").otherwise(" ")
    items = lines.groupBy("book", "page", "run", "k", "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "bare"))), lambda s: s["bare"]), "\x00").alias("x"), between.alias("b"), F.max(F.length(F.regexp_extract("t", HEADING, 1))).alias("level"), F.max("pos").alias("end"), F.max_by(F.col("line").rlike(TABLE_END), "pos").alias("closed"))
    items = items.withColumn("x", F.replace("x", F.lit("\x00"), F.col("b")))
    whole = items.groupBy("book", "page", "run", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "x"))), lambda s: s["x"]).alias("items"), F.max("level").alias("level"), F.max("closed").alias("closed"))
    bad = F.max(((F.col("k") == "table") & ~F.col("closed")).cast("int")).over(Window.partitionBy("book", "page")) == 1
    names = F.when(F.col("k").isin("bullet", "number"), "list").when(F.col("k") == "text", "paragraph").otherwise(F.col("k"))
    seq = F.row_number().over(Window.partitionBy("book", "page").orderBy("run"))
    return whole.select("book", "page", seq.alias("seq"), names.alias("kind"), F.when(F.col("k") == "heading", F.col("level")).alias("level"), F.when(F.col("k").isin("bullet", "number"), F.col("k") == "number").alias("ordered"), "items", bad.alias("bad"))


TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|<[!?][^>]*>", re.S)
ALT = re.compile(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
#: How each element is written as text.
PLAIN_TAGS, CLOSED_TAGS = frozenset("body section div a em strong i b span sub".split()), frozenset("br img hr col".split())
BLOCK_TAGS = frozenset("p aside figure li td th caption h1 h2 h3".split())
LISTS, GROUPS = frozenset(("ol", "ul")), frozenset("table thead tbody tfoot tr".split())


def plain_chapter(markup: str) -> str | None:
    """A chapter's text: headings underlined, quotes set in, cells parted by bars, raised numbers in brackets; null where an
    element has no rule."""
    stack: list[tuple[str, list[str]]] = [("body", [])]
    at = 0

    def out(text: str) -> None:
        if stack[-1][0] not in GROUPS and stack[-1][0] not in LISTS:
            stack[-1][1].append(text)

    def close() -> None:
        tag, parts = stack.pop()
        text = "".join(parts)
        if tag in BLOCK_TAGS:
            text = re.sub(r"[ \t]*\n[ \t]*", "\n", text).strip()
        into = stack[-1][1]
        if tag == "sup":
            into.append(f"[{text}]")
        elif tag in ("h1", "h2") and text:
            into.append(f"\n\n{text}\n{('=' if tag == 'h1' else '-') * max(map(len, text.split(chr(10))))}\n\n")
        elif tag in ("p", "aside", "figure", "h3"):
            into.append(f"\n\n{text}\n\n" if text else "")
        elif tag == "blockquote":
            text = "\n".join("    " + line if line else line for line in tidied(text).split("\n"))
            into.append(f"\n\n{text}\n\n" if text else "")
        elif tag in LISTS or tag == "table":
            rows = "\n".join(x.strip() for x in parts if x.strip())
            into.append(f"\n\n{rows}\n\n" if rows else "")
        elif tag in ("thead", "tbody", "tfoot"):
            into.append("\n".join(x.strip() for x in parts if x.strip()))
        elif tag == "tr":
            into.append(" | ".join(x.strip() for x in parts))
        elif tag != "colgroup":
            into.append(text)

    for m in TAG.finditer(markup):
        out(entities.unescape(markup[at : m.start()]))
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if any(t == tag for t, _ in stack[1:]):
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if tag == "br":
            out("\n")
        elif tag == "img":
            alt = ALT.search(m.group(3))
            out(f"[{entities.unescape(alt.group(1) or alt.group(2) or '')}]" if alt and (alt.group(1) or alt.group(2)) else "[figure]")
        elif tag == "hr":
            out("\n\n* * *\n\n")
        elif tag in CLOSED_TAGS:
            continue
        elif tag in PLAIN_TAGS or tag in BLOCK_TAGS or tag in LISTS or tag in GROUPS or tag in ("sup", "blockquote", "colgroup"):
            stack.append((tag, []))
            if m.group(4):
                close()
        else:
            return None
    out(entities.unescape(markup[at:]))
    while len(stack) > 1:
        close()
    return tidied("".join(stack[0][1]))


def tidied(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"[ \t]+\Z", "", line) for line in text.split("\n"))).strip()


def _plain(batches):
    for rows in sliced(batches):
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([None if t is None else plain_chapter(t) for t in rows.column(1).to_pylist()], pa.string())], names=["id", "text"])


def plain_chapters(rows: DataFrame, id_col: str, markup_col: str) -> DataFrame:
    """id, text of each chapter; a null text where the markup has an element without a rule."""
    return rows.select(F.col(id_col).cast("long"), F.col(markup_col)).mapInArrow(_plain, "id long, text string")
