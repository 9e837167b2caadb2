"""Markup: element tables with source spans, enclosing elements, markers masked and restored, text of elements.

Parsing is per document in a small tokenizer; everything after is joins and windows over the element table.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import sliced

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
TOKEN = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>|<[!?][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
ELEMENTS = "doc long, id int, parent int, tag string, attrs map<string,string>, start int, end int, inner string"


def elements_of(markup: str):
    """(id, parent, tag, attrs, start, end, text directly inside) in document order; offsets in code points."""
    out: list[list] = []
    stack: list[int] = []
    at = 0

    def text(upto: int) -> None:
        if stack and upto > at:
            out[stack[-1]][6].append(entities.unescape(markup[at:upto]))

    def close(n: int, end: int) -> None:
        while len(stack) > n:
            out[stack.pop()][5] = end

    for m in TOKEN.finditer(markup):
        text(m.start())
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            continue
        if m.group(2):
            depth = next((k for k in range(len(stack) - 1, -1, -1) if out[stack[k]][2] == tag), None)
            if depth is not None:
                close(depth + 1, m.start())
                close(depth, m.end())
            continue
        attrs = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(m.group(4))}
        if tag in ("p", "li") and stack and out[stack[-1]][2] == tag:
            close(len(stack) - 1, m.start())
        out.append([len(out), stack[-1] if stack else None, tag, attrs, m.start(), m.end(), []])
        if tag not in VOID and not m.group(4).endswith("/"):
            stack.append(len(out) - 1)
    text(len(markup))
    close(0, len(markup))
    return out


def _elements(batches):
    for rows in sliced(batches):
        out = [(doc, *e[:6], "".join(e[6])) for doc, markup in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()) for e in elements_of(markup or "")]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.int32(), pa.string())
        cols = [pa.array([list(o[k].items()) if k == 4 else o[k] for o in out], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(cols, names=["doc", "id", "parent", "tag", "attrs", "start", "end", "inner"])


def elements(docs: DataFrame, id_col: str, html_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(_elements, ELEMENTS)


def inside(els: DataFrame, tag: str) -> DataFrame:
    """doc, id of the elements that stand within one of this tag. Spans nest, so an element is inside if the furthest end
    of such elements that start before it lies beyond its own start: one window over a document, no range join."""
    w = Window.partitionBy("doc").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("tag") == tag, F.col("end"))).over(w)
    return els.withColumn("reach", reach).where(F.col("start") < F.col("reach")).select("doc", "id")


def page_at(els: DataFrame, markers: DataFrame) -> DataFrame:
    """doc, id, page: the last page marker (doc, offset, page) at or before an element's start (as-of by union and window)."""
    both = els.select("doc", F.col("start").alias("offset"), "id", F.lit(None).cast("long").alias("page"), F.lit(1).alias("kind")).unionByName(markers.select("doc", "offset", F.lit(None).cast("int").alias("id"), F.col("page").cast("long").alias("page"), F.lit(0).alias("kind")))
    w = Window.partitionBy("doc").orderBy("offset", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("page", F.last("page", ignorenulls=True).over(w)).where("kind = 1").select("doc", "id", "page")


def dead_entries(entries: DataFrame, alive: DataFrame) -> DataFrame:
    """entries (doc, id, start, end, target): a list entry dies if it and every entry within it have targets, all dead.

    The live (or targetless) entries of a document are marked at their start; an entry lives if a mark lies in its span,
    which is a running count at its end minus the one at its start."""
    known = entries.join(alive.select("target", F.lit(1).alias("ok")).distinct(), "target", "left")
    mark = (F.col("target").isNull() | F.col("ok").isNotNull()).cast("int")
    points = known.select("doc", F.col("start").alias("at"), F.col("id"), mark.alias("m"), F.lit("open").alias("kind")).unionByName(known.select("doc", F.col("end").alias("at"), F.col("id"), F.lit(0).alias("m"), F.lit("shut").alias("kind")))
    w = Window.partitionBy("doc").orderBy("at", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    run = points.withColumn("run", F.sum("m").over(w))
    spans = run.groupBy("doc", "id").agg(F.max(F.when(F.col("kind") == "open", F.col("run") - F.col("m"))).alias("a"), F.max(F.when(F.col("kind") == "shut", F.col("run"))).alias("b"))
    return spans.where("a = b").select("doc", "id")


def link_targets(els: DataFrame) -> DataFrame:
    """doc, href, refs: how often each target is referred to."""
    return els.where((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()).groupBy("doc", F.col("attrs")["href"].alias("href")).agg(F.count(F.lit(1)).alias("refs"))


def tag_counts(els: DataFrame) -> DataFrame:
    return els.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc").alias("docs"))


MASK = re.compile(r"\*\*|\*|[⁰¹²³⁴⁵⁶⁷⁸⁹]+")


def mask(text: str) -> tuple[str, list[str]]:
    """Emphasis signs and raised numbers as numbered markers, and what they stand for."""
    kept: list[str] = []

    def one(m):
        kept.append(m.group())
        return f"⟦m{len(kept)}⟧"

    return MASK.sub(one, text), kept


def unmask(text: str, kept: list[str]) -> str:
    return re.sub(r"⟦m(\d+)⟧", lambda m: kept[int(m.group(1)) - 1] if 0 < int(m.group(1)) <= len(kept) else m.group(), text)


def _masked(batches):
    for rows in sliced(batches):
        got = [mask(t or "") for t in rows.column(1).to_pylist()]
        back = [unmask(a, k) == (t or "") for (a, k), t in zip(got, rows.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string())), pa.array(back, pa.bool_())], names=["id", "masked", "kept", "round_trips"])


def masked(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_masked, "id long, masked string, kept array<string>, round_trips boolean")


def marker_complaint(text, count):
    """Column: invented, missing or doubled markers of an answer that should hold m1..m<count>, or null."""
    found = F.transform(F.regexp_extract_all(text, F.lit("⟦m([0-9]+)⟧"), F.lit(1)), lambda s: s.cast("int"))
    return (
        F.when(F.exists(found, lambda i: (i < 1) | (i > count)), "invented")
        .when(F.size(F.array_distinct(found)) < F.size(found), "doubled")
        .when(F.size(found) < count, "missing")
    )


#: Elements that are taken out with all they hold, and attributes that may hold an address.
UNSAFE, ADDRESSES = frozenset("script iframe object embed style".split()), frozenset("href src xlink:href action formaction data".split())
TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
WRITTEN = re.compile(r"\s+([^\s=>\"'/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")


def safe_markup(markup: str) -> str:
    """Markup without unsafe elements (stray tags of them too), without event handlers and script addresses."""
    out: list[str] = []
    at, open_tag = 0, None
    for m in TAG.finditer(markup):
        tag = (m.group(2) or "").lower()
        if open_tag:
            if m.group(1) and tag == open_tag:
                open_tag, at = None, m.end()
            continue
        if tag in UNSAFE:
            out.append(markup[at : m.start()])
            at = m.end()
            if not m.group(1) and re.search(rf"</{tag}\s*>", markup[at:], re.I):
                open_tag = tag
        elif tag and m.group(3).strip():
            kept = WRITTEN.sub(lambda a: "" if unsafe_attribute(a.group(1).lower(), a.group(2)) else a.group(), m.group(3))
            if kept != m.group(3):
                out.append(markup[at : m.start()] + f"<{m.group(1)}{m.group(2)}{kept}>")
                at = m.end()
    out.append(markup[at:])
    return "".join(out)


def unsafe_attribute(name: str, value: str) -> bool:
    handler = name.startswith("on") and name[2:].isascii() and name[2:].isalpha()
    return handler or (name in ADDRESSES and value[:1] in "\"'" and value[1:].lstrip().lower().startswith("javascript:"))


def _safe(batches):
    for rows in sliced(batches):
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([None if t is None else safe_markup(t) for t in rows.column(1).to_pylist()], pa.string())], names=["id", "markup"])


def without_unsafe(rows: DataFrame, id_col: str, markup_col: str) -> DataFrame:
    """id, markup of each row with what could run taken out."""
    return rows.select(F.col(id_col).cast("long"), F.col(markup_col)).mapInArrow(_safe, "id long, markup string")
