"""Imported books: the documents of an EPUB in spine order, and their markup as rows with anchors and references."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import sliced
from .markup import ATTRIBUTE, safe_markup

#: What the elements of a book are.
HEADINGS = {"h1": "Title", **{f"h{k}": "Section-header" for k in range(2, 7)}}
LEAVES = {**HEADINGS, "dt": None, "dd": None, "pre": None, "p": None, "figcaption": "Caption"}
HOLDERS = {"blockquote": "Quote", "li": "List-item"}
CONTAINERS = frozenset("html body div section article main header footer nav hgroup center details noscript dl ul ol figure aside".split())
DROPPED, NOTES = frozenset("script style iframe object embed head".split()), frozenset("footnote endnote rearnote note".split())
TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|<[!?][^>]*>", re.S)
EMPTY = frozenset("br img hr col meta link input area base embed source wbr".split())
RAISED = str.maketrans("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
ROWS = "doc long, n int, category string, text string, anchors array<string>, refs array<struct<href:string,at:int,len:int>>"


def exploded(markup: str):
    """(category, text, ids, references as (href, at, length)) of a document's rows in order.

    A heading, paragraph, caption or note is a row; what stands loose in a container is one as well. Quotes and list items
    hand their category down, tables stay markup, pictures are rows with their label. References are offsets in the row."""
    stack: list[list] = []  # tag, inherited category, kind (leaf, note, holder, inline)
    text: list[str] = []
    refs: list[list] = []
    ids: list[str] = []
    size, at, deep = 0, 0, None

    def add(raw: str, keep: bool = False) -> None:
        nonlocal size
        raw = raw if keep else re.sub(r"\s+", " ", raw)
        text.append(raw)
        size += len(raw)

    def row(category: str):
        nonlocal size, text, refs, ids
        raw = "".join(text)
        whole = re.sub(r" *\n *", "\n", raw.strip())
        lead = len(raw) - len(raw.lstrip())
        found = [(h, a - lead, n) for h, a, n in refs if n > 0 and a >= lead and a - lead + n <= len(whole)]
        text, refs, size = [], [], 0
        if whole:
            mine, ids = ids, []
            return category, whole, mine, found
        return None

    def inherited() -> str:
        return next((s[1] for s in reversed(stack) if s[1]), "Text")

    def leaf():
        return next((s for s in reversed(stack) if s[2] in ("leaf", "note")), None)

    for m in TAG.finditer(markup):
        raw = markup[at : m.start()]
        tag = (m.group(2) or "").lower()
        closing = bool(m.group(1))
        if deep is not None:
            if closing and tag == deep[0]:
                deep[1] -= 1
                if not deep[1]:
                    if deep[2] is not None:
                        yield "Table", safe_markup(markup[deep[2] : m.end()]).strip(), ids, []
                        ids = []
                    deep, at = None, m.end()
            elif tag == deep[0] and not m.group(4):
                deep[1] += 1
            continue
        keep = any(s[0] == "pre" for s in stack)
        add(entities.unescape(raw), keep)
        at = m.end()
        if not tag:
            continue
        attrs = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(m.group(3))} if not closing else {}
        blockish = tag in LEAVES or tag in HOLDERS or tag in CONTAINERS or tag in ("table", "hr")
        if closing:
            if not any(s[0] == tag for s in stack):
                continue
            while True:
                last = stack.pop()
                if last[2] in ("leaf", "note") or (last[2] == "holder" and leaf() is None):
                    made = row(last[1] or inherited())
                    if made:
                        yield made
                elif last[2] == "ref":
                    refs.append([last[3], last[4], size - last[4]])
                elif last[2] == "sup":
                    inner = "".join(text)[last[4] :]
                    if inner.strip().isascii() and inner.strip().isdigit():
                        whole = "".join(text)[: last[4]] + inner.strip().translate(RAISED)
                        text[:], size = [whole], len(whole)
                if last[0] == tag:
                    break
            continue
        if tag in DROPPED and not m.group(4):
            deep = [tag, 1, None]
            continue
        if blockish and leaf() is None or (blockish and leaf()[2] == "leaf" and tag in LEAVES):
            made = row((leaf() or [0, None])[1] or inherited())
            if made:
                yield made
        if "id" in attrs:
            ids.append(attrs["id"])
        if tag == "br":
            add("\n", True)
        elif tag == "img" and attrs.get("src") and leaf() is None:
            made = row(inherited())
            if made:
                yield made
            yield "Picture", re.sub(r"\s+", " ", attrs.get("alt", "")).strip(), ids, [(attrs["src"], 0, 0)]
            ids = []
        elif tag == "table" and leaf() is None and not m.group(4):
            deep = [tag, 1, m.start()]
        elif tag not in EMPTY and not m.group(4):
            kinds = set((attrs.get("epub:type", "") + " " + attrs.get("role", "").replace("doc-", "")).split())
            if leaf() is None and kinds & NOTES:
                stack.append([tag, "Footnote", "note"])
            elif leaf() is None and tag in LEAVES:
                heading = any(re.fullmatch(r"h[1-6]", c) for c in attrs.get("class", "").split())
                stack.append([tag, LEAVES[tag] or ("Section-header" if tag == "p" and heading else None), "leaf"])
            elif tag in HOLDERS or tag in CONTAINERS:
                stack.append([tag, HOLDERS.get(tag), "holder"])
            elif tag == "a" and attrs.get("href"):
                stack.append([tag, None, "ref", attrs["href"], size])
            elif tag == "sup":
                stack.append([tag, None, "sup", None, size])
            else:
                stack.append([tag, None, "inline"])
    if deep is None:
        add(entities.unescape(markup[at:]))
    made = row((leaf() or [0, None])[1] or inherited())
    if made:
        yield made


def _exploded(batches):
    for rows in sliced(batches):
        out = [(doc, n, *r) for doc, markup in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()) for n, r in enumerate(exploded(markup or ""))]
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("href", pa.string()), ("at", pa.int32()), ("len", pa.int32())])))
        cols = [pa.array([[{"href": h, "at": a, "len": n} for h, a, n in o[k]] if k == 5 else o[k] for o in out], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(cols, names=["doc", "n", "category", "text", "anchors", "refs"])


def exploded_rows(documents: DataFrame, id_col: str, markup_col: str) -> DataFrame:
    """doc, n, category, text, anchors, refs of each document's rows; documents are independent of each other."""
    return documents.select(F.col(id_col).cast("long"), F.col(markup_col).cast("string")).mapInArrow(_exploded, ROWS)


def _spine(batches):
    import io
    import posixpath
    import zipfile
    from urllib.parse import unquote
    from xml.etree import ElementTree

    local = lambda e: e.tag.rpartition("}")[2]
    for rows in batches:
        out = []
        for path, content in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                container = ElementTree.fromstring(z.read("META-INF/container.xml"))
                package = next(e.attrib["full-path"] for e in container.iter() if local(e) == "rootfile")
                tree = ElementTree.fromstring(z.read(package))
                manifest = {e.attrib["id"]: e.attrib for e in tree.iter() if local(e) == "item"}
                for n, ref in enumerate(e for e in tree.iter() if local(e) == "itemref"):
                    href = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(manifest[ref.attrib["idref"]]["href"])))
                    out.append((path, n, href, z.read(href).decode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], names=["book", "n", "document", "markup"])


def epub_documents(spark: SparkSession, path: str) -> DataFrame:
    """book (path), n, document, markup of each EPUB's spine, in reading order. A book is one file; books run in parallel."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_spine, "book string, n int, document string, markup string")
