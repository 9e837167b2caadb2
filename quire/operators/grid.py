"""Tables: their rows and cells as written, and each cell's place on the grid under row and column spans.

A small reader gives the cells of each fragment's first table. A nested table, and any markup, is text of the cell it stands
in; what is code is no text. Placing is a fold over a table's rows that carries how far each column is still covered.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .batches import sliced
from .splice import ATTRIBUTE, TOKEN

#: Fixed value: how far a cell may reach.
MAX_SPAN = 64
NUMBER = re.compile(r"\s*\+?([0-9]+)")
ROW_GROUPS = frozenset(("thead", "tbody", "tfoot", "caption", "colgroup"))
CELLS = "doc long, rows int, columns int, grid boolean, cells array<struct<row: int, k: int, col: int, header: boolean, colspan: int, rowspan: int, text: string>>"


def span(said: str | None) -> int:
    """A whole number of one at least that an attribute begins with, up to MAX_SPAN; else 1."""
    m = NUMBER.match(said or "")
    digits = (m.group(1).lstrip("0") if m else "") or "1"
    return MAX_SPAN if len(digits) > 2 else min(int(digits), MAX_SPAN)


def rows_of(markup: str) -> list[list[tuple[bool, int, int, str]]]:
    """The first table's rows of (header, colspan, rowspan, text); rows without cells are left out. A fragment without a
    table's tag is read as the inside of one. Cells and rows end where the next begins."""
    rows: list[list] = []
    row: list | None = None
    cell: list | None = None
    depth = 0 if re.search(r"<\s*table[\s>]", markup, re.I) else 1
    wrapped, hidden, at = depth == 1, 0, 0

    def end_cell() -> None:
        nonlocal cell
        if cell is not None:
            row.append((cell[0], cell[1], cell[2], "".join(cell[3]).strip(X.WIDE_BLANK)))
        cell = None

    def end_row() -> None:
        nonlocal row
        end_cell()
        if row:
            rows.append(row)
        row = None

    for m in TOKEN.finditer(markup):
        if cell is not None and not hidden:
            cell[3].append(entities.unescape(markup[at : m.start()]))
        at = m.end()
        tag, closes = (m.group(5) or "").lower(), bool(m.group(4))
        if tag == "template":
            hidden = max(0, hidden - 1) if closes else hidden + 1
        elif hidden:
            continue
        elif tag == "table":
            if not closes:
                depth += 1
            elif depth:
                depth -= 1
                if not depth and not wrapped:
                    at = len(markup)
                    break
        elif depth == 1 and tag in ("td", "th"):
            end_cell()
            if not closes:
                row = [] if row is None else row
                attrs = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(m.group(6))}
                cell = [tag == "th", span(attrs.get("colspan")), span(attrs.get("rowspan")), []]
        elif depth == 1 and (tag == "tr" or tag in ROW_GROUPS):
            end_row()
            if tag == "tr" and not closes:
                row = []
    if cell is not None and not hidden:
        cell[3].append(entities.unescape(markup[at:]))
    end_row()
    return rows


def placed(rows: list[list[tuple[bool, int, int, str]]]) -> tuple[list[list[int]], int, bool]:
    """The column of each cell, the number of columns, and whether the cells cover the grid without gap or overlap. A cell
    stands in the first column that is free in its row; what reaches below the last row is cut there."""
    covered: dict[int, int] = {}
    columns, width, overlap = [], 0, False
    for y, row in enumerate(rows):
        covered = {x: until for x, until in covered.items() if until > y}
        taken, x, mine = dict(covered), 0, []
        for _, across, down, _ in row:
            while x in taken:
                x += 1
            mine.append(x)
            for c in range(x, x + across):
                overlap |= c in taken
                taken[c] = max(taken.get(c, 0), y + down)
            x += across
        columns.append(mine)
        width, covered = max(width, max(taken) + 1), taken
    return columns, width, not overlap and _whole(rows, columns, width)


def _whole(rows, columns, width: int) -> bool:
    area = sum(across * min(down, len(rows) - y) for y, row in enumerate(rows) for _, across, down, _ in row)
    return bool(rows) and area == width * len(rows)


def _tables(batches):
    for batch in sliced(batches):
        out = []
        for doc, markup in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = rows_of(markup or "")
            columns, width, whole = placed(rows)
            cells = [{"row": y, "k": k, "col": columns[y][k], "header": c[0], "colspan": c[1], "rowspan": c[2], "text": c[3]} for y, row in enumerate(rows) for k, c in enumerate(row)]
            out.append((doc, len(rows), width, whole, cells))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.struct([("row", pa.int32()), ("k", pa.int32()), ("col", pa.int32()), ("header", pa.bool_()), ("colspan", pa.int32()), ("rowspan", pa.int32()), ("text", pa.string())])))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["doc", "rows", "columns", "grid", "cells"])


def tables(docs: DataFrame, id_col: str = "doc", markup_col: str = "markup") -> DataFrame:
    """doc, rows, columns, grid, cells of each fragment. No row: it holds no table, and its words are what is shown. grid:
    every place is covered exactly once. Null and empty fragments have no rows."""
    return docs.select(F.col(id_col).cast("long"), F.col(markup_col).cast("string")).mapInArrow(_tables, CELLS)


def table_cells(found: DataFrame) -> DataFrame:
    """One row for each cell: doc, row, k (in its row), col, header, colspan, rowspan, text, head (its row is all headers)."""
    cells = found.select("doc", F.inline("cells"))
    return cells.withColumn("head", F.min("header").over(Window.partitionBy("doc", "row")))
