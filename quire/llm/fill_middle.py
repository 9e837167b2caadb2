"""Fill-in-middle transformation on ropes.

A text becomes a rope: leaves of at most LEAF code points that share the text's memory until they are joined, each with its
number of units and of code points, below nodes that cache the sums. The rope is split at two unit ranks; the three subtrees
are put together anew with sentinel leaves between them, which touches only nodes along the cuts. The transformation is
inverted by splitting the output's rope at its sentinels. A unit is a code point, a line (with its line feed) or a word
(with the white space before it; what follows the last word belongs to it).

No sentinel overlaps itself or another one, and a text that contains one is left plain, so each sentinel of an output occurs
once and the inverse is exact. A null text is empty; empty texts are plain. The cut of a document depends on nothing but its
id (null: no digits) and its number of units. Repeated rows are treated alike; other columns are kept by with_middles and left
aside by the query. An empty table gives an empty result. Very long texts are more leaves; the tree's depth is logarithmic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, texts_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
LEAF = 2048
#: Patterns that match one unit each, so that the units of a text cover it.
UNITS = {"char": None, "line": re.compile(r"[^\n]*\n|[^\n]+"), "word": re.compile(r"\s*\S+(?:\s+\Z)?|\s+\Z")}


@dataclass(frozen=True, slots=True)
class Leaf:
    text: str
    units: int

    @property
    def points(self) -> int:
        return len(self.text)

    depth = 0


@dataclass(frozen=True, slots=True)
class Node:
    left: Leaf | Node
    right: Leaf | Node
    units: int
    points: int
    depth: int


Rope = Leaf | Node
EMPTY = Leaf("", 0)


def _node(left: Rope, right: Rope) -> Node:
    return Node(left, right, left.units + right.units, left.points + right.points, 1 + max(left.depth, right.depth))


def concat(left: Rope, right: Rope) -> Rope:
    """Both ropes as one; depths of siblings differ by one at most, as those of the arguments' siblings do."""
    if not left.points:
        return right
    if not right.points:
        return left
    if left.depth > right.depth + 1:
        return _balanced(left.left, concat(left.right, right))
    if right.depth > left.depth + 1:
        return _balanced(concat(left, right.left), right.right)
    return _node(left, right)


def _balanced(left: Rope, right: Rope) -> Rope:
    """A node of two ropes whose depths differ by two at most."""
    if left.depth > right.depth + 1:
        if left.left.depth >= left.right.depth:
            return _node(left.left, _node(left.right, right))
        return _node(_node(left.left, left.right.left), _node(left.right.right, right))
    if right.depth > left.depth + 1:
        if right.right.depth >= right.left.depth:
            return _node(_node(left, right.left), right.right)
        return _node(_node(left, right.left.left), _node(right.left.right, right.right))
    return _node(left, right)


def rope_of(text: str, unit: str = "char", leaf: int = LEAF) -> Rope:
    """A balanced rope of the text; a leaf ends with a unit, so a longer unit has a leaf of its own."""
    pattern = UNITS[unit]
    if pattern is None:
        row = [Leaf(text[i : i + leaf], min(leaf, len(text) - i)) for i in range(0, len(text), leaf)]
    else:
        row, start, count = [], 0, 0
        for match in pattern.finditer(text):
            if count and match.end() - start > leaf:
                row.append(Leaf(text[start : match.start()], count))
                start, count = match.start(), 0
            count += 1
        if count:
            row.append(Leaf(text[start:], count))
    return _built(row, 0, len(row)) if row else EMPTY


def _built(row: list[Leaf], start: int, end: int) -> Rope:
    """Leaves start to end, halved until one is left."""
    if end - start == 1:
        return row[start]
    middle = (start + end) // 2
    return _node(_built(row, start, middle), _built(row, middle, end))


def split(rope: Rope, rank: int, unit: str = "char", by: str = "units") -> tuple[Rope, Rope]:
    """The first ``rank`` units (or code points, by="points") and the rest. Splitting by points counts the units of a cut
    leaf anew, so a unit that is cut through is one on either side."""
    size = rope.units if by == "units" else rope.points
    if rank <= 0:
        return EMPTY, rope
    if rank >= size:
        return rope, EMPTY
    if isinstance(rope, Node):
        first = rope.left.units if by == "units" else rope.left.points
        if rank < first:
            a, b = split(rope.left, rank, unit, by)
            return a, concat(b, rope.right)
        a, b = split(rope.right, rank - first, unit, by)
        return concat(rope.left, a), b
    pattern = UNITS[unit]
    if pattern is None:
        return Leaf(rope.text[:rank], rank), Leaf(rope.text[rank:], rope.units - rank)
    if by == "units":
        at = next(m for k, m in enumerate(pattern.finditer(rope.text), 1) if k == rank).end()
        return Leaf(rope.text[:at], rank), Leaf(rope.text[at:], rope.units - rank)
    head, tail = rope.text[:rank], rope.text[rank:]
    return tuple(Leaf(t, sum(1 for _ in pattern.finditer(t))) for t in (head, tail))


def leaves(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, Node):
            stack += [top.right, top.left]
        else:
            yield top.text


def flat(rope: Rope) -> str:
    return rope.text if isinstance(rope, Leaf) else "".join(leaves(rope))


def transformed(text: str, cuts: tuple[int, int], form: str, unit: str = "char") -> tuple[str, int, int, int]:
    """The output, and the code points of prefix, middle and suffix. cuts: two unit ranks in any order."""
    low, high = sorted(cuts)
    prefix, rest = split(rope_of(text, unit), low, unit)
    middle, suffix = split(rest, high - low, unit)
    marks = {s: Leaf(s, 1) for s in SENTINELS}
    parts = [marks[PREFIX], prefix, marks[SUFFIX], suffix, marks[MIDDLE], middle]
    if form == "spm":
        parts = [*parts[2:4], *parts[:2], *parts[4:]]
    out: Rope = EMPTY
    for part in parts:
        out = concat(out, part)
    return flat(out), prefix.points, middle.points, suffix.points


def restored(output: str, form: str) -> str:
    """The text of an output: its rope is split at the sentinels and put back in order."""
    if form == "plain":
        return output
    cuts = sorted((output.index(s), s) for s in SENTINELS)
    rest, taken, found = rope_of(output), 0, {}
    for (at, sentinel), (end, _) in zip(cuts, [*cuts[1:], (len(output), "")]):
        _, rest = split(rest, at + len(sentinel) - taken, by="points")
        found[sentinel], rest = split(rest, end - at - len(sentinel), by="points")
        taken = end
    return flat(concat(concat(found[PREFIX], found[MIDDLE]), found[SUFFIX]))


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of ``seed:`` and the decimal id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
OUT_SQL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
BACK_SQL = OUT_SQL + ", restored string"


def _with_middles(unit: str, rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for i, text, h1, h2, h3, h4 in zip(part.column(0).to_pylist(), texts_of(part.column(1)).to_pylist(), *(part.column(k).to_pylist() for k in range(2, 6))):
                    pattern = UNITS[unit]
                    n = len(text) if pattern is None else sum(1 for _ in pattern.finditer(text))
                    if not text or h3 % 100 >= rate or any(s in text for s in SENTINELS):
                        rows.append((i, n, "plain", None, None, text))
                        continue
                    form = "spm" if h4 % 100 < spm_rate else "psm"
                    output, prefix, middle, _ = transformed(text, (h1 % (n + 1), h2 % (n + 1)), form, unit)
                    rows.append((i, n, form, prefix, middle, output))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)

    return run


def fill_in_middle(docs: DataFrame, unit: str = "char", rate: int = 90, spm_rate: int = 20, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n (units of the text), form, prefix_chars and middle_chars (null where plain), output.

    rate: of 100 documents, so many are transformed; spm_rate: of 100 transformed ones, so many begin with the suffix."""
    rows = id_text(docs, id_col, text_col)
    return rows.select("doc_id", "text", *draws(F.col("doc_id"), seed)).mapInArrow(_with_middles(unit, rate, spm_rate), OUT_SQL)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 5):
            texts = [restored(o, f) for o, f in zip(part.column(5).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*OUT.names, "restored"])


def restore_middles(outputs: DataFrame) -> DataFrame:
    """fill_in_middle's rows with the text that each output and its form give again."""
    return outputs.select(*OUT.names).mapInArrow(_restored, BACK_SQL)
