"""Filter interaction audit: what each filter removes at each place of each order, from counts of failure masks.

Every document becomes one mask of the filters it fails. Documents are counted by (part, mask), so what is left is one row
of 2 ** n cells for each part, whatever the corpus holds. All n! orders are then visited by adjacent transpositions: one swap
of neighbours leads to the next order, and only the two steps that changed places are summed from the cells again. Shapley
totals accumulate along the walk.

Identity is by sha256 of the whole text. Texts that are identical share the filters that depend on the text alone, so rows are
grouped by (digest, mask, part, labels) before digests meet: a group of millions of copies is a few rows there, and no row is
joined back. With copies of one text, all but the rows of its smallest doc_id fail.

A null text counts as empty; a null doc_id is neither smaller nor greater than another, so its row never fails identity and
makes no other fail; it has no label. Repeated rows count each; rows of one doc_id with one text do not make each other fail.
Labels of several rows for one doc_id hold if one of them does; null labels do not. A null part is the empty string. Columns
beyond those named are left aside. An empty table gives no rows. Filters are limited by their n! orders: eight at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, col

#: A filter of this name stands for "identical to the text of a smaller doc_id".
IDENTICAL = "identical"
MOST = 8
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_filters(text: Column) -> dict[str, Column | str]:
    """The five failure conditions of the audit, by letter."""
    words = F.filter(F.split(text, SPACE_CLASS + "+", -1), lambda w: w != "")
    few = F.size(words) < 200
    alike = F.size(F.array_distinct(words)) * F.lit(100) < F.size(words) * F.lit(50)
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    loud = capitals.cast("long") * 100 > F.char_length(text).cast("long") * 3
    return {"A": few, "B": alike, "C": loud, "D": text.rlike("[#$%&*|]"), "E": IDENTICAL}


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str] | None = None, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, mask, n, good, toxic: documents by part and the bits of the filters that they fail (bit k is the k-th filter).

    filters: name to a failure condition over a column ``text`` (null texts are empty by then), or IDENTICAL."""
    filters = filters or text_filters(F.col("text"))
    if len(filters) > MOST:
        raise ValueError(f"{len(filters)} filters have too many orders: {MOST} at most")
    rows = docs.select(
        col(docs, id_col).cast("long").alias("doc_id"), F.coalesce(col(docs, text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(col(docs, part_col).cast("string"), F.lit("")).alias("part")
    )
    own, same = F.lit(0), 0
    for k, condition in enumerate(filters.values()):
        if isinstance(condition, str):
            same |= 1 << k
        else:
            own = own + F.when(condition, 1 << k).otherwise(0)
    marked = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), own.cast("int").alias("mask"), "part")
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    both = marked.join(known, "doc_id", "left").select("doc_id", "digest", "mask", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    sums = [F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")]
    if not same:
        return both.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n")).groupBy("part", "mask").agg(*sums)
    # the join dealt the rows by doc_id, so this count needs no shuffle
    ids = both.groupBy("doc_id", "digest", "mask", "part", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    kinds = ids.groupBy("digest", "mask", "part", "good", "toxic").agg(F.min(named).alias("first"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    lowest = kinds.groupBy("digest").agg(F.min("first.doc_id").alias("lowest"))
    found = kinds.join(lowest, "digest")
    passing = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), passing.alias("n")), F.struct((F.col("mask") + same).alias("mask"), (F.col("n") - passing).alias("n"))))
    cells = found.select("part", "good", "toxic", split.alias("cell")).select("part", "good", "toxic", "cell.mask", "cell.n").where("n > 0")
    return cells.groupBy("part", "mask").agg(*sums)


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places i at which to swap neighbours i and i + 1, so that all n! orders are visited, each once, from the first one on."""
    order, leftward = list(range(n)), [True] * n
    while True:
        best = -1
        for i, k in enumerate(order):
            j = i - 1 if leftward[k] else i + 1
            if 0 <= j < n and order[j] < k and (best < 0 or k > order[best]):
                best = i
        if best < 0:
            return
        k = order[best]
        i = best - 1 if leftward[k] else best
        order[i], order[i + 1] = order[i + 1], order[i]
        for other in range(k + 1, n):
            leftward[other] = not leftward[other]
        yield i


class Walk:
    """One part's cells and the sums of the order that the walk stands at."""

    def __init__(self, cells: np.ndarray):
        """cells: one row for each of n, good and toxic, one column for each mask."""
        self.cells, self.n = cells, cells.shape[1].bit_length() - 1
        self.masks = np.arange(cells.shape[1])
        self.order = list(range(self.n))
        self.lost = [self._lost(i) for i in range(self.n)]
        self.shapley = [0] * self.n
        self.failing = [int(cells[0, (self.masks >> f) & 1 == 1].sum()) for f in range(self.n)]

    def _lost(self, i: int) -> tuple[int, ...]:
        """What step i removes of all, good and toxic documents: those that fail its filter and none before it."""
        before = sum(1 << f for f in self.order[:i])
        hit = (self.masks & before == 0) & ((self.masks >> self.order[i]) & 1 == 1)
        return tuple(int(x) for x in self.cells[:, hit].sum(axis=1))

    def swap(self, i: int) -> None:
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]
        self.lost[i], self.lost[i + 1] = self._lost(i), self._lost(i + 1)

    def steps(self) -> list[tuple]:
        """filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost of each step; counts into Shapley."""
        left, out = int(self.cells[0].sum()), []
        for f, (gone, good, toxic) in zip(self.order, self.lost):
            left -= gone
            self.shapley[f] += gone
            out.append((f, left, gone, self.failing[f] - gone, int(self.cells[0, 1 << f]), good, toxic))
        return out


def _audited(names: str, swaps: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cells = np.zeros((3, 1 << len(names)), np.int64)
                for c in row["cells"]:
                    cells[:, c["mask"]] += (c["n"], c["good"], c["toxic"])
                walk = Walk(cells)
                orders, steps = [], []
                for i in [-1, *swaps]:
                    if i >= 0:
                        walk.swap(i)
                    orders.append("".join(names[f] for f in walk.order))
                    steps += walk.steps()
                columns = list(zip(*steps))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(steps), pa.string()),
                        pa.array([o for o in orders for _ in names], pa.string()),
                        pa.array(list(range(1, len(names) + 1)) * len(orders), pa.int32()),
                        *[pa.array(c, pa.int64()) for c in columns[1:]],
                        pa.array([walk.shapley[f] for f in columns[0]], pa.int64()),
                    ],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    return run


def audit_orders(counts: DataFrame, names: str) -> DataFrame:
    """One row for each part, order of the filters (one letter each) and step, from part, mask, n, good and toxic."""
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    swaps = list(adjacent_swaps(len(names)))
    assert len(swaps) == math.factorial(len(names)) - 1
    return cells.mapInArrow(_audited(names, swaps), AUDIT_SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters A to E over all orders, by language."""
    return audit_orders(mask_counts(docs, labels), "ABCDE")
