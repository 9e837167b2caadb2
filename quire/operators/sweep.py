"""Sweeps: a census of pattern matches with offsets, and cuts from right to left."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as X
from .batches import runs


def census(rows: DataFrame, pattern: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, n, hit of each match. Matches are taken by the JVM; a pattern that matches nothing at all is refused."""
    import re

    if re.search(pattern, ""):
        raise ValueError("the pattern matches an empty string")
    hits = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
    return rows.select(F.col(id_col).alias("id"), F.posexplode(hits).alias("n", "hit"))


def spans(rows: DataFrame, pattern: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, start, end, hit: offsets in code points."""
    each = rows.select(F.col(id_col).cast("long").alias("id"), F.explode(X.match_spans(F.col(text_col), pattern)).alias("s"))
    return each.select("id", F.col("s.at").cast("long").alias("start"), (F.col("s.at") + F.col("s.len")).cast("long").alias("end"), F.col("s.hit").alias("hit"))


#: Blanks that may meet at a seam, and marks that no blank stands before.
SEAM_BLANKS, CLOSERS = " \t\n\r", ".,;:!?)"


def sewn(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans (disjoint, any order), sewn at each seam and nowhere else, and trimmed.

    Cuts go from right to left. Of two blanks that meet, one stays: the line break if there is one, else the left one. A blank
    before a closing mark goes. A mend never reaches into the cut to its left."""
    order = sorted(spans, reverse=True)
    kept: list[str] = []  # from the end of the text on
    behind = text[order[0][1] :] if order else text
    first = behind[:1]
    kept.append(behind)
    for k, (start, _) in enumerate(order):
        floor = order[k + 1][1] if k + 1 < len(order) else 0
        left = text[start - 1] if start else ""
        end = start
        if left and first and left in SEAM_BLANKS:
            if first in SEAM_BLANKS and not (first == "\n" and left != "\n" and start > floor):
                kept[-1] = kept[-1][1:]
                if not kept[-1] and len(kept) > 1:
                    kept.pop()
                first = kept[-1][:1]
            elif (first in SEAM_BLANKS or first in CLOSERS) and start > floor:
                end = start - 1
        if end > floor:
            kept.append(text[floor:end])
            first = kept[-1][:1]
    return "".join(reversed(kept)).strip(X.WIDE_BLANK)


@F.arrow_udf(StringType())
def _sewn(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for at, n in runs(texts):
        rows = zip(*(c.slice(at, n).to_pylist() for c in (texts, starts, ends)))
        out.append(pa.array([t if t is None or not s else sewn(t, list(zip(s, e))) for t, s, e in rows], pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def without_spans(text: Column, spans: Column) -> Column:
    """text without spans (array<struct<start, end>>, code points); as it is where there are none. One pass over each text."""
    return _sewn(text, F.transform(spans, lambda s: s["start"].cast("int")), F.transform(spans, lambda s: s["end"].cast("int")))


def cut_spans(rows: DataFrame, chosen: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """rows with their chosen spans (id, start, end) cut as ``swept``, and ``struck`` where nothing is left."""
    spans = chosen.groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    both = rows.join(spans, F.col(id_col) == F.col("__id"), "left")
    return both.withColumn("swept", without_spans(F.col(text_col), F.col("__spans"))).withColumn("struck", F.col("__spans").isNotNull() & (F.col("swept") == "")).drop("__id", "__spans")


def cut(rows: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """Rows with all matches cut as ``swept``, and ``struck`` where nothing is left; a row without a match is as it was."""
    spans = F.transform(X.match_spans(F.col(text_col), pattern), lambda s: F.struct(s["at"].alias("start"), (s["at"] + s["len"]).alias("end")))
    both = rows.withColumn("__spans", spans)
    return both.withColumn("swept", without_spans(F.col(text_col), F.col("__spans"))).withColumn("struck", (F.size("__spans") > 0) & (F.col("swept") == "")).drop("__spans")
