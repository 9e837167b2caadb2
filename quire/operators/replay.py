"""Overlays and edit logs: field-wise last write wins where no structural verb occurs, an ordered fold per book otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRUCTURAL = ("merge", "split", "move", "link")


def last_per_key(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The row with the largest seq of each key."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def overlay(amendments: DataFrame, keys: list[str], fields: list[str], seq: str = "seq") -> DataFrame:
    """For each key and field the value that was said last; a null means not said."""
    return amendments.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields])


def amended(blocks: DataFrame, amendments: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks without the struck ones, with categories and texts replaced."""
    last = overlay(amendments, keys, ["strike", "category", "text"]).withColumnsRenamed({"category": "__category", "text": "__text", "strike": "__strike"})
    both = blocks.join(last, keys, "left").where(~F.coalesce("__strike", F.lit(False)))
    return both.withColumn("category", F.coalesce("__category", "category")).withColumn("text", F.coalesce("__text", "text")).drop("__category", "__text", "__strike")


def overlay_tally(amendments: DataFrame, keys: list[str]) -> DataFrame:
    """One row: struck (which excludes the rest), reclassified, corrected, joined."""
    last = overlay(amendments, keys, ["strike", "category", "text", "join"])
    live = ~F.coalesce("strike", F.lit(False))
    return last.agg(F.count_if(~live).alias("struck"), F.count_if(live & F.col("category").isNotNull()).alias("reclassified"), F.count_if(live & F.col("text").isNotNull()).alias("corrected"), F.count_if(live & F.coalesce("join", F.lit(False))).alias("joined"))


def replay_fold(rows: DataFrame, ops: DataFrame) -> DataFrame:
    """rows (book, id, text, category, shelf) after ops (book, seq, op, id, text, category), none of them structural."""
    said = lambda *verbs: F.when(F.col("op").isin(*verbs), F.col("seq"))
    last = ops.groupBy("book", "id").agg(
        F.max_by("op", said("strike", "restore")).alias("s"), F.max_by("text", said("text")).alias("t"), F.max_by("category", said("category")).alias("c"), F.max(said("restore-furniture")).alias("f"), F.max(said("text")).alias("retyped")
    )
    both = rows.join(last, ["book", "id"], "left")
    return both.select("book", "id", F.coalesce("t", "text").alias("text"), F.coalesce("c", "category").alias("category"), F.when(F.col("f").isNull(), F.col("shelf")).alias("shelf"), (F.coalesce("s", F.lit("")) == "strike").alias("struck"), F.col("retyped").isNotNull().alias("retyped"))


def missing_targets(rows: DataFrame, ops: DataFrame) -> DataFrame:
    """Ops that name no row: they never fail, they are listed once."""
    return ops.join(rows.select("book", "id"), ["book", "id"], "left_anti").select("book", "id").distinct()


def replay_structural(rows: DataFrame, ops: DataFrame) -> DataFrame:
    """rows (book, pos, id, text, category) after merges, splits and moves in log order: book, pos, id, text, category, struck."""

    def run(key, left, right):
        import pandas as pd

        order = list(left.sort_values("pos").id)
        text, kind = dict(zip(left.id, left.text)), dict(zip(left.id, left.category))
        struck: set[str] = set()
        for o in right.sort_values("seq").itertuples(index=False):
            if o.id not in text:
                continue
            if o.op in ("strike", "restore"):
                (struck.add if o.op == "strike" else struck.discard)(o.id)
            elif o.op == "text":
                text[o.id] = o.text
            elif o.op == "category":
                kind[o.id] = o.category
            elif o.op == "merge" and o.into in text and o.into != o.id and "Footnote" not in (kind[o.id], kind[o.into]):
                text[o.into] = f"{text[o.into]} {text.pop(o.id)}"
                order.remove(o.id)
            elif o.op == "split" and kind[o.id] != "Footnote" and 0 < o.at < len(text[o.id]) and f"{o.id}/1" not in text:
                a, b = f"{o.id}/1", f"{o.id}/2"
                whole = text.pop(o.id)
                text |= {a: whole[: int(o.at)], b: whole[int(o.at) :]}
                kind |= {a: kind[o.id], b: kind[o.id]}
                i = order.index(o.id)
                order[i : i + 1] = [a, b]
            elif o.op == "move" and o.into in text and o.into != o.id:
                order.remove(o.id)
                order.insert(order.index(o.into), o.id)
        return pd.DataFrame({"book": key[0], "pos": range(len(order)), "id": order, "text": [text[i] for i in order], "category": [kind[i] for i in order], "struck": [i in struck for i in order]})

    return rows.groupBy("book").cogroup(ops.groupBy("book")).applyInPandas(run, "book string, pos long, id string, text string, category string, struck boolean")
