"""Chapter verbs of the edit log: set, rename, remove, move and reset of a book's divisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERBS = ("chapter-set", "chapter-rename", "chapter-remove", "chapter-move", "chapter-reset")


def replayed_chapters(seed: DataFrame, ops: DataFrame) -> DataFrame:
    """book, id, title after the log's chapter verbs. seed: book, id, title; ops: book, seq, op, id, into, title.

    Only what comes after a book's last reset counts. A division wanders when it is moved, so a book's chapter verbs are a
    fold in log order; their number is that of a person's decisions, and the divisions are a map from row id to title. A
    rename, removal or move of what divides nothing, and a move to a row that has a division, do nothing."""
    verbs = ops.where(F.col("op").isin(*VERBS))
    reset = verbs.where("op = 'chapter-reset'").groupBy("book").agg(F.max("seq").alias("__reset"))
    live = verbs.join(reset, "book", "left").where("op <> 'chapter-reset' and (__reset is null or seq > __reset)")
    logs = live.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "id", "into", "title"))).alias("log"))
    first = seed.groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("id", F.coalesce("title", F.lit("")).alias("title")))).alias("now"))
    empty = F.expr("cast(map() as map<string,string>)")

    def step(now, o):
        has = F.map_contains_key(now, o["id"])
        without = F.map_filter(now, lambda k, v: k != o["id"])
        put = lambda m, k, v: F.map_concat(F.map_filter(m, lambda x, y: x != k), F.create_map(k, v))
        title = F.coalesce(o["title"], F.lit(""))
        free = has & ~F.map_contains_key(now, F.coalesce(o["into"], F.lit("")))
        return (
            F.when(o["op"] == "chapter-set", put(now, o["id"], title))
            .when((o["op"] == "chapter-rename") & has, put(now, o["id"], title))
            .when(o["op"] == "chapter-remove", without)
            .when((o["op"] == "chapter-move") & free & o["into"].isNotNull(), put(without, F.coalesce(o["into"], F.lit("")), F.coalesce(F.try_element_at(now, o["id"]), F.lit(""))))
            .otherwise(now)
        )

    both = first.join(logs, "book", "full").select("book", F.coalesce("now", empty).alias("now"), "log")
    return both.select("book", F.explode(F.when(F.col("log").isNull(), F.col("now")).otherwise(F.aggregate("log", F.col("now"), step))).alias("id", "title"))


def linked(refs: DataFrame, rows: DataFrame, ops: DataFrame) -> DataFrame:
    """ops (book, seq, block, at, len, note) of the link verb with ``refused``, the reason or null. rows: book, id, text,
    category, shelf; refs: book, block, at, len of the references that are there.

    A link must name a row in the flow and a note, end within the row's text, and meet no reference that is there or that an
    earlier accepted link has made. Of links that meet each other the earliest is accepted; a link that meets a refused one
    only is accepted too, so each row's links are folded in order."""
    flow = rows.select("book", F.col("id").alias("block"), F.when(F.col("shelf").isNull(), F.char_length("text")).alias("__n"))
    notes = rows.select("book", F.col("id").alias("note"), F.col("category").alias("__c"))
    held = refs.groupBy("book", "block").agg(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), F.col("len").cast("int").alias("len"))).alias("__held"))
    both = ops.join(flow, ["book", "block"], "left").join(notes, ["book", "note"], "left").join(held, ["book", "block"], "left")
    none = F.expr("cast(array() as array<struct<at:int,len:int>>)")
    meets = lambda spans, at, n: F.exists(spans, lambda s: (at < s["at"] + s["len"]) & (s["at"] < at + n))
    at, n = F.col("at").cast("int"), F.col("len").cast("int")
    why = F.when(F.col("__n").isNull(), "no such row").when(F.col("__c").isNull(), "no such note").when(F.col("__c") != "Footnote", "not a note").when(at + n > F.col("__n"), "past the end").when(meets(F.coalesce("__held", none), at, n), "claimed")
    judged = both.withColumn("__why", why)
    lists = judged.where("__why is null").groupBy("book", "block").agg(F.array_sort(F.collect_list(F.struct("seq", at.alias("at"), n.alias("len")))).alias("xs"))
    start = F.struct(none.alias("held"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def step(acc, o):
        bad = meets(acc["held"], o["at"], o["len"])
        return F.struct(F.when(bad, acc["held"]).otherwise(F.array_append(acc["held"], F.struct(o["at"].alias("at"), o["len"].alias("len")))).alias("held"), F.when(bad, F.array_append(acc["out"], o["seq"].cast("long"))).otherwise(acc["out"]).alias("out"))

    clash = lists.select("book", F.explode(F.aggregate("xs", start, step, lambda a: a["out"])).alias("seq")).withColumn("__clash", F.lit("claimed"))
    return judged.join(clash, ["book", "seq"], "left").select("book", "seq", "block", "at", "len", "note", F.coalesce("__why", "__clash").alias("refused"))
