"""Translation planning and checking: chunks, rendered and parsed answers, complaints, banks and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Characters of a chunk, and the range of answer length to question length.
BUDGET, SHORTEST, LONGEST = 2000, 0.25, 3.0


def cut_to_budget(items: Column, budget: int = BUDGET) -> Column:
    """Chunk number of each item of an ordered array of weights: consecutive, an item over the budget alone."""
    start = F.struct(F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc, w):
        fits = (acc["chunk"] >= 0) & (acc["used"] + w <= budget)
        chunk = F.when(fits, acc["chunk"]).otherwise(acc["chunk"] + 1)
        return F.struct(chunk.alias("chunk"), F.when(fits, acc["used"] + w).otherwise(w).cast("long").alias("used"), F.array_append(acc["out"], chunk).alias("out"))

    return F.aggregate(items, start, step, lambda a: a["out"])


def plan_chunks(items: DataFrame, key: str, budget: int = BUDGET) -> DataFrame:
    """items (key, pos, weight) -> key, chunk, first_pos, n, weight. The unit of the fold is one key's list."""
    lists = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("weight").cast("long").alias("weight")))).alias("xs"))
    numbered = lists.select(key, F.explode(F.arrays_zip(F.col("xs"), cut_to_budget(F.transform("xs", lambda x: x["weight"]), budget).alias("chunk"))).alias("z"))
    return numbered.groupBy(key, F.col("z.chunk").alias("chunk")).agg(F.min("z.xs.pos").alias("first_pos"), F.count(F.lit(1)).alias("n"), F.sum("z.xs.weight").alias("weight"))


def complaint(question: Column, answer: Column) -> Column:
    """Why an answer is refused, or null."""
    answer = X.trim_all(X.unfenced(answer))
    q, a = F.char_length(X.strip_markers(question)), F.char_length(X.strip_markers(answer))
    return F.when(answer == "", "empty").when(a == 0, "only markers").when(a < q * SHORTEST, "too short").when(a > q * LONGEST, "too long")


def rendered(parts: Column) -> Column:
    """Parts as numbered lines."""
    return F.array_join(F.transform(parts, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "\n")


def parsed_answer(answer: Column, count: Column) -> Column:
    """Parts of a numbered answer, or null where the numbers or their count are off."""
    lines = F.filter(F.split(X.unfenced(answer), "\n"), lambda s: X.trim_all(s) != "")
    right = F.forall(F.transform(lines, lambda s, i: F.regexp_extract(s, r"\A[ \t]*([0-9]+)\.[ \t]", 1) == (i + 1).cast("string")), lambda b: b)
    return F.when((F.size(lines) == count) & right, F.transform(lines, lambda s: X.trim_all(F.regexp_replace(s, r"\A[ \t]*[0-9]+\.[ \t]+", ""))))


def distinct_questions(blocks: DataFrame, fields: list[str]) -> DataFrame:
    """key and how often it is asked: identical questions are asked once."""
    return blocks.groupBy(X.bank_key(*[F.col(f).cast("string") for f in fields]).alias("key")).agg(F.count(F.lit(1)).alias("asked"))


def resolved_records(rows: DataFrame, records: DataFrame) -> DataFrame:
    """rows (id, src) with the record found by id, else by src, else by src without a trailing ':0'; text null if none."""
    r = lambda n: records.select(F.col("key").alias(f"k{n}"), F.col("text").alias(f"t{n}"))
    out = rows.join(r(1), F.col("id") == F.col("k1"), "left").join(r(2), F.col("src") == F.col("k2"), "left").join(r(3), F.regexp_replace("src", r":0\z", "") == F.col("k3"), "left")
    return out.select("id", "src", F.coalesce("t1", "t2", "t3").alias("text"), F.when(F.col("k1").isNotNull(), "id").when(F.col("k2").isNotNull(), "src").when(F.col("k3").isNotNull(), "family").alias("by"))


def list_runs(items: DataFrame) -> DataFrame:
    """items (book, pos, category, text) -> book, run, kind, n: consecutive List-items of one list kind."""
    from pyspark.sql import Window

    w = Window.partitionBy("book").orderBy("pos")
    kind = F.when(F.col("category") == "List-item", F.when(F.col("text").rlike(r"\A[0-9]+[.)]"), "ol").otherwise("ul"))
    marked = items.withColumn("kind", kind).withColumn("new", F.when(F.col("kind").eqNullSafe(F.lag("kind").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(w)).where("kind is not null")
    return runs.groupBy("book", "run", "kind").agg(F.count(F.lit(1)).alias("n"))
