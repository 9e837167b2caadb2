"""Banks of page answers for many books: a log of states, versions of answers, and what a run does with what it finds.

A shelf is a folder that driver and executors share. ``answers`` holds the appended pages by version; ``log`` holds numbered
entries, each one row a book. An entry or an append counts once it is whole, so what a lost job left behind is not seen. The
state of a book is what its last entries say: which version is its bank, whether a run was completed over it, and which version
is pending beside it and for what it was asked. A new reading never touches the bank: it is written as pending, and takes its
place in steps (``finish_steps``) of which each leaves a state that the next run mends without reading a page anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "book string, event string, version long, skip array<int>, language string, model string, completed_at string, pages long, action string, target string, carried long, reason string"
ANSWERS = "book string, version long, append long, page int, seq long, text string"


class Shelf:
    """The shelf below a path, which need not exist yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, folder: str) -> list[tuple[str, bool]]:
        """The folders below one, and whether each is whole."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at)]
        return [(n, files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/{n}/_SUCCESS"))) for n in names]

    def _next(self) -> int:
        return 1 + max((int(n) for n, _ in self._names("log")), default=0)

    def log(self) -> DataFrame:
        """The rows of whole entries with their number."""
        whole = [f"{self.path}/log/{n}" for n, done in self._names("log") if done]
        if not whole:
            return self.spark.createDataFrame([], ENTRY + ", n long")
        n = F.regexp_extract(F.col("_metadata.file_path"), r"/log/([0-9]+)/[^/]*\z", 1).cast("long")
        return self.spark.read.schema(ENTRY).parquet(*whole).withColumn("n", n)

    def put(self, rows: DataFrame, number: int | None = None) -> int:
        """A new entry; columns that rows lacks are null. A number that is taken is an error."""
        number = self._next() if number is None else number
        schema = self.spark.createDataFrame([], ENTRY).schema
        cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
        rows.select(*cols).write.mode("errorifexists").parquet(f"{self.path}/log/{number:012d}")
        return number

    def append(self, opened: DataFrame, answers: DataFrame) -> None:
        """Answers (book, page, seq, text) into the versions that a run has opened; books it has not opened are an error."""
        to = opened.where("target is not null").select("book", "version")
        rows = answers.select(F.col("book").cast("string").alias("book"), F.col("page").cast("int").alias("page"), F.col("seq").cast("long").alias("seq"), "text").join(to, "book", "left")
        known = F.when(F.col("version").isNull(), F.raise_error(F.concat(F.lit("no bank was opened for "), F.coalesce("book", F.lit("null")))).cast("long")).otherwise(F.col("version"))
        number = 1 + max((int(n.split("-")[0]) for n, _ in self._names("answers")), default=0)
        rows.select("book", known.alias("version"), F.lit(number).cast("long").alias("append"), "page", "seq", "text").write.parquet(f"{self.path}/answers/{number:012d}-{uuid.uuid4().hex}")

    def answers(self) -> DataFrame:
        """book, version, page, text: the last answer of each page in each version; blank ones are answers too."""
        whole = [f"{self.path}/answers/{n}" for n, done in self._names("answers") if done]
        raw = self.spark.read.schema(ANSWERS).parquet(*whole) if whole else self.spark.createDataFrame([], ANSWERS)
        last = F.max_by(F.struct("text"), F.struct("append", "seq"))
        return raw.groupBy("book", "version", "page").agg(last.alias("r")).select("book", "version", "page", "r.text")

    def state(self) -> DataFrame:
        """book, bank (version or null), completed (struct or null), pending (struct of version, skip, language, or null)."""
        event = F.col("event")
        last = lambda value, *events: F.max_by(value, F.when(event.isin(*events), F.col("n")))
        said = self.log().where(event.isNotNull()).groupBy("book").agg(
            last(F.col("version"), "open", "promote").alias("bank"),
            last(F.when(event == "mark", F.struct("completed_at", "pages")), "mark", "unmark").alias("completed"),
            last(F.when(event == "pend", F.struct("version", "skip", "language")), "pend", "open", "promote", "discard").alias("pending"),
        )
        return said

    def bank(self) -> DataFrame:
        """book, page, text of the banks as they are."""
        return self.answers().join(self.state().select("book", F.col("bank").alias("version")), ["book", "version"]).select("book", "page", "text")

    def open(self, asks: DataFrame) -> DataFrame:
        """What a run does with each book: asks (book, skip, language, model, fresh, reuse) -> book, action, target, version,
        carried (pages that are there already), reason. Written as an entry before it is returned, so it is decided once.

        reuse answers from a completed bank alone and changes nothing; else it is refused. A pending version goes on if it was
        asked the same (pages to skip as a set, and the language; one without a request counts as the same), else it is
        discarded, as it is under fresh. Then a bank with answers is read anew beside it if it was completed, or under fresh; it
        goes on if it was not; an empty one is begun. Books that are asked twice are an error."""
        number = self._next()
        sizes = self.answers().groupBy("book", "version").agg(F.count(F.lit(1)).alias("n"))
        ask = asks.select(F.col("book").cast("string").alias("book"), F.array_sort(F.array_distinct(F.coalesce("skip", F.array().cast("array<int>")))).alias("skip"), "language", "model", F.coalesce("fresh", F.lit(False)).alias("fresh"), F.coalesce("reuse", F.lit(False)).alias("reuse"))
        twice = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("asked twice: "), F.first("book"))).cast("boolean"))
        once = ask.groupBy("book").agg(F.first(F.struct("skip", "language", "model", "fresh", "reuse")).alias("a"), twice.alias("__twice")).where("__twice is null").select("book", "a.*")
        found = once.join(self.state(), "book", "left")
        found = found.join(sizes.select("book", F.col("version").alias("bank"), F.col("n").alias("banked")), ["book", "bank"], "left")
        found = found.withColumn("held", F.col("pending.version")).join(sizes.select("book", F.col("version").alias("held"), F.col("n").alias("carried_on")), ["book", "held"], "left")
        return self._decided(found.withColumns({"banked": F.coalesce("banked", F.lit(0)), "carried_on": F.coalesce("carried_on", F.lit(0))}), number)

    def _decided(self, found: DataFrame, number: int) -> DataFrame:
        done, pending = F.col("completed").isNotNull(), F.col("pending").isNotNull()
        no_request = F.col("pending.skip").isNull() & F.col("pending.language").isNull()
        same = no_request | ((F.col("pending.skip") == F.col("skip")) & F.col("pending.language").eqNullSafe(F.col("language")))
        reason = F.when(F.col("fresh") & F.col("reuse"), "fresh and reuse").when(F.col("reuse") & (F.col("banked") == 0), "nothing to reuse").when(F.col("reuse") & ~done, "no run has completed")
        go_on = pending & ~F.col("fresh") & F.coalesce(same, F.lit(False))
        beside = (F.col("banked") > 0) & (done | F.col("fresh"))
        first = lambda refused, reuse, on, new, begin, rest: F.when(reason.isNotNull(), refused).when(F.col("reuse"), reuse).when(go_on, on).when(beside, new).when(F.col("banked") == 0, begin).otherwise(rest)
        null = F.lit(None)
        action = first("refused", "reuse", F.when(F.col("carried_on") > 0, "resume").otherwise("read-fresh"), F.lit("read-fresh"), F.lit("read-fresh"), F.lit("resume"))
        out = found.select(
            "book", "skip", "language", "model", reason.alias("reason"), action.alias("action"),
            first(null, null, F.lit("pending"), F.lit("pending"), F.lit("bank"), F.lit("bank")).alias("target"),
            first(null, F.col("bank"), F.col("held"), F.lit(number), F.coalesce(F.col("bank"), F.lit(number)), F.col("bank")).cast("long").alias("version"),
            first(F.lit(0), F.col("banked"), F.col("carried_on"), F.lit(0), F.lit(0), F.col("banked")).cast("long").alias("carried"),
            first(null, null, F.lit("pend"), F.lit("pend"), F.lit("open"), F.when(pending, F.lit("discard"))).alias("event"),
        )
        self.put(out, number)
        return self.log().where(F.col("n") == number).select("book", "action", "target", "version", "carried", "reason")

    def missing(self, opened: DataFrame, pages: DataFrame) -> DataFrame:
        """pages (book, page) that a run still has to read: not carried by the version it has opened, and not to be skipped."""
        asked = self.log().where("target is not null").select("book", "version", "n", "skip")
        skip = asked.groupBy("book", "version").agg(F.max_by("skip", "n").alias("skip"))
        want = pages.select(F.col("book").cast("string").alias("book"), F.col("page").cast("int").alias("page")).distinct().join(opened.where("target is not null").select("book", "version"), "book").join(skip, ["book", "version"])
        return want.where(~F.array_contains("skip", F.col("page"))).join(self.answers().select("book", "version", "page"), ["book", "version", "page"], "left_anti").select("book", "page")

    def finish_steps(self, opened: DataFrame, completed_at: str) -> list[Callable[[], int]]:
        """The steps by which what a run wrote becomes the bank, in their order: the marks of banks to be replaced go, what was
        pending takes their place, and all are marked as completed. After the first the bank is the old one, unmarked, beside a
        whole pending version; after the second it is the new one, unmarked: either is gone on with by the next run. A pending
        version that is not there any more is an error, before anything is changed."""
        wrote = opened.where("target is not null").select("book", "target", "version")

        def held() -> DataFrame:
            both = wrote.where("target = 'pending'").join(self.state().select("book", "pending", "bank"), "book", "left")
            same = F.coalesce(F.col("pending.version") == F.col("version"), F.lit(False))
            return both.where(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("nothing is pending for "), "book")).cast("boolean")))

        def marks() -> DataFrame:
            sizes = self.answers().groupBy("book", "version").agg(F.count(F.lit(1)).alias("pages"))
            return wrote.join(sizes, ["book", "version"], "left").select("book", F.lit("mark").alias("event"), F.lit(completed_at).alias("completed_at"), F.coalesce("pages", F.lit(0)).alias("pages"))

        return [
            lambda: self.put(held().select("book", F.lit("unmark").alias("event"))),
            lambda: self.put(held().select("book", F.lit("promote").alias("event"), "version")),
            lambda: self.put(marks()),
        ]

    def finish(self, opened: DataFrame, completed_at: str) -> None:
        for step in self.finish_steps(opened, completed_at):
            step()
