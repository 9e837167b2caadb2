"""Ledger trees: ancestry and closure by pointer doubling or recursion, boundaries, current standard, merged metadata.

steps (project, id, parent, action, created). Closures are over one project's few steps each; projects run in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut


def ancestry(steps: DataFrame) -> DataFrame:
    """project, id, ancestor, depth: every step with itself (depth 0) and each step above it.

    Pointer doubling: pairs of distance up to d are joined with themselves to reach 2d, so a chain of n takes log2(n)
    joins. The loop ends when no new pair comes; a step that is its own ancestor is refused.
    """
    pairs = steps.where("parent is not null").select("project", "id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    reach = hop = cut(pairs)
    while True:
        if not reach.where("id = ancestor").isEmpty():
            raise ValueError("a step is its own ancestor")
        up = hop.select("project", F.col("id").alias("ancestor"), F.col("ancestor").alias("far"), F.col("depth").alias("more"))
        on = lambda df: df.join(up, ["project", "ancestor"]).select("project", "id", F.col("far").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        reach, hop = cut(reach.unionByName(on(reach))), cut(on(hop))
        if hop.isEmpty():
            break
    return steps.select("project", "id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")).unionByName(reach).distinct()


def position(steps: DataFrame, pointers: DataFrame) -> DataFrame:
    """project, at: the pointer's step if it exists, else the newest (of equals the later one)."""
    newest = steps.groupBy("project").agg(F.max_by("id", F.struct("created", "id")).alias("newest"))
    real = pointers.join(steps.select("project", F.col("id").alias("pointer")), ["project", "pointer"], "left_semi")
    return newest.join(real, "project", "left").select("project", F.coalesce("pointer", "newest").alias("at"))


def nearest_upward(steps: DataFrame, closure: DataFrame, action: str, boundary: str | None = None) -> DataFrame:
    """For each step the closest step at or above it with this action, unless a boundary action lies nearer."""
    named = closure.join(steps.select("project", F.col("id").alias("ancestor"), "action"), ["project", "ancestor"])
    hit = F.when(F.col("action") == action, F.col("depth"))
    stop = F.when(F.col("action") == boundary, F.col("depth")) if boundary else F.lit(None).cast("int")
    best = named.groupBy("project", "id").agg(F.min_by("ancestor", hit).alias("found"), F.min(hit).alias("d"), F.min(stop).alias("b"))
    return best.select("project", "id", F.when(F.col("b").isNull() | (F.col("d") <= F.col("b")), F.col("found")).alias("found"))


def current_standard(steps: DataFrame, closure: DataFrame, at: DataFrame) -> DataFrame:
    """project, action, id: the nearest step of each action on the way from the position up that is not ``stale``."""
    path = closure.join(at.select("project", F.col("at").alias("id")), ["project", "id"], "left_semi").select("project", F.col("ancestor").alias("id"), "depth")
    fresh = steps.where(~F.coalesce("stale", F.lit(False))).select("project", "id", "action")
    return path.join(fresh, ["project", "id"]).groupBy("project", "action").agg(F.min_by("id", "depth").alias("id"))


def stale_after(closure: DataFrame, landed: DataFrame) -> DataFrame:
    """project, id of the descendants of the landed steps; the landed steps themselves are fresh."""
    return closure.where("depth > 0").join(landed.select("project", F.col("id").alias("ancestor")), ["project", "ancestor"], "left_semi").select("project", "id").distinct()


def without_subtree(steps: DataFrame, closure: DataFrame, gone: DataFrame) -> DataFrame:
    """Steps that stay when the subtrees of ``gone`` are deleted; an origin is refused and stays with all below it."""
    deep = gone.join(steps.where("parent is not null").select("project", "id"), ["project", "id"], "left_semi")
    below = closure.join(deep.select("project", F.col("id").alias("ancestor")), ["project", "ancestor"], "left_semi").select("project", "id")
    return steps.join(below, ["project", "id"], "left_anti")


def merged_fields(rows: DataFrame, keys: list[str], fields: list[str], seq: str) -> DataFrame:
    """The newest value that is not blank of each field."""
    return rows.groupBy(*keys).agg(*[F.max_by(f, F.when(F.trim(F.col(f).cast("string")) != "", F.col(seq))).alias(f) for f in fields])


def chronological(steps: DataFrame) -> DataFrame:
    """Steps in order of creation, with a mark where the parent is not the row above."""
    w = Window.partitionBy("project").orderBy("created", "id")
    return steps.withColumn("row", F.row_number().over(w)).withColumn("jumps", ~F.col("parent").eqNullSafe(F.lag("id").over(w)))


def origins(steps: DataFrame) -> DataFrame:
    """project, id: the first step without a parent."""
    return steps.where("parent is null").groupBy("project").agg(F.min_by("id", F.struct("created", "id")).alias("id"))


def children(steps: DataFrame) -> DataFrame:
    """project, parent, id, nth: direct children in the order of creation."""
    nth = F.row_number().over(Window.partitionBy("project", "parent").orderBy("created", "id"))
    return steps.where("parent is not null").select("project", "parent", "id", nth.alias("nth"))


def appended(steps: DataFrame, new: DataFrame) -> DataFrame:
    """new steps (at most one a project) with why they are refused, or the time they are kept with.

    A step needs an id of its own and a parent that is there; only the first step of a project has none. Times never fall."""
    last = steps.groupBy("project").agg(F.max("created").alias("__last"))
    taken = steps.select("project", "id", F.lit(True).alias("__taken"))
    parents = steps.select("project", F.col("id").alias("parent"), F.lit(True).alias("__parent"))
    both = new.join(last, "project", "left").join(taken, ["project", "id"], "left").join(parents, ["project", "parent"], "left")
    refused = F.when(F.col("__taken"), "same id").when(F.col("parent").isNull() & F.col("__last").isNotNull(), "second origin").when(F.col("parent").isNotNull() & F.col("__parent").isNull(), "no such parent")
    return both.select("project", "id", "parent", "action", F.greatest("created", "__last").alias("created"), refused.alias("refused"))


def landings(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """runs (project, id, parent, action, params, payload) with the step that each replaces, if any, and its old payload if
    no step names it any more. A run replaces the first step of its action, parent and asked parameters that is not
    irreplaceable. steps: project, id, parent, action, params (as text, without what runs mint), payload, retention, created."""
    same = steps.where("retention is null or retention <> 'irreplaceable'").groupBy("project", F.coalesce(F.col("parent"), F.lit(-1)).alias("__p"), "action", F.coalesce("params", F.lit("")).alias("__a")).agg(F.min_by(F.struct("id", "payload"), F.struct("created", "id")).alias("target"))
    asked = runs.withColumn("__p", F.coalesce(F.col("parent"), F.lit(-1))).withColumn("__a", F.coalesce("params", F.lit("")))
    hit = asked.join(same, ["project", "__p", "action", "__a"], "left").select("project", "id", F.col("target.id").alias("replaces"), "payload", F.col("target.payload").alias("old"))
    uses = steps.groupBy("project", F.col("payload").alias("old")).agg(F.count(F.lit(1)).alias("__uses"))
    both = hit.join(uses, ["project", "old"], "left")
    displaced = F.when((F.col("old") != F.col("payload")) & (F.col("__uses") <= 1), F.col("old"))
    return both.select("project", "id", "replaces", displaced.alias("displaced"))


def landed(steps: DataFrame, runs: DataFrame, closure: DataFrame) -> DataFrame:
    """steps (with ``stale``) after the runs: replaced steps have the run's payload and are fresh, all below them are stale,
    other runs are steps of their own."""
    hits = landings(steps, runs)
    swaps = hits.where("replaces is not null").join(runs.select("project", "id", "payload"), ["project", "id"]).groupBy("project", F.col("replaces").alias("id")).agg(F.max_by("payload", "id").alias("__payload"))
    below = stale_after(closure, swaps).withColumn("__below", F.lit(True))
    old = steps.join(swaps, ["project", "id"], "left").join(below, ["project", "id"], "left")
    old = old.withColumn("stale", F.when(F.col("__below"), True).when(F.col("__payload").isNotNull(), False).otherwise(F.col("stale"))).withColumn("payload", F.coalesce("__payload", "payload")).drop("__payload", "__below")
    new = runs.join(hits.where("replaces is null").select("project", "id"), ["project", "id"], "left_semi")
    return old.unionByName(new.select("project", "id", "parent", "action", "params", "payload", "retention", "created", F.lit(False).alias("stale")))


def orphaned_payloads(steps: DataFrame, left: DataFrame) -> DataFrame:
    """project, payload of removed steps that no step which is left names."""
    gone = steps.join(left.select("project", "id"), ["project", "id"], "left_anti").select("project", "payload").where("payload is not null").distinct()
    return gone.join(left.select("project", "payload"), ["project", "payload"], "left_anti")


def in_effect(steps: DataFrame, closure: DataFrame, at: DataFrame, actions: list[str], bounds: list[str]) -> DataFrame:
    """project, id, nth: steps of these actions on the way up from the position to the first bound, oldest first."""
    path = closure.join(at.select("project", F.col("at").alias("id")), ["project", "id"], "left_semi").select("project", F.col("ancestor").alias("id"), "depth").join(steps.select("project", "id", "action"), ["project", "id"])
    bound = path.groupBy("project").agg(F.min(F.when(F.col("action").isin(*bounds) & ~F.col("action").isin(*actions), F.col("depth"))).alias("bound"))
    live = path.join(bound, "project").where(F.col("action").isin(*actions) & (F.col("bound").isNull() | (F.col("depth") < F.col("bound"))))
    return live.select("project", "id", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("depth"))).alias("nth"))


def metadata_steps(steps: DataFrame, closure: DataFrame, at: DataFrame, action: str = "metadata") -> DataFrame:
    """project, id of the metadata steps whose parent is on the way up from the position."""
    path = closure.join(at.select("project", F.col("at").alias("id")), ["project", "id"], "left_semi").select("project", F.col("ancestor").alias("parent"))
    return steps.where(F.col("action") == action).join(path, ["project", "parent"], "left_semi").select("project", "id")


def moved_pointers(pointers: DataFrame, removed: DataFrame, gone: DataFrame, steps: DataFrame) -> DataFrame:
    """project, pointer after a deletion: a pointer to a removed step goes to the parent of the deleted subtree's root (gone)."""
    parents = gone.join(steps.select("project", "id", "parent"), ["project", "id"]).groupBy("project").agg(F.min("parent").alias("__up"))
    hit = removed.select("project", F.col("id").alias("pointer"), F.lit(True).alias("__hit"))
    both = pointers.join(hit, ["project", "pointer"], "left").join(parents, "project", "left")
    return both.select("project", F.when(F.col("__hit"), F.col("__up")).otherwise(F.col("pointer")).alias("pointer"))
