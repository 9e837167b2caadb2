"""Running values over long orders without one task for a whole group.

A group's rows are cut into blocks of STEP order values. Each block is summed up first; a window over the few block rows
gives what a block inherits, and a window within a block does the rest. The order value must be a whole number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 65_536


def _block(order: str, step: int) -> Column:
    return F.floor(F.col(order) / step)


def running(rows: DataFrame, keys: list[str], order: str, value: str, fold: Callable, name: str, before: bool = False, step: int = STEP) -> DataFrame:
    """rows with ``name``: fold (F.sum, F.max or F.min) of value over the group's rows up to this one in order, or, with
    before, up to the one before (null for the first). Equal order values come one after the other in any order."""
    blocked = rows.withColumn("__block", _block(order, step))
    sums = blocked.groupBy(*keys, "__block").agg(fold(value).alias("__own"))
    far = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__b"), fold("__own").over(far).alias("__far"))
    near = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    same = (blocked["__block"] == F.col("__b")) & _all([blocked[k].eqNullSafe(F.col(f"__{k}")) for k in keys])
    both = blocked.withColumn("__near", fold(value).over(near)).join(carried, same, "left")
    if fold is F.sum:
        total = F.when(F.col("__far").isNull() & F.col("__near").isNull(), None).otherwise(F.coalesce("__far", F.lit(0)) + F.coalesce("__near", F.lit(0)))
    else:
        total = (F.greatest if fold is F.max else F.least)("__far", "__near")
    return both.select(*rows.columns, total.alias(name))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def previous(rows: DataFrame, keys: list[str], orders: list[str], value: str, name: str, step: int = STEP) -> DataFrame:
    """rows with ``name``: value of the row before in the group. The first order is cut into blocks; a block's first row
    takes the last value of the block before."""
    blocked = rows.withColumn("__block", _block(orders[0], step))
    lasts = blocked.groupBy(*keys, "__block").agg(F.max_by(value, F.struct(*orders)).alias("__last"))
    far = Window.partitionBy(*keys).orderBy("__block")
    carried = lasts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__b"), F.lag("__last").over(far).alias("__far"))
    near = Window.partitionBy(*keys, "__block").orderBy(*orders)
    same = (blocked["__block"] == F.col("__b")) & _all([blocked[k].eqNullSafe(F.col(f"__{k}")) for k in keys])
    both = blocked.withColumn("__first", F.row_number().over(near) == 1).withColumn("__near", F.lag(value).over(near)).join(carried, same, "left")
    return both.select(*rows.columns, F.when(F.col("__first"), F.col("__far")).otherwise(F.col("__near")).alias(name))


def following(rows: DataFrame, keys: list[str], order: str, value: str, name: str, step: int = STEP) -> DataFrame:
    """rows with ``name``: the first value that is not null on a row of the group with a greater order value; of several with
    the same order value, the least. Rows with equal order values see the same."""
    blocked = rows.withColumn("__block", _block(order, step))
    held = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("value")))
    firsts = blocked.groupBy(*keys, "__block").agg(F.min(held).alias("__own"))
    far = Window.partitionBy(*keys).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__b"), F.min("__own").over(far).alias("__far"))
    near = Window.partitionBy(*keys, "__block").orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, -1)
    same = (blocked["__block"] == F.col("__b")) & _all([blocked[k].eqNullSafe(F.col(f"__{k}")) for k in keys])
    both = blocked.withColumn("__near", F.min(held).over(near)).join(carried, same, "left")
    return both.select(*rows.columns, F.coalesce("__near", "__far")["value"].alias(name))
