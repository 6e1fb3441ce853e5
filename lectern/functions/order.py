"""Positions over all rows, or over all rows of a group, without one task that holds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.durable import durable

#: monotonically_increasing_id holds the partition above these bits and the place within it below.
_BITS = 33


def numbered(df: DataFrame, order: list[str | Column], column: str = "number", keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """`df` with a column 1, 2, 3, ... in this order, written once by `keep`.

    Rows are range-partitioned and sorted where they lie; a partition's rows count from
    the sum of the rows before it. What meets in one task is one number per partition.
    Rows that are equal in `order` are numbered in any order.
    """
    place = "_place_" + column
    placed = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()))
    part, within = F.shiftright(place, _BITS), F.col(place).bitwiseAND(F.lit((1 << _BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(within) + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(column, within + F.col("_start") + 1).select(*df.columns, column)


def numbered_within(df: DataFrame, groups: list[str], order: list[str | Column], column: str = "number", keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """As `numbered`, from 1 on in each group; a group of any size spreads over partitions. Groups that are null count as one."""
    every = numbered(df, [*groups, *order], column, keep)
    first = every.groupBy(*groups).agg(F.min(column).alias("_first")).select(*(F.col(g).alias(f"_of_{g}") for g in groups), "_first")
    same = None
    for g in groups:
        one = every[g].eqNullSafe(first[f"_of_{g}"])
        same = one if same is None else same & one
    return every.join(first, same).withColumn(column, F.col(column) - F.col("_first") + 1).select(*df.columns, column)
