"""Joins and ranks that hold when one key has a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.io import materialize

#: A key is heavy from one in so many rows on, so there are at most so many heavy keys: the bound of what is broadcast here.
HEAVY_ONE_IN = 1000


def heavy_keys(counts: DataFrame, keys: Sequence[str], count: str, total: int) -> DataFrame:
    """The keys of ``counts`` (one row per key) that hold at least ``total / HEAVY_ONE_IN`` rows: at most HEAVY_ONE_IN rows."""
    least = max(2, -(-total // HEAVY_ONE_IN))
    return counts.filter(F.col(count) >= least).select(*keys)


def salted_join(big: DataFrame, unique: DataFrame, keys: Sequence[str], heavy: DataFrame, spread: Column, how: str = "inner", salts: int = 64) -> DataFrame:
    """Join ``big`` with ``unique`` (at most one row per key) on ``keys``.

    Rows of ``big`` with a heavy key or a null in the keys are spread over ``salts`` tasks by ``spread``, a column that
    depends on the row only (so that a task run again puts it in the same place); of ``unique``, only the rows with a heavy
    key (at most HEAVY_ONE_IN) are repeated.
    """
    heavy = heavy.select(*keys).withColumn("_heavy", F.lit(True))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    left = big.join(F.broadcast(heavy), list(keys), "left").withColumn("_salt", F.when(F.col("_heavy") | null_key, salt).otherwise(F.lit(0))).drop("_heavy")
    right = (
        unique.join(F.broadcast(heavy), list(keys), "left")
        .withColumn("_salt", F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .drop("_heavy")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def rank_in_groups(df: DataFrame, keys: Sequence[str], order: str, tie: str, counts: DataFrame, count: str, total: int, rank: str = "rank", per_cell: int = 100_000) -> DataFrame:
    """``df`` with the rank (from 1) of each row in its group by (``order``, ``tie``), where ``order`` is a uniform 64-bit hash.

    ``counts`` has one row per group. A group of more than ``per_cell`` rows is cut into cells of equal ranges of the hash,
    ranked cell by cell and shifted by the sizes of the cells before: no task sorts a whole hot group, and the ranks are exact.
    Cells don't grow with the data: of more rows there are more cells, and what says where they begin is joined like any other
    stored table. Keys must not be null.
    """
    hot = counts.filter(F.col(count) > per_cell).select(*keys, F.ceil(F.col(count) / F.lit(float(per_cell))).cast("long").alias("_cells"))
    step = F.lit(float(2**64))
    cell = F.least(F.floor((F.col(order).cast("double") + F.lit(float(2**63))) / step * F.col("_cells")), F.col("_cells") - 1)
    hot = materialize(hot, "hot")
    celled = salted_join(df, hot, keys, heavy_keys(counts, keys, count, total), F.struct(order, tie), "left").withColumn("_cell", F.coalesce(cell, F.lit(0)).cast("long"))
    sizes = celled.filter(F.col("_cells").isNotNull()).groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sizes.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "cells")
    local = Window.partitionBy(*keys, "_cell").orderBy(order, tie)
    return (
        celled.withColumn("_rn", F.row_number().over(local))
        .join(offsets, [*keys, "_cell"], "left")
        .withColumn(rank, F.col("_rn") + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_rn", "_before", "_cell", "_cells")
    )
