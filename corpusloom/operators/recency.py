"""First rows of groups and of all, by time or place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group. Spark drops rows beyond the n-th before the shuffle (window group limit)."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def last_wins(log: DataFrame, key: str, position: str) -> DataFrame:
    """Of an append-only log, the last row of each key: an aggregation, combined on the map side."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max(F.struct(position, *[c for c in rest if c != position])).alias("_s")).select(key, *[F.col("_s")[c].alias(c) for c in rest])


def most_recent(df: DataFrame, time: str, tie: str, n: int) -> DataFrame:
    """The ``n`` rows with the greatest time text (null as empty), ties by ``tie``: a top-k, not a sort."""
    return df.orderBy(F.coalesce(F.col(time), F.lit("")).desc(), F.asc(tie)).limit(n)


def native_by_account(df: DataFrame, account: str, time: str, tie: str, per_account: int, overall: int) -> DataFrame:
    """At least ``per_account`` most recent rows of every account, then the most recent of all others up to ``overall``."""
    when = F.coalesce(F.col(time), F.lit(""))
    named = df.withColumn(account, F.coalesce(account, F.lit("")))
    floor = first_per_group(named, [account], [when.desc(), F.asc(tie)], per_account)
    missing = max(0, overall - floor.count())
    rest = named.join(floor.select(tie), tie, "left_anti")
    return floor.unionByName(most_recent(rest, time, tie, missing)) if missing else floor


def enough_native(df: DataFrame, account: str, kind: str, size: str, quota: int, cap: int) -> DataFrame:
    """account, enough: whether it has three times the quota of each native kind and bytes up to the cap."""
    kinds = [F.count_if(F.col(kind) == k) >= 3 * quota for k in ("gsheets", "gdocs", "gslides")]
    return df.groupBy(account).agg((kinds[0] & kinds[1] & kinds[2] & (F.coalesce(F.sum(F.when(F.col(kind) == "binary", F.col(size))), F.lit(0)) >= cap)).alias("enough"))
