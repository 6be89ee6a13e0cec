"""Selection under a byte budget.

A budgeted fill takes items in order, each if it still fits; what doesn't fit is passed over and smaller later ones may still
fit. That depends on the order, so a running sum alone isn't the answer. It is made parallel like this: the items are put in
order and cut into stored ranges. As long as whole ranges fit, they are taken by their sums; a range in which something doesn't
fit is folded by one task; ranges without an item as small as the rest of the budget are passed over. Only the ranges' sums
and least sizes reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.io import materialize
from corpusloom.operators.skew import heavy_keys, salted_join

#: Rows in one range, about: what one task folds.
RANGE_ROWS = 500_000


def in_ranges(df: DataFrame, order: Sequence[Column], rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` stored in ranges of the order, with ``_range`` and ``_at`` (the place within it). The order must be total."""
    n = df.count()
    parts = max(1, -(-n // rows))
    ranged = (df.repartitionByRange(parts, *order) if parts > 1 else df.coalesce(1)).withColumn("_range", F.spark_partition_id())
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return materialize(placed, "ranges")


def global_index(df: DataFrame, order: Sequence[Column], name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with the place (from 0) of each row in a total order of all rows: exact, without one task that sees them all."""
    placed = in_ranges(df, order, rows)
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row for each range of ``rows`` rows
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(before, "_range").withColumn(name, (F.col("_before") + F.col("_at") - 1).cast("long")).drop("_range", "_at", "_before")


def place_in_groups(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """The place (from 0) of each row in its group, from its place among all: a hot group is spread over many ranges."""
    indexed = materialize(global_index(df, [*[F.asc(g) for g in group], *order], "_index", rows), "indexed")
    first = materialize(indexed.groupBy(*group).agg(F.min("_index").alias("_first"), F.count(F.lit(1)).alias("_n")), "groups")
    heavy = heavy_keys(first, group, "_n", first.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    return salted_join(indexed, first.drop("_n"), group, heavy, F.col("_index")).withColumn(name, F.col("_index") - F.col("_first")).drop("_index", "_first")


def fill(df: DataFrame, size: str, cap: int, order: Sequence[Column], used: int = 0, most: int | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of ``df`` that a fill in ``order`` takes: each if ``used`` plus its size stays within ``cap``, at most ``most`` rows.

    Sizes that are null or not positive take no room. ``order`` must be total, and starts after the rows already ``used``.
    """
    placed = in_ranges(df.withColumn("_size", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))), order, rows)
    ranges = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("sum"), F.min("_size").alias("least")).orderBy("_range").collect()
    left, room, whole, some = cap - used, most if most is not None else sum(r["n"] for r in ranges), [], []
    for r in ranges:
        if r["sum"] <= left and r["n"] <= room:
            whole.append(r["_range"])
            left, room = left - r["sum"], room - r["n"]
        elif r["least"] <= left and room > 0:
            fold = _folder(left, room)
            one = placed.filter(F.col("_range") == r["_range"]).select("_range", "_at", "_size")
            hits = materialize(one.groupBy("_range").applyInPandas(fold, "_range int, _at int"), "fold")
            spent = one.join(hits, ["_range", "_at"]).agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
            left, room = left - spent[0], room - spent[1]
            some.append(placed.join(hits, ["_range", "_at"], "left_semi"))
    parts = [placed.filter(F.col("_range").isin(whole)), *some]
    return reduce(DataFrame.unionByName, parts).drop("_range", "_at", "_size")


def _folder(left: int, room: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The fold of one range: the places of the rows taken with ``left`` bytes and ``room`` rows to go."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        taken, free = [], left
        for at, s in zip(pdf["_at"].tolist(), pdf["_size"].tolist()):
            if len(taken) < room and s <= free:
                taken.append(at)
                free -= s
        return pd.DataFrame({"_range": pdf["_range"].iloc[0], "_at": taken}, columns=["_range", "_at"])

    return fold


def greedy_fill(df: DataFrame, size: str, cap: int, tie: Sequence[str]) -> DataFrame:
    """Largest first; of equal sizes those first in ``tie``."""
    return fill(df, size, cap, [F.desc_nulls_last(size), *[F.asc(t) for t in tie]])


def as_is_fill(df: DataFrame, size: str, cap: int | None, identifier: str, order: Sequence[str], used: int = 0, done: DataFrame | None = None) -> DataFrame:
    """In the given order; of an identifier met again the first row counts. Ids in ``done`` take room but don't come out again."""
    first = Window.partitionBy(identifier).orderBy(*order)
    once = df.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")
    taken = once if cap is None else fill(once, size, cap, [F.asc(o) for o in order], used)
    return taken if done is None else taken.join(done.select(identifier), identifier, "left_anti")


def all_files(scan: DataFrame, default_owner: str = "") -> DataFrame:
    """Every listed file that is no folder, shortcut or row without an id, natives without a size included; blank owners get the default."""
    kept = scan.filter(~F.coalesce("is_folder", F.lit(False)) & ~F.coalesce("is_shortcut", F.lit(False)) & (F.coalesce("drive_file_id", F.lit("")) != ""))
    owner = F.when(F.coalesce("owner_email", F.lit("")) == "", default_owner).otherwise(F.col("owner_email"))
    size = F.coalesce(F.col("size_bytes").cast("string").try_cast("bigint"), F.lit(0))
    return kept.select("drive_file_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("path", F.lit("")).alias("path"), owner.alias("owner_email"), size.alias("size_bytes"), F.coalesce("modified_time", F.lit("")).alias("modified_time"))


def first_threads(threads: DataFrame, most: int, cap: int, order: Sequence[str], size: str = "size_bytes") -> DataFrame:
    return fill(threads, size, cap, [F.asc(o) for o in order], most=most)


def _named(df: DataFrame, account: str, size: str) -> DataFrame:
    """Rows without an account belong to the one without a name, rows without a size take no room."""
    return df.withColumns({account: F.coalesce(account, F.lit("")), size: F.coalesce(F.col(size), F.lit(0))})


def _accounts(df: DataFrame, account: str, size: str) -> DataFrame:
    """account, priority (0 has the most bytes), n."""
    totals = df.groupBy(account).agg(F.sum(size).alias("_total"), F.count(F.lit(1)).alias("_n"))
    return global_index(totals, [F.desc("_total"), F.asc(account)], "priority")


def equal_split(df: DataFrame, account: str, size: str, cap: int, tie: Sequence[str], rows: int = RANGE_ROWS) -> DataFrame:
    """An equal share for each account, filled largest first, then what is left of the budget from all the rest.

    The rows of an account meet in one task, in order, and stream through a fold whose state is the account and what is left of
    its share; an account of more than ``rows`` rows is filled by ranges instead.
    """
    df = _named(df, account, size)
    counts = materialize(df.groupBy(account).agg(F.count(F.lit(1)).alias("_n")), "accounts")
    n = counts.count()
    if not n:
        return df.limit(0)
    share, schema, columns = cap // n, df.schema, df.columns

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, free = object(), 0
        for batch in it:
            keep = []
            for a, s in zip(batch.column(columns.index(account)).to_pylist(), batch.column(columns.index(size)).to_pylist()):
                if a != current:
                    current, free = a, share
                keep.append(s <= free)
                free -= s if keep[-1] else 0
            yield batch.filter(pa.array(keep, pa.bool_()))

    large = [r[account] for r in counts.filter(F.col("_n") > rows).select(account).collect()]  # at most all rows / rows
    small = df.filter(~F.col(account).isin(large)) if large else df
    taken = small.repartition(account).sortWithinPartitions(F.asc(account), F.desc(size), *[F.asc(t) for t in tie]).mapInArrow(fold, schema)
    for a in large:
        taken = taken.unionByName(greedy_fill(df.filter(F.col(account) == a), size, share, tie))
    taken = materialize(taken, "shares")
    spent = taken.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    rest = df.join(taken.select(account, *tie), [account, *tie], "left_anti")
    return taken.unionByName(greedy_fill(rest, size, cap - spent, [account, *tie])) if spent < cap else taken


def _until_full(turns: DataFrame, order: Sequence[Column], left: int, rows: int) -> tuple[DataFrame, object]:
    """``turns`` in ranges with ``_running`` sums, and the first row that goes beyond ``left``, if any."""
    placed = in_ranges(turns, order, rows)
    sums = placed.groupBy("_range").agg(F.sum("_size").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    running = F.col("_before") + F.sum("_size").over(Window.partitionBy("_range").orderBy("_at"))
    summed = materialize(placed.join(before.select("_range", "_before"), "_range").withColumn("_running", running), "turns")
    first = F.min(F.struct("_range", "_at", "priority", (F.col("_running") - F.col("_size")).alias("spent"))).alias("b")
    return summed, summed.filter(F.col("_running") > left).agg(first).first()["b"]


def _ahead(broken) -> Column:
    return (F.col("_range") < broken["_range"]) | ((F.col("_range") == broken["_range"]) & (F.col("_at") < broken["_at"]))


def _open(df: DataFrame, account: str, size: str, priority: DataFrame) -> DataFrame:
    return df.join(priority.select(account, "priority"), account).withColumn("_size", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)))


def round_robin(df: DataFrame, account: str, size: str, cap: int, order: Sequence[Column], priority: DataFrame, used: int = 0, rows: int = RANGE_ROWS) -> DataFrame:
    """In turns, each account in order of ``priority`` gives its next row that still fits, until nothing does.

    ``priority``: account, priority. ``order``: of the rows of one account, total. As long as every row met fits, the turns
    are a fixed order: rank in the account, then priority. At the first that doesn't, all rows that don't fit any more are
    dropped and the turns go on, at that account, with new ranks. Once few rows remain, one task finishes.
    """
    columns = df.columns
    open_ = materialize(_open(df, account, size, priority), "open")
    left, start, parts = cap - used, 0, []
    while True:
        fits = open_.filter(F.col("_size") <= left)
        n = fits.count()
        if not n or left <= 0:
            break
        later = (F.col("priority") < start).cast("int") + 1
        if n <= rows:
            turns = fits.withColumn("_turn", F.row_number().over(Window.partitionBy(account).orderBy(*order)) - 1 + later)
            parts.append(_finish(turns, left).select(*columns))
            break
        turns = place_in_groups(fits, [account], order, "_place", rows).withColumn("_turn", F.col("_place") + later).drop("_place")
        summed, broken = _until_full(turns, [F.asc("_turn"), F.asc("priority")], left, rows)
        if broken is None:
            parts.append(summed.select(*columns))
            break
        parts.append(summed.filter(_ahead(broken)).select(*columns))
        open_ = summed.filter(~_ahead(broken)).select(*columns, "priority", "_size")
        left, start = left - broken["spent"], broken["priority"]
    return reduce(DataFrame.unionByName, parts) if parts else df.limit(0)


def _finish(turns: DataFrame, left: int) -> DataFrame:
    """The turns of a bounded number of rows, in one task. ``_turn`` is a rank from which an account's queue follows."""
    wide = turns.withColumn("_one", F.lit(1))

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["priority", "_turn"]).reset_index(drop=True)
        queues = {p: list(zip(q.index.tolist(), q["_size"].tolist(), q["_turn"].tolist())) for p, q in pdf.groupby("priority")}
        at, free, keep = dict.fromkeys(queues, 0), left, []
        turn, live = 1, sorted(queues)
        while live and free > 0:
            still = []
            for p in live:
                q, i = queues[p], at[p]
                if q[0][2] > turn:  # its first turn is the second
                    still.append(p)
                    continue
                while i < len(q) and q[i][1] > free:
                    i += 1
                if i < len(q):
                    keep.append(q[i][0])
                    free -= q[i][1]
                    i += 1
                if i < len(q):
                    still.append(p)
                at[p] = i
            turn, live = turn + 1, still
        return pdf.loc[sorted(keep)]

    return wide.groupBy("_one").applyInPandas(take, wide.schema)


def _finish_first(fits: DataFrame, order: str, identifier: str, left: int, first: int, start: int, given: int) -> DataFrame:
    """The first phase over a bounded number of rows, in one task: up to ``first`` of each priority (of ``start``, ``given`` are taken)."""
    wide = fits.withColumn("_one", F.lit(1))

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["priority", order, identifier]).reset_index(drop=True)
        keep, free, taken = [], left, {start: given}
        for i, (p, s) in enumerate(zip(pdf["priority"].tolist(), pdf["_size"].tolist())):
            if free > 0 and taken.get(p, 0) < first and s <= free:
                keep.append(i)
                free -= s
                taken[p] = taken.get(p, 0) + 1
        return pdf.loc[keep]

    return wide.groupBy("_one").applyInPandas(take, wide.schema)


def binary_by_account(df: DataFrame, account: str, size: str, identifier: str, cap: int, rows: int = RANGE_ROWS) -> DataFrame:
    """First the smallest file of each account, if it is within an equal share and fits, then turns, largest files first."""
    df = _named(df, account, size)
    accounts = materialize(_accounts(df, account, size).select(account, "priority"), "accounts")
    n = accounts.count()
    if not n:
        return df.limit(0)
    # the last of an account by size descending and id is its smallest
    last = df.groupBy(account).agg(F.max_by(identifier, F.struct((-F.col(size)).alias("s"), F.col(identifier))).alias(identifier), F.min(size).alias("_least"))
    offered = last.filter(F.col("_least") <= cap // n).join(accounts, account)
    granted = materialize(fill(offered, "_least", cap, [F.asc("priority")], rows=rows), "granted")
    spent = granted.agg(F.coalesce(F.sum("_least"), F.lit(0))).first()[0]
    keys = granted.select(account, identifier)
    first = df.join(keys, [account, identifier], "left_semi")
    rest = df.join(keys, [account, identifier], "left_anti")
    return first.unionByName(round_robin(rest, account, size, cap, [F.desc(size), F.asc(identifier)], accounts, spent, rows))


def two_phase(df: DataFrame, folder: str, size: str, order: str, identifier: str, first: int, cap: int, rows: int = RANGE_ROWS) -> DataFrame:
    """Up to ``first`` files of each folder, folder by folder in order of name, then turns over the folders; files in walk order."""
    df = _named(df, folder, size)
    names = materialize(global_index(df.select(folder).distinct(), [F.asc(folder)], "priority"), "folders")
    columns, left, start, given, parts = df.columns, cap, 0, 0, []
    open_ = materialize(_open(df, folder, size, names), "open") if first > 0 else None
    while open_ is not None and left > 0:
        fits = open_.filter((F.col("_size") <= left) & (F.col("priority") >= start))
        if fits.count() <= rows:
            some = materialize(_finish_first(fits, order, identifier, left, first, start, given), "finish")
            parts.append(some.select(*columns))
            left -= some.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
            break
        placed = place_in_groups(fits, [folder], [F.asc(order), F.asc(identifier)], "_place", rows)
        turns = placed.withColumn("_turn", F.col("_place") + 1).drop("_place").filter(F.col("_turn") <= F.lit(first) - F.when(F.col("priority") == start, given).otherwise(0))
        summed, broken = _until_full(turns, [F.asc("priority"), F.asc("_turn")], left, rows)
        if broken is None:
            parts.append(summed.select(*columns))
            left -= summed.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
            break
        ahead = summed.filter(_ahead(broken))
        parts.append(ahead.select(*columns))
        here = ahead.filter(F.col("priority") == broken["priority"]).count()
        given = here + (given if broken["priority"] == start else 0)
        left, start = left - broken["spent"], broken["priority"]
        open_ = open_.join(ahead.select(folder, identifier), [folder, identifier], "left_anti")
    taken = materialize(reduce(DataFrame.unionByName, parts), "first") if parts else df.limit(0)
    rest = df.join(taken.select(folder, identifier), [folder, identifier], "left_anti")
    return taken.unionByName(round_robin(rest, folder, size, cap, [F.asc(order), F.asc(identifier)], names, cap - left, rows))
