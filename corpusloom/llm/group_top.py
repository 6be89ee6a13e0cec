"""Problem 6: the N first rows of every group, by simultaneous bisection of per-group cutoffs.

Rows are ordered by a code made of integer components (a score, its tie breakers, an identifier cut into slices), compared
from the first component on. All groups are bisected at once: a pass counts, for each group, the rows above ``2**LEVELS - 1``
midpoints of the group's current interval (that many bisection steps in one aggregation, combined on the map side), moves the
group's cutoff to the interval that holds the N-th row, and keeps only the rows inside it for the next pass. A group is done
as soon as the rows above its cutoff are exactly N. No group is ever sorted or collected: a hot group adds at most
``2**LEVELS`` counts for each map task, and its rows are spread by salt when they meet their cutoff.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.io import materialize
from corpusloom.operators.skew import heavy_keys, salted_join

#: Bisection steps taken in one pass.
LEVELS = 8
#: Codes stay within these bounds, so that differences fit 64 bits; greater scores are two components.
CODE_MAX = 2**62 - 1
#: Bytes of an identifier in one component.
SLICE = 7


def instant_micros(text: Column) -> Column:
    """Microseconds of an RFC 3339 instant in any spelling; without an offset it is UTC; null if unreadable."""
    t = F.upper(F.trim(text))
    zoned = F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(zoned))


def _descending(value: Column) -> Column:
    v = value.cast("long")
    return F.when(v.isNull(), F.lit(-CODE_MAX)).otherwise(F.greatest(F.least(v, F.lit(CODE_MAX)), F.lit(1 - CODE_MAX)))


def _halves(value: Column) -> list[Column]:
    """The upper and lower 32 bits, for scores beyond CODE_MAX."""
    v = value.cast("long")
    return [F.when(v.isNull(), F.lit(-(2**32))).otherwise(F.shiftright(v, 32)), F.coalesce(v.bitwiseAND(F.lit(2**32 - 1)), F.lit(0))]


def _ascending_slice(text: Column, k: int) -> Column:
    part = F.substring(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 1 + SLICE * k, SLICE)
    return -F.conv(F.rpad(F.hex(part), 2 * SLICE, "0"), 16, 10).cast("long")


def top_per_group(df: DataFrame, group: str, descending: Sequence[str], identifier: str, n: int) -> DataFrame:
    """The ``n`` first rows of each ``group`` by the integer columns ``descending`` (nulls last), then ``identifier`` ascending.

    Returns the columns group, descending, identifier; other columns of ``df`` are left out, whatever their names. Rows with a
    null group have none and are left out. A null identifier counts as an empty one. Rows equal in all these columns are
    interchangeable and each counts. An empty input gives an empty result; n below 1 gives none.
    """
    columns = [group, *descending, identifier]
    rows = df.select(*columns).filter(F.col(group).isNotNull())
    if n < 1:
        return rows.limit(0)
    rows = materialize(rows, "rows")
    ranges = rows.agg(F.max(F.octet_length(identifier)), *[f(F.col(c).cast("long")) for c in descending for f in (F.min, F.max)]).first()
    slices = -(-(ranges[0] or 0) // SLICE)
    wide = [max(abs(ranges[1 + 2 * i] or 0), abs(ranges[2 + 2 * i] or 0)) >= CODE_MAX for i in range(len(descending))]
    codes = [code for c, w in zip(descending, wide) for code in (_halves(F.col(c)) if w else [_descending(F.col(c))])] + [_ascending_slice(F.col(identifier), k) for k in range(slices)] + [-F.length(F.coalesce(F.col(identifier), F.lit("")))]

    def code(at: Column) -> Column:
        """The component number ``at``; a CASE, so that only the component in use is computed."""
        return reduce(lambda c, k: c.when(at == k, codes[k]), range(1, len(codes)), F.when(at == 0, codes[0])).otherwise(F.lit(0)).cast("long")

    first = rows.withColumn("_c", codes[0].cast("long"))
    stats = materialize(first.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi")), "groups")
    total = stats.agg(F.sum("_n")).first()[0] or 0
    heavy = materialize(heavy_keys(stats, [group], "_n", total), "heavy")
    joined = salted_join(rows, stats, [group], heavy, F.col(identifier))
    state = materialize(joined.withColumn("_in", F.col("_n") <= n).withColumn("_need", F.lit(n).cast("long")).withColumn("_at", F.lit(0)).drop("_n"), "pass")
    parts = [state.filter("_in").select(*columns)]
    bins = 2**LEVELS
    while True:
        open_ = state.filter(~F.col("_in"))
        if open_.isEmpty():
            return reduce(DataFrame.unionAll, parts)
        width = (F.col("_hi") - F.col("_lo") + 1).cast("double")
        binned = open_.withColumn("_c", code(F.col("_at"))).withColumn("_bin", F.least(F.lit(bins - 1), F.floor((F.col("_c") - F.col("_lo")).cast("double") * bins / width)).cast("int"))
        after = code(F.col("_at") + 1)
        counts = binned.groupBy(group, "_bin").agg(
            F.count(F.lit(1)).alias("_m"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi"), F.min(after).alias("_lo2"), F.max(after).alias("_hi2"), F.min("_need").alias("_need"), F.min("_at").alias("_at")
        )
        above = Window.partitionBy(group).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
        tied = F.col("_lo") == F.col("_hi")
        cuts = (
            counts.withColumn("_above", F.coalesce(F.sum("_m").over(above), F.lit(0)))
            .filter((F.col("_above") < F.col("_need")) & (F.col("_above") + F.col("_m") >= F.col("_need")))
            .select(
                group, F.col("_bin").alias("_cut"), F.col("_m"), (F.col("_need") - F.col("_above")).alias("_need"), (F.col("_at") + tied.cast("int")).alias("_at"),
                F.when(tied, F.col("_lo2")).otherwise(F.col("_lo")).alias("_lo"), F.when(tied, F.col("_hi2")).otherwise(F.col("_hi")).alias("_hi"),
            )
        )
        cuts = materialize(cuts, "cuts")
        met = salted_join(binned.select(*columns, "_bin"), cuts, [group], heavy, F.col(identifier)).filter(F.col("_bin") >= F.col("_cut"))
        inside = (F.col("_bin") > F.col("_cut")) | (F.col("_m") == F.col("_need"))
        state = materialize(met.withColumn("_in", inside).drop("_bin", "_cut", "_m"), "pass")
        equal = ~F.col("_in") & (F.col("_at") >= len(codes))
        copies = state.filter(equal).dropDuplicates([group]).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_need"))))
        parts += [state.filter("_in").select(*columns), copies.select(*columns)]
        state = state.filter(~equal)


def latest_files(scan_rows: DataFrame) -> DataFrame:
    """One row per listed file: its state with the latest ``modified_time``; of equal times the greatest state. Rows without an id are no files.

    An aggregation, combined on the map side, so that a file listed very often needs no sort of its own.
    """
    state = F.struct(
        instant_micros(F.col("modified_time")).alias("modified"), F.col("size_bytes"), F.coalesce(F.col("is_folder"), F.lit(False)).alias("is_folder"),
        F.coalesce(F.col("is_shortcut"), F.lit(False)).alias("is_shortcut"), F.lower(F.trim("owner_email")).alias("owner_email"),
    )
    return scan_rows.filter(F.col("drive_file_id").isNotNull()).groupBy("drive_file_id").agg(F.max(state).alias("s")).select("drive_file_id", "s.*")


def top_files(scan_rows: DataFrame, n: int = 3) -> DataFrame:
    """owner_email, size_bytes, modified, drive_file_id, rank: the ``n`` largest files of each owner."""
    files = latest_files(scan_rows).filter(~F.col("is_folder") & ~F.col("is_shortcut") & F.col("size_bytes").isNotNull() & (F.col("owner_email") != ""))
    top = top_per_group(files, "owner_email", ["size_bytes", "modified"], "drive_file_id", n)
    order = Window.partitionBy("owner_email").orderBy(F.desc("size_bytes"), F.desc_nulls_last("modified"), "drive_file_id")
    return top.withColumn("rank", F.row_number().over(order))
