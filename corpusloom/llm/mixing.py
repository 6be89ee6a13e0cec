"""Problem 8: a mix of sources with target shares of tokens, by subset-sum budget fitting.

The documents of a source are counted by exact token length. Its budget is first spent on whole repeats of all its documents,
then on a proportional part of each length, and what remains is fitted by a bounded-knapsack search over the counts that are
left. Documents are then chosen by a seeded hash, as many of each length as the fit says. Only counts by length reach the
fit, one task for each source; documents are shuffled as ids.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.io import materialize
from corpusloom.llm.tokens import VOCABULARY, with_token_count
from corpusloom.operators.skew import heavy_keys, rank_in_groups, salted_join

#: The knapsack search fits a rest up to this many tokens exactly; larger rests are first brought down by whole documents.
REST = 50_000


def knapsack(lengths: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many to take of each (length, count), so that the sum is the greatest that is at most ``budget``.

    Sums are the bits of one integer; counts are split into powers of two. It ends as soon as the budget itself is reached.
    """
    reach, mask, steps = 1, (1 << (budget + 1)) - 1, []
    for length, count in lengths:
        if not 0 < length <= budget:
            continue
        k, left = 1, min(count, budget // length)
        while left and not reach >> budget & 1:
            k = min(k, left)
            steps.append((reach, length, k))
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
        if reach >> budget & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            taken[length] = taken.get(length, 0) + k
    return taken


def fit(counts: pd.DataFrame, budget: int, max_repeats: int, seed: str) -> pd.DataFrame:
    """For the rows (tokens, n) of one source: ``every``, the repeats of each document of that length, and ``more``, how many get one more."""
    counts = counts.sort_values("tokens").reset_index(drop=True)
    length, n = counts["tokens"].tolist(), counts["n"].tolist()
    total = sum(a * b for a, b in zip(length, n))
    every = max_repeats if total == 0 else min(max_repeats, budget // total)
    more = [0] * len(n)
    if total and every < max_repeats:
        rest = budget - every * total
        more = [b * rest // total for b in n]
        left = rest - sum(a * b for a, b in zip(length, more))
        order = list(range(len(n)))
        random.Random(seed).shuffle(order)
        while left > REST:
            before = left
            for i in order:
                if left > REST and more[i] < n[i] and 0 < length[i] <= left:
                    k = min(n[i] - more[i], max(1, (left - REST) // length[i] // len(n)))
                    more[i] += k
                    left -= k * length[i]
            if left == before:
                break
        where = {a: i for i, a in enumerate(length)}
        for a, k in knapsack([(length[i], n[i] - more[i]) for i in order], left).items():
            more[where[a]] += k
    return counts.assign(every=every, more=more)


class Mix:
    """Columns used: documents doc_id, text, source; targets source, weight_bp, max_repeats, total_bp.

    Sources are compared by ``lower(trim(source))``; documents of no or another source count for the size of the whole only.
    Null or empty texts have no tokens: they are repeated like the rest of their source, but add nothing. Repeated rows are
    records of their own. A target without documents is reported with no tokens. Of a source named twice in ``targets``, the
    row that sorts first counts; rows with nulls are left out. ``targets`` is a specification of at most ``MAX_TARGETS`` rows.
    """

    MAX_TARGETS = 100_000

    def __init__(self, documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 29):
        spark = documents.sparkSession
        rows = targets.select("source", "weight_bp", "max_repeats", "total_bp").na.drop().orderBy("source", "weight_bp", "max_repeats", "total_bp").limit(self.MAX_TARGETS + 1).collect()
        if len(rows) > self.MAX_TARGETS:
            raise ValueError(f"more than {self.MAX_TARGETS} targets")
        named: dict[str, tuple] = {}
        for r in rows:
            named.setdefault(r["source"].strip(" ").lower(), tuple(r))
        self.targets = spark.createDataFrame([(k, *v) for k, v in named.items()], "source_key string, source string, weight_bp long, max_repeats long, total_bp long")
        keyed = documents.select("doc_id", "text", F.lower(F.trim("source")).alias("source_key"))
        counted = with_token_count(keyed, "text", "tokens", vocabulary).withColumn("order", F.xxhash64(F.lit(seed), F.col("doc_id")))
        self.records = materialize(counted, "records")
        by_length = self.records.groupBy("source_key", "tokens").agg(F.count(F.lit(1)).alias("n"))
        by_length = materialize(by_length, "lengths")
        self.whole, total = by_length.agg(F.coalesce(F.sum(F.col("tokens") * F.col("n")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        whole = self.whole
        wanted = by_length.join(F.broadcast(self.targets), "source_key")  # at most MAX_TARGETS rows

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            first = pdf.iloc[0]
            budget = int(first["weight_bp"]) * int(first["total_bp"]) * whole // 10**8
            return fit(pdf, budget, int(first["max_repeats"]), f"{seed} {first['source_key']}")[["source_key", "tokens", "n", "every", "more"]]

        self.fits = materialize(wanted.groupBy("source_key").applyInPandas(one, "source_key string, tokens long, n long, every long, more long"), "fits")
        self.total = total

    def chosen(self) -> DataFrame:
        """doc_id, source (as in the targets), tokens, repeats: the records of the mix, ``repeats`` at least 1."""
        keys = ["source_key", "tokens"]
        heavy = heavy_keys(self.fits, keys, "n", self.total)
        mine = self.records.join(F.broadcast(self.targets.select("source_key", "source")), "source_key")
        met = materialize(salted_join(mine, self.fits, keys, heavy, F.col("doc_id")).filter((F.col("every") > 0) | (F.col("more") > 0)), "met")
        part = (F.col("more") > 0) & (F.col("more") < F.col("n"))
        ranked = rank_in_groups(met.filter(part), keys, "order", "doc_id", self.fits.filter(part).select(*keys, "n"), "n", self.total)
        some = ranked.withColumn("repeats", F.col("every") + (F.col("rank") <= F.col("more")).cast("long"))
        whole = met.filter(~part).withColumn("repeats", F.col("every") + (F.col("more") > 0).cast("long"))
        columns = ["doc_id", "source", "tokens", "repeats"]
        return some.select(*columns).unionAll(whole.select(*columns)).filter(F.col("repeats") > 0)

    def shares(self) -> DataFrame:
        """source, wanted_tokens, mixed_tokens, records, weight_bp, real_bp (of the mix), reached.

        ``reached`` is false where even ``max_repeats`` of every document stay below the exact, unrounded target.
        """
        per = self.chosen().groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.count(F.lit(1)).alias("records"), F.min("repeats").alias("least"))
        had = self.fits.groupBy("source_key").agg(F.sum("n").alias("had"))
        shown = self.targets.join(per, "source", "left").join(had, "source_key", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
        whole = shown.agg(F.sum("mixed_tokens").alias("mix"))
        exact = F.col("weight_bp").cast("decimal(38,0)") * F.col("total_bp") * F.lit(self.whole)
        spent = F.col("had").isNull() | ((F.col("records") == F.col("had")) & (F.col("least") >= F.col("max_repeats")))
        short = spent & (exact > F.col("mixed_tokens").cast("decimal(38,0)") * F.lit(10**8))
        return shown.crossJoin(F.broadcast(whole)).select(  # one row
            "source", F.floor(exact / F.lit(10**8)).cast("long").alias("wanted_tokens"), "mixed_tokens", F.coalesce("records", F.lit(0)).alias("records"), "weight_bp",
            F.coalesce(F.floor(F.col("mixed_tokens") * 10000 / F.col("mix")), F.lit(0)).cast("long").alias("real_bp"), (~short).alias("reached"),
        )

    def unreachable(self) -> DataFrame:
        return self.shares().filter(~F.col("reached")).select("source")
