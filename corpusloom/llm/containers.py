"""Problem 7: texts into containers of a fixed number of tokens, by bound-certified repacking.

Every partition of items is packed by best-fit decreasing and compared with a lower bound from dual-feasible functions: a
partition whose number of containers equals its bound is certified; one that isn't is packed again by best sums. What has gaps (containers with space left) is exchanged:
such containers are spread anew over fewer partitions and their items packed again, where a new packing is kept only if it
needs fewer containers. Containers without a gap never move again. Only sizes and ids are shuffled, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.io import materialize
from corpusloom.llm.tokens import VOCABULARY, with_token_count

CAPACITY = 3000
#: Items in one partition, about.
ITEMS = 16_384
#: Space left, in hundredths of a container, from which a container has a gap.
GAP = 1
#: Rounds of exchange at most.
ROUNDS = 4


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs, by three families of dual-feasible functions.

    A dual-feasible function f maps shares of a container to shares such that whatever fits one container still fits after f;
    the sum of f over all items, rounded up, is then a bound. Here: the identity; for each e up to a half, items above 1 - e
    counted whole and those below e left out; and for each k, items counted as floor((k+1)x)/k where (k+1)x isn't whole.
    """
    if not len(sizes):
        return 0
    many = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    volume = np.cumsum(many * size)
    number = np.cumsum(many)
    best = -(-int(volume[-1]) // capacity)
    e = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - e]
    middle = volume[capacity - e] - volume[e - 1]
    best = max(best, int((large + -(-middle // capacity)).max(initial=0)))
    for k in range(1, 51):
        scaled = (k + 1) * size
        best = max(best, -(-int((many * np.where(scaled % capacity == 0, k * size, (scaled // capacity) * capacity)).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item: largest items first, each into the fullest container that still holds it."""
    bins = np.empty(len(sizes), dtype=np.int64)
    free: list[tuple[int, int]] = []
    opened = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect_left(free, (s, -1))
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, opened
            opened += 1
        bins[i] = b
        if left - s >= 0:
            insort(free, (left - s, b))
    return bins


def best_sums(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item: the largest item left, then those that together come nearest to the rest of its container.

    The sums that can be reached are the bits of one integer; larger sizes are tried first, and the search of a container ends
    when it can be filled exactly.
    """
    queues: dict[int, list[int]] = {}
    for i, size in enumerate(sizes.tolist()):
        queues.setdefault(size, []).append(i)
    bins = np.zeros(len(sizes), dtype=np.int64)
    queues.pop(0, None)  # what takes no room stays in the first container
    order, opened = sorted(queues, reverse=True), 0
    while order:
        if not queues[order[0]]:
            order.pop(0)
            continue
        content, room = [order[0]], capacity - order[0]
        reach, full, mask, steps = 1, 1 << room, (1 << (room + 1)) - 1, []
        for size in order:
            free = len(queues[size]) - (size == order[0])
            for _ in range(min(free, room // size) if size <= room else 0):
                grown = reach | ((reach << size) & mask)
                if grown == reach:
                    break
                steps.append((reach, size))
                reach = grown
                if reach & full:
                    break
            if reach & full:
                break
        at = reach.bit_length() - 1
        for before, size in reversed(steps):
            if not before >> at & 1:
                at -= size
                content.append(size)
        for size in content:
            bins[queues[size].pop()] = opened
        opened += 1
        if opened % 64 == 0:
            order = [size for size in order if queues[size]]
    return bins


def _pack(pdf: pd.DataFrame, capacity: int, round_: int) -> pd.DataFrame:
    """One partition: a new packing, kept if it needs fewer containers than the items come in."""
    sizes = pdf["tokens"].to_numpy(np.int64)
    old = pdf["container"].to_numpy(np.int64)
    bins, part = best_fit_decreasing(sizes, capacity), int(pdf["part"].iloc[0])
    if int(bins.max()) + 1 > lower_bound(sizes, capacity):  # not certified: a second way, kept if it is better
        bins = min(bins, best_sums(sizes, capacity), key=lambda b: int(b.max()))
    before = len(np.unique(old)) if round_ else None
    if before is None or int(bins.max()) + 1 < before:
        pdf = pdf.assign(container=(np.int64(round_) << 58) | (np.int64(part) << 22) | bins)
    used = pd.Series(sizes).groupby(pdf["container"].to_numpy()).transform("sum").to_numpy()
    count = pdf["container"].nunique()
    return pdf.assign(free=capacity - used, certified=count == lower_bound(sizes, capacity))


_SCHEMA = "doc_id long, piece int, token_start long, tokens long, part long, container long, free long, certified boolean"


class Containers:
    """Columns used: documents doc_id, text.

    A text longer than ``capacity`` tokens is cut into full pieces and a rest; nothing else is split. A null or empty text is
    an item of no tokens and still gets a container. Repeated rows are items of their own. No documents, no containers.
    """

    #: Tasks of one round at most; each packs its parts one after another.
    TASKS = 100_000

    def __init__(self, documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, items: int = ITEMS, rounds: int = ROUNDS):
        self.capacity = capacity
        counted = with_token_count(documents.select("doc_id", "text"), "text", "all_tokens", vocabulary)
        pieces = F.greatest(F.ceil(F.col("all_tokens") / F.lit(capacity)), F.lit(1)).cast("int")
        cut = counted.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).withColumn("token_start", F.col("piece").cast("long") * capacity)
        cut = cut.withColumn("tokens", F.least(F.col("all_tokens") - F.col("token_start"), F.lit(capacity)).cast("long"))
        # the key of the spread is stored with the row, so that a task run again finds it unchanged, and is even for repeated ids too
        self.items = materialize(cut.select("doc_id", "piece", "token_start", "tokens", F.monotonically_increasing_id().alias("row")), "items")
        n = self.items.count()
        parts = max(1, -(-n // items))
        first = self.items.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).withColumn("container", F.lit(0).cast("long")).drop("row")
        packed, closed = self._round(first, 0), []
        for r in range(1, rounds + 1):
            gap = F.col("free") * 100 >= F.lit(GAP * capacity)
            open_ = packed.filter(gap)
            n, volume, used = open_.agg(F.count(F.lit(1)), F.sum("tokens"), F.countDistinct("container")).first()
            if not n or parts == 1 or used <= -(-volume // capacity):
                break
            closed.append(packed.filter(~gap))
            parts = max(1, min(parts - 1, -(-n // items)))
            again = open_.withColumn("part", F.pmod(F.xxhash64("container", F.lit(r)), F.lit(parts))).drop("free", "certified")
            packed = self._round(again, r)
        self.packed = reduce(DataFrame.unionByName, [*closed, packed])

    def _round(self, items: DataFrame, r: int) -> DataFrame:
        capacity = self.capacity
        # as many tasks as parts: packing is work by item, and the planner would join parts by their bytes
        spread = items.repartition(min(items.select("part").distinct().count(), self.TASKS) or 1, "part")
        done = spread.groupBy("part").applyInPandas(lambda pdf: _pack(pdf, capacity, r)[["doc_id", "piece", "token_start", "tokens", "part", "container", "free", "certified"]], _SCHEMA)
        return materialize(done, "packed")

    def contents(self) -> DataFrame:
        """container, position (from 0), doc_id, piece, token_start, tokens.

        Positions follow size within a container; containers of a round hold at most the items of their partition.
        """
        order = Window.partitionBy("container").orderBy(F.desc("tokens"), "doc_id", "piece")
        return self.packed.select("container", (F.row_number().over(order) - 1).alias("position"), "doc_id", "piece", "token_start", "tokens")

    def report(self) -> DataFrame:
        """items, tokens, containers, least (a bound from the volume), certified_items: those in partitions that meet their own bound."""
        return self.packed.agg(
            F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.countDistinct("container").alias("containers"),
            F.ceil(F.coalesce(F.sum("tokens"), F.lit(0)) / F.lit(self.capacity)).alias("least"), F.count_if("certified").alias("certified_items"),
        )

    def oversize(self) -> DataFrame:
        """doc_id of the documents that exceed a container by themselves: those with more than one piece."""
        return self.packed.filter(F.col("piece") >= 1).select("doc_id").distinct()
