"""Problem 9: long passages that documents share, by collinear chaining of k-mer seeds.

1. Of each distinct text, seeds are taken: the k-mer with the least hash in each window of ``w = span - k + 1`` k-mers, so that
   any common passage of ``span`` characters has a common seed at the same place of the passage in both texts.
2. Seeds are joined on their hash; those of two documents are the anchors of the pair.
3. The anchors of a pair are chained in order of both texts, with a cost for gaps, through a Fenwick tree.
4. Chains are aligned: anchors are extended to the longest verbatim runs around them, the gaps between runs are compared, and
   each chain becomes a (fuzzy) passage. A pair shares a verbatim span if a run has ``span`` characters or more.

Exact copies are one class with one representative; only representatives are compared. A seed in more than ``HOT`` places is
not paired as it is: around each of its places all windows of ``span`` characters are hashed, and only places with an equal
window meet, in blocks, so that a short phrase in a third of all texts makes no pairs that aren't results. These pairs are then
chained and aligned like all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.io import materialize
from corpusloom.llm.distinct_texts import KEY, DistinctTexts
from corpusloom.operators.skew import heavy_keys, salted_join

#: Characters that a shared passage must have.
SPAN = 200
#: Characters of a seed. Longer seeds make fewer false pairs and more seeds.
K = 100
#: Places from which a seed is hot.
HOT = 64
#: Places of one seed in one text from which only the first is kept and the pair is compared as a whole, all places of its windows.
REPEATS = 8
#: Members from which a class of exact copies is linked to its least member only.
EXPAND = 1000
#: Places of a window in one block of the join of its places, about.
IN_BLOCK = 1000
#: Cost of a gap of one character in a chain, in characters of a match.
GAP_COST = 0.1
#: Characters that are hashed at a time.
BLOCK = 1_000_000
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def window_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each window of ``k`` code points: a polynomial from prefix sums, mixed."""
    n = len(points)
    size = 1 << max(BLOCK, n + 1).bit_length()
    up, down = _powers(size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(points.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def _window_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, by doubling."""
    least, size = x, 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return least if size == w else np.minimum(least[: len(x) - w + 1], least[w - size : len(x) - size + 1])


def seeds(texts: list[str], span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, place, vague) of the seeds of some texts of at least ``span`` characters.

    ``vague``: the seed stands more than once within a window, or too often in its text; its places aren't complete then.
    """
    w = span - k + 1
    points = [_code_points(t) for t in texts]
    length = np.array([len(p) for p in points])
    begin = np.concatenate([[0], np.cumsum(length)])
    x = window_hashes(np.concatenate(points), k)
    least = _window_least(x, w)
    # windows that lie within one text, run by run of an equal least hash
    inside = np.ones(len(least) + 1, bool)
    for b in begin[1:-1].tolist():
        inside[max(0, b - span + 1) : b] = False
    inside[-1] = False
    starts_run = inside[:-1].copy()
    starts_run[1:] &= (least[1:] != least[:-1]) | ~inside[:-2]
    first = np.flatnonzero(starts_run)
    ends_run = inside[:-1] & (~inside[1:] | np.concatenate([least[1:] != least[:-1], [True]]))
    last = np.flatnonzero(ends_run)
    windows = np.lib.stride_tricks.sliding_window_view(x, w)
    place = first + windows[first].argmin(axis=1)
    place2 = last + w - 1 - windows[last][:, ::-1].argmin(axis=1)
    vague = place != place2
    place, vague = np.concatenate([place, place2[vague]]), np.concatenate([vague, vague[vague]])
    text = np.searchsorted(begin, place, side="right") - 1
    order = np.lexsort((place, x[place], text))
    text, place, vague = text[order], place[order], vague[order]
    value = x[place]
    fresh = np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])])
    group = np.cumsum(fresh) - 1
    often = np.bincount(group)[group] > REPEATS
    keep = np.concatenate([[True], (place[1:] != place[:-1])]) & (fresh | ~often)
    vague |= often
    return text[keep], value[keep].view(np.int64), (place - begin[text])[keep], vague[keep]


def chain(anchors: np.ndarray, k: int) -> list[np.ndarray]:
    """Anchors (place a, place b) in chains that ascend in both, best first; each anchor is in one chain.

    The score of a chain is ``k`` for each anchor less GAP_COST for each character skipped in either text; the best
    predecessor is the prefix maximum of score + GAP_COST * (a + b), kept in a Fenwick tree over the places in b.
    """
    anchors = anchors[np.lexsort((anchors[:, 1], anchors[:, 0]))]
    a, b = anchors[:, 0].tolist(), anchors[:, 1].tolist()
    at = {v: i + 1 for i, v in enumerate(sorted(set(b)))}
    n, size = len(a), len(at)
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)
    score, before = [float(k)] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and a[j] == a[i]:
            best, at_b = (float("-inf"), -1), at[b[j]] - 1
            while at_b > 0:
                best = max(best, tree[at_b])
                at_b -= at_b & -at_b
            gained = best[0] - GAP_COST * (a[j] + b[j])
            if best[1] >= 0 and gained > 0:
                score[j], before[j] = k + gained, best[1]
            j += 1
        for m in range(i, j):
            entry, at_b = (score[m] + GAP_COST * (a[m] + b[m]), m), at[b[m]]
            while at_b <= size:
                tree[at_b] = max(tree[at_b], entry)
                at_b += at_b & -at_b
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda i: -score[i]):
        path = []
        while end >= 0 and not used[end]:
            used[end] = True
            path.append(end)
            end = before[end]
        if path:
            out.append(anchors[path[::-1]])
    return out


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """Characters that are equal from the start."""
    n, done = min(len(x), len(y)), 0
    step = 256
    while done < n:
        differ = np.flatnonzero(x[done : min(n, done + step)] != y[done : min(n, done + step)])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 4
    return n


def verbatim_runs(x: np.ndarray, y: np.ndarray, anchors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(place in x, place in y, length): the longest verbatim runs through the anchors, each run once."""
    reached: dict[int, int] = {}
    runs = []
    for p, q in anchors.tolist():
        if p + k <= reached.get(p - q, -1):
            continue
        forward = _same(x[p:], y[q:])
        if forward < k:  # the hashes met by chance
            continue
        back = _same(x[:p][::-1], y[:q][::-1])
        runs.append((p - back, q - back, back + forward))
        reached[p - q] = p + forward
    return runs


def _edits(x: np.ndarray, y: np.ndarray) -> int:
    """Edit distance of two gaps. What they begin or end with in common costs nothing; a row holds the shorter one."""
    front = _same(x, y)
    x, y = x[front:], y[front:]
    back = _same(x[::-1], y[::-1])
    x, y = sorted((x[: len(x) - back], y[: len(y) - back]), key=len, reverse=True)
    if not len(y):
        return len(x)
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i, c in enumerate(x):
        new = np.minimum(row + 1, np.concatenate([[i + 1], row[:-1] + (y != c)]))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def align(x: np.ndarray, y: np.ndarray, anchors: np.ndarray, k: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Passages (begin a, end a, begin b, end b, edits) and verbatim runs of one pair."""
    passages, every = [], []
    for path in chain(anchors, k):
        runs = verbatim_runs(x, y, path, k)
        if not runs:
            continue
        edits = 0
        for (p, q, n), (p2, q2, _) in zip(runs, runs[1:]):
            edits += _edits(x[p + n : max(p + n, p2)], y[q + n : max(q + n, q2)])
        every += runs
        passages.append((runs[0][0], max(p + n for p, _, n in runs), runs[0][1], max(q + n for _, q, n in runs), edits))
    return passages, every


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for each j from ``low[i]`` up to ``high[i]``."""
    n = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[i]


def _met(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> tuple[np.ndarray, bool]:
    """The anchors of two texts by all their common ``seeds``, and whether one of these is vague."""
    (_, value_x, place_x, vague_x), (_, value_y, place_y, vague_y) = x, y
    order = np.argsort(value_y, kind="stable")
    value_y, place_y, vague_y = value_y[order], place_y[order], vague_y[order]
    i, j = _ranges(np.searchsorted(value_y, value_x), np.searchsorted(value_y, value_x, side="right"))
    return np.stack([place_x[i], place_y[j]], 1), bool((vague_x[i] | vague_y[j]).any())


def _begun(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The (i, j) of equal values before which there are no equal ones: as many rows as there are runs, however long these are."""
    before_x, before_y = np.concatenate([[1], x[:-1] + 2]), np.concatenate([[0], y[:-1] + 2])
    size = max(x.max(), y.max()) + 3
    order = np.lexsort((before_y, y))
    key, ordered = y[order] * size + before_y[order], y[order]
    same = x * size + before_x
    found = [_ranges(np.searchsorted(ordered, x), np.searchsorted(key, same)), _ranges(np.searchsorted(key, same, side="right"), np.searchsorted(ordered, x, side="right"))]
    return np.concatenate([np.stack([i, order[j]], 1) for i, j in found])


def _all_runs(x: np.ndarray, y: np.ndarray, span: int) -> np.ndarray:
    """Anchors for a pair with vague seeds: the first and the last window of each verbatim run of ``span`` characters or more.

    A window that stands several times in either text is in a run for each two of its places.
    """
    if min(len(x), len(y)) < span:
        return np.empty((0, 2), np.int64)
    hx, hy = window_hashes(x, span), window_hashes(y, span)
    number = np.unique(np.concatenate([hx, hy]), return_inverse=True)[1]
    nx, ny = number[: len(hx)], number[len(hx) :]
    last = np.array([len(nx) - 1, len(ny) - 1]) - _begun(nx[::-1], ny[::-1])
    return np.unique(np.concatenate([_begun(nx, ny), last]), axis=0)


class SharedSpans:
    """Columns used: documents doc_id, text.

    Null texts and texts of less than ``span`` characters share nothing. Texts are compared code point by code point. Rows with
    a null id are left out; of repeated rows of one id and text one counts. Exact copies share their whole text: in ``pairs``
    a class of up to EXPAND members gives all its pairs, a larger one the pair of its least member with each other member
    (``classes`` has all members of any class). Empty tables give empty results.
    """

    def __init__(self, documents: DataFrame, span: int = SPAN, k: int = K):
        self.span, self.k, self.documents = span, k, documents.select("doc_id", "text")
        usable = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.length("text") >= span))
        self.texts = DistinctTexts(usable)
        self.one = self.texts.one_each().select("doc_id", "text")
        long = "doc_id long, seed long, place int, vague boolean"

        def take(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                begin, size = 0, 0
                for i in range(len(texts)):
                    size += len(texts[i].as_py())
                    if size >= BLOCK or i == len(texts) - 1:
                        number, value, place, vague = seeds(texts[begin : i + 1].to_pylist(), span, k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[begin + number], pa.int64()), pa.array(value), pa.array(place.astype(np.int32)), pa.array(vague)], ["doc_id", "seed", "place", "vague"])
                        begin, size = i + 1, 0

        self.seeds = materialize(self.one.mapInArrow(take, long), "seeds")
        # a seed is shared if its least and greatest document differ
        counts = self.seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("places"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        shared = materialize(counts.filter(F.col("low") != F.col("high")).select("seed", "places"), "shared")
        total = self.seeds.count()
        self.heavy = heavy_keys(shared, ["seed"], "places", total)
        self.places = materialize(salted_join(self.seeds, shared, ["seed"], self.heavy, F.struct("doc_id", "place")), "places")

    def _windows(self, places: DataFrame) -> DataFrame:
        """window, doc_id, place, before: the windows of ``span`` characters around some places of seeds that stand in several texts.

        Where a seed is vague, its places aren't complete, and all windows of the text are taken. ``before``: the window one
        character earlier if it is among them too, else a value of this place alone.
        """
        span, k = self.span, self.k
        # bounded by the text; stored, so that the planner knows its size before it decides whether texts must be shuffled
        of = materialize(places.groupBy("doc_id").agg(F.collect_set("place").alias("at"), F.max("vague").alias("vague")), "near")
        texts = self.one.join(of, "doc_id").select("doc_id", "text", "at", "vague")

        def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for doc, text, at, vague in zip(*(c.to_pylist() for c in batch.columns)):
                    values = window_hashes(_code_points(text), span)
                    near = np.full(len(values), bool(vague))
                    for p in at:
                        near[max(0, p + k - span) : p + 1] = True
                    place = np.flatnonzero(near)
                    alone = _mix(place.astype(np.uint64) + _mix(np.full(len(place), doc, np.int64).view(np.uint64)))
                    before = np.where((place > 0) & near[place - 1], values[place - 1], alone)
                    columns = [pa.array(values[place].view(np.int64)), pa.array(np.full(len(place), doc, np.int64)), pa.array(place.astype(np.int32)), pa.array(before.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["window", "doc_id", "place", "before"])

        found = materialize(texts.mapInArrow(windows, "window long, doc_id long, place int, before long"), "windows")
        counts = found.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter(F.col("low") != F.col("high")).select("window", "n")
        counts = materialize(counts, "windows")
        return salted_join(found, counts, ["window"], heavy_keys(counts, ["window"], "n", found.count()), F.struct("doc_id", "place")).drop("n")

    def coverage(self) -> DataFrame:
        """doc_id, n_chars, shared_chars, share: how much of each document stands, in passages of ``span`` characters or more, in another one.

        No pairs are made: a character is shared if it lies in a window of ``span`` characters that stands in several texts, and
        all characters of a text with copies are. Null and short texts share nothing; a null text has no characters.
        """
        windows = self._windows(self.places).select("doc_id", "place").distinct()
        after = F.lead("place").over(Window.partitionBy("doc_id").orderBy("place")) - F.col("place")  # bounded by the text
        covered = windows.withColumn("n", F.least(F.coalesce(after, F.lit(self.span)), F.lit(self.span))).groupBy(F.col("doc_id").alias("class_id")).agg(F.sum("n").alias("covered"))
        members = self.classes().join(covered, "class_id", "left").select("doc_id", "copies", "covered")
        sized = self.documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), (F.length("text") >= self.span).alias("long")).filter(F.col("doc_id").isNotNull()).distinct()
        shared = F.when(F.coalesce(F.col("long"), F.lit(False)), F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce(F.col("covered"), F.lit(0)))).otherwise(F.lit(0)).cast("long")
        out = sized.join(members, "doc_id", "left").withColumn("shared_chars", F.least(shared, F.col("n_chars").cast("long")))
        return out.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "shared_chars", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("share"))

    def _seeded(self) -> DataFrame:
        """doc_id_a, doc_id_b, place_a, place_b, vague: the places that two texts have in common by seeds that aren't hot."""
        places = self.places.filter(F.col("places") <= HOT).select("seed", "doc_id", "place", "vague")
        a, b = (places.select("seed", *(F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "place", "vague"))) for x in "ab")
        met = a.join(b, "seed").filter(F.col("doc_id_a") < F.col("doc_id_b"))
        return met.select("doc_id_a", "doc_id_b", "place_a", "place_b", (F.col("vague_a") | F.col("vague_b")).alias("vague"))

    def _hot(self) -> DataFrame | None:
        """doc_id_a, doc_id_b, place_a, place_b: a common window of each pair that shares one around hot seeds; None without hot seeds.

        A pair meets only where its common passage begins, that is where the windows before differ; windows before which all
        texts have the same are left out first. So the rows made are the pairs that there are, not the pairs times the length.
        """
        hot = self.places.filter(F.col("places") > HOT)
        if hot.isEmpty():
            return None
        windows = self._windows(hot)
        begins = windows.groupBy("window").agg(F.min("before").alias("low"), F.max("before").alias("high")).filter(F.col("low") != F.col("high")).select("window")
        begun = materialize(windows.join(begins, "window", "left_semi"), "begun")
        sizes = materialize(begun.groupBy("window").agg(F.ceil(F.count(F.lit(1)) / F.lit(IN_BLOCK)).cast("int").alias("blocks")), "blocks")
        large = sizes.filter("blocks > 1")
        # the places of a window meet in blocks, so that the pairs of a window in a third of all texts are made by many tasks
        cut = begun.join(large, "window", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("doc_id", "place"), F.col("blocks")).cast("int"))
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        a, b = (cut.select("window", *(F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "place", "before")), *keys) for x, keys in (
            ("a", (F.col("mine").alias("block_a"), F.explode(every).alias("block_b"))), ("b", (F.explode(every).alias("block_a"), F.col("mine").alias("block_b")))))
        met = a.join(b, ["window", "block_a", "block_b"]).filter((F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("before_a") != F.col("before_b")))
        return met.groupBy("doc_id_a", "doc_id_b").agg(F.min(F.struct("place_a", "place_b")).alias("p")).select("doc_id_a", "doc_id_b", "p.place_a", "p.place_b")

    @staticmethod
    def _anchors(met: DataFrame) -> DataFrame:
        """doc_id_a, doc_id_b, anchors, vague: the places of each pair."""
        return met.groupBy("doc_id_a", "doc_id_b").agg(F.collect_set(F.struct("place_a", "place_b")).alias("anchors"), F.max("vague").alias("vague"))

    def passages(self) -> DataFrame:
        """doc_id_a, doc_id_b, begin_a, end_a, begin_b, end_b, edits, longest: the passages of each pair of representatives.

        Passages come from chains, so they may hold differences (``edits``); ``longest`` is the longest verbatim run of the pair
        in this passage. Runs of less than ``span`` characters make no passage of their own. Two texts with hot seeds get their
        anchors from the seeds of both, all places of all common ones, so HOT changes no row.
        """
        hot = self._hot()
        met = self._seeded()
        return self._aligned(met if hot is None else met.unionByName(hot.withColumn("vague", F.lit(True))))

    def _aligned(self, met: DataFrame) -> DataFrame:
        span, k = self.span, self.k
        pairs = materialize(self._anchors(met), "pairs")
        used = pairs.select(F.explode(F.array("doc_id_a", "doc_id_b")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        used = materialize(used, "used")
        heavy = heavy_keys(used, ["doc_id"], "n", max(1, used.agg(F.sum("n")).first()[0] or 0))
        texts = materialize(self.one.join(used.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.first("text").alias("text")), "text")
        hot = self.places.filter(F.col("places") > HOT).select("doc_id").distinct().withColumn("hot", F.lit(True))
        texts = texts.join(hot, "doc_id", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        side = lambda x: texts.select(F.col("doc_id").alias(f"doc_id_{x}"), F.col("text").alias(f"text_{x}"), F.col("hot").alias(f"hot_{x}"))
        both = salted_join(pairs, side("a"), ["doc_id_a"], heavy.withColumnRenamed("doc_id", "doc_id_a"), F.col("doc_id_b"))
        both = salted_join(both, side("b"), ["doc_id_b"], heavy.withColumnRenamed("doc_id", "doc_id_b"), F.col("doc_id_a"))

        def aligned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["doc_id_a", "doc_id_b", "begin_a", "end_a", "begin_b", "end_b", "edits", "longest"]
            for batch in it:
                rows = []
                seeded = lru_cache(maxsize=256)(lambda text: seeds([text], span, k))
                for r in batch.to_pylist():
                    x, y = _code_points(r["text_a"]), _code_points(r["text_b"])
                    anchors, vague = np.array([(p["place_a"], p["place_b"]) for p in r["anchors"]], np.int64), r["vague"]
                    if r["hot_a"] and r["hot_b"]:  # they may have hot seeds in common, which aren't among the anchors
                        anchors, vague = _met(seeded(r["text_a"]), seeded(r["text_b"]))
                    pieces = align(x, y, anchors, k)
                    if vague and len(more := _all_runs(x, y, span)):
                        pieces = tuple(one + two for one, two in zip(pieces, align(x, y, more, span)))
                    for begin_a, end_a, begin_b, end_b, edits in set(pieces[0]):
                        longest = max((n for p, q, n in pieces[1] if begin_a <= p and p + n <= end_a and begin_b <= q and q + n <= end_b), default=0)
                        if longest >= span:
                            rows.append((r["doc_id_a"], r["doc_id_b"], begin_a, end_a, begin_b, end_b, edits, longest))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 8)], names)

        return both.select("doc_id_a", "doc_id_b", "text_a", "text_b", "anchors", "vague", "hot_a", "hot_b").mapInArrow(aligned, "doc_id_a long, doc_id_b long, begin_a long, end_a long, begin_b long, end_b long, edits long, longest long")

    def classes(self) -> DataFrame:
        """doc_id, class_id (the least id with the same text), copies."""
        return salted_join(self.texts.rows.select("doc_id", *KEY).distinct(), self.texts.groups, KEY, self.texts.heavy, F.col("doc_id")).select("doc_id", F.col("least").alias("class_id"), "copies")

    def pairs(self) -> DataFrame:
        """doc_id_a < doc_id_b: the pairs of documents that share a span."""
        linked = self.passages().select("doc_id_a", "doc_id_b").distinct()
        members = materialize(self.classes().filter(F.col("copies") > 1), "members")
        for x in "ab":  # a representative without copies stands for itself
            of = members.select(F.col("class_id").alias(f"doc_id_{x}"), F.col("doc_id").alias("member"))
            linked = linked.join(of, f"doc_id_{x}", "left").withColumn(f"doc_id_{x}", F.coalesce("member", f"doc_id_{x}")).drop("member")
        a, b = (members.select("class_id", "copies", F.col("doc_id").alias(f"doc_id_{x}")) for x in "ab")
        small = a.filter(F.col("copies") <= EXPAND).join(b.drop("copies"), "class_id").filter(F.col("doc_id_a") < F.col("doc_id_b"))
        large = members.filter((F.col("copies") > EXPAND) & (F.col("doc_id") != F.col("class_id"))).select(F.col("class_id").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"))
        every = linked.unionByName(small.select("doc_id_a", "doc_id_b")).unionByName(large)
        return every.select(F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b"))
