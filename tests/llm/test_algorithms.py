"""Problems 2, 3, 6, 7, 8 and 9 against brute force on small and awkward inputs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import containers, distinct_texts, group_top, mixing, quota_sample, shared_spans, token_budget, tokens

DOCS = "doc_id long, text string, lang string, source string, artifact_id long, owner_email string, seed string, rank int"


# --- 6


def top(rows, n):
    groups = defaultdict(list)
    for g, s, t, i in rows:
        if g is not None:
            groups[g].append((s, t, i))
    low = -(2**70)
    key = lambda r: (-(r[0] if r[0] is not None else low), -(r[1] if r[1] is not None else low), r[2] or "")
    return sorted(((g, *r) for g, rs in groups.items() for r in sorted(rs, key=key)[:n]), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_top_per_group(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "a", "a", "b", "c", None]), r.choice([None, 1, 1, 2, 10**12, -5]), r.choice([None, 7, 8]), f"id-{r.randrange(30):04d}-long-identifier") for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, s long, t long, i string").withColumn("_bin", F.lit("clash"))
    got = group_top.top_per_group(df, "g", ["s", "t"], "i", 5)
    assert got.columns == ["g", "s", "t", "i"]
    assert sorted(map(tuple, got.collect()), key=str) == top(rows, 5)


def test_top_edges(spark):
    schema = "g string, s long, i string"
    empty = spark.createDataFrame([], schema)
    assert group_top.top_per_group(empty, "g", ["s"], "i", 3).count() == 0
    same = spark.createDataFrame([("a", 1, "x")] * 10 + [("a", None, None)], schema)
    assert group_top.top_per_group(same, "g", ["s"], "i", 3).count() == 3
    assert group_top.top_per_group(same, "g", ["s"], "i", 20).count() == 11
    assert group_top.top_per_group(same, "g", ["s"], "i", 0).count() == 0


# --- 2


def test_tokens_of_parts(monkeypatch):
    text = "The quick brown fox, 12 jumps  over it's   lazy\n\ndogs! " * 40
    whole = tokens.count_tokens(text)
    monkeypatch.setattr(tokens, "PART", 37)
    assert tokens.count_tokens(text) == whole
    assert tokens.count_tokens("x" * 500) and tokens.count_tokens(" " * 500)
    assert tokens.count_tokens(None) == tokens.count_tokens("") == 0


def test_token_budget(spark):
    rows = [(i, "same text here", "en", "s", 1, "a@X.io ", None, 0) for i in range(6)] + [(10, "other words of text", None, None, 2, None, None, 0), (11, None, "de", " ", None, "b@y.io", None, 0), (12, "", "de", None, 3, "", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    evidence = spark.createDataFrame([(1, 3, "Google Drive", None), (1, None, " ", "x@z.io"), (2, 400, "googledrive ", "x@z.io"), (3, 0, None, None), (None, 5, "n", None)], "artifact_id long, token_count long, source_guess string, owner_email string")
    b = token_budget.TokenBudget(docs, evidence)
    n = tokens.count_tokens("same text here")
    totals = {(r["source"], r["language"], r["domain"]): (r["documents"], r["tokens"]) for r in b.totals().collect()}
    assert totals[("googledrive", "en", "x.io")] == (6, 6 * n) and totals[("googledrive", "(none)", "z.io")] == (1, tokens.count_tokens("other words of text"))
    assert totals[("(none)", "de", "y.io")] == (1, 0) and sum(d for d, _ in totals.values()) == 9
    assert [r["doc_id"] for r in b.misjudged().collect()] == [10]
    none = token_budget.TokenBudget(docs.limit(0), evidence.limit(0))
    assert none.totals().count() == none.misjudged().count() == 0


def test_distinct_texts(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, "b"), (None, "a"), (None, None), (4, None)], "doc_id long, text string")
    d = distinct_texts.DistinctTexts(docs)
    assert d.total == 7 and sorted(str(r["text"]) for r in d.one_each().select("text").distinct().collect()) == ["None", "a", "b"]
    assert d.one_each().filter("text = 'a'").count() == 1


# --- 3

PLAN = "plan_id string, bucket_number int, target_bp int, min_rows int, sample_bp int"


def quota(spark, sizes, plan):
    rows = [(b * 100_000 + i, b) for b, n in sizes.items() for i in range(n)]
    evidence = spark.createDataFrame([(a,) for a, _ in rows] + [(rows[0][0],), (None,), (999_999_999,)] if rows else [], "artifact_id long")
    log = spark.createDataFrame([(a, b, 5) for a, b in rows] + [(a, 9, 1) for a, _ in rows] + [(None, 1, 1), (999_999_999, None, 2)], "row_id long, bucket_number int, log_pos long")
    return quota_sample.QuotaSample(evidence, log, spark.createDataFrame(plan, PLAN))


def test_quota_sample(spark):
    q = quota(spark, {1: 500, 2: 300, 3: 7, 4: 0}, [("p", 1, 5000, 0, 2000), ("p", 2, 3000, 0, 2000), ("p", 3, 1000, 12, 2000), ("p", 4, 1000, 5, 2000), ("q", 1, 10000, None, 10000), (None, 1, 1, 1, 1)])
    report = {(r["plan_id"], r["bucket_number"]): r for r in q.report().collect()}
    size = 2000 * 807 // 10000
    assert report["p", 1]["need"] == 5000 * size // 10000 and report["p", 1]["sampled"] in (report["p", 1]["need"], report["p", 1]["need"] + 1)
    assert report["p", 3]["sampled"] == 7 and not report["p", 3]["met"] and report["p", 4]["eligible"] == 0 and not report["p", 4]["met"]
    assert sorted(tuple(r) for r in q.unmet().collect()) == [("p", 3), ("p", 4), ("q", 1)]
    sample = q.sample().collect()
    assert len(sample) == len(set(sample)) and all(r["artifact_id"] // 100_000 == r["bucket_number"] for r in sample)
    again = quota(spark, {1: 500, 2: 300, 3: 7, 4: 0}, [("p", 1, 5000, 0, 2000)]).sample().collect()
    assert {r["artifact_id"] for r in again} == {r["artifact_id"] for r in sample if r["plan_id"] == "p" and r["bucket_number"] == 1}


def test_quota_spreads_over_cells(spark, monkeypatch):
    from corpusloom.operators import skew

    rows = [(1, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "b int, id long").withColumn("h", F.xxhash64("id"))
    counts = df.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    got = {r["id"]: r["rank"] for r in skew.rank_in_groups(df, ["b"], "h", "id", counts, "n", 5000, per_cell=100).collect()}
    order = sorted(((r["h"], r["id"]) for r in df.collect()))
    assert [got[i] for _, i in order] == list(range(1, 5001))


def test_quota_empty(spark):
    q = quota(spark, {}, [("p", 1, 5000, 2, 2000), ("p", 2, 5000, 0, 2000)])
    assert q.sample().count() == 0 and [tuple(r) for r in q.unmet().collect()] == [("p", 1)]


# --- 7


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60))
def test_packing_and_bound(sizes):
    x = np.array(sizes)
    bins = containers.best_fit_decreasing(x, 50)
    used = np.bincount(bins, weights=x)
    assert used.max() <= 50 and len(set(bins.tolist())) == bins.max() + 1
    assert containers.lower_bound(x, 50) <= bins.max() + 1
    # no two containers can be merged: best fit would have filled the first
    assert len(used) < 2 or sorted(used)[0] + sorted(used)[1] > 50 or 0 in x


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60))
def test_best_sums(sizes):
    x = np.array(sizes)
    bins = containers.best_sums(x, 50)
    used = np.bincount(bins, weights=x)
    assert used.max() <= 50 and used.sum() == x.sum() and len(set(bins.tolist())) >= bins.max()
    assert containers.lower_bound(x, 50) <= bins.max() + 1


def test_bound_beats_volume():
    assert containers.lower_bound(np.array([26] * 10), 50) == 10
    assert containers.lower_bound(np.array([17] * 9), 50) == 5


def test_containers(spark):
    r = random.Random(1)
    texts = [(i, " ".join(["word"] * r.randrange(1, 90))) for i in range(300)] + [(300, "word " * 450), (301, None), (302, ""), (302, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("container", F.lit("clash"))
    c = containers.Containers(df, capacity=100, items=64)
    rows = c.contents().collect()
    used, spans = Counter(), defaultdict(list)
    for x in rows:
        used[x["container"]] += x["tokens"]
        spans[x["doc_id"]].append((x["token_start"], x["tokens"]))
    assert max(used.values()) <= 100 and len(rows) == len({(x["container"], x["position"]) for x in rows})
    for i, t in texts[:301]:
        n = tokens.count_tokens(t)
        assert sum(k for _, k in spans[i]) == n and (len(spans[i]) == 1 or n > 100)
    assert [x["doc_id"] for x in c.oversize().collect()] == [300] and len(spans[302]) == 2
    report = c.report().first()
    assert report["containers"] == len(used) <= 1.05 * report["least"] + 1
    assert containers.Containers(df.limit(0)).contents().count() == 0


# --- 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 5)), max_size=6, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_knapsack(lengths, budget):
    taken = mixing.knapsack(lengths, budget)
    sums = {0}
    for a, n in lengths:
        sums = {s + k * a for s in sums for k in range(n + 1)}
    assert sum(a * k for a, k in taken.items()) == max(s for s in sums if s <= budget)
    assert all(0 <= k <= dict(lengths)[a] for a, k in taken.items())


def test_mix(spark):
    r = random.Random(2)
    docs = [(i, "word " * r.randrange(1, 60), "en", r.choice(["Big", " big", "BIG ", "Small", None]), None, None, None, 0) for i in range(400)] + [(900, None, "en", "Big", None, None, None, 0)]
    df = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("Big", 5000, 2, 6000), ("Small", 5000, 1, 6000), ("None", 100, 2, 6000), (None, 1, 1, 1)], "source string, weight_bp int, max_repeats int, total_bp int")
    m = mixing.Mix(df, targets)
    size = {d[0]: tokens.count_tokens(d[1]) for d in docs}
    chosen = m.chosen().collect()
    assert len({c["doc_id"] for c in chosen}) == len(chosen) and all(1 <= c["repeats"] <= (2 if c["source"] == "Big" else 1) and c["tokens"] == size[c["doc_id"]] for c in chosen)
    shares = {s["source"]: s for s in m.shares().collect()}
    assert shares["Big"]["reached"] and shares["Big"]["mixed_tokens"] == shares["Big"]["wanted_tokens"]
    assert not shares["Small"]["reached"] and shares["Small"]["mixed_tokens"] == sum(size[d[0]] for d in docs if d[3] == "Small")
    assert sorted(x["source"] for x in m.unreachable().collect()) == ["None", "Small"]
    assert mixing.Mix(df.limit(0), targets).chosen().count() == 0


# --- 9


def shared(docs, span):
    at = defaultdict(set)
    for i, t in docs:
        for p in range(len(t or "") - span + 1):
            at[t[p : p + span]].add(i)
    return {(a, b) for s in at.values() for a in s for b in s if a < b}


def passages(seed, n=60):
    r = random.Random(seed)
    letters = "abcde fghé\U0001f600"
    word = lambda k: "".join(r.choice(letters) for _ in range(k))
    stock = [word(r.randrange(20, 90)) for _ in range(12)] + ["ab" * 40, "z" * 70]
    docs = [(i, "".join(r.choice([word(r.randrange(30)), r.choice(stock)]) for _ in range(r.randrange(1, 8)))) for i in range(n)]
    return docs + [(n + 1, docs[0][1]), (n + 2, docs[0][1]), (n + 3, None), (n + 4, ""), (n + 5, "z" * 400), (n + 6, "z" * 333 + "q")]


@pytest.mark.parametrize("seed, hot", [(0, 64), (1, 3)])
def test_shared_spans(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(shared_spans, "HOT", hot)
    docs = passages(seed)
    df = spark.createDataFrame(docs + docs[:1] + [(None, docs[0][1])], "doc_id long, text string").withColumn("seed", F.lit(1))
    s = shared_spans.SharedSpans(df, span=40, k=20)
    got = [tuple(x) for x in s.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == shared(docs, 40)
    text, spots = dict(docs), defaultdict(set)
    for i, t in docs:
        for at in range(len(t or "") - 39):
            spots[t[at : at + 40]].add(i)
    cover = {i: len({at + k for at in range(len(t or "") - 39) if len(spots[t[at : at + 40]]) > 1 for k in range(40)}) for i, t in docs}
    assert {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in s.coverage().collect()} == {i: (len(t or ""), cover[i]) for i, t in docs}
    assert {r["doc_id"]: r["copies"] for r in s.classes().collect()}[docs[0][0]] >= 3
    for p in s.passages().collect():
        assert p["longest"] >= 40 and p["end_a"] - p["begin_a"] >= p["longest"] and p["end_b"] <= len(text[p["doc_id_b"]])
    assert shared_spans.SharedSpans(df.limit(0), span=40, k=20).pairs().count() == 0


def repeated(seed, n=24):
    """Texts with a few stock passages, some of them several times in one text."""
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    stock = [word(r.randrange(42, 70)) for _ in range(3)]
    docs = [(i, "".join(word(r.randrange(1, 50)) + r.choice(stock) for _ in range(r.randrange(1, 5)))) for i in range(n)]
    often = "".join(stock[0] + word(3) for _ in range(shared_spans.REPEATS + 2))
    return docs + [(n, word(9) + stock[1] + word(9)), (n + 1, stock[1] + word(60) + stock[1]), (n + 2, often), (n + 3, word(5) + stock[0] + word(4) + stock[0]), (n + 4, "z" * 47), (n + 5, "y" + "z" * 44)]


def maximal(a, b, span):
    """All verbatim runs (place in a, place in b, length) that can't be made longer, by brute force."""
    out = set()
    for d in range(-len(a), len(b)):
        p = max(0, -d)
        while p < min(len(a), len(b) - d):
            n = 0
            while p + n < min(len(a), len(b) - d) and a[p + n] == b[p + n + d]:
                n += 1
            if n >= span:
                out.add((p, p + d, n))
            p += n + 1
    return out


def test_shared_passages_repeat(spark, monkeypatch):
    docs = repeated(5)
    text, df, got = dict(docs), spark.createDataFrame(docs, "doc_id long, text string"), {}
    for hot in (3, 10_000):
        monkeypatch.setattr(shared_spans, "HOT", hot)
        got[hot] = sorted(tuple(p) for p in shared_spans.SharedSpans(df, span=40, k=20).passages().collect())
    assert got[3] == got[10_000]
    found = defaultdict(list)
    for a, b, *p in got[3]:
        found[a, b].append(p)
    for a, b in combinations(text, 2):
        runs = maximal(text[a], text[b], 40)
        for p, q, n in runs:
            assert any(x <= p and p + n <= x2 and y <= q and q + n <= y2 and longest >= n for x, x2, y, y2, _, longest in found[a, b]), (a, b, p, q, n)
        assert {longest for *_, longest in found[a, b]} <= {n for _, _, n in runs}
    n = len(docs) - 6
    assert len(found[n, n + 1]) == 2  # once in one text, twice in the other


def test_all_runs():
    r = random.Random(3)
    for _ in range(60):
        a, b = ("".join(r.choice("ab") for _ in range(r.randrange(70))) for _ in range(2))
        got = shared_spans._all_runs(*(shared_spans._code_points(t) for t in (a, b)), 5)
        runs = maximal(a, b, 5)
        assert {tuple(x) for x in got.tolist()} == {(p, q) for p, q, _ in runs} | {(p + n - 5, q + n - 5) for p, q, n in runs}


def test_chain():
    anchors = np.array([(0, 50), (10, 60), (20, 5), (30, 80), (200, 250)])
    chains = [c.tolist() for c in shared_spans.chain(anchors, 20)]
    assert chains[0][:3] == [[0, 50], [10, 60], [30, 80]] and sum(map(len, chains)) == 5


def test_fuzzy_alignment():
    a, b = "x" * 5 + "the same long passage of text " * 3, "the same long passage of text " * 2 + "the same LONG passage of text "
    x, y = (shared_spans._code_points(t) for t in (a, b))
    passages_, runs = shared_spans.align(x, y, np.array([(5, 0), (40, 35), (78, 73)]), 10)
    assert passages_[0][:4] == (5, 95, 0, 90) and passages_[0][4] == 4 and max(n for _, _, n in runs) == 69


def test_edit_distance_is_exact():
    r = np.random.default_rng(5)

    def plain(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x):
            row, old = [i + 1], row
            for j, d in enumerate(y):
                row.append(min(old[j + 1] + 1, row[j] + 1, old[j] + (c != d)))
        return row[-1]

    for _ in range(60):
        x, y = (r.integers(0, 3, r.integers(0, 12)) for _ in "xy")
        assert shared_spans._edits(x, y) == plain(x.tolist(), y.tolist())
    long = r.integers(0, 50, 3000)
    assert shared_spans._edits(long, np.concatenate([long[:1000], long[1010:]])) == 10


def test_boilerplate_in_many_texts_meets_in_blocks(spark, monkeypatch):
    """A passage in 120 texts with other text around it, far more than a block holds and than a seed may stand in."""
    monkeypatch.setattr(shared_spans, "IN_BLOCK", 16)
    import random

    r = random.Random(4)
    words = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    common, short = words(40), words(20)
    rows = [(i, f"{words(12)} {common} {words(12)}") for i in range(120)] + [(i, f"{words(30)} {short} {words(30)}") for i in range(120, 240)]
    spans = shared_spans.SharedSpans(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {tuple(x) for x in spans.pairs().collect()}
    assert got == {(a, b) for a in range(120) for b in range(a + 1, 120)}
    assert spans.passages().filter("longest < 279").count() == 0


def test_top_of_scores_of_64_bits(spark):
    rows = [("g", s, f"i{n}") for n, s in enumerate([2**63 - 1, 2**63 - 2, 2**62 + 5, 2**62 + 4, 0, -(2**63), -(2**63) + 1, None])]
    df = spark.createDataFrame(rows, "g string, s long, i string")
    for n in range(1, 9):
        got = {r["i"] for r in group_top.top_per_group(df, "g", ["s"], "i", n).collect()}
        assert got == {i for _, _, i in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0)))[:n]}
