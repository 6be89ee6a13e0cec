"""Budgeted selection against plain folds, with ranges of a few rows so that every path is taken."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import recency, select


def items(seed, n=60, accounts=5, top=40):
    r = random.Random(seed)
    return [(f"i{k:03d}", f"a{min(r.randrange(accounts), r.randrange(accounts))}", r.randrange(top), k) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, account string, size long, at long").repartition(3)


def fold(rows, cap, used=0, most=10**9):
    out = []
    for row in rows:
        if len(out) < most and used + row[2] <= cap:
            out.append(row[0])
            used += row[2]
    return out


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_fill(spark, seed):
    rows = items(seed)
    cap = sum(r[2] for r in rows) // 3
    want = fold(sorted(rows, key=lambda r: (-r[2], r[0])), cap)
    assert ids(select.fill(frame(spark, rows), "size", cap, [F.desc("size"), F.asc("id")], rows=7)) == sorted(want)
    want = fold(sorted(rows, key=lambda r: r[3]), cap, used=5, most=9)
    assert ids(select.fill(frame(spark, rows), "size", cap, [F.asc("at")], used=5, most=9, rows=7)) == sorted(want)


def turns(queues, cap, used):
    out, at, going = [], dict.fromkeys(queues, 0), True
    while used < cap and going:
        going = False
        for a in queues:
            q, i = queues[a], at[a]
            while i < len(q) and used + q[i][2] > cap:
                i += 1
            if i < len(q):
                out.append(q[i][0])
                used += q[i][2]
                going, i = True, i + 1
            at[a] = i
    return out


def by_account(rows):
    total = {}
    for r in rows:
        total[r[1]] = total.get(r[1], 0) + r[2]
    return {a: sorted((r for r in rows if r[1] == a), key=lambda r: (-r[2], r[0])) for a in sorted(total, key=lambda a: (-total[a], a))}


@pytest.mark.parametrize("seed, rows_per_range", [(0, 6), (1, 6), (2, 1000)])
def test_binary_by_account(spark, seed, rows_per_range):
    rows = [r for r in items(seed, 40) if r[2]]
    queues, cap = by_account(rows), sum(r[2] for r in rows) // 3
    share, used, first = cap // len(queues), 0, []
    for a, q in queues.items():
        if q[-1][2] <= share and used + q[-1][2] <= cap:
            used += q[-1][2]
            first.append(q.pop()[0])
    want = first + turns(queues, cap, used)
    assert ids(select.binary_by_account(frame(spark, rows), "account", "size", "id", cap, rows=rows_per_range)) == sorted(want)


@pytest.mark.parametrize("seed, first, rows_per_range", [(0, 2, 6), (1, 0, 6), (2, 3, 1000)])
def test_two_phase(spark, seed, first, rows_per_range):
    rows = [r for r in items(seed, 40) if r[2]]
    cap, used, want = sum(r[2] for r in rows) // 3, 0, []
    queues = {a: sorted((r for r in rows if r[1] == a), key=lambda r: r[3]) for a in sorted({r[1] for r in rows})}
    at = dict.fromkeys(queues, 0)

    def take(a):
        nonlocal used
        while at[a] < len(queues[a]):
            r = queues[a][at[a]]
            at[a] += 1
            if used + r[2] <= cap:
                want.append(r[0])
                used += r[2]
                return True
        return False

    for a in queues:
        for _ in range(first):
            if used >= cap or not take(a):
                break
    while used < cap and any([take(a) for a in queues if used < cap]):
        pass
    assert ids(select.two_phase(frame(spark, rows), "account", "size", "at", "id", first, cap, rows=rows_per_range)) == sorted(want)


@pytest.mark.parametrize("limit", [5, 1000])
def test_equal_split(spark, limit):
    rows = items(7)
    cap = sum(r[2] for r in rows) // 2
    share = cap // len({r[1] for r in rows})
    order = lambda r: (-r[2], r[0])
    got = [i for a in {r[1] for r in rows} for i in fold(sorted((r for r in rows if r[1] == a), key=order), share)]
    spent = sum(r[2] for r in rows if r[0] in got)
    got += fold(sorted((r for r in rows if r[0] not in got), key=lambda r: (-r[2], r[1], r[0])), cap - spent)
    assert ids(select.equal_split(frame(spark, rows), "account", "size", cap, ["id"], rows=limit)) == sorted(got)


def test_as_is(spark):
    rows = [("a", "x", 5, 0), ("a", "x", 5, 1), ("b", "x", 0, 2), ("c", "x", 9, 3), ("d", "x", 4, 4)]
    done = spark.createDataFrame([("a",)], "id string")
    assert ids(select.as_is_fill(frame(spark, rows), "size", 10, "id", ["at"], done=done)) == ["b", "d"]
    assert ids(select.as_is_fill(frame(spark, rows), "size", None, "id", ["at"])) == ["a", "b", "c", "d"]


def test_empty(spark):
    none = frame(spark, []) if False else spark.createDataFrame([], "id string, account string, size long, at long")
    assert ids(select.greedy_fill(none, "size", 10, ["id"])) == []
    assert ids(select.equal_split(none, "account", "size", 10, ["id"])) == []
    assert ids(select.binary_by_account(none, "account", "size", "id", 10)) == []
    assert ids(select.two_phase(none, "account", "size", "at", "id", 2, 10)) == []


def test_without_account_or_size(spark):
    rows = [("a", None, 5, 0), ("b", None, None, 1), ("c", "x", 4, 2), ("d", None, 9, 3)]
    df = spark.createDataFrame(rows, "id string, account string, size long, at long")
    assert ids(select.equal_split(df, "account", "size", 10, ["id"])) == ["a", "b", "c"]
    assert ids(select.binary_by_account(df, "account", "size", "id", 10)) == ["a", "b", "c"]
    assert ids(select.two_phase(df, "account", "size", "at", "id", 1, 10)) == ["a", "b", "c"]


def test_places(spark):
    rows = items(3, 50, 3)
    got = {r["id"]: r["p"] for r in select.place_in_groups(frame(spark, rows), ["account"], [F.asc("at")], "p", rows=7).collect()}
    for a in {r[1] for r in rows}:
        assert [got[r[0]] for r in rows if r[1] == a] == list(range(sum(r[1] == a for r in rows)))


def test_recency(spark):
    df = spark.createDataFrame([("f1", "a", "2024"), ("f2", "a", "2023"), ("f3", "a", None), ("f4", "b", "2020"), ("f5", None, "2025")], "id string, account string, t string")
    assert ids(recency.native_by_account(df, "account", "t", "id", 1, 4)) == ["f1", "f2", "f4", "f5"]
    assert ids(recency.native_by_account(df, "account", "t", "id", 1, 2)) == ["f1", "f4", "f5"]
    log = spark.createDataFrame([("k", 1, "x"), ("k", 3, "z"), ("k", 2, "y"), ("l", 1, None)], "k string, p long, v string")
    assert sorted((r["k"], r["v"]) for r in recency.last_wins(log, "k", "p").collect()) == [("k", "z"), ("l", None)]
