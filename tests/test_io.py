from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from corpusloom import io
from corpusloom.operators import skew


class Unset:
    """A session that names no checkpoint folder."""

    def __init__(self, spark):
        self.sparkContext = spark.sparkContext
        self.conf = self

    def get(self, key, default=None):
        return default


def test_scratch_dir(spark):
    assert io.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    own = io.scratch_dir(Unset(spark))
    assert os.path.isdir(own) and io.scratch_dir(Unset(spark)) == own


def test_materialize_and_release(spark):
    df = io.materialize(spark.range(5).withColumn("x", F.lit(None).cast("string")), "t")
    assert df.count() == 5 and df.columns == ["id", "x"]
    io.release(spark)
    again = io.materialize(spark.range(3), "t")
    assert again.count() == 3


def test_scratch_dir_must_be_shared_on_a_cluster(spark):
    far = Unset(spark)
    far.sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "a"})()
    with pytest.raises(ValueError):
        io.scratch_dir(far)


def test_release_of_one_result(spark):
    with io.scope("one") as one:
        a = io.materialize(spark.range(3), "t")
    b = io.materialize(spark.range(4), "t")
    io.release(spark, one)
    assert b.count() == 4
    with pytest.raises(Exception):
        a.count()


def test_ranks_of_a_hot_group_in_cells(spark):
    rows = spark.range(3000).select((F.col("id") % 30 == 0).alias("k"), F.xxhash64("id").alias("h"), "id")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = skew.rank_in_groups(rows, ["k"], "h", "id", counts, "n", 3000, per_cell=200)
    seen = {}
    for r in sorted(got.collect(), key=lambda r: (r["k"], r["h"])):
        seen[r["k"]] = seen.get(r["k"], 0) + 1
        assert r["rank"] == seen[r["k"]]


def test_spread(spark, sf):
    one = io.table(spark, sf, "documents")
    assert io.spread(one, "doc_id").rdd.getNumPartitions() >= 1 and io.spread(one, "doc_id").count() == one.count()
    many = one.repartition(8)
    assert "Repartition" in io.spread(one, "doc_id")._jdf.queryExecution().optimizedPlan().toString() and many.count() == one.count()


def test_salted_join(spark):
    rows = [("hot", i) for i in range(500)] + [("cold", i) for i in range(3)] + [(None, i) for i in range(50)]
    big = spark.createDataFrame(rows, "k string, i long")
    unique = spark.createDataFrame([("hot", "h"), ("cold", "c"), ("none", "n")], "k string, v string")
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    heavy = skew.heavy_keys(counts.filter("k = 'hot'"), ["k"], "n", 553)
    inner = skew.salted_join(big, unique, ["k"], heavy, F.col("i"))
    assert inner.columns == ["k", "i", "v"] and {r["v"]: r["count"] for r in inner.groupBy("v").count().collect()} == {"h": 500, "c": 3}
    assert skew.salted_join(big, unique, ["k"], heavy, F.col("i"), "left").filter("v IS NULL").count() == 50
