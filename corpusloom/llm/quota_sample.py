"""Problem 3: samples with given category proportions, by systematic unequal-probability sampling.

Artifacts are put in order of category and, within a category, of a seeded hash. The running sum of their inclusion
probabilities is known from the rank in the category (ranks are exact prefix counts across partitions); an artifact is taken
where the sum, moved by one random start per plan, crosses an integer. Floors are repaired afterwards: the next untaken
artifacts of a category that is short enter, the last taken ones of a category above its need leave. Both are decided from
the rank alone, without another pass.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.io import materialize
from corpusloom.operators.skew import rank_in_groups

#: Categories that count.
BUCKETS = range(1, 8)


def valid_buckets(classifications: DataFrame) -> DataFrame:
    """row_id, bucket_number: of each row_id the entry with the highest ``log_pos`` (of equal ones the greatest bucket)."""
    last = classifications.filter(F.col("row_id").isNotNull()).groupBy("row_id").agg(F.max(F.struct("log_pos", "bucket_number")).alias("v"))
    return last.select("row_id", "v.bucket_number")


def eligible_artifacts(evidence: DataFrame, classifications: DataFrame) -> DataFrame:
    valid = valid_buckets(classifications).filter(F.col("bucket_number").isin(*BUCKETS))
    artifacts = evidence.select("artifact_id").filter(F.col("artifact_id").isNotNull()).distinct()
    return artifacts.join(valid.withColumnRenamed("row_id", "artifact_id"), "artifact_id")


def _plan(rows: list, counts: dict[int, int], seed: int) -> list[dict]:
    """The parameters of one plan, a row per bucket."""
    everything = sum(counts.values())
    size = rows[0]["sample_bp"] * everything // 10000
    start, before, out = random.Random(f"{seed} {rows[0]['plan_id']}").random(), 0.0, []
    for r in sorted(rows, key=lambda r: r["bucket_number"]):
        have = counts.get(r["bucket_number"], 0)
        want = min(float(have), size * r["target_bp"] / 10000)
        need = max(size * r["target_bp"] // 10000, r["min_rows"] or 0)
        taken = math.floor(before + want + start) - math.floor(before + start)
        out.append({"plan_id": r["plan_id"], "bucket_number": r["bucket_number"], "target_bp": r["target_bp"], "eligible": have, "need": need, "step": want / have if have else 0.0, "before": before, "after": before + want, "start": start, "keep": taken, "extra": max(0, min(have, need) - taken)})
        before += want
    over = sum(p["keep"] + p["extra"] for p in out) - size
    for p in sorted(out, key=lambda p: (p["need"] - p["keep"], p["bucket_number"])):
        less = max(0, min(over, p["keep"] - p["need"]))
        p["keep"] -= less
        over -= less
    return out


class QuotaSample:
    """Columns used: evidence artifact_id; classifications row_id, log_pos, bucket_number; targets plan_id, bucket_number, target_bp, min_rows, sample_bp.

    Null or impossible buckets make an artifact ineligible, repeated rows count once. Rows of ``targets`` with a null plan,
    bucket or share are left out; of a bucket named twice in a plan the first in order counts. ``targets`` is a specification,
    read on the driver: at most ``MAX_TARGETS`` rows, else ValueError. Without eligible artifacts the sample is empty and every
    bucket with a positive minimum is reported.
    """

    MAX_TARGETS = 100_000

    def __init__(self, evidence: DataFrame, classifications: DataFrame, targets: DataFrame, seed: int = 17):
        spark = evidence.sparkSession
        self.pool = materialize(eligible_artifacts(evidence, classifications).withColumn("order", F.xxhash64(F.lit(seed), F.col("artifact_id"))), "eligible")
        counts = self.pool.groupBy("bucket_number").agg(F.count(F.lit(1)).alias("n"))
        had = {r["bucket_number"]: r["n"] for r in counts.collect()}  # at most as many rows as BUCKETS
        rows = targets.select("plan_id", "bucket_number", "target_bp", "min_rows", "sample_bp").na.drop(subset=["plan_id", "bucket_number", "target_bp", "sample_bp"]).orderBy("plan_id", "bucket_number", "target_bp", "min_rows").limit(self.MAX_TARGETS + 1).collect()
        if len(rows) > self.MAX_TARGETS:
            raise ValueError(f"more than {self.MAX_TARGETS} targets")
        plans: dict[str, dict[int, object]] = {}
        for r in rows:
            plans.setdefault(r["plan_id"], {}).setdefault(r["bucket_number"], r)
        parameters = [p for plan in plans.values() for p in _plan(list(plan.values()), had, seed)]
        schema = "plan_id string, bucket_number int, target_bp int, eligible long, need long, step double, before double, after double, start double, keep long, extra long"
        self.plans = spark.createDataFrame([tuple(p.values()) for p in parameters], schema)
        self.counts, self.total = counts, sum(had.values())

    def sample(self) -> DataFrame:
        """plan_id, bucket_number, artifact_id."""
        ranked = rank_in_groups(self.pool, ["bucket_number"], "order", "artifact_id", self.counts, "n", self.total)
        r = F.col("rank")
        at = lambda k: F.floor(F.when(k >= F.col("eligible"), F.col("after")).otherwise(F.col("before") + k * F.col("step")) + F.col("start"))
        met = ranked.join(F.broadcast(self.plans), "bucket_number")  # at most MAX_TARGETS rows
        met = met.withColumn("upto", at(r) - F.floor(F.col("before") + F.col("start"))).withColumn("crossing", at(r) > F.when(r == 1, F.floor(F.col("before") + F.col("start"))).otherwise(at(r - 1)))
        take = F.when(F.col("crossing"), F.col("upto") <= F.col("keep")).otherwise(r - F.col("upto") <= F.col("extra"))
        return met.filter(take).select("plan_id", "bucket_number", "artifact_id")

    def report(self) -> DataFrame:
        """plan_id, bucket_number, target_bp, eligible, need, sampled, share_bp (of the plan's sample), met."""
        taken = self.sample().groupBy("plan_id", "bucket_number").agg(F.count(F.lit(1)).alias("sampled"))
        whole = taken.groupBy("plan_id").agg(F.sum("sampled").alias("size"))
        shown = self.plans.join(taken, ["plan_id", "bucket_number"], "left").join(whole, "plan_id", "left")
        sampled = F.coalesce(F.col("sampled"), F.lit(0)).cast("long")
        return shown.select("plan_id", "bucket_number", "target_bp", "eligible", "need", sampled.alias("sampled"), F.coalesce(F.floor(sampled * 10000 / F.col("size")), F.lit(0)).cast("long").alias("share_bp"), (sampled >= F.col("need")).alias("met"))

    def unmet(self) -> DataFrame:
        return self.report().filter(~F.col("met")).select("plan_id", "bucket_number")
