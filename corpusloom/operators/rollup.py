"""Roll-ups of the inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import vocab as V
from corpusloom.functions.signals import path_prefix
from corpusloom.operators.select import place_in_groups


def bucket_dimension(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(list(V.BUCKETS.items()), "bucket_number int, bucket_name string")


def counts(df: DataFrame, key: Column, metric: str, top: int | None = None, blank: str = "(blank)") -> DataFrame:
    """Metric, Key, Value: rows for each key, blanks named; with ``top``, the most frequent ones (ties by key)."""
    named = F.when(F.coalesce(key.cast("string"), F.lit("")) == "", blank).otherwise(key.cast("string"))
    out = df.groupBy(named.alias("Key")).agg(F.count(F.lit(1)).alias("Value"))
    out = out if top is None else out.orderBy(F.desc("Value"), "Key").limit(top)
    return out.select(F.lit(metric).alias("Metric"), "Key", "Value")


def overview(evidence: DataFrame) -> DataFrame:
    """The long table of counts: by category, confidence, and the most frequent values of six more columns where present."""
    parts = [counts(evidence, F.col("bucket_number"), "bucket_count"), counts(evidence, F.col("confidence"), "confidence_count")]
    for column, metric, top in (
        ("source_guess", "source_guess_top", 40), ("extension", "extension_top", 40), ("quality_tier", "quality_tier_top", 20),
        ("modality", "modality_top", 40), ("content_type", "content_type_top", 40), ("sub_category", "sub_category_top", 40),
    ):
        if column in evidence.columns:
            parts.append(counts(evidence, F.lower(F.col(column)) if column == "extension" else F.col(column), metric, top))
    return reduce(DataFrame.unionAll, parts)


def bucket_summary(evidence: DataFrame) -> DataFrame:
    """bucket_number, bucket_name, items, high, low: all seven categories, and a total with number 0."""
    sure = F.lower(F.trim("confidence"))
    per = evidence.groupBy("bucket_number").agg(F.count(F.lit(1)).alias("items"), F.count_if(sure == "high").alias("high"), F.count_if(sure == "low").alias("low"))
    every = bucket_dimension(evidence).join(per, "bucket_number", "left").na.fill(0, ["items", "high", "low"])
    total = every.agg(*[F.sum(c).alias(c) for c in ("items", "high", "low")]).select(F.lit(0).alias("bucket_number"), F.lit("Total").alias("bucket_name"), "items", "high", "low")
    return every.select("bucket_number", "bucket_name", "items", "high", "low").unionAll(total)


def ready(evidence: DataFrame, target: int) -> DataFrame:
    """Whether every category has ``target`` rows: one row."""
    per = evidence.groupBy("bucket_number").agg(F.count(F.lit(1)).alias("n"))
    return bucket_dimension(evidence).join(per, "bucket_number", "left").agg(F.every(F.coalesce(F.col("n"), F.lit(0)) >= target).alias("ready"), F.min(F.coalesce(F.col("n"), F.lit(0))).alias("least"))


def _top(df: DataFrame, value: Column, k: int, name: str) -> DataFrame:
    """bucket_number, name: the k most frequent non-blank values of each category, ties by value."""
    n = df.select("bucket_number", value.alias("v")).filter(F.coalesce(F.col("v"), F.lit("")) != "").groupBy("bucket_number", "v").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("bucket_number").orderBy(F.desc("n"), "v"))
    kept = n.withColumn("at", rank).filter(F.col("at") <= k)
    return kept.groupBy("bucket_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(name))


def effort(n: Column, structured: Column, exports: Column, pdfs: Column) -> Column:
    many = pdfs >= F.greatest(F.lit(10), F.floor(n / 3))
    easy = (structured > 0) | (exports > 0)
    return (
        F.when(n == 0, "Unknown — no evidence found in dump").when(easy & many, "Medium — mix of exports + many document PDFs").when(easy, "Low — structured exports / system dumps present")
        .when(many, "Medium — mostly document artifacts (likely manual cleanup)").otherwise("Medium — unstructured dump; may require manual interpretation")
    )


def bucket_profile(evidence: DataFrame) -> DataFrame:
    """One row for each category: count, sources, extensions, places, first filenames, effort."""
    e = evidence.filter(F.col("bucket_number").isin(*V.BUCKETS))
    ext = F.lower("extension")
    basic = e.groupBy("bucket_number").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(ext.isin("csv", "json", "xlsx")).alias("structured"), F.count_if(F.col("source_guess").isin("Slack", "Notion", "Jira", "GitHub", "Google Drive")).alias("exports"), F.count_if(ext == "pdf").alias("pdfs"),
    )
    sources = e.filter(F.trim("source_guess") != "").select("bucket_number", "source_guess").distinct()
    rank = F.row_number().over(Window.partitionBy("bucket_number").orderBy("source_guess"))
    sources = sources.withColumn("at", rank).filter("at <= 20").groupBy("bucket_number").agg(F.array_sort(F.collect_list("source_guess")).alias("sources"))
    first = F.row_number().over(Window.partitionBy("bucket_number").orderBy("artifact_id"))
    samples = e.select("bucket_number", "artifact_id", "filename").withColumn("at", first).filter("at <= 8").groupBy("bucket_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "filename"))), lambda x: x["filename"]).alias("samples"))
    out = bucket_dimension(evidence).join(basic, "bucket_number", "left").na.fill(0)
    for part in (sources, _top(e, ext, 12, "extensions"), _top(e, path_prefix(F.col("path")), 8, "places"), samples):
        out = out.join(part, "bucket_number", "left")
    empty = F.array().cast("array<string>")
    listed = {c: F.coalesce(c, empty) for c in ("sources", "extensions", "places", "samples")}
    return out.withColumns(listed).withColumn("effort", effort(F.col("items"), F.col("structured"), F.col("exports"), F.col("pdfs"))).drop("structured", "exports", "pdfs")


def inventory(profile: DataFrame) -> DataFrame:
    """The seven-row inventory, from the profile alone."""
    part = lambda label, values, k, by: F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(F.slice(values, 1, k), by)))
    named = F.filter(F.transform("samples", lambda s: F.trim(s)), lambda s: s != "")
    return profile.select(
        "bucket_number", F.col("bucket_name").alias("Category"),
        F.concat_ws("; ", part("Artifact types: ", F.col("extensions"), 8, ", "), F.concat(F.lit("Observed items: "), F.col("items").cast("string")), part("Examples: ", named, 4, "; ")).alias("What it includes"),
        F.concat_ws("; ", part("Systems: ", F.col("sources"), 8, ", "), part("Folders: ", F.col("places"), 8, "; ")).alias("Where to find it"), F.col("effort").alias("How hard to pull"),
    )


def threads(messages: DataFrame, size: str = "size_estimate") -> DataFrame:
    """user_email, thread_id, subject (of the first message), size_bytes, messages: an aggregation, combined on the map side."""
    key = F.struct("date_unix", "message_id")
    return messages.groupBy("user_email", "thread_id").agg(F.min(F.struct(key.alias("k"), F.col("subject"))).alias("s"), F.sum(F.coalesce(F.col(size), F.lit(0))).alias("size_bytes"), F.count(F.lit(1)).alias("messages")).select("user_email", "thread_id", "s.subject", "size_bytes", "messages")


def thread_messages(messages: DataFrame) -> DataFrame:
    """user_email, thread_id, position, message_id: the ids of each thread in order, as rows, so that no thread is collected."""
    rows = messages.select("user_email", "thread_id", "date_unix", "message_id")
    return place_in_groups(rows, ["user_email", "thread_id"], [F.asc("date_unix"), F.asc("message_id")], "position").select("user_email", "thread_id", "position", "message_id")
