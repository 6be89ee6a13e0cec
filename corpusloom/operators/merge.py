"""Joins of the inventory: labels onto rows, logs onto artifacts, what is left to do, shortcuts, ordered substring lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import vocab as V
from corpusloom.functions.signals import instant
from corpusloom.operators.recency import last_wins

CLASS_COLUMNS = ["bucket_number", "bucket_name", "confidence", "rationale", "llm_pass"]


def filled(*columns: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in columns])


def current_labels(log: DataFrame) -> DataFrame:
    """One row for each row_id: the one with the highest log_pos."""
    return last_wins(log.filter(F.col("row_id").isNotNull()), "row_id", "log_pos")


def label(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """Every evidence row with its label, if any. The planner picks the strategy: both sides grow with the corpus."""
    keep = labels.select(F.col("row_id").alias("artifact_id"), *[c for c in CLASS_COLUMNS if c in labels.columns])
    return evidence.join(keep, "artifact_id", "left")


def merge_checkpoints(artifacts: DataFrame, labels: DataFrame, subcategories: DataFrame | None = None, orphans: bool = True) -> DataFrame:
    """Artifacts, labels and sub-categories by id; blank label fields don't overwrite. Labels without an artifact stay, unless ``orphans`` is false."""
    fields = [c for c in CLASS_COLUMNS if c in labels.columns]
    renamed = labels.select(F.col("row_id").alias("artifact_id"), *[F.col(c).alias(f"_{c}") for c in fields])
    out = artifacts.join(renamed, "artifact_id", "full_outer" if orphans else "left")
    out = out.withColumns({c: filled(F.col(f"_{c}"), F.col(c)) if c in artifacts.columns else F.col(f"_{c}") for c in fields}).drop(*[f"_{c}" for c in fields])
    if subcategories is None:
        return out
    named = subcategories.select(F.col("row_id").alias("artifact_id"), F.col("sub_category").alias("_sub"))
    current = F.col("sub_category") if "sub_category" in out.columns else F.lit(None).cast("string")
    return out.join(named, "artifact_id", "left").withColumn("sub_category", filled(F.col("_sub"), current)).drop("_sub")


def pending(rows: DataFrame, done: DataFrame, key: str, done_key: str) -> DataFrame:
    return rows.join(done.select(F.col(done_key).alias(key)), key, "left_anti")


def resumed(rows: DataFrame, done: DataFrame, key: str, done_key: str) -> DataFrame:
    return rows.join(done.select(F.col(done_key).alias(key)), key, "left_semi")


def subcategory_candidates(labelled: DataFrame) -> DataFrame:
    """Rows that still want a sub-category: none yet, a known category, a reason."""
    none = F.coalesce(F.trim("sub_category"), F.lit("")) == "" if "sub_category" in labelled.columns else F.lit(True)
    return labelled.filter(none & F.col("bucket_number").isin(*V.SUBCATEGORIES) & (F.trim("rationale") != ""))


def second_pass_candidates(labelled: DataFrame) -> DataFrame:
    return labelled.filter((F.lower(F.trim("confidence")) == "low") & (F.coalesce(F.col("llm_pass"), F.lit(1)) == 1))


def include_list(df: DataFrame, column: str, names: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows whose ``column`` is one of ``names``, in any case and with outer blanks, and the names that no row has."""
    wanted = {n.strip().lower(): n for n in names if n.strip()}
    rows = df.filter(F.lower(F.trim(column)).isin(*wanted) if wanted else F.lit(False))
    found = {r[0] for r in rows.select(F.lower(F.trim(column))).distinct().collect()}  # at most the names
    return rows, [n for key, n in wanted.items() if key not in found]


def taxonomy(df: DataFrame) -> DataFrame:
    """bucket_number, label, ordinal."""
    return df.sparkSession.createDataFrame([(b, name, i) for b, names in V.SUBCATEGORIES.items() for i, name in enumerate(names)], "bucket_number int, label string, ordinal int")


def normalized_subcategory(df: DataFrame, bucket: str, raw: str, out: str) -> DataFrame:
    """The label of the category that equals ``raw``, in any case, else the category's last one; null without a category."""
    labels = F.broadcast(taxonomy(df))  # 108 rows
    named = labels.select(F.col("bucket_number").alias("_b"), F.lower("label").alias("_l"), F.col("label").alias("_label"))
    last = F.create_map(*[x for b, names in V.SUBCATEGORIES.items() for x in (F.lit(b), F.lit(names[-1]))])
    met = df.join(named, (F.col(bucket) == F.col("_b")) & (F.lower(F.trim(raw)) == F.col("_l")), "left")
    return met.withColumn(out, F.coalesce("_label", last[F.col(bucket)])).drop("_b", "_l", "_label")


def resolve_shortcuts(scan: DataFrame) -> DataFrame:
    """Shortcuts with what they point to: drive_file_id, target_id, target_name, target_mime, status (ok, no_target, missing, folder, chained)."""
    at = F.unix_micros(instant(F.col("modified_time"))).alias("at")  # spellings and offsets differ, so the text has no order
    state = last_wins(scan.filter(F.col("drive_file_id").isNotNull()).select("drive_file_id", "name", "mime_type", "is_folder", "is_shortcut", "shortcut_target_id", at), "drive_file_id", "at")
    target = state.select(F.col("drive_file_id").alias("target_id"), F.col("name").alias("target_name"), F.col("mime_type").alias("target_mime"), F.col("is_folder").alias("_folder"), F.col("is_shortcut").alias("_shortcut"))
    links = state.filter("is_shortcut").select("drive_file_id", F.col("shortcut_target_id").alias("target_id"))
    status = F.when(F.coalesce(F.col("target_id"), F.lit("")) == "", "no_target").when(F.col("_folder").isNull(), "missing").when(F.col("_folder"), "folder").when(F.col("_shortcut"), "chained").otherwise("ok")
    return links.join(target, "target_id", "left").select("drive_file_id", "target_id", "target_name", "target_mime", status.alias("status"))


def first_match(df: DataFrame, text: str, needles: DataFrame, out: str, limit: int = 10_000) -> DataFrame:
    """The label of the first needle, by ``ord``, that occurs in the text, for needles that are a table (needle, label, ord).

    At most ``limit`` needles become one ordered CASE, so that rows are tested where they are, without a join.
    """
    rows = needles.orderBy("ord").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} needles")
    low = F.lower(F.col(text))
    case = reduce(lambda c, r: c.when(low.contains(r["needle"].lower()), r["label"]), rows[1:], F.when(low.contains(rows[0]["needle"].lower()), rows[0]["label"])) if rows else F.lit(None).cast("string")
    return df.withColumn(out, case)
