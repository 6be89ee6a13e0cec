"""Batch classification with a pluggable classifier, in two passes, with a log that makes it resumable."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import vocab as V
from corpusloom.functions.text import truncated
from corpusloom.io import materialize
from corpusloom.operators.merge import pending, second_pass_candidates
from corpusloom.sinks.workbook import append_log
from corpusloom.sources.files import read_log

#: Rows of one call, characters of a description and of the other fields.
BATCH, DESCRIPTION, FIELD = 25, 1200, 400
LABELS = "row_id long, bucket_number int, bucket_name string, confidence string, rationale string, llm_pass int"


class Classifier(Protocol):
    """Given items (dicts with row_id, description, ...), returns dicts with row_id, bucket_number, confidence, rationale."""

    def __call__(self, items: list[dict]) -> list[dict]: ...


def offline(items: list[dict]) -> list[dict]:
    """A stand-in without a model: the same answer for the same text, by a checksum. Never a measure of quality."""
    out = []
    for item in items:
        h = sum(map(ord, f"{item.get('filename')} {item.get('description')}"))
        out.append({"row_id": item["row_id"], "bucket_number": h % 7 + 1, "confidence": ("high", "medium", "low")[h % 3], "rationale": f"checksum {h % 1000}"})
    return out


def retried(call: Callable[[], list[dict]], attempts: int = 8, base: float = 0.75, most: float = 90.0, retryable: type[Exception] | tuple = (ConnectionError, TimeoutError), sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """Doubling pauses with a quarter of jitter, capped."""
    for n in range(attempts + 1):
        try:
            return call()
        except retryable:
            if n == attempts:
                raise
            pause = base * 2**n
            sleep(min(most, pause + random.uniform(0, pause / 4)))
    return []


def payload(evidence: DataFrame) -> DataFrame:
    """What a classifier sees of an artifact."""
    description = F.concat_ws(" | ", F.col("content_summary"), F.col("snippet"))
    cut = {c: truncated(F.col(c), FIELD) for c in ("filename", "extension", "path", "snippet")}
    return evidence.select(F.col("artifact_id").alias("row_id"), truncated(description, DESCRIPTION).alias("description"), F.col("source_guess").alias("source"), *[v.alias("path_hint" if k == "path" else k) for k, v in cut.items()])


def valid(answers: list[dict], asked: set[int], llm_pass: int) -> list[tuple]:
    """Answers to asked rows with a category that exists; an unknown confidence is low; of several for a row the last."""
    kept = {}
    for a in answers:
        try:
            row, bucket = int(a["row_id"]), int(a["bucket_number"])
        except (KeyError, TypeError, ValueError):
            continue
        if row in asked and bucket in V.BUCKETS:
            sure = str(a.get("confidence") or "").strip().lower()
            kept[row] = (row, bucket, V.BUCKETS[bucket], sure if sure in ("high", "medium", "low") else "low", str(a.get("rationale") or ""), llm_pass)
    return list(kept.values())


def answered(call: Callable[[], list[dict]]) -> list[dict]:
    """The answers of a call with its retries; none if it fails for good: its rows stay pending and are asked again by the next run."""
    try:
        return retried(call)
    except Exception:  # noqa: BLE001
        return []


def classify(items: DataFrame, classifier: Classifier = offline, llm_pass: int = 1, batch: int = BATCH) -> DataFrame:
    """A label for each item that the classifier answers; calls of ``batch`` rows, across the rows of a task. Failing batches give none."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[dict] = []

        def flush(rows: list[dict]) -> pd.DataFrame:
            answers = answered(lambda: classifier(rows))
            return pd.DataFrame(valid(answers, {r["row_id"] for r in rows}, llm_pass), columns=["row_id", "bucket_number", "bucket_name", "confidence", "rationale", "llm_pass"])

        for pdf in it:
            waiting += pdf.astype(object).where(pdf.notna(), None).to_dict("records")
            while len(waiting) >= batch:
                yield flush(waiting[:batch])
                waiting = waiting[batch:]
        if waiting:
            yield flush(waiting)

    return items.mapInPandas(run, LABELS)


def two_pass(evidence: DataFrame, done: DataFrame | None = None, fast: Classifier = offline, full: Classifier = offline) -> DataFrame:
    """Labels of all rows that ``done`` lacks by the fast classifier, then of the unsure ones by the full one, which replaces."""
    todo = pending(evidence, done, "artifact_id", "row_id") if done is not None else evidence
    first = materialize(classify(payload(todo), fast, 1), "first")
    unsure = second_pass_candidates(first).select(F.col("row_id").alias("artifact_id"))
    second = materialize(classify(payload(todo.join(unsure, "artifact_id", "left_semi")), full, 2), "second")
    return first.join(second.select("row_id"), "row_id", "left_anti").unionByName(second)


def logged(evidence: DataFrame, log: str, fast: Classifier = offline, full: Classifier = offline, rows: int = 100_000) -> DataFrame:
    """The labels of ``evidence`` through an append-only log: what the log has isn't asked again, the rest is asked in parts of about
    ``rows`` rows, each logged as a whole as soon as it is done. A run that ends half way loses the part it was in; the next one
    goes on from the log.
    """
    spark = evidence.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    known = lambda: read_log(spark, log, LABELS, "row_id") if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
    done = known()
    todo = materialize(pending(evidence, done, "artifact_id", "row_id") if done is not None else evidence, "todo")
    n = todo.count()
    parts = -(-n // rows)
    for part in range(parts):
        append_log(two_pass(todo.filter(F.pmod(F.xxhash64("artifact_id"), F.lit(parts)) == part), None, fast, full), log)
    done = known()
    return done if done is not None else spark.createDataFrame([], LABELS)


def subcategories(candidates: DataFrame, classifier: Callable[[int, list[dict]], list[dict]], batch: int = 50) -> DataFrame:
    """row_id, sub_category (raw): batches within a category, made by sorting each task's rows, so that no category is one task.

    Calls are retried; failing ones give nothing. Of the answers only those to asked rows count, the last of a row.
    """

    def ask(bucket: int, rows: list[dict]) -> pd.DataFrame:
        asked = {int(r["row_id"]) for r in rows}
        found = {}
        for a in answered(lambda: classifier(bucket, rows)):
            try:
                row, name = int(a["row_id"]), str(a["sub_category"] or "").strip()
            except (KeyError, TypeError, ValueError):
                continue
            if row in asked and name:
                found[row] = name
        return pd.DataFrame(list(found.items()), columns=["row_id", "sub_category"])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[dict]] = {}
        for pdf in it:
            for row in pdf.to_dict("records"):
                rows = waiting.setdefault(int(row["bucket_number"]), [])
                rows.append(row)
                if len(rows) == batch:
                    yield ask(int(row["bucket_number"]), waiting.pop(int(row["bucket_number"])))
        for bucket, rows in waiting.items():
            yield ask(bucket, rows)

    return candidates.select(F.col("artifact_id").alias("row_id"), "bucket_number", "rationale", "filename").mapInPandas(run, "row_id long, sub_category string")


def offline_subcategory(bucket: int, rows: list[dict]) -> list[dict]:
    names = V.SUBCATEGORIES[bucket]
    return [{"row_id": r["row_id"], "sub_category": names[sum(map(ord, str(r["rationale"]))) % len(names)]} for r in rows]
