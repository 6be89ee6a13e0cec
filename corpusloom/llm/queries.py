"""Queries of the problems and, where SQL can express them on whole tables, the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.io import table, texts
from corpusloom.llm import containers, group_top, mail_layout, mixing, personal_data, quota_sample, shared_spans, subjects, token_budget

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_layout.newly_written(texts(spark, sf_dir, "message", "message_id"))


def _budget(spark: SparkSession, sf_dir: str) -> token_budget.TokenBudget:
    return token_budget.TokenBudget(texts(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "evidence"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budget(spark, sf_dir).misjudged()


def p2_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budget(spark, sf_dir).totals()


def _quota(spark: SparkSession, sf_dir: str) -> quota_sample.QuotaSample:
    return quota_sample.QuotaSample(*(table(spark, sf_dir, name) for name in ("evidence", "classifications", "sample_targets")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir).unmet()


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir).sample()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir).report()


def _subjects(spark: SparkSession, sf_dir: str) -> subjects.Subjects:
    evidence = texts(spark, sf_dir, "evidence", "artifact_id")
    return subjects.Subjects(evidence, *(table(spark, sf_dir, name) for name in ("classifications", "subject_areas", "subject_labels")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).assigned()


def p4_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).composition()


def _personal(spark: SparkSession, sf_dir: str) -> personal_data.PersonalData:
    return personal_data.PersonalData(texts(spark, sf_dir, "message", "message_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).entities()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).rewritten()


def p5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).rewritten(placeholders=False)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_top.top_files(table(spark, sf_dir, "scan_rows")).select("owner_email", "drive_file_id")


def p6_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_top.top_files(table(spark, sf_dir, "scan_rows")).select("owner_email", "rank", "drive_file_id", "size_bytes", "modified")


def _containers(spark: SparkSession, sf_dir: str) -> containers.Containers:
    return containers.Containers(texts(spark, sf_dir, "documents", "doc_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _containers(spark, sf_dir).oversize()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _containers(spark, sf_dir).contents()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _containers(spark, sf_dir).report()


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.Mix(texts(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).unreachable()


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).chosen()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares()


def _spans(spark: SparkSession, sf_dir: str) -> shared_spans.SharedSpans:
    return shared_spans.SharedSpans(texts(spark, sf_dir, "documents", "doc_id"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).pairs()


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).passages()


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).coverage()


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).classes()


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p2_token_budget, p3_found, p3_sample, p3_report, p4_found, p4_composition, p5_found, p5_redacted, p5_surrogates, p6_found, p6_top_files, p7_found, p7_containers, p7_report, p8_found, p8_mix, p8_shares, p9_found, p9_passages, p9_coverage, p9_classes)}

_FILES = """
WITH state AS (
  SELECT drive_file_id, epoch_us(CAST(modified_time AS TIMESTAMPTZ)) AS modified, size_bytes,
         coalesce(is_folder, false) AS is_folder, coalesce(is_shortcut, false) AS is_shortcut, lower(trim(owner_email)) AS owner_email
  FROM scan_rows WHERE drive_file_id IS NOT NULL),
file AS (
  SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY drive_file_id ORDER BY modified DESC NULLS LAST, size_bytes DESC NULLS LAST,
         is_folder DESC, is_shortcut DESC, owner_email DESC NULLS LAST) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY owner_email ORDER BY size_bytes DESC, modified DESC NULLS LAST, drive_file_id) AS rank
  FROM file WHERE NOT is_folder AND NOT is_shortcut AND size_bytes IS NOT NULL AND owner_email <> '')
"""
_ELIGIBLE = """
WITH valid AS (
  SELECT row_id, bucket_number FROM classifications WHERE row_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY log_pos DESC NULLS LAST, bucket_number DESC NULLS LAST) = 1),
eligible AS (
  SELECT artifact_id, bucket_number FROM (SELECT DISTINCT artifact_id FROM evidence) JOIN valid ON row_id = artifact_id WHERE bucket_number BETWEEN 1 AND 7),
had AS (SELECT bucket_number, count(*) AS n FROM eligible GROUP BY ALL),
plan AS (
  SELECT plan_id, bucket_number, coalesce(n, 0) AS eligible, greatest(target_bp::BIGINT * (sample_bp::BIGINT * (SELECT count(*) FROM eligible) // 10000) // 10000, min_rows) AS need
  FROM sample_targets LEFT JOIN had USING (bucket_number))
"""
_WINDOWS = """
WITH windows AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
shared AS (SELECT w.* FROM windows w JOIN (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)) USING (h))
"""
ORACLE: dict[str, str] = {
    # no recorded count lies near the bounds, so characters / 4 decide as tokens do
    "p2_found": """
        SELECT DISTINCT doc_id FROM documents JOIN evidence USING (artifact_id)
        WHERE token_count IS NOT NULL AND (token_count < length(text) / 8.0 OR token_count > length(text) / 2.0)""",
    "p3_found": _ELIGIBLE + "SELECT plan_id, bucket_number FROM plan WHERE eligible < need",
    "p6_found": _FILES + "SELECT owner_email, drive_file_id FROM ranked WHERE rank <= 3",
    "p6_top_files": _FILES + "SELECT owner_email, CAST(rank AS INTEGER) AS rank, drive_file_id, size_bytes, modified FROM ranked WHERE rank <= 3",
    # no document lies near the bound, so characters / 4 decide as tokens do
    "p7_found": "SELECT DISTINCT doc_id FROM documents WHERE length(text) / 4.0 > 3000",
    "p8_found": """
        WITH sized AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS size FROM documents GROUP BY ALL)
        SELECT t.source FROM mix_targets t LEFT JOIN sized s ON s.source = lower(trim(t.source))
        WHERE t.weight_bp / 1e4 * t.total_bp / 1e4 * (SELECT sum(size) FROM sized) > t.max_repeats * coalesce(s.size, 0)""",
    # all windows of 200 characters, by digest
    "p9_found": _WINDOWS + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM shared a JOIN shared b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p9_coverage": _WINDOWS + """,
        spots AS (SELECT doc_id, least(200, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 200)) AS n FROM (SELECT DISTINCT doc_id, i FROM shared)),
        covered AS (SELECT doc_id, sum(n)::BIGINT AS n FROM spots GROUP BY doc_id)
        SELECT d.doc_id, length(d.text) AS n_chars, coalesce(c.n, 0) AS shared_chars, CASE WHEN length(d.text) > 0 THEN round(coalesce(c.n, 0) / length(d.text), 6) ELSE 0.0 END AS share FROM documents d LEFT JOIN covered c USING (doc_id)""",
    "p9_classes": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE length(text) >= 200",
}
