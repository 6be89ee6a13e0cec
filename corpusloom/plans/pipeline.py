"""The inventory pipeline as one plan: artifacts to evidence, labels, enrichment and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.classify import Classifier, logged, offline, subcategories, two_pass
from corpusloom.functions import html, signals, text
from corpusloom.functions.archives import archive_counts, archive_layout, archive_text
from corpusloom.functions.summary import folded, summary
from corpusloom.io import materialize
from corpusloom.operators import merge, rollup
from corpusloom.sinks.workbook import tabs

#: Characters of the text that signals look at, and of the snippet that is kept.
HEAD, SNIPPET = 4000, 800


def _plain() -> Column:
    """The content as text; bytes that aren't UTF-8, as in office files, become replacement characters and no error."""
    return F.make_valid_utf8(F.col("content").cast("string"))


def full_text(files: DataFrame) -> DataFrame:
    """``files`` (filename, extension, content) with ``full_text``: by kind of file; media have the stem of their name; null if unreadable."""
    e, plain = F.col("extension"), _plain()
    stem = F.regexp_replace("filename", r"(?<=.)\.[^.]*$", "")
    body = (
        F.when(signals.is_title_only(e), stem).when(e.isin("html", "htm"), html.main_text(plain)).when(e.isin("docx", "pptx", "xlsx", "xlsm"), archive_text("content", "extension"))
        .when(e.isin("txt", "md", "rst", "log", "csv", "tsv", "json", "yaml", "yml", "xml", "toml", *signals.V.CODE), plain)
    )
    return files.withColumn("full_text", body)


def content_inventory(files: DataFrame) -> Column:
    """The cell of counts for a row with extension and content."""
    e, plain = F.col("extension"), _plain()
    pair = lambda *x: F.create_map(*[v for k, n in x for v in (F.lit(k), n.cast("long"))])
    picture = F.when(e.isin("jpg", "jpeg"), "jpeg").when(e.isin("png", "gif", "svg", "webp"), e).when(e.isin("bmp", "tif", "tiff"), "bmp").otherwise("other_image")
    counts = (
        F.when(e.isin(signals.V.IMAGE), F.create_map(F.lit("images"), F.lit(1).cast("long"), picture, F.lit(1).cast("long"))).when(e.isin(signals.V.AUDIO_VIDEO), pair(("video_audio", F.lit(1))))
        .when(e.isin("html", "htm"), html.content_counts(plain)).when(e.isin("docx", "pptx", "xlsx"), archive_counts("content", "extension")).when(e.isin("csv", "tsv"), pair(("rows", text.delimited_rows(plain))))
    )
    return F.coalesce(html.counts_cell(counts), F.lit(""))


def evidence(files: DataFrame, whole: bool = False) -> DataFrame:
    """Evidence of files that were read: artifact_id, path, filename, extension, size_bytes, modified_time_unix, source_guess, content.

    Personal data is looked for in the first HEAD characters, or with ``whole`` in all of the text.
    """
    read = full_text(files)
    head = F.when(F.length("full_text") > HEAD, F.concat(F.substring("full_text", 1, HEAD), F.lit("\n…(truncated)…"))).otherwise(F.col("full_text"))
    words = text.word_count(F.col("full_text"))
    pii = signals.pii_types(F.col("full_text" if whole else "_head"))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    plain = _plain()
    embedded = F.col("extension").isin("html", "htm") & html.has_picture(plain) | F.col("content_inventory").rlike(r"(^|; )images: ")
    return (
        read.withColumn("_head", head).withColumn("word_count", words).withColumn("content_inventory", content_inventory(read)).withColumn("_layout", archive_layout("content", "extension"))
        .withColumns({
            "snippet": F.coalesce(F.substring("_head", 1, SNIPPET), F.lit("")), "pii_types": F.array_join(pii, ", "), "pii_flag": F.when(F.size(pii) > 0, "Yes").otherwise("No"),
            "token_count": F.coalesce(text.token_estimate(F.col("full_text")), F.lit(0).cast("long")), "page_count": text.page_count(F.col("extension"), F.col("word_count"), *[F.col(f"_layout.{x}") for x in ("units", "pictures", "picture_height")]),
            "modality": signals.joined(signals.modalities(F.col("extension"), embedded)), "_path": folded(F.concat_ws("/", folder, "filename")), "_text": folded(F.col("_head")),
        })
        .withColumn("content_summary", summary(F.col("filename"), folder, F.col("extension"), F.col("_head"), F.col("_path"), F.col("_text")))
        .drop("_head", "_path", "_text", "_layout", "content", "full_text")
    )


def metadata_evidence(scan: DataFrame, max_download: int | None = None) -> DataFrame:
    """Evidence of listed files whose bytes aren't read: folders and shortcuts left out, with the reason; files above ``max_download`` bytes keep their metadata only."""
    mime, size = F.col("mime_type"), F.col("size_bytes")
    reason = F.when(signals.is_binary(mime), "binary_skip").when(signals.is_large_sheet(mime, size), "large_sheet_skip").when(size > F.lit(max_download), "size_skip").otherwise("read")
    return scan.filter(~F.coalesce(F.col("is_folder"), F.lit(False)) & ~F.coalesce(F.col("is_shortcut"), F.lit(False))).select(
        "drive_file_id", "path", F.col("name").alias("filename"), signals.canonical_extension(F.col("name"), mime).alias("extension"), size.alias("size_bytes"), signals.unix_seconds(F.col("modified_time")).alias("modified_time_unix"),
        signals.source_system(F.col("path"), "Google Drive").alias("source_guess"), signals.joined(signals.mime_modalities(mime)).alias("modality"), reason.alias("strategy"), "owner_email", "last_modified_by",
        F.concat(F.lit("https://drive.google.com/file/d/"), F.col("drive_file_id")).alias("drive_url"),
    )


def mail_evidence(messages: DataFrame, whole: bool = False) -> DataFrame:
    """Evidence of message bodies: kind eml, modality text, an empty inventory. ``whole`` as in ``evidence``."""
    body = F.coalesce(F.col("body_text"), F.lit(""))
    pii = signals.pii_types(body if whole else F.substring(body, 1, HEAD))
    return messages.select(
        "message_id", "thread_id", F.concat(F.lit("gmail/"), F.coalesce("user_email", F.lit("")), F.lit("/"), "message_id").alias("path"), F.concat(F.coalesce("subject", F.lit("")), F.lit(".eml")).alias("filename"), F.lit("eml").alias("extension"),
        F.col("size_estimate").alias("size_bytes"), F.col("date_unix").alias("modified_time_unix"), F.lit("Gmail").alias("source_guess"), F.substring(body, 1, SNIPPET).alias("snippet"), F.array_join(pii, ", ").alias("pii_types"), F.when(F.size(pii) > 0, "Yes").otherwise("No").alias("pii_flag"),
        text.word_count(body).alias("word_count"), text.token_estimate(body).alias("token_count"), F.lit("text").alias("modality"), F.lit("").alias("content_inventory"),
    )


def enriched(rows: DataFrame) -> DataFrame:
    """``rows`` with content type, fallback sub-category and quality tier."""
    c = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    types = signals.content_types(*[F.coalesce(c(x), F.lit("")) for x in ("rationale", "content_summary", "snippet", "filename", "path")])
    last = F.create_map(*[x for b, names in signals.V.SUBCATEGORIES.items() for x in (F.lit(b), F.lit(names[-1]))])
    tier = signals.quality_tier(F.col("token_count"), F.col("word_count"), signals.tags(c("modality")), F.col("_types"), c("extension"), c("confidence"))
    return rows.withColumn("_types", types).withColumn("content_type", signals.joined(F.col("_types"))).withColumn("quality_tier", tier).withColumn("sub_category", merge.filled(c("sub_category"), last[F.col("bucket_number")])).drop("_types")


def with_subcategories(labelled: DataFrame, classifier: Callable[[int, list[dict]], list[dict]]) -> DataFrame:
    """``labelled`` where rows that want a sub-category get the classifier's: the label that its answer equals, else the category's last one."""
    asked = materialize(subcategories(merge.subcategory_candidates(labelled), classifier), "subcategories")
    buckets = labelled.select(F.col("artifact_id").alias("row_id"), "bucket_number").filter("row_id IS NOT NULL").dropDuplicates(["row_id"])
    named = merge.normalized_subcategory(asked.join(buckets, "row_id"), "bucket_number", "sub_category", "_named").select(F.col("row_id").alias("artifact_id"), "_named")
    current = F.col("sub_category") if "sub_category" in labelled.columns else F.lit(None).cast("string")
    return labelled.join(named.dropDuplicates(["artifact_id"]), "artifact_id", "left").withColumn("sub_category", merge.filled(current, F.col("_named"))).drop("_named")


def build(
    rows: DataFrame, labels: DataFrame | None = None, fast: Classifier = offline, full: Classifier = offline, subcategory: Callable[[int, list[dict]], list[dict]] | None = None, log: str | None = None
) -> dict[str, DataFrame]:
    """All tables of the inventory from evidence: known labels are kept, the rest is classified.

    ``subcategory``: a classifier for the sub-categories; without it each row gets its category's last one. ``log``: where
    labels are kept as they are made, so that a run that was broken off goes on from there.
    """
    todo = merge.pending(rows, labels, "artifact_id", "row_id") if labels is not None and log else rows
    new = logged(todo, log, fast, full) if log else two_pass(rows, labels, fast, full)
    known = new if labels is None else labels.select(new.columns).unionByName(new)
    labelled = merge.label(rows, known)
    labelled = enriched(with_subcategories(labelled, subcategory) if subcategory else labelled)
    return tabs(labelled, rollup.inventory(rollup.bucket_profile(labelled)).drop("bucket_number"), rollup.overview(labelled)) | {"labelled": labelled}
