"""Signals of an artifact as column expressions: kinds, sources, personal data, content types, usefulness."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import vocab as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once for each row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _labels(tests: list[tuple[str, Column]]) -> Column:
    """The labels whose test holds, in their order."""
    return F.filter(F.array(*[F.when(test, F.lit(label)) for label, test in tests]), lambda x: x.isNotNull())


def joined(labels: Column, by: str = "; ") -> Column:
    return F.array_join(labels, by)


def tags(cell: Column) -> Column:
    """The labels of a cell: split at ; or , and trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def extension(filename: Column) -> Column:
    """The lower-case suffix without its dot; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(filename, r"[^.]\.([^.]+)$", 1))


def canonical_extension(filename: Column, mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.MIME_EXTENSION.items() for x in pair])
    return F.coalesce(F.nullif(extension(filename), F.lit("")), table[mime], F.lit(""))


def local_suffix(filename: Column, mime: Column) -> Column:
    """The suffix under which a file is stored to be read: that of the export, else its own, else of its MIME type."""
    e = F.nullif(extension(filename), F.lit(""))
    export = F.create_map(*[F.lit(x) for pair in V.EXPORTS.items() for x in pair])[mime]
    return (
        F.when(export == "text/plain", F.when(e.isin("txt", "md", "csv"), e).otherwise("txt"))
        .when(export == "text/csv", "csv").when(export == "image/png", "png").when(e.isNotNull(), e)
        .when(mime == "image/jpeg", "jpg").when(mime == "image/png", "png").otherwise("bin")
    )


def source_system(path: Column, default: str | None = None) -> Column:
    """The first hint, in their order, that occurs in the path: one pass of ordered tests."""
    low = F.lower(path)
    out = reduce(lambda c, hint: c.when(low.contains(hint[0]), hint[1]), V.SOURCE_HINTS[1:], F.when(low.contains(V.SOURCE_HINTS[0][0]), V.SOURCE_HINTS[0][1]))
    return out.otherwise(F.lit(default).cast("string"))


def modalities(ext: Column, embedded: Column | None = None) -> Column:
    """The sorted modality labels of an extension; ``embedded``: whether the file holds pictures."""
    e, has = F.lower(ext), F.lit(False) if embedded is None else F.coalesce(embedded, F.lit(False))
    image, media = e.isin(V.IMAGE), e.isin(V.AUDIO_VIDEO)
    code, tabular, structured, slides = e.isin(V.CODE), e.isin(V.TABULAR), e.isin(V.STRUCTURED), e == "pptx"
    holder = e.isin("xlsx", "xlsm", "xls", "pptx", "pdf", "docx", "html", "htm")
    text = code | slides | e.isin("pdf", "docx", "html", "htm") | e.isin(V.TEXT) | ~(tabular | structured)
    alone = image | media
    return F.when(image, F.array(F.lit("image"))).when(media, F.array(F.lit("audio_video"))).otherwise(
        _labels([("code", code), ("slides", slides), ("structured_data", structured), ("tabular", tabular), ("text", text & ~alone), ("visual_embedded", holder & has)])
    )


def mime_modalities(mime: Column) -> Column:
    table = F.create_map(*[x for k, v in V.MIME_MODALITY.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in v]))])
    return F.coalesce(table[mime], F.when(mime.startswith("image/"), F.array(F.lit("image"))).when(mime.startswith("video/") | mime.startswith("audio/"), F.array(F.lit("audio_video"))), F.array().cast("array<string>"))


def is_binary(mime: Column) -> Column:
    return F.coalesce(mime.isin(V.BINARY) | _any([mime.startswith(p) for p in V.BINARY_PREFIXES]), F.lit(False))


def is_large_sheet(mime: Column, size: Column) -> Column:
    return F.coalesce(mime.isin(V.SHEETS) & (size > V.SHEET_BYTES), F.lit(False))


def is_title_only(ext: Column) -> Column:
    return F.coalesce(F.lower(ext).isin(V.TITLE_ONLY), F.lit(False))


def native_kind(mime: Column, size: Column) -> Column:
    """gsheets, gdocs, gslides, binary for anything with a size, else null."""
    table = F.create_map(*[F.lit(x) for pair in V.NATIVE.items() for x in pair])
    return F.coalesce(table[mime], F.when(size > 0, F.lit("binary")))


def modified_before(modified: Column, cutoff: Column) -> Column:
    """An unknown time counts as before."""
    return F.coalesce(modified < cutoff, F.lit(True))


def instant(text: Column) -> Column:
    """An RFC 3339 instant; without an offset it is UTC; null if unreadable."""
    t = F.upper(F.trim(text))
    return F.try_to_timestamp(F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z"))))


def unix_seconds(text: Column) -> Column:
    return F.coalesce(F.unix_micros(instant(text)) / 1e6, F.lit(0.0))


def safe_size(text: Column) -> Column:
    n = text.cast("string").try_cast("bigint")
    return F.when(n >= 0, n)


def pii_types(text: Column) -> Column:
    """The sorted types that quick patterns find."""
    return _labels([(t, F.coalesce(text.rlike(V.PII_PATTERNS[t]), F.lit(False))) for t in sorted(V.PII_PATTERNS)])


def secret_kind(text: Column) -> Column:
    return F.when(text.rlike(V.PRIVATE_KEY), "private_key").when(text.rlike(V.KUBECONFIG), "kubeconfig")


def content_types(*pieces: Column) -> Column:
    """The labels whose words occur in any of the pieces, else Factual."""
    found = lambda blob: _labels([(label, _any([blob.contains(n) for n in needles])) for label, needles in V.CONTENT_TYPES.items()])
    return let(let(F.lower(F.concat_ws("\n", *pieces)), found), lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("Factual"))))


def quality_tier(tokens: Column, words: Column, modality: Column, content: Column, ext: Column, confidence: Column | None = None) -> Column:
    """High, Medium or Low. ``modality`` and ``content`` are arrays of labels."""
    strong = F.arrays_overlap(content, F.array(*[F.lit(x) for x in V.STRONG_TYPES]))
    facts = F.struct(
        F.coalesce(tokens, F.lit(0)).alias("t"), F.coalesce(words, F.lit(0)).alias("w"), modality.alias("m"), strong.alias("strong"), F.lower(F.coalesce(ext, F.lit(""))).alias("e"),
        (F.lit(False) if confidence is None else F.coalesce(F.lower(F.trim(confidence)) == "low", F.lit(False))).alias("unsure"),
    )
    return let(facts, _tier)


def _tier(x: Column) -> Column:
    t, m, e = x["t"], x["m"], x["e"]
    only = lambda label: (F.size(m) > 0) & (F.size(F.array_except(m, F.array(F.lit(label)))) == 0)
    grid = F.array_contains(m, "tabular") | e.isin(*V.TABULAR, "json")
    score = F.when(t >= 8000, 2).when(t >= 1500, 1).otherwise(0)
    raised = F.when(x["strong"], F.least(F.lit(2), score + 1)).when(grid, F.greatest(F.lit(0), score - 1)).otherwise(score)
    final = F.when(e.isin("html", "htm", "log") & (t < 8000), F.greatest(F.lit(0), raised - 1)).otherwise(raised)
    tiny = (t <= 80) & (only("image") | only("audio_video") | (x["w"] <= 40))
    return let(final, lambda s: F.when(tiny | (s == 0), "Low").when((s == 2) & ~x["unsure"], "High").otherwise("Medium"))


def folder_id(raw: Column) -> Column:
    """The id in a folder's address; the own root folder by any of its names."""
    s = F.trim(raw)
    low = F.lower(s)
    found = F.nullif(F.regexp_extract(s, r"/folders/([A-Za-z0-9_-]+)", 1), F.lit(""))
    return F.when(low.isin("root", "my-drive", "mydrive") | (low.contains("drive.google.com") & low.contains("my-drive")), "root").otherwise(F.coalesce(found, F.substring_index(F.substring_index(s, "?", 1), "/", 1)))


def bucket_name(number: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in V.BUCKETS.items() for x in pair])[number]


def bucket_of_title(title: Column) -> Column:
    """The category whose name, plain or numbered and cut to 31 characters, is the title of a sheet."""
    t = F.trim(title)
    return reduce(lambda c, b: c.when((t == b[1][:31]) | (t == f"{b[0]}. {b[1]}"[:31]), b[0]), list(V.BUCKETS.items())[1:], F.when((t == V.BUCKETS[1][:31]) | (t == f"1. {V.BUCKETS[1]}"[:31]), 1))


def path_prefix(path: Column) -> Column:
    """The folders of a path, at most the last three above the file."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    n = F.size(parts)
    return F.array_join(F.when(n >= 4, F.slice(parts, n - 3, F.lit(3))).otherwise(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0)))), "/")
