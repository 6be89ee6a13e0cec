"""Text measures as column expressions: normalised text, words, tokens, pages, cuts."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pictographs that count as blanks.
EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}]+"
#: Words on a page of plain text, of a document with figures, of a short and of a long prose document; from how many words a document is long.
WORDS_PER_PAGE, DOCUMENT_PAGE, PROSE_PAGE, LONG_PROSE_PAGE, LONG_PROSE = 275, 120, 141, 180, 4000
#: Fixed value: English metric units of picture height that fill a page.
PICTURE_PAGE = 12_374_880
#: Upper bounds of the word tiers.
WORD_TIERS = [("lt100", 100), ("100_499", 500), ("500_1499", 1500), ("1500_2499", 2500)]


@F.pandas_udf(T.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition; there is no such function in Spark."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def json_pretty(text: pd.Series) -> pd.Series:
    """Indented JSON; text that isn't JSON stays as it is."""

    def one(t: str) -> str:
        try:
            return json.dumps(json.loads(t), indent=2, ensure_ascii=False)
        except ValueError:
            return t

    return text.map(one, na_action="ignore")


def safe_path(path: Column) -> Column:
    """A relative path without steps upwards, drive letters or a leading slash."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..") & ~p.rlike("^[A-Za-z]:$")), "/")


def numbered_name(name: Column, place: Column) -> Column:
    """A name met before in a folder gets its place in brackets before the suffix; place 0 keeps it."""
    suffix = F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    return F.when(place <= 0, name).otherwise(F.concat(stem, F.lit(" ("), place.cast("string"), F.lit(")"), suffix))


def normalized(text: Column) -> Column:
    """Pictographs become blanks, compatibility forms are composed, words broken at a line end are joined, invisible characters go.

    Plain ASCII texts, which none of this but the joining concerns, reach the Arrow function as nulls.
    """
    special = F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(text, EMOJI, " "))
    t = F.coalesce(compatible(special), text)
    t = F.regexp_replace(t, "\\x{FE0F}", "")
    t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(t, r"([a-z])\n([a-z])", "$1$2")
    t = F.regexp_replace(t, r"([A-Z])\n([A-Z])", "$1$2")
    return F.regexp_replace(F.regexp_replace(t, "\r", "\n"), "[\\x{00AD}\\x{200B}]", "")


def word_count(text: Column) -> Column:
    """Runs of anything but white space in the normalised text; a null text has none."""
    return F.coalesce(F.size(F.regexp_extract_all(normalized(text), F.lit(r"(?U)(\S+)"), F.lit(1))), F.lit(0)).cast("long")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters; blank texts have none."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(0)).otherwise(F.floor(F.length(text) / 4)).cast("long")


def pages(words: Column, per_page: int | Column = WORDS_PER_PAGE) -> Column:
    per = F.lit(per_page) if isinstance(per_page, int) else per_page
    return F.when(words <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor((words + per - 1) / per))).cast("long")


def page_count(extension: Column, words: Column, units: Column | None = None, pictures: Column | None = None, picture_height: Column | None = None) -> Column:
    """Pages by kind of file. ``units``: slides, sheets or PDF pages, where known; pictures and their summed height of documents."""
    units = F.lit(None).cast("long") if units is None else units
    pictures = F.lit(0) if pictures is None else F.coalesce(pictures, F.lit(0))
    height = F.lit(0) if picture_height is None else F.coalesce(picture_height, F.lit(0))
    stacked = F.ceil(height / PICTURE_PAGE)
    extra = F.when(height <= 0, 0).when(pictures <= 1, F.greatest(F.lit(0), stacked - 1)).otherwise(stacked)
    prose = pages(words, F.when(words >= LONG_PROSE, F.lit(LONG_PROSE_PAGE)).otherwise(F.lit(PROSE_PAGE)))
    e = F.lower(extension)
    return (
        F.when(e.isin("pdf", "pptx", "xlsx", "xlsm", "xls") & (units > 0), units)
        .when(e == "docx", F.when(pictures == 0, prose).otherwise(pages(words, DOCUMENT_PAGE) + extra))
        .when(e.isin("html", "htm"), pages(words, DOCUMENT_PAGE))
        .otherwise(pages(words))
        .cast("long")
    )


def word_tier(words: Column) -> Column:
    tier = F.when(words < WORD_TIERS[0][1], WORD_TIERS[0][0])
    for name, below in WORD_TIERS[1:]:
        tier = tier.when(words < below, name)
    return tier.otherwise("ge2500")


def truncated(text: Column, limit: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def human_size(size: Column) -> Column:
    """Bytes with a unit; unknown and negative sizes are empty."""
    out = F.when(size.isNull() | (size < 0), F.lit("")).when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B")))
    for i, unit in enumerate(["KB", "MB", "GB"], 1):
        out = out.when(size < 1024 ** (i + 1), F.concat(F.format_string("%.1f", F.bround(size / float(1024**i), 1)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(size / float(1024**4), 1)), F.lit(" TB")))


def delimited_rows(text: Column, first: int = 5_000_000) -> Column:
    """Physical lines of the first bytes of a delimited file; a last line end begins no line."""
    lines = F.split(F.regexp_replace(F.substring(text, 1, first), "\r\n?", "\n"), "\n")
    return F.when(F.trim(text) == "", F.lit(0)).otherwise(F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)).cast("long")


def scrubbed(text: Column) -> Column:
    """Without the control characters that sheets can't hold."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def compact(text: Column, limit: int) -> Column:
    """One line of at most ``limit`` characters, cut at a blank if that keeps most of it."""
    one = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, EMOJI, " "), "[\\x{00AD}\\x{200B}\\x{FE0F}]", ""), r"(?U)\s+", " "))
    cut = limit - 3
    head = F.substring(one, 1, cut)
    at = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    return F.when(F.length(one) <= limit, one).when(at >= max(20, int(cut * 0.6)), F.concat(F.rtrim(F.substring(one, F.lit(1), at)), F.lit("..."))).otherwise(F.concat(F.rtrim(head), F.lit("...")))
