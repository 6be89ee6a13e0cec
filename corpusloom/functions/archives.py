"""Office files as zip archives of XML: counts and text, by Arrow functions over the bytes."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.files import sheet_rows

#: Fixed value: bytes from which a worksheet counts as one with data.
DATA_SHEET = 1500
_WORD, _DRAWN = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
_MEDIA = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "webp": "webp", "svg": "svg", "bmp": "bmp", "tif": "bmp", "tiff": "bmp"}


def counts(data: bytes | None, kind: str) -> dict[str, int]:
    """Pictures by format, charts, tables, slides or worksheets of a docx, pptx or xlsx file; nothing if it can't be read."""
    out: dict[str, int] = {}

    def add(name: str, n: int = 1) -> None:
        out[name] = out.get(name, 0) + n

    try:
        with zipfile.ZipFile(io.BytesIO(bytes(data or b""))) as z:
            base = {"docx": "word", "pptx": "ppt", "xlsx": "xl"}[kind]
            for info in z.infolist():
                name = info.filename
                if name.startswith(f"{base}/media/"):
                    add("images")
                    add(_MEDIA.get(name.rpartition(".")[2].lower(), "other_image"))
                elif re.match(rf"{base}/charts/chart\d*\.xml$", name):
                    add("charts")
                elif kind == "docx" and name == "word/document.xml":
                    add("tables", len(re.findall(rb"<w:tbl[ >]", z.read(name))))
                elif kind == "pptx" and re.match(r"ppt/slides/slide\d+\.xml$", name):
                    add("slides")
                    add("tables", len(re.findall(rb"<a:tbl[ >]", z.read(name))))
                elif kind == "xlsx" and re.match(r"xl/worksheets/sheet\d+\.xml$", name):
                    add("worksheets")
                    add("data_sheets", int(info.file_size >= DATA_SHEET))
                elif kind == "xlsx" and re.match(r"xl/tables/table\d+\.xml$", name):
                    add("tables")
    except (zipfile.BadZipFile, KeyError, OSError, RuntimeError):
        return {}
    return {k: v for k, v in out.items() if v}


def layout(data: bytes | None, kind: str) -> tuple[int | None, int, int]:
    """What pages are counted by: slides of a pptx or sheets of an xlsx or xlsm file, else null; pictures in the lines of a docx file and their summed height."""
    try:
        with zipfile.ZipFile(io.BytesIO(bytes(data or b""))) as z:
            if kind == "docx":
                extents = [e.find(f"{_DRAWN}extent") for e in ElementTree.fromstring(z.read("word/document.xml")).findall(f".//{_WORD}p/{_WORD}r/{_WORD}drawing/{_DRAWN}inline")]
                return None, len(extents), sum(int(e.get("cy") or 0) for e in extents if e is not None)
            if kind == "pptx":
                return sum(e.tag.endswith("}sldId") for e in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter()), 0, 0
            names, links = set(z.namelist()), {r.get("Id"): r.get("Target") or "" for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            sheets = [links.get(v, "") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if e.tag.endswith("}sheet") for k, v in e.attrib.items() if k.endswith("}id")]
            return sum((t.lstrip("/") if t.startswith("/") else f"xl/{t}") in names for t in sheets), 0, 0
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, OSError, RuntimeError, ValueError):
        return None, 0, 0


def text(data: bytes | None, kind: str) -> str | None:
    """The text of a docx, pptx or xlsx file; null if it can't be read."""
    try:
        if kind in ("xlsx", "xlsm"):
            return "\n".join(f"# {name}\n" + "\n".join("\t".join(r) for r in rows) for name, rows in sheet_rows(bytes(data)).items())
        with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
            names = ["word/document.xml"] if kind == "docx" else sorted((n for n in z.namelist() if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
            paragraphs = []
            for name in names:
                for e in ElementTree.fromstring(z.read(name)).iter():
                    if e.tag.rpartition("}")[2] == "p":
                        paragraphs.append("".join("\t" if x.tag.endswith("}tab") else x.text or "" for x in e.iter() if x.tag.rpartition("}")[2] in ("t", "tab")))
            return "\n".join(p for p in paragraphs if p.strip())
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, OSError, TypeError, RuntimeError):
        return None


@F.pandas_udf(T.MapType(T.StringType(), T.LongType()))
def archive_counts(content: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([counts(c, k) if k in ("docx", "pptx", "xlsx") else {} for c, k in zip(content, kind)])


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("units", "pictures", "picture_height")]))
def archive_layout(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    rows = [layout(c, k) if k in ("docx", "pptx", "xlsx", "xlsm") else (None, 0, 0) for c, k in zip(content, kind)]
    return pd.DataFrame(rows, columns=["units", "pictures", "picture_height"]).astype("Int64")


@F.pandas_udf(T.StringType())
def archive_text(content: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([text(c, k) if c is not None and k in ("docx", "pptx", "xlsx", "xlsm") else None for c, k in zip(content, kind)])
