"""Sinks: workbooks for people, partitioned tables for machines, JSON lines, manifests, copies, documents."""

from __future__ import annotations

import os
import re
import shutil
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import vocab as V
from corpusloom.functions.text import human_size

#: Fixed value: the most rows that one sheet holds; a longer table is for ``write_tabs``.
SHEET_ROWS = 1_048_575
#: Rows of the sample tab; rows whose widths are measured; least and greatest width.
SAMPLE, MEASURED, NARROW, WIDE = 250, 200, 14, 60
_ILLEGAL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def display(evidence: DataFrame) -> DataFrame:
    """The columns shown to people; missing ones are blank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in evidence.columns else F.lit("")
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("bigint"), F.lit(0)) if c in evidence.columns else F.lit(0).cast("long")
    size = human_size(F.col("size_bytes")) if "size_bytes" in evidence.columns else F.lit("")
    shown = {
        "Item Name": text("filename"), "File Type": text("extension"), "Content Summary": text("content_summary"), "PII Flag": text("pii_flag"), "Size": size, "Word Count": number("word_count"), "LLM Tokens": number("token_count"), "Page Count": number("page_count"),
        "Modality": text("modality"), "Content Type": text("content_type"), "Quality tier": text("quality_tier"), "What is contained": text("content_inventory"), "Source": text("source_guess"), "Owner": text("owner_email"), "Last Modified By": text("last_modified_by"),
        "Drive URL": text("drive_url"), "LLM Pass": text("llm_pass"), "Path / Subsection": text("path"), "bucket_number": text("bucket_number"), "bucket_name": text("bucket_name"), "Sub-category": text("sub_category"), "confidence": text("confidence"), "rationale": text("rationale"),
    }
    return evidence.select(*[v.alias(k) for k, v in shown.items()])


def tabs(evidence: DataFrame, inventory: DataFrame | None = None, overview: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of the company workbook by title."""
    shown = display(evidence)
    out = {k: v for k, v in (("Inventory", inventory), ("Overview", overview)) if v is not None}
    out |= {"Evidence": shown, "Sample Files": shown.limit(SAMPLE)}
    for number, name in V.BUCKETS.items():
        title = name[:31]
        out[title if title not in out else f"{number}. {name}"[:31]] = shown.filter(F.col("bucket_number") == str(number))
    flagged = lambda c, v: shown.filter(F.lower(F.trim(F.col(f"`{c}`"))) == v)
    return out | {"Low Confidence": flagged("confidence", "low"), "PII Flagged": flagged("PII Flag", "yes")}


def _letters(i: int) -> str:
    out = ""
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, value: object) -> str:
    if value is None or (isinstance(value, float) and (value != value or value in (float("inf"), float("-inf")))):
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_ILLEGAL.sub("", str(value)))}</t></is></c>'
    return f'<c r="{ref}"><v>{value}</v></c>'


def write_workbook(tables: dict[str, DataFrame], path: str) -> None:
    """One XLSX file on the driver, for people: each table is streamed row by row and must fit a sheet, else ValueError."""
    kind = "http://schemas.openxmlformats.org/"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        titles = list(tables)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{kind}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(titles) + 1)) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{kind}package/2006/relationships"><Relationship Id="r1" Type="{kind}officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{kind}package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{kind}officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(titles) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{kind}spreadsheetml/2006/main" xmlns:r="{kind}officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, t in enumerate(titles, 1)) + "</sheets></workbook>")
        for i, title in enumerate(titles, 1):
            df = tables[title]
            sample = [list(map(str, r)) for r in df.limit(MEASURED).collect()]
            widths = [min(WIDE, max(NARROW, 2 + max([len(c), *(len(r[j]) for r in sample)]))) for j, c in enumerate(df.columns)]
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as out:
                out.write(f'<worksheet xmlns="{kind}spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>'.encode())
                out.write("".join(f'<col min="{j}" max="{j}" width="{w}" customWidth="1"/>' for j, w in enumerate(widths, 1)).encode() + b"</cols><sheetData>")
                for n, row in enumerate([df.columns], 1):
                    out.write(f'<row r="{n}">{"".join(_cell(f"{_letters(j)}{n}", v) for j, v in enumerate(row, 1))}</row>'.encode())
                for n, row in enumerate(df.toLocalIterator(), 2):
                    if n > SHEET_ROWS + 1:
                        raise ValueError(f"{title}: more rows than a sheet holds; write_tabs has no such bound")
                    out.write(f'<row r="{n}">{"".join(_cell(f"{_letters(j)}{n}", v) for j, v in enumerate(row, 1))}</row>'.encode())
                out.write(b"</sheetData></worksheet>")


def write_tabs(tables: dict[str, DataFrame], path: str, format: str = "parquet") -> None:
    """Each table in a folder of its own, of any size."""
    for title, df in tables.items():
        plain = df.toDF(*[re.sub(r"[ ,;{}()\n\t=]+", "_", c) for c in df.columns])
        plain.write.mode("overwrite").format(format).save(os.path.join(path, re.sub(r"\W+", "_", title)))


def write_segmented(evidence: DataFrame, path: str) -> None:
    """One folder for each category, in one write."""
    evidence.repartition("bucket_number", F.pmod(F.xxhash64("artifact_id"), F.lit(16))).write.mode("overwrite").partitionBy("bucket_number").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Appends JSON lines; a batch appears as a whole."""
    df.write.mode("append").json(path)


def snapshot_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def manifest(files: DataFrame, threads: DataFrame, path: str, **facts: object) -> None:
    """Facts, files and threads: JSON lines of each below ``path``, so that a manifest may have any number of entries."""
    files.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/files")
    threads.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/gmail_threads")
    files.sparkSession.createDataFrame([(k, str(v)) for k, v in facts.items()] or [("version", "1")], "name string, value string").write.mode("overwrite").json(f"{path}/facts")


def copy_files(df: DataFrame, source: str, target: str) -> DataFrame:
    """path, status: each file of ``path`` copied from one folder to another, where it isn't there yet with the same size."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path in pdf["path"]:
                a, b = os.path.join(source, path), os.path.join(target, path)
                try:
                    if os.path.exists(b) and os.path.getsize(a) == os.path.getsize(b):
                        rows.append((path, "skipped"))
                        continue
                    os.makedirs(os.path.dirname(b), exist_ok=True)
                    shutil.copyfile(a, f"{b}.part")
                    os.replace(f"{b}.part", b)
                    rows.append((path, "copied"))
                except OSError as e:
                    rows.append((path, f"failed: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["path", "status"])

    return df.select("path").mapInPandas(run, "path string, status string")


def transfer(items: DataFrame, done: DataFrame, key: str, send) -> DataFrame:
    """key, status: ``send(row)`` for each item that isn't done; an item sent twice must do no harm, as tasks may run again."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for row in pdf.to_dict("records"):
                try:
                    send(row)
                    rows.append((row[key], "sent"))
                except Exception as e:  # noqa: BLE001
                    rows.append((row[key], f"failed: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=[key, "status"])

    kind = dict(items.dtypes)[key]
    return items.join(done.select(key), key, "left_anti").mapInPandas(run, f"{key} {kind}, status string")


def docx_bytes(text: str, title: str = "") -> bytes:
    """A plain document: one paragraph for each line, the title as a heading."""
    import io

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    head = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t xml:space="preserve">{escape(_ILLEGAL.sub("", title))}</w:t></w:r></w:p>' if title else ""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(_ILLEGAL.sub("", line))}</w:t></w:r></w:p>' for line in (text or "").splitlines())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{head}{body}</w:body></w:document>')
    return out.getvalue()


def convert_documents(files: DataFrame) -> DataFrame:
    """path, docx, error: html, txt and json files (path, content) as documents; what can't be converted keeps its error."""
    import json

    from corpusloom.functions.html import html_text

    def one(path: str, content: bytes) -> tuple[str, bytes | None, str | None]:
        try:
            text, kind = bytes(content).decode("utf-8", "replace"), path.rpartition(".")[2].lower()
            if kind in ("html", "htm"):
                found = re.search(r"(?is)<title[^>]*>([^<]*)</title>", text)
                return path, docx_bytes(html_text(text), found.group(1).strip() if found else ""), None
            if kind == "json":
                try:
                    text = json.dumps(json.loads(text), indent=2, ensure_ascii=False)
                except ValueError:
                    pass
            return path, docx_bytes(text), None
        except Exception as e:  # noqa: BLE001
            return path, None, f"{type(e).__name__}: {e}"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([one(p, c) for p, c in zip(pdf["path"], pdf["content"])], columns=["path", "docx", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, docx binary, error string")
