from __future__ import annotations

import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom import vocab as V
from corpusloom.functions import archives, html, mail, signals, summary, text
from corpusloom.sinks.workbook import docx_bytes


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, words",
    [("hello\nworld", 1), ("exam-\nple two", 2), ("A B", 2), ("a b", 2), ("ﬁne", 1), ("a\U0001f600b", 2), ("soft­hyphen", 1), ("", 0), (None, 0), ("HELLO\nWORLD x", 2), ("Mixed\nCase", 2)],
)
def test_words(spark, given, words):
    assert one(spark, text.word_count(F.lit(given).cast("string"))) == words


def test_pages(spark):
    assert [one(spark, text.pages(F.lit(n))) for n in (0, 1, 275, 276)] == [0, 1, 1, 2]
    assert one(spark, text.page_count(F.lit("docx"), F.lit(4000))) == 23
    assert one(spark, text.page_count(F.lit("docx"), F.lit(120), pictures=F.lit(2), picture_height=F.lit(12_374_881))) == 3
    assert one(spark, text.page_count(F.lit("pdf"), F.lit(9999), units=F.lit(7).cast("long"))) == 7


def test_word_tiers(spark):
    assert [one(spark, text.word_tier(F.lit(n))) for n in (0, 99, 100, 499, 500, 1500, 2499, 2500)] == ["lt100", "lt100", "100_499", "100_499", "500_1499", "1500_2499", "1500_2499", "ge2500"]


def test_sizes(spark):
    assert [one(spark, text.human_size(F.lit(n).cast("long"))) for n in (None, -1, 0, 1023, 2304, 13568, 5 * 2**30)] == ["", "", "0 B", "1023 B", "2.2 KB", "13.2 KB", "5.0 GB"]
    assert [one(spark, signals.safe_size(F.lit(x).cast("string"))) for x in ("12", "-1", "x", None)] == [12, None, None, None]


def test_cuts(spark):
    assert one(spark, text.truncated(F.lit("abcdef"), 3)) == "abc…"
    assert one(spark, text.delimited_rows(F.lit("a,b\r\nc\n"))) == 2
    assert one(spark, text.json_pretty(F.lit('{"a":[1]}'))) == '{\n  "a": [\n    1\n  ]\n}' and one(spark, text.json_pretty(F.lit("no"))) == "no"
    assert one(spark, text.safe_path(F.lit("C:\\x/../y//z"))) == "x/y/z"
    assert one(spark, text.numbered_name(F.lit("a.b.txt"), F.lit(2))) == "a.b (2).txt"
    assert one(spark, text.scrubbed(F.lit("a\x00b\tc"))) == "ab\tc"


@pytest.mark.parametrize(
    "tokens, words, modality, content, ext, confidence, tier",
    [
        (50, 20, "text", "Factual", "txt", "high", "Low"), (9000, 5000, "text", "Factual", "pdf", "high", "High"), (9000, 5000, "text", "Factual", "pdf", "low", "Medium"), (2000, 900, "tabular", "Factual", "csv", "high", "Low"),
        (2000, 900, "text", "Narrative", "docx", "high", "High"), (2000, 900, "text", "Factual", "html", "high", "Low"), (60, 50, "image", "Factual", "png", "high", "Low"), (90, 50, "image; text", "Narrative", "png", None, "Medium"),
    ],
)
def test_quality_tier(spark, tokens, words, modality, content, ext, confidence, tier):
    tags = lambda s: signals.tags(F.lit(s))
    assert one(spark, signals.quality_tier(F.lit(tokens), F.lit(words), tags(modality), tags(content), F.lit(ext), F.lit(confidence).cast("string"))) == tier


def test_signals(spark):
    assert [one(spark, signals.extension(F.lit(x))) for x in ("a.PDF", "x.tar.gz", ".bashrc", "noext")] == ["pdf", "gz", "", ""]
    assert one(spark, signals.canonical_extension(F.lit("plan"), F.lit("application/vnd.google-apps.document"))) == "gdoc"
    assert one(spark, signals.local_suffix(F.lit("t"), F.lit("application/vnd.google-apps.spreadsheet"))) == "csv"
    assert one(spark, signals.source_system(F.lit("x/Google Drive/y"))) == "Google Drive"
    assert one(spark, signals.joined(signals.modalities(F.lit("xlsx"), F.lit(True)))) == "tabular; visual_embedded"
    assert one(spark, signals.joined(signals.modalities(F.lit("pptx")))) == "slides; text"
    assert one(spark, signals.joined(signals.modalities(F.lit("py")))) == "code; text"
    assert one(spark, signals.joined(signals.modalities(F.lit("unknown")))) == "text"
    assert one(spark, signals.joined(signals.mime_modalities(F.lit("video/x")))) == "audio_video"
    assert one(spark, signals.joined(signals.content_types(F.lit("the Q3 Postmortem and an INVOICE")))) == "Decision-log; Transactional"
    assert one(spark, signals.joined(signals.content_types(F.lit("zzz")))) == "Factual"
    assert one(spark, signals.joined(signals.pii_types(F.lit("a@b.io +49 123-4567 GB29NWBK60161331926819")))) == "email; iban; phone"
    assert one(spark, signals.secret_kind(F.lit("apiVersion: v1\nfoo\nclusters:"))) == "kubeconfig"
    assert one(spark, signals.folder_id(F.lit("https://drive.google.com/drive/folders/A-b_1?x"))) == "A-b_1"
    assert one(spark, signals.folder_id(F.lit("My-Drive"))) == "root"
    assert one(spark, signals.unix_seconds(F.lit("2024-01-01T01:00:00+01:00"))) == 1704067200.0
    assert one(spark, signals.unix_seconds(F.lit("never"))) == 0.0
    assert one(spark, signals.bucket_of_title(F.lit("4. Financial & Legal"))) == 4


def test_taxonomy_sizes():
    assert [len(V.SUBCATEGORIES[b]) for b in V.BUCKETS] == [24, 14, 13, 15, 14, 15, 13]


def test_summary(spark):
    def of(name, path, ext, snippet):
        return one(spark, summary.summary(F.lit(name), F.lit(path), F.lit(ext), F.lit(snippet), summary.folded(F.lit(f"{path}/{name}")), summary.folded(F.lit(snippet))))

    assert of("a.txt", "x", "txt", "-----BEGIN PRIVATE KEY-----").startswith("WARNING: Private key")
    assert of("KBIS.pdf", "x", "pdf", "") == "French company registration extract (KBIS)."
    assert of("n.txt", "x", "txt", "Lettre de DÉMISSION") == "Employee resignation letter."
    assert of("dsn_03-2024.xml", "x", "xml", "") == "Monthly social declaration (DSN) (03-2024)."
    assert of("movie.mkv", "x", "mkv", "") == "Video file."
    assert of("m.eml", "x", "eml", "hello") == "Email (.eml). Subject: hello"
    assert of("q", "x", "", "") == "Company file."


def test_html(spark):
    page = '<table><IMG SRC="A.PNG?v=1"><img><img src="data:image/jpeg;b"><svg><canvas></table>'
    assert one(spark, html.counts_cell(html.content_counts(F.lit(page)))) == "canvas: 1; images: 3; jpeg: 1; other_image: 1; png: 1; svg: 1; tables: 1"
    assert one(spark, html.title(F.lit("<TITLE> a </TITLE>"), "z")) == "a"
    assert one(spark, html.best_source(F.lit("a 1x, b 3x, c 3x"))) == "b"
    assert one(spark, html.style_map(F.lit("a: 1; A: 2; b:c:d"))) == {"a": "2", "b": "c:d"}
    assert one(spark, html.rgb_hex(F.lit("rgba(999, 0, 16, .5)"))) == "#FF0010"
    assert one(spark, html.font_points(F.lit("16px"))) == 12.0
    assert html.html_text("<head><title>t</title></head><body><p>x</p><script>no</script><article><a href='https://h.example/a'><img alt='p'><img alt='p'></a></article></body>") == "p"
    assert html.html_text("<title>t</title><p>x</p>", main=False).split() == ["t", "x"]
    assert html.html_text(None) == ""


def test_mail(spark):
    data = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    payload = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": data("hällo?")}}, {"mimeType": "text/html", "body": {"data": data("<b>no</b>")}}]}, {"mimeType": "application/pdf", "filename": "a.pdf", "body": {"attachmentId": "x", "size": 3}}]}
    got = one(spark, mail.payload_parts(F.lit(json.dumps(payload))))
    assert got["body_text"] == "hällo?" and got["attachments"][0]["filename"] == "a.pdf"
    assert one(spark, mail.decoded(F.lit(data("x?>~")))) == b"x?>~"
    assert one(spark, mail.date_unix(F.lit("Thu, 01 Jan 1970 01:00:00 +0100"))) == 0.0
    assert one(spark, mail.date_unix(F.lit("yesterday"))) == 0.0


def test_archives():
    data = docx_bytes("first\nsecond & third", "Head")
    assert archives.text(data, "docx") == "Head\nfirst\nsecond & third"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/media/image1.JPG", b"x")
        z.writestr("word/charts/chart1.xml", b"x")
        z.writestr("word/document.xml", b"<w:tbl><w:tbl >")
    assert archives.counts(out.getvalue(), "docx") == {"images": 1, "jpeg": 1, "charts": 1, "tables": 2}
    assert archives.counts(b"junk", "docx") == {} and archives.text(b"junk", "pptx") is None
