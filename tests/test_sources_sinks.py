from __future__ import annotations

import base64
import io
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom import classify
from corpusloom.plans import pipeline
from corpusloom.sinks import workbook
from corpusloom.sources import files, listing
from corpusloom.streaming import rounds


@pytest.fixture
def tree(tmp_path):
    for path, data in {"b.txt": "mail a@b.io " * 30, "a/z.html": "<title>T</title><body><p>how to</p><img src='x.png'></body>", "a/_kept.csv": "x,y\n1,2\n", "a/.hidden": "x", ".git/c": "x", "node_modules/d.js": "x", "c/movie.mp4": "", "a/b/deep.md": "# deep"}.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(data)
    return tmp_path


def test_tree_and_evidence(spark, tree):
    scan = files.scan_tree(spark, str(tree), bytes=100_000)
    assert [r["path"] for r in scan.orderBy("artifact_id").collect()] == ["b.txt", "a/_kept.csv", "a/z.html", "a/b/deep.md", "c/movie.mp4"]
    assert files.scan_tree(spark, str(tree), limit=2).count() == 2
    assert files.scan_tree(spark, str(tree), html="true").count() == 1
    rows = {r["path"]: r for r in pipeline.evidence(scan).collect()}
    assert rows["b.txt"]["pii_flag"] == "Yes" and rows["b.txt"]["word_count"] == 60
    assert rows["a/z.html"]["content_inventory"] == "images: 1; png: 1" and rows["a/z.html"]["modality"] == "text; visual_embedded" and rows["a/z.html"]["snippet"] == "how to"
    assert rows["a/_kept.csv"]["content_inventory"] == "rows: 2" and rows["c/movie.mp4"]["snippet"] == "movie"
    tables = pipeline.build(pipeline.evidence(scan))
    assert tables["Evidence"].count() == 5 and tables["Inventory"].count() == 7
    assert files.account_files(scan).filter("account = 'a'").count() == 3


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1 <&> \x01x", 2, None), ("b", 3, 1.5)], "`Item description` string, n long, System double")
    workbook.write_workbook({"One": df, "Two": df.limit(0)}, str(tmp_path / "w.xlsx"))
    got = files.read_inventory(spark, str(tmp_path / "w.xlsx")).orderBy("row_id").collect()
    assert [(r["row_id"], r["description"], r["n"], r["source"]) for r in got] == [(1, "1 <&> x", "2", None), (2, "b", "3", "1.5")]
    assert files.column_role(["Tool used", "Platform"], files.SOURCE) == "Platform"
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "c.csv"))
    assert files.read_inventory(spark, str(tmp_path / "c.csv")).count() == 2


def test_logs_and_manifest(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": 1, "v": "a"}\nbroken\n{"id": 1, "v": "b"}\n{"id": 2, "v": "c"}\n')
    assert sorted(tuple(r) for r in files.read_log(spark, str(tmp_path / "log.jsonl"), "id long, v string", "id").collect()) == [(1, "b"), (2, "c")]
    workbook.append_log(spark.createDataFrame([(3, "d")], "id long, v string"), str(tmp_path / "out"))
    workbook.append_log(spark.createDataFrame([(4, "e")], "id long, v string"), str(tmp_path / "out"))
    assert files.read_log(spark, str(tmp_path / "out"), "id long, v string", "id").count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"files": [{"file_id": "x", "bucket_name": " "}, {"file_id": "x", "bucket_name": "B"}, {"file_id": "y", "bucket_name": "C"}]}))
    assert sorted((r["file_id"], r["bucket_name"]) for r in files.read_manifest(spark, str(tmp_path / "m.json")).collect()) == [("x", "Unclassified"), ("y", "C")]


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, part in parts.items():
            z.writestr(name, part)
    return out.getvalue()


def test_pages_of_office_files(spark):
    w, d = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
    picture = '<w:p><w:r><w:drawing><d:inline><d:extent cx="1" cy="7000000"/></d:inline></w:drawing></w:r></w:p>'
    document = lambda n: f'<w:document xmlns:w="{w}" xmlns:d="{d}"><w:body><w:p><w:r><w:t>{"word " * 130}</w:t></w:r></w:p>{picture * n}</w:body></w:document>'
    slides = {"ppt/presentation.xml": '<p:p xmlns:p="p"><p:sldIdLst><p:sldId/><p:sldId/><p:sldId/></p:sldIdLst></p:p>'} | {f"ppt/slides/slide{i}.xml": '<p:s xmlns:p="p"/>' for i in (1, 2, 3)}
    sheets = {
        "xl/workbook.xml": '<x:w xmlns:x="x" xmlns:r="r"><x:sheet name="A" r:id="a"/><x:sheet name="B" r:id="b"/></x:w>', "xl/_rels/workbook.xml.rels": '<R><r Id="a" Target="worksheets/sheet1.xml"/><r Id="b" Target="/xl/worksheets/sheet2.xml"/></R>',
        "xl/worksheets/sheet1.xml": "<s/>", "xl/worksheets/sheet2.xml": "<s/>",
    }
    kinds = {"a.docx": {"word/document.xml": document(0)}, "b.docx": {"word/document.xml": document(1)}, "c.docx": {"word/document.xml": document(2)}, "d.pptx": slides, "e.xlsx": sheets, "f.xlsm": sheets}
    rows = [(n, n, n, n.rpartition(".")[2], bytearray(office(parts))) for n, parts in kinds.items()] + [("g.pptx", "g.pptx", "g.pptx", "pptx", bytearray(b"junk")), ("h.txt", "h.txt", "h.txt", "txt", bytearray(b"one")), ("i.docx", "i.docx", "i.docx", "docx", None)]
    got = pipeline.evidence(spark.createDataFrame(rows, "artifact_id string, path string, filename string, extension string, content binary")).collect()
    assert {r["filename"][0]: r["page_count"] for r in got} == {"a": 1, "b": 2, "c": 4, "d": 3, "e": 2, "f": 2, "g": 0, "h": 1, "i": 0}


def test_archive_is_safe(tmp_path):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name in ("ok/a.txt", "../evil.txt"):
            info = tarfile.TarInfo(name)
            info.size = 1
            t.addfile(info, io.BytesIO(b"x"))
    assert files.extract_archive(out.getvalue(), str(tmp_path / "r")) == 1
    assert not (tmp_path / "evil.txt").exists()


@pytest.fixture
def pages(tmp_path):
    def put(path, value):
        os.makedirs(tmp_path / "pages" / os.path.dirname(path), exist_ok=True)
        (tmp_path / "pages" / path).write_text(json.dumps(value))

    put("u@x.io/root.json", [{"id": "f1", "name": "Zeta", "mimeType": listing.FOLDER}, {"id": "a", "name": "a.txt", "size": "5", "modifiedTime": "2024-01-01T00:00:00Z", "owners": [{"emailAddress": "u@x.io"}]}])
    put("u@x.io/f1.json", [{"id": "b", "name": "b.txt", "size": "7", "modifiedTime": "2020-01-01T00:00:00Z"}, {"id": "s", "name": "s", "mimeType": listing.SHORTCUT, "shortcutDetails": {"targetId": "a"}}])
    os.makedirs(tmp_path / "pages/u@x.io/bodies")
    (tmp_path / "pages/u@x.io/bodies/a").write_bytes(b"0123456789")
    put("v@x.io/root.json", [{"id": "c", "name": "c.bin", "size": "x"}])
    body = base64.urlsafe_b64encode(b"hello").decode()
    put("u@x.io/mail/m1.json", {"id": "m1", "threadId": "t", "labelIds": ["A", "B"], "sizeEstimate": 9, "payload": {"mimeType": "text/plain", "headers": [{"name": "SUBJECT", "value": "s"}, {"name": "From", "value": "w"}], "body": {"data": body}}})
    return str(tmp_path / "pages")


def test_bodies_are_whole(spark, pages):
    with open(f"{pages}/u@x.io/bodies/b", "wb") as f:
        f.write(b"x" * 9000)
    drives = spark.createDataFrame([("u@x.io", "a"), ("u@x.io", "b"), ("u@x.io", "none")], "account string, drive_file_id string")
    sizes = lambda **most: {r["drive_file_id"]: (r["content"] and len(r["content"]), r["truncated"]) for r in listing.with_bodies(drives, pages, **most).collect()}
    assert sizes() == {"a": (10, False), "b": (9000, False), "none": (None, None)}
    assert sizes(most=10) == {"a": (10, False), "b": (10, True), "none": (None, None)}


def test_listings(spark, pages, tmp_path):
    rows = listing.scan_drives(spark, pages).orderBy("row_number").collect()
    assert [(r["account"], r["path"], r["size_bytes"]) for r in rows] == [("u@x.io", "Zeta", None), ("u@x.io", "Zeta/b.txt", 7), ("u@x.io", "Zeta/s", None), ("u@x.io", "a.txt", 5), ("v@x.io", "c.bin", None)]
    assert listing.scan_drives(spark, pages, cutoff="2022-01-01T00:00:00Z").filter("drive_file_id = 'a'").isEmpty()
    bodies = {r["drive_file_id"]: (r["content"], r["error"]) for r in listing.with_bodies(listing.scan_drives(spark, pages), pages, most=4).collect()}
    assert bodies["a"] == (b"0123", None) and bodies["b"][1] == "FileNotFoundError"
    m = listing.fetch_mail(spark, pages).first()
    assert (m["subject"], m["sender"], m["body_text"], m["labels"]) == ("s", "w", "hello", "A, B")


def test_stream_of_rounds(spark, pages, tmp_path):
    spark.dataSource.register(listing.DriveListing)
    stream = spark.readStream.format("drive_listing").options(root=pages, folders="1").load().filter("NOT is_folder")
    query = stream.writeStream.foreachBatch(lambda b, n: rounds.take_round(b, n, str(tmp_path / "taken"), 10, "drive_file_id", "size_bytes", ["path"])).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if (query.lastProgress or {}).get("batchId", -1) >= 3:
                break
    finally:
        query.stop()
    got = {r["file_id"] for r in rounds.read_taken(spark, str(tmp_path / "taken")).collect()}
    assert got == {"a", "c", "s"}  # b no longer fits after a


def test_copy_and_transfer(spark, tree, tmp_path):
    df = spark.createDataFrame([("b.txt",), ("missing",)], "path string")
    got = {r["path"]: r["status"] for r in workbook.copy_files(df, str(tree), str(tmp_path / "to")).collect()}
    assert got["b.txt"] == "copied" and got["missing"].startswith("failed")
    assert workbook.copy_files(df.limit(1), str(tree), str(tmp_path / "to")).first()["status"] == "skipped"
    done = spark.createDataFrame([("missing",)], "path string")
    assert [r["status"] for r in workbook.transfer(df, done, "path", lambda row: None).collect()] == ["sent"]


def test_documents(spark):
    df = spark.createDataFrame([("a.html", b"<title>t</title><p>x</p>"), ("b.json", b'{"a":1}'), ("c.txt", None)], "path string, content binary")
    got = {r["path"]: r for r in workbook.convert_documents(df).collect()}
    assert got["a.html"]["docx"] and got["b.json"]["docx"] and got["c.txt"]["error"]


def test_segmented(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (2, 7), (3, 1)], "artifact_id long, bucket_number int")
    workbook.write_segmented(df, str(tmp_path / "seg"))
    assert spark.read.parquet(str(tmp_path / "seg")).filter("bucket_number = 1").count() == 2
    workbook.manifest(df, df, str(tmp_path / "man"), cap=5)
    assert spark.read.text(str(tmp_path / "man/files")).count() == 3
    workbook.snapshot_csv(df, str(tmp_path / "csv"))
    workbook.write_tabs({"A b": df}, str(tmp_path / "tabs"))
    assert spark.read.parquet(str(tmp_path / "tabs/A_b")).count() == 3


def test_classifier(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return [{"ok": 1}]

    assert classify.retried(flaky, sleep=lambda s: None) == [{"ok": 1}]
    with pytest.raises(ConnectionError):
        classify.retried(lambda: (_ for _ in ()).throw(ConnectionError()), attempts=1, sleep=lambda s: None)
    assert classify.valid([{"row_id": 1, "bucket_number": 9}, {"row_id": "2", "bucket_number": 3, "confidence": "HIGH"}, {"row_id": 5, "bucket_number": 1}, {}], {1, 2}, 1) == [(2, 3, "Strategy & Planning", "high", "", 1)]
    rows = spark.createDataFrame([(i, f"f{i}", "s", "n", "p", "txt", None) for i in range(60)], "artifact_id long, filename string, content_summary string, snippet string, path string, extension string, source_guess string")
    labels = classify.two_pass(rows)
    assert labels.count() == 60 and labels.filter("llm_pass = 2").count() == 20
    assert classify.two_pass(rows, labels).count() == 0
    sub = classify.subcategories(rows.withColumn("bucket_number", F.lit(3)).withColumn("rationale", F.lit("r")), classify.offline_subcategory)
    assert sub.count() == 60


def test_later_batches_win_in_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    for value in ("old", "new", "newest"):
        workbook.append_log(spark.createDataFrame([(i, value) for i in range(20)], "id long, v string").repartition(4), path)
    assert {r["v"] for r in files.read_log(spark, path, "id long, v string", "id").collect()} == {"newest"}


def test_manifest_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", " "), ("b", "Two"), ("", "x")], "file_id string, bucket_name string")
    workbook.manifest(df, df.limit(0), str(tmp_path / "m"), cap=5)
    assert sorted((r["file_id"], r["bucket_name"]) for r in files.read_manifest(spark, str(tmp_path / "m")).collect()) == [("a", "Unclassified"), ("b", "Two")]


def test_labels_go_on_from_the_log(spark, tmp_path):
    """A classifier that fails for some rows leaves them pending; the next run asks for these only."""
    import os

    from corpusloom import classify
    from corpusloom.plans import pipeline

    asked = str(tmp_path / "asked")
    os.makedirs(asked)

    def counting(fail):
        def call(items):
            for item in items:
                open(os.path.join(asked, str(item["row_id"])), "a").write("x")
            if fail and any(item["row_id"] % 2 for item in items):
                raise RuntimeError("no answer")
            return [{**a, "confidence": "high"} for a in classify.offline(items)]

        return call

    rows = spark.createDataFrame([(i, f"f{i}.txt", "txt", f"p/f{i}.txt", "s", "c", "Local") for i in range(60)], "artifact_id long, filename string, extension string, path string, snippet string, content_summary string, source_guess string").repartition(60, "artifact_id")
    log = str(tmp_path / "labels")
    first = {r["row_id"] for r in classify.logged(rows, log, counting(True), counting(True), 25).collect()}
    assert len(first) < 60
    before = {n: os.path.getsize(os.path.join(asked, n)) for n in os.listdir(asked)}
    labels = classify.logged(rows, log, counting(False), counting(False), 25)
    assert labels.count() == 60
    after = {n: os.path.getsize(os.path.join(asked, n)) for n in os.listdir(asked)}
    assert all(after[str(i)] == before[str(i)] for i in first) and all(after[str(i)] > before.get(str(i), 0) for i in set(range(60)) - first)
    tables = pipeline.build(rows.withColumns({"token_count": F.lit(1).cast("long"), "word_count": F.lit(1).cast("long"), "pii_flag": F.lit("No"), "pii_types": F.lit(""), "modality": F.lit("text"), "page_count": F.lit(1).cast("long"), "size_bytes": F.lit(1).cast("long"), "content_inventory": F.lit("")}), log=log, subcategory=classify.offline_subcategory)
    got = tables["labelled"].select("bucket_number", "sub_category", "rationale").collect()
    assert all(r["sub_category"] == classify.offline_subcategory(r["bucket_number"], [{"row_id": 1, "rationale": r["rationale"]}])[0]["sub_category"] for r in got)


def test_subcategory_answers_are_checked(spark):
    from corpusloom import classify

    rows = spark.createDataFrame([(1, 3, "r", "f"), (2, 3, "r", "f")], "artifact_id long, bucket_number int, rationale string, filename string").coalesce(1)
    odd = lambda bucket, items: [{"row_id": 1, "sub_category": "a"}, {"row_id": "1", "sub_category": " b "}, {"row_id": 9, "sub_category": "c"}, {"sub_category": "d"}, {"row_id": 2, "sub_category": None}]
    assert [tuple(r) for r in classify.subcategories(rows, odd).collect()] == [(1, "b")]


def test_shortcuts_compare_instants(spark):
    from corpusloom.operators import merge

    rows = [("s", "l", None, False, True, "old", "2024-03-01T23:30:00+09:00"), ("s", "l", None, False, True, "new", "2024-03-01T20:00:00Z"), ("new", "n", "text/plain", False, False, None, None)]
    scan = spark.createDataFrame(rows, "drive_file_id string, name string, mime_type string, is_folder boolean, is_shortcut boolean, shortcut_target_id string, modified_time string")
    assert [(r["target_id"], r["status"]) for r in merge.resolve_shortcuts(scan).collect()] == [("new", "ok")]


def test_include_list_names_what_is_missing(spark):
    from corpusloom.operators import merge

    df = spark.createDataFrame([("A ",), ("b",), ("c",), (None,)], "name string")
    rows, missing = merge.include_list(df, "name", ["a", "B", "x", " "])
    assert sorted(r["name"] for r in rows.collect()) == ["A ", "b"] and missing == ["x"]
    assert merge.include_list(df, "name", [])[0].count() == 0
