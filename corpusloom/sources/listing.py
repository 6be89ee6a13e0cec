"""Listings of cloud drives and mailboxes through clients; the client shipped here replays pages that were stored as JSON.

A client has ``accounts()``, ``children(account, folder)`` (rows of a folder, paged by itself), ``body(account, file)``,
``message_ids(account, query)`` and ``message(account, id)``. The option ``client`` of the data sources names its class as ``module:Class``; the option ``root`` is
given to it. Clients that need a network or credentials are for the user to supply.
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from corpusloom.functions.mail import header, payload_parts
from corpusloom.functions.signals import instant, modified_before
from corpusloom.operators.select import global_index

SCAN = (
    "drive_file_id string, path string, name string, mime_type string, modified_time string, size_bytes long, md5_checksum string, is_folder boolean, is_shortcut boolean, "
    "shortcut_target_id string, owner_email string, last_modified_by string, account string"
)
FOLDER, SHORTCUT = "application/vnd.google-apps.folder", "application/vnd.google-apps.shortcut"


class StoredPages:
    """``root/<account>/<folder>.json`` hold the files of a folder; ``root/<account>/mail/<id>.json`` the messages."""

    def __init__(self, root: str):
        self.root = root

    def accounts(self) -> list[str]:
        return sorted(d for d in os.listdir(self.root) if os.path.isdir(os.path.join(self.root, d)))

    def children(self, account: str, folder: str) -> list[dict]:
        try:
            with open(os.path.join(self.root, account, f"{folder}.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return []

    def message_ids(self, account: str, query: str = "") -> list[str]:
        try:
            return sorted(n[:-5] for n in os.listdir(os.path.join(self.root, account, "mail")) if n.endswith(".json"))
        except FileNotFoundError:
            return []

    def message(self, account: str, message: str) -> dict:
        with open(os.path.join(self.root, account, "mail", f"{message}.json")) as f:
            return json.load(f)


    def body(self, account: str, file: str) -> bytes:
        with open(os.path.join(self.root, account, "bodies", file), "rb") as f:
            return f.read()


def client_of(options: dict) -> object:
    module, _, name = options.get("client", f"{__name__}:StoredPages").partition(":")
    return getattr(importlib.import_module(module), name)(options["root"])


def row_of(file: dict, path: str, account: str) -> tuple:
    """A scan row of a file as the service describes it; sizes that aren't numbers are null."""
    size = str(file.get("size") or "")
    owners, mime = file.get("owners") or [{}], file.get("mimeType") or ""
    return (
        file.get("id"), path, file.get("name") or "", mime, file.get("modifiedTime"), int(size) if size.isdigit() else None, file.get("md5Checksum"), mime == FOLDER, mime == SHORTCUT,
        (file.get("shortcutDetails") or {}).get("targetId"), (owners[0] or {}).get("emailAddress") or "", (file.get("lastModifyingUser") or {}).get("emailAddress") or "", account,
    )


def sorted_children(client: object, account: str, folder: str) -> list[dict]:
    """Folders before files, each by name in lower case."""
    return sorted(client.children(account, folder), key=lambda f: (f.get("mimeType") != FOLDER, (f.get("name") or "").lower()))


class DriveListing(DataSource):
    """``format("drive_listing")``: the files below ``folder`` (default root) of every account, one partition for each account.

    As a stream it lists ``folders`` folders in each batch; the offset is the frontier, so a stream resumes where it stopped.
    """

    @classmethod
    def name(cls) -> str:
        return "drive_listing"

    def schema(self) -> str:
        return SCAN

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _ListingStream(dict(self.options))


class _ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        wanted = self.options.get("accounts")
        return [InputPartition(a) for a in (wanted.split(",") if wanted else client_of(self.options).accounts())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client, account = client_of(self.options), partition.value
        stack = [(self.options.get("folder", "root"), "")]
        while stack:
            folder, base = stack.pop()
            below = []
            for f in sorted_children(client, account, folder):
                path = f"{base}{f.get('name') or ''}"
                yield row_of(f, path, account)
                if f.get("mimeType") == FOLDER:
                    below.append((f["id"], f"{path}/"))
            stack += reversed(below)


class _ListingStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.folders = options, int(options.get("folders", "50"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frontier": json.dumps([[a, self.options.get("folder", "root"), ""] for a in client_of(self.options).accounts()])}

    def _round(self, start: dict) -> tuple[list[tuple], dict]:
        client, frontier, rows = client_of(self.options), json.loads(start["frontier"]), []
        now, later = frontier[: self.folders], frontier[self.folders :]
        for account, folder, base in now:
            for f in sorted_children(client, account, folder):
                path = f"{base}{f.get('name') or ''}"
                rows.append(row_of(f, path, account))
                if f.get("mimeType") == FOLDER:
                    later.append([account, f["id"], f"{path}/"])
        return rows, {"frontier": json.dumps(later)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._round(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._round(start)[0])


class MailMessages(DataSource):
    """``format("mail_messages")``: account, message_id, message (JSON as the service gives it), one partition for each account."""

    @classmethod
    def name(cls) -> str:
        return "mail_messages"

    def schema(self) -> str:
        return "account string, message_id string, message string"

    def reader(self, schema) -> DataSourceReader:
        return _MailReader(dict(self.options))


class _MailReader(_ListingReader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client = client_of(self.options)
        for message in client.message_ids(partition.value, self.options.get("query", "")):
            yield partition.value, message, json.dumps(client.message(partition.value, message))


def scan_drives(spark: SparkSession, root: str, limit: int | None = None, cutoff: str | None = None, **options: str) -> DataFrame:
    """Scan rows of all accounts, with a row number in order of account and path; only those before the cutoff, at most ``limit``."""
    spark.dataSource.register(DriveListing)
    rows = spark.read.format("drive_listing").options(root=root, **options).load()
    if cutoff is not None:
        rows = rows.filter(F.col("is_folder") | modified_before(instant(F.col("modified_time")), instant(F.lit(cutoff))))
    numbered = global_index(rows, [F.asc("account"), F.asc("path"), F.asc("drive_file_id")], "row_number")
    return numbered if limit is None else numbered.filter(F.col("row_number") < limit)


def with_bodies(files: DataFrame, root: str, most: int | None = None, client: str = f"{__name__}:StoredPages", file: str = "drive_file_id") -> DataFrame:
    """``files`` (with account) with each body as content, and an error where there is none; with ``most``, its first bytes, and ``truncated`` where there are more."""
    columns = files.columns

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service = client_of({"client": client, "root": root})
        for batch in it:
            contents, errors, cut = [], [], []
            for account, name in zip(batch.column(columns.index("account")).to_pylist(), batch.column(columns.index(file)).to_pylist()):
                try:
                    body = service.body(account, name)
                    contents.append(body[:most])
                    errors.append(None)
                    cut.append(most is not None and len(body) > most)
                except Exception as e:  # noqa: BLE001
                    contents.append(None)
                    errors.append(type(e).__name__)
                    cut.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(contents, pa.binary()), pa.array(errors, pa.string()), pa.array(cut, pa.bool_())], [*columns, "content", "error", "truncated"])

    return files.mapInArrow(fetch, f"{', '.join(f'{n} {t}' for n, t in files.dtypes)}, content binary, error string, truncated boolean")


def fetch_mail(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Messages in the schema of the table ``message``."""
    spark.dataSource.register(MailMessages)
    raw = spark.read.format("mail_messages").options(root=root, **options).load()
    schema = "id string, threadId string, labelIds array<string>, snippet string, sizeEstimate long, payload struct<headers: array<struct<name: string, value: string>>>"
    m = F.from_json("message", schema)
    parsed = raw.withColumn("m", m).withColumn("parts", payload_parts(F.get_json_object("message", "$.payload")))
    h = lambda name: header(F.col("m.payload.headers"), name)
    return parsed.select(
        F.col("m.id").alias("message_id"), F.col("m.threadId").alias("thread_id"), F.col("account").alias("user_email"), F.coalesce(F.nullif(h("subject"), F.lit("")), F.lit("(no subject)")).alias("subject"), h("from").alias("sender"), h("to").alias("to_field"),
        h("cc").alias("cc"), h("date").alias("date_str"), F.array_join("m.labelIds", ", ").alias("labels"), F.col("parts.body_text"), F.col("m.snippet"), F.col("m.sizeEstimate").alias("size_estimate"), F.col("parts.attachments"),
    )
