"""File trees, delimited and workbook inventories, JSON logs and manifests, archives of repositories."""

from __future__ import annotations

import io
import os
import re
import tarfile
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.functions.signals import extension, source_system
from corpusloom.operators.recency import first_per_group
from corpusloom.operators.select import global_index

#: Directories that scans leave out, and column names that a description and a source are looked for under.
SKIPPED = [".venv", "__pycache__", "node_modules"]
DESCRIPTION = ["description", "what it includes", "item", "details", "notes", "content", "data"]
SOURCE = ["source", "where to find it", "system", "tool", "platform", "location"]


class FileTree(DataSource):
    """``spark.read.format("file_tree").option("root", dir)``: path (relative), size_bytes, modified_time_unix, and, with the option
    ``bytes``, that many first bytes as content. Unlike the built-in file sources it shows names that begin with ``_``.
    A partition is a directory of the first level; options ``strict`` and ``hidden`` keep skipped directories and dot files."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, size_bytes long, modified_time_unix double, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.strict = options.get("strict", "false").lower() == "true"
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.bytes = int(options.get("bytes", "0"))
        self.html = options.get("html", "false").lower() == "true"

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition("")] + [InputPartition(d) for d in sorted(e.name for e in os.scandir(self.root) if e.is_dir() and self._kept(e.name))]

    def _kept(self, directory: str) -> bool:
        return self.strict or not (directory in SKIPPED or (directory.startswith(".") and not self.hidden))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        top = os.path.join(self.root, partition.value)
        for base, dirs, names in os.walk(top):
            dirs[:] = [] if partition.value == "" else sorted(d for d in dirs if self._kept(d))
            for name in sorted(names):
                if (name.startswith(".") and not self.hidden) or (self.html and not name.lower().endswith((".html", ".htm"))):
                    continue
                path = os.path.join(base, name)
                try:
                    stat = os.stat(path)
                    with open(path, "rb") as f:
                        head = f.read(self.bytes) if self.bytes else None
                except OSError:
                    continue
                yield os.path.relpath(path, self.root).replace(os.sep, "/"), stat.st_size, stat.st_mtime, head


def walk_key(path: Column) -> Column:
    """Sorts paths as a walk meets them: the files of a directory by name, then its directories by name."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    return F.concat(F.regexp_replace(folder, r"([^/]*)/", "\u0002$1"), F.lit("\u0001"), F.regexp_extract(path, r"([^/]*)$", 1))


def scan_tree(spark: SparkSession, root: str, limit: int | None = None, **options: object) -> DataFrame:
    """artifact_id (from 1, in walk order), path, filename, extension, size_bytes, modified_time_unix, source_guess, content."""
    spark.dataSource.register(FileTree)
    files = spark.read.format("file_tree").options(root=root, **{k: str(v) for k, v in options.items()}).load()
    numbered = global_index(files.withColumn("_key", walk_key(F.col("path"))), [F.asc("_key")], "_index")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    out = numbered.select((F.col("_index") + 1).alias("artifact_id"), "path", name.alias("filename"), extension(name).alias("extension"), "size_bytes", "modified_time_unix", source_system(F.col("path")).alias("source_guess"), "content")
    return out if limit is None else out.filter(F.col("artifact_id") <= limit)


def account_files(tree: DataFrame) -> DataFrame:
    """Non-empty files with the first directory of their path as the account."""
    return tree.filter(F.col("size_bytes") > 0).withColumn("account", F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(""))


def column_role(columns: Sequence[str], names: Sequence[str], given: str | None = None) -> str | None:
    """A column by name: the given one, else an exact match in order of the names, else one that contains a name."""
    plain = {c: " ".join(c.lower().split()) for c in columns}
    if given is not None:
        return next((c for c in columns if plain[c] == " ".join(given.lower().split())), None)
    exact = [c for n in names for c in columns if plain[c] == n]
    part = [c for n in names for c in columns if n in plain[c]]
    return next(iter(exact + part), None)


def read_inventory(spark: SparkSession, path: str, sheet: str | None = None, description: str | None = None, source: str | None = None) -> DataFrame:
    """A CSV or XLSX table with ``row_id`` (from 1), and description and source under these names where such columns are found."""
    if path.lower().endswith((".xlsx", ".xlsm")):
        spark.dataSource.register(Workbook)
        rows = spark.read.format("workbook").options(path=path, **({"sheet": sheet} if sheet else {})).load()
        names = [r["name"] for r in rows.select(F.explode(F.map_keys("cells")).alias("name")).distinct().orderBy("name").limit(16_384).collect()]  # the format's bound on columns
        table = rows.select("row", *[F.col("cells")[n].alias(n) for n in names])
    else:
        table = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("row", F.monotonically_increasing_id())
        names = [c for c in table.columns if c != "row"]
    table = global_index(table, [F.asc("row")], "row_id").withColumn("row_id", F.col("row_id") + 1).drop("row")
    roles = {"description": column_role(names, DESCRIPTION, description), "source": column_role(names, SOURCE, source)}
    return table.withColumns({role: F.col(f"`{c}`") for role, c in roles.items() if c})


class Workbook(DataSource):
    """``format("workbook")``, option path and sheet: row (from 1), cells (map of header to text). One task reads a sheet."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "row long, cells map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return _SheetReader(self.options)


class _SheetReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.sheet = options["path"], options.get("sheet")

    def read(self, partition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            sheets = sheet_rows(f.read())
        rows = sheets[self.sheet] if self.sheet else next(iter(sheets.values()), [])
        if rows:
            head = [str(h) for h in rows[0]]
            for i, row in enumerate(rows[1:], 1):
                yield i, {h: v for h, v in zip(head, row) if h and v != ""}


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def sheet_rows(data: bytes) -> dict[str, list[list[str]]]:
    """The cells of each worksheet of an XLSX file as text, in order of the sheets."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
            if _tag(s) != "sheet":
                continue
            target = next(links[v] for k, v in s.attrib.items() if k.endswith("}id"))
            rows = []
            for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter():
                if _tag(row) != "row":
                    continue
                cells: list[str] = []
                for c in row:
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters.group()))) - 1 if letters else len(cells)
                    cells += [""] * (at - len(cells))
                    value = "".join(t.text or "" for t in c.iter() if _tag(t) in ("v", "t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                rows.append(cells)
            out[s.get("name")] = rows
    return out


def read_log(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """An append-only JSON-lines log: unreadable lines are dropped, of each key the last line counts.

    Later files come after earlier ones by the time they were written (names of parts say nothing); within a file the line counts.
    """
    read = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    placed = read.withColumn("_at", F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())).filter(F.col("_bad").isNull() & F.col(key).isNotNull())
    return first_per_group(placed, [key], [F.desc("_at")]).drop("_bad", "_at")


def read_manifest(spark: SparkSession, path: str, default_bucket: str = "Unclassified") -> DataFrame:
    """The files of a manifest, the first entry of a file_id, blank categories named: one JSON document with ``files``, or a folder as ``sinks.workbook.manifest`` writes it."""
    lines = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/files")
    if lines.getFileSystem(spark._jsc.hadoopConfiguration()).exists(lines):
        files = spark.read.json(f"{path}/files").withColumn("_at", F.monotonically_increasing_id())
    else:
        files = spark.read.option("multiLine", True).json(path).select(F.posexplode("files").alias("_at", "f")).select("_at", "f.*")
    once = first_per_group(files.filter(F.coalesce(F.col("file_id"), F.lit("")) != ""), ["file_id"], [F.asc("_at")]).drop("_at")
    bucket = F.col("bucket_name") if "bucket_name" in once.columns else F.lit(None).cast("string")
    return once.withColumn("bucket_name", F.coalesce(F.nullif(F.trim(bucket), F.lit("")), F.lit(default_bucket)))


def extract_archive(data: bytes, to: str) -> int:
    """Unpacks a repository's tar or zip archive; members that would leave ``to`` and links are left out. Returns the files."""
    n, root = 0, os.path.realpath(to)
    inside = lambda name: os.path.realpath(os.path.join(root, name)).startswith(root + os.sep)
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if not m.is_dir() and inside(m.filename):
                    z.extract(m, root)
                    n += 1
        return n
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            if m.isfile() and inside(m.name):
                t.extract(m, root, filter="data")
                n += 1
    return n


