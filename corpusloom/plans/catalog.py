"""Every query of the core by name, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import classify as C
from corpusloom import vocab as V
from corpusloom.functions import html, mail, signals, text
from corpusloom.functions.summary import FILE_KINDS, GREETING, LETTER_HEAD, MONTH, PATH_TOPICS, TEXT_TOPICS, fold_text, folded, summary, telling_line
from corpusloom.io import materialize, table, texts
from corpusloom.operators import merge, recency, rollup, select
from corpusloom.plans import pipeline
from corpusloom.sinks.workbook import display
from corpusloom.streaming import rounds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Bytes of the sampling queries, and rows of their floors and caps.
CAP, PER_ACCOUNT, OVERALL, THREADS = 40 * 2**30, 2, 350, 300


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- tables that several queries start from

_TEXTS = ["path", "filename", "extension", "source_guess", "snippet", "content_summary", "pii_flag", "modality", "content_inventory", "drive_url", "owner_email"]
_NUMBERS = ["size_bytes", "word_count", "token_count", "page_count"]


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each artifact: of rows repeated on resume, the greatest non-blank value of each column."""
    e = table(spark, sf_dir, "evidence").filter(F.col("artifact_id").isNotNull())
    return e.groupBy("artifact_id").agg(*[F.max(F.when(F.trim(c) != "", F.col(c))).alias(c) for c in _TEXTS], *[F.max(c).alias(c) for c in _NUMBERS])


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.current_labels(table(spark, sf_dir, "classifications"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.label(artifacts(spark, sf_dir), labels(spark, sf_dir))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each listed file."""
    s = table(spark, sf_dir, "scan_rows").filter(F.col("drive_file_id").isNotNull())
    at = F.unix_micros(signals.instant(F.col("modified_time")))
    return recency.last_wins(s.select("drive_file_id", at.alias("at"), "path", "name", "mime_type", "modified_time", "size_bytes", "is_folder", "is_shortcut", "shortcut_target_id", "owner_email"), "drive_file_id", "at")


_ART = "artifacts AS (SELECT artifact_id, " + ", ".join(f"max(CASE WHEN trim({c}) <> '' THEN {c} END) AS {c}" for c in _TEXTS) + ", " + ", ".join(f"max({c}) AS {c}" for c in _NUMBERS) + " FROM evidence WHERE artifact_id IS NOT NULL GROUP BY artifact_id)"
_CLS = """labels AS (SELECT * FROM classifications WHERE row_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY log_pos DESC NULLS LAST, bucket_number DESC NULLS LAST, bucket_name DESC NULLS LAST,
  confidence DESC NULLS LAST, rationale DESC NULLS LAST, llm_pass DESC NULLS LAST, logged_at DESC NULLS LAST) = 1)"""
_LAB = f"{_ART}, {_CLS}, labelled AS (SELECT a.*, l.bucket_number, l.bucket_name, l.confidence, l.rationale, l.llm_pass FROM artifacts a LEFT JOIN labels l ON l.row_id = a.artifact_id)"
_FILES = """files AS (SELECT drive_file_id, epoch_us(CAST(modified_time AS TIMESTAMPTZ)) AS at, path, name, mime_type, modified_time, size_bytes, is_folder, is_shortcut, shortcut_target_id, owner_email FROM scan_rows WHERE drive_file_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY drive_file_id ORDER BY epoch_us(CAST(modified_time AS TIMESTAMPTZ)) DESC NULLS LAST, path DESC NULLS LAST, name DESC NULLS LAST, mime_type DESC NULLS LAST, modified_time DESC NULLS LAST,
  size_bytes DESC NULLS LAST, is_folder DESC NULLS LAST, is_shortcut DESC NULLS LAST, shortcut_target_id DESC NULLS LAST, owner_email DESC NULLS LAST) = 1)"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- text measures of documents

_NORMAL = (
    "regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(text, '[\\x{1F1E6}-\\x{1F1FF}\\x{1F300}-\\x{1FAFF}\\x{2700}-\\x{27BF}\\x{2600}-\\x{26FF}]+', ' ', 'g'),"
    " '[\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]', ' ', 'g'), chr(65039), ''), '([\\pL\\pN_])-\\n([\\pL\\pN_])', '\\1\\2', 'g'), '([a-z])\\n([a-z])', '\\1\\2', 'g'), '([A-Z])\\n([A-Z])', '\\1\\2', 'g'), chr(13), chr(10)), '[\\x{00AD}\\x{200B}]', '', 'g')"
)
_WORDS = f"coalesce(len(regexp_extract_all({_NORMAL}, '\\S+')), 0)::BIGINT"
_TOKENS = "CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE length(text) // 4 END::BIGINT"
_PAGES = lambda w, per=275: f"(CASE WHEN {w} <= 0 THEN 0 ELSE greatest(1, ({w} + {per} - 1) // {per}) END)::BIGINT"
_PII = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {_q(V.PII_PATTERNS[t])}) THEN '{t}' END" for t in sorted(V.PII_PATTERNS)) + "], lambda x: x IS NOT NULL)"


def _types_sql(*columns: str) -> str:
    blob = "lower(concat_ws(chr(10), " + ", ".join(columns) + "))"
    found = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains({blob}, {_q(n)})" for n in needles) + f" THEN '{label}' END" for label, needles in V.CONTENT_TYPES.items()) + "], lambda x: x IS NOT NULL)"
    return f"(CASE WHEN len({found}) > 0 THEN {found} ELSE ['Factual'] END)"


def _tier_sql(tokens: str, words: str, modality: str, types: str, ext: str, confidence: str) -> str:
    strong = f"list_has_any({types}, [{', '.join(map(_q, V.STRONG_TYPES))}])"
    only = lambda m: f"(len({modality}) > 0 AND len(list_filter({modality}, lambda x: x <> '{m}')) = 0)"
    grid = f"(list_contains({modality}, 'tabular') OR {ext} IN ({', '.join(map(_q, [*V.TABULAR, 'json']))}))"
    score = f"(CASE WHEN {tokens} >= 8000 THEN 2 WHEN {tokens} >= 1500 THEN 1 ELSE 0 END)"
    score = f"(CASE WHEN {strong} THEN least(2, {score} + 1) ELSE {score} END)"
    score = f"(CASE WHEN {grid} AND NOT {strong} THEN greatest(0, {score} - 1) ELSE {score} END)"
    score = f"(CASE WHEN {ext} IN ('html', 'htm', 'log') AND {tokens} < 8000 THEN greatest(0, {score} - 1) ELSE {score} END)"
    return f"CASE WHEN ({tokens} <= 80 AND ({only('image')} OR {only('audio_video')} OR {words} <= 40)) OR {score} = 0 THEN 'Low' WHEN {score} = 2 AND coalesce(lower(trim({confidence})), '') <> 'low' THEN 'High' ELSE 'Medium' END"


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "documents", "doc_id").select("doc_id", "text", "source")
    return d.withColumn("words", text.word_count(F.col("text"))).withColumn("tokens", F.coalesce(text.token_estimate(F.col("text")), F.lit(0).cast("long")))


@query(f"SELECT doc_id, {_WORDS} AS words, {_PAGES(_WORDS)} AS pages, {_PAGES(_WORDS, 120)} AS document_pages FROM documents")
def word_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _measured(spark, sf_dir)
    return d.select("doc_id", "words", text.pages(F.col("words")).alias("pages"), text.pages(F.col("words"), text.DOCUMENT_PAGE).alias("document_pages"))


@query(f"SELECT doc_id, {_TOKENS} AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.token_estimate(F.col("text")), F.lit(0).cast("long")).alias("tokens"))


@query(f"WITH t AS (SELECT CASE WHEN w < 100 THEN 'lt100' WHEN w < 500 THEN '100_499' WHEN w < 1500 THEN '500_1499' WHEN w < 2500 THEN '1500_2499' ELSE 'ge2500' END AS tier, w FROM (SELECT {_WORDS} AS w FROM documents)) SELECT tier, count(*) AS items, sum(w)::BIGINT AS words FROM t GROUP BY tier")
def word_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).groupBy(text.word_tier(F.col("words")).alias("tier")).agg(F.count(F.lit(1)).alias("items"), F.sum("words").alias("words"))


@query(f"SELECT doc_id, array_to_string({_PII}, ', ') AS pii_types, CASE WHEN len({_PII}) > 0 THEN 'Yes' ELSE 'No' END AS pii_flag FROM documents")
def pii_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = signals.pii_types(F.col("text"))
    return texts(spark, sf_dir, "documents", "doc_id").select("doc_id", F.array_join(types, ", ").alias("pii_types"), F.when(F.size(types) > 0, "Yes").otherwise("No").alias("pii_flag"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(text, {_q(V.PRIVATE_KEY)}) THEN 'private_key' WHEN regexp_matches(text, {_q(V.KUBECONFIG)}) THEN 'kubeconfig' ELSE 'none' END AS secret FROM documents")
def secret_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id").select("doc_id", F.coalesce(signals.secret_kind(F.col("text")), F.lit("none")).alias("secret"))


@query(f"SELECT doc_id, array_to_string({_types_sql('text')}, '; ') AS content_type FROM documents")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id").select("doc_id", signals.joined(signals.content_types(F.col("text"))).alias("content_type"))


_TIERED = f"WITH m AS MATERIALIZED (SELECT {_WORDS} AS words, {_TOKENS} AS tokens, {_types_sql('text')} AS types, len({_PII}) > 0 AS pii FROM documents), t AS (SELECT *, {_tier_sql('tokens', 'words', chr(91) + _q('text') + chr(93), 'types', _q('txt'), 'NULL')} AS tier FROM m)"


@query(_TIERED + " SELECT tier, count(*) AS items, count(*) FILTER (pii) AS with_pii, sum(words)::BIGINT AS words, sum(tokens)::BIGINT AS tokens FROM t GROUP BY tier")
def quality_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one scan of the documents, all signals as native expressions, one aggregate."""
    d = _measured(spark, sf_dir)
    tier = signals.quality_tier(F.col("tokens"), F.col("words"), F.array(F.lit("text")), signals.content_types(F.col("text")), F.lit("txt"))
    return d.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.size(signals.pii_types(F.col("text"))) > 0).alias("with_pii"), F.sum("words").alias("words"), F.sum("tokens").alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(text) > 800 THEN concat(substr(text, 1, 800), '…') ELSE text END AS snippet, CASE WHEN length(text) > 4000 THEN concat(substr(text, 1, 4000), chr(10), '…(truncated)…') ELSE text END AS head FROM documents")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 800).alias("snippet"), text.truncated(F.col("text"), 4000, "\n…(truncated)…").alias("head"))


@query("SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS scrubbed FROM documents")
def scrubbed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.scrubbed(F.col("text")).alias("scrubbed"))


@query("SELECT doc_id, (CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(t, chr(10))) - CASE WHEN ends_with(t, chr(10)) THEN 1 ELSE 0 END END)::BIGINT AS lines FROM (SELECT doc_id, text, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents)")
def delimited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id").select("doc_id", text.delimited_rows(F.col("text")).alias("lines"))


_PAGE = "concat('<html><head><title> ', coalesce(source, ''), '</title></head><body><table><tr><td>', replace(coalesce(text, ''), chr(10), '</td></tr><tr><td>'), '</td></tr></table><img src=\"', coalesce(lang, ''), '/p.PNG?x=1\"><img alt=\"x\"><svg></svg></body></html>')"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out as pages: there is no table of web pages."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    body = F.regexp_replace(c("text"), "\n", "</td></tr><tr><td>")
    page = F.concat(F.lit("<html><head><title> "), c("source"), F.lit("</title></head><body><table><tr><td>"), body, F.lit('</td></tr></table><img src="'), c("lang"), F.lit('/p.PNG?x=1"><img alt="x"><svg></svg></body></html>'))
    return texts(spark, sf_dir, "documents", "doc_id").select("doc_id", page.alias("page"))


@query(f"""
    WITH p AS (SELECT doc_id, {_PAGE} AS page FROM documents)
    SELECT doc_id, concat('images: ', len(regexp_extract_all(page, '(?i)<img\\b')), '; other_image: 1; png: 1; svg: ', len(regexp_extract_all(page, '(?i)<svg\\b')), '; tables: ', len(regexp_extract_all(page, '(?i)<table\\b'))) AS counts,
           len(regexp_extract_all(page, '(?i)<td\\b'))::BIGINT AS cells, coalesce(nullif(trim(regexp_extract(page, '(?is)<title[^>]*>([^<]*)</title>', 1)), ''), '(untitled)') AS title FROM p""")
def html_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    return p.select("doc_id", html.counts_cell(html.content_counts(F.col("page"))).alias("counts"), html.tag_count(F.col("page"), "td").alias("cells"), html.title(F.col("page"), "(untitled)").alias("title"))


# --- signals of artifacts and files

_HINT = "CASE " + " ".join(f"WHEN contains(lower(path), {_q(n)}) THEN {_q(s)}" for n, s in V.SOURCE_HINTS) + " END"


@query(f"WITH {_ART} SELECT artifact_id, {_HINT} AS source FROM artifacts")
def source_guess_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts(spark, sf_dir).select("artifact_id", signals.source_system(F.col("path")).alias("source"))


_SUM_RULE = lambda col, groups: " AND ".join("(" + " OR ".join(f"contains({col}, {_q(w)})" for w in dict.fromkeys(fold_text(w) for w in g)) + ")" for g in groups)
_HAS = lambda *words: "(" + " OR ".join(f"contains(low, {_q(w)})" for w in words) + ")"
_DATE = f"coalesce(translate(nullif(regexp_extract(name, {_q(MONTH)}, 1), ''), '_/', '--'), nullif(regexp_extract(name, '\\b(20\\d{{2}})\\b', 1), ''), translate(nullif(regexp_extract(folder, {_q(MONTH)}, 1), ''), '_/', '--'), nullif(regexp_extract(folder, '\\b(20\\d{{2}})\\b', 1), ''))"
_DATED = lambda label: f"concat('{label}', coalesce(concat(' (', {_DATE}, ')'), ''), '.')"
_CONTRACT = f"({_HAS('cdi', 'cdd', 'contrat de travail', 'employment contract')} OR ({_HAS('contrat')} AND {_HAS('hr', 'rh')}) OR ({_HAS('contract')} AND {_HAS('hr', 'employment')}) OR contains(lower(body), 'contrat de travail') OR contains(lower(body), 'employment contract'))"
_READABLE = "(trim(body) <> '' AND e IN ('pdf', 'doc', 'docx', 'ppt', 'pptx'))"
_ONE = "trim(regexp_replace(concat('Email (.eml). Subject: ', trim(body)), '[\\s\\x{00A0}]+', ' ', 'g'))"
_SUMMARY = (
    f"CASE WHEN regexp_matches(body, {_q(V.PRIVATE_KEY)}) OR {_HAS('private key')} THEN 'WARNING: Private key material detected. Exclude from licensing.' WHEN regexp_matches(body, {_q(V.KUBECONFIG)}) OR {_HAS('kubeconfig')} THEN 'WARNING: Kubernetes cluster credentials detected. Exclude from licensing.' "
    + " ".join(f"WHEN {_SUM_RULE('fp', g)} THEN {_q(label)}" for label, *g in PATH_TOPICS) + " "
    + " ".join(f"WHEN {_SUM_RULE('ft', g)} THEN " + ("CASE WHEN contains(body, 'cdi') THEN 'Employment contract (CDI) for employee.' ELSE 'Employment contract for employee.' END" if label == "Employment contract for employee." else _q(label)) for label, *g in TEXT_TOPICS)
    + f" WHEN ft <> '' AND ({_HAS('photo', 'image', 'screenshot')} OR contains(ft, 'screenshot') OR contains(ft, {_q(fold_text(chr(99) + 'apture d' + chr(39) + 'écran'))})) THEN 'Screenshot / photo.'"
    f" WHEN {_HAS('bulletin', 'payslip')} THEN {_DATED('Payslip')} WHEN {_HAS('dsn')} THEN {_DATED('Monthly social declaration (DSN)')} WHEN {_HAS('urssaf')} THEN {_DATED('URSSAF contribution declaration')}"
    f" WHEN {_HAS('rib', 'iban')} THEN 'Bank details document.' WHEN {_HAS('cni', 'passport', 'carte vitale')} THEN 'Personal identity document.' WHEN {_HAS('cv', 'resume')} THEN 'Team member CV / resume.'"
    f" WHEN {_CONTRACT} AND {_HAS('avenant', 'amend')} THEN 'Employment contract amendment.' WHEN {_CONTRACT} AND {_HAS('stage', 'intern')} THEN 'Internship agreement.' WHEN {_CONTRACT} THEN 'Employment contract.'"
    f" WHEN {_HAS('mutuelle', 'prevoyance', 'insurance')} THEN 'Health / insurance documentation.' WHEN e IN ('xlsx', 'xls') AND {_HAS('bspce', 'bsa', 'cap')} THEN 'Equity / options tracking spreadsheet.'"
    f" WHEN {_READABLE} AND {_HAS('legal', 'contract', 'contrat')} THEN 'Company legal document.' WHEN {_READABLE} AND {_HAS('hr', 'rh')} THEN 'HR document.' WHEN {_READABLE} THEN 'Company document.'"
    f" WHEN e = 'eml' AND trim(body) <> '' THEN CASE WHEN length({_ONE}) <= 200 THEN {_ONE} WHEN length(regexp_extract(substr({_ONE}, 1, 197), '^(.*) ', 1)) >= 118 THEN concat(rtrim(regexp_extract(substr({_ONE}, 1, 197), '^(.*) ', 1)), '...') ELSE concat(rtrim(substr({_ONE}, 1, 197)), '...') END WHEN e = 'eml' THEN 'Email message (.eml).' "
    + " ".join(f"WHEN e IN ({', '.join(map(_q, kinds))}) THEN {_q(label)}" for label, kinds in FILE_KINDS) + " WHEN e <> '' THEN concat(upper(e), ' file.') ELSE 'Company file.' END"
)


@query(f"""
    WITH {_ART}, x AS (SELECT artifact_id, coalesce(filename, '') AS name, regexp_replace(coalesce(path, ''), '/?[^/]*$', '') AS folder, lower(trim(coalesce(extension, ''))) AS e, coalesce(snippet, '') AS body FROM artifacts),
    y AS (SELECT *, lower(concat_ws('/', folder, name)) AS low, trim(regexp_replace(strip_accents(lower(concat_ws('/', folder, name))), '[\\s\\x{{00A0}}]+', ' ', 'g')) AS fp, trim(regexp_replace(strip_accents(lower(body)), '[\\s\\x{{00A0}}]+', ' ', 'g')) AS ft FROM x)
    SELECT artifact_id, {_SUMMARY} AS summary FROM y""")
def summary_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.regexp_replace(F.coalesce("path", F.lit("")), r"/?[^/]*$", "")
    a = artifacts(spark, sf_dir).withColumn("fp", folded(F.concat_ws("/", folder, F.coalesce("filename", F.lit(""))))).withColumn("ft", folded(F.col("snippet")))
    return a.select("artifact_id", summary(F.col("filename"), folder, F.col("extension"), F.col("snippet"), F.col("fp"), F.col("ft")).alias("summary"))


_EXT = "lower(regexp_extract(name, '[^.]\\.([^.]+)$', 1))"
_CASE = lambda col, pairs, other: f"CASE {col} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in pairs) + f" ELSE {other} END"


@query(f"""
    SELECT drive_file_id, path, listed_at, coalesce(nullif({_EXT}, ''), {_CASE('coalesce(mime_type, chr(0))', V.MIME_EXTENSION.items(), "''")}) AS extension,
           coalesce(mime_type IN ({', '.join(map(_q, V.BINARY))}) OR regexp_matches(mime_type, '^(image|video|audio)/'), false) AS skipped, coalesce(mime_type IN ({', '.join(map(_q, V.SHEETS))}) AND size_bytes > {V.SHEET_BYTES}, false) AS large_sheet,
           {_CASE("coalesce(mime_type, '')", [(k, '; '.join(v)) for k, v in V.MIME_MODALITY.items()], "CASE WHEN starts_with(mime_type, 'image/') THEN 'image' WHEN regexp_matches(mime_type, '^(video|audio)/') THEN 'audio_video' ELSE '' END")} AS modality,
           {_CASE("coalesce(mime_type, '')", V.NATIVE.items(), "CASE WHEN size_bytes > 0 THEN 'binary' END")} AS kind FROM scan_rows""")
def mime_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = F.col("mime_type"), F.col("size_bytes")
    return table(spark, sf_dir, "scan_rows").select("drive_file_id", "path", "listed_at", signals.canonical_extension(F.col("name"), m).alias("extension"), signals.is_binary(m).alias("skipped"), signals.is_large_sheet(m, s).alias("large_sheet"), signals.joined(signals.mime_modalities(m)).alias("modality"), signals.native_kind(m, s).alias("kind"))


_MODALITY = (
    f"CASE WHEN e IN ({', '.join(map(_q, V.IMAGE))}) THEN 'image' WHEN e IN ({', '.join(map(_q, V.AUDIO_VIDEO))}) THEN 'audio_video' ELSE array_to_string(list_filter([CASE WHEN e IN ({', '.join(map(_q, V.CODE))}) THEN 'code' END, CASE WHEN e = 'pptx' THEN 'slides' END,"
    f" CASE WHEN e IN ({', '.join(map(_q, V.STRUCTURED))}) THEN 'structured_data' END, CASE WHEN e IN ({', '.join(map(_q, V.TABULAR))}) THEN 'tabular' END,"
    f" CASE WHEN e IN ({', '.join(map(_q, [*V.CODE, *V.TEXT, 'pptx', 'pdf', 'docx', 'html', 'htm']))}) OR e NOT IN ({', '.join(map(_q, [*V.TABULAR, *V.STRUCTURED]))}) THEN 'text' END], lambda x: x IS NOT NULL), '; ') END"
)


@query(f"WITH {_ART}, x AS (SELECT artifact_id, lower(coalesce(extension, '')) AS e FROM artifacts) SELECT artifact_id, {_MODALITY} AS modality, e IN ({', '.join(map(_q, V.TITLE_ONLY))}) AS title_only FROM x")
def extension_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.coalesce(F.col("extension"), F.lit(""))
    return artifacts(spark, sf_dir).select("artifact_id", signals.joined(signals.modalities(e)).alias("modality"), signals.is_title_only(e).alias("title_only"))


@query("""SELECT drive_file_id, listed_at, path, modified_time, CASE WHEN size_bytes IS NULL OR size_bytes < 0 THEN '' WHEN size_bytes < 1024 THEN concat(size_bytes, ' B') WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024.0)
    WHEN size_bytes < 1073741824 THEN printf('%.1f MB', size_bytes / 1048576.0) WHEN size_bytes < 1099511627776 THEN printf('%.1f GB', size_bytes / 1073741824.0) ELSE printf('%.1f TB', size_bytes / 1099511627776.0) END AS size,
    coalesce(epoch_us(CAST(modified_time AS TIMESTAMPTZ)) / 1e6, 0.0) AS modified_unix, coalesce(CAST(modified_time AS TIMESTAMPTZ) < TIMESTAMPTZ '2023-01-01 00:00:00+00', true) AS before_2023 FROM scan_rows""")
def sizes_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("modified_time")
    return table(spark, sf_dir, "scan_rows").select("drive_file_id", "listed_at", "path", "modified_time", text.human_size(F.col("size_bytes")).alias("size"), signals.unix_seconds(m).alias("modified_unix"), signals.modified_before(signals.instant(m), F.lit("2023-01-01T00:00:00Z").cast("timestamp")).alias("before_2023"))


@query(f"WITH {_ART} SELECT artifact_id, coalesce(nullif(regexp_extract(trim(drive_url), '/folders/([A-Za-z0-9_-]+)', 1), ''), split_part(split_part(trim(drive_url), '?', 1), '/', 1)) AS folder FROM artifacts WHERE drive_url IS NOT NULL")
def folder_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts(spark, sf_dir).filter(F.col("drive_url").isNotNull()).select("artifact_id", signals.folder_id(F.col("drive_url")).alias("folder"))


@query(f"""
    WITH state AS (SELECT drive_file_id, name, mime_type, is_folder, is_shortcut, shortcut_target_id FROM scan_rows WHERE drive_file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY drive_file_id ORDER BY epoch_us(CAST(modified_time AS TIMESTAMPTZ)) DESC NULLS LAST, name DESC NULLS LAST,
      mime_type DESC NULLS LAST, is_folder DESC NULLS LAST, is_shortcut DESC NULLS LAST, shortcut_target_id DESC NULLS LAST) = 1),
    link AS (SELECT drive_file_id, shortcut_target_id AS target_id FROM state WHERE is_shortcut)
    SELECT l.drive_file_id, l.target_id, t.name AS target_name, t.mime_type AS target_mime,
           CASE WHEN coalesce(l.target_id, '') = '' THEN 'no_target' WHEN t.is_folder IS NULL THEN 'missing' WHEN t.is_folder THEN 'folder' WHEN t.is_shortcut THEN 'chained' ELSE 'ok' END AS status
    FROM link l LEFT JOIN state t ON t.drive_file_id = l.target_id""")
def shortcut_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.resolve_shortcuts(table(spark, sf_dir, "scan_rows"))


@query(f"SELECT DISTINCT drive_file_id, path, CASE WHEN coalesce(mime_type IN ({', '.join(map(_q, V.BINARY))}) OR regexp_matches(mime_type, '^(image|video|audio)/'), false) THEN 'binary_skip' WHEN coalesce(mime_type IN ({', '.join(map(_q, V.SHEETS))}) AND size_bytes > {V.SHEET_BYTES}, false) THEN 'large_sheet_skip' ELSE 'read' END AS strategy, coalesce({_HINT}, 'Google Drive') AS source_guess FROM scan_rows WHERE NOT coalesce(is_folder, false) AND NOT coalesce(is_shortcut, false)")
def metadata_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.metadata_evidence(table(spark, sf_dir, "scan_rows")).select("drive_file_id", "path", "strategy", "source_guess").distinct()


# --- mail


@query("SELECT message_id, user_email, coalesce(date_unix, 0.0) AS date_unix FROM message")
def mail_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "message").select("message_id", "user_email", mail.date_unix(F.col("date_str")).alias("date_unix"))


@query("""SELECT message_id, user_email, 0 AS position, NULL::VARCHAR AS filename, 'message/rfc822' AS mime_type, size_estimate AS size_bytes FROM message
    UNION ALL SELECT message_id, user_email, i AS position, a.filename, a.mime_type, a.size_bytes FROM (SELECT message_id, user_email, unnest(attachments) AS a, unnest(range(1, len(attachments) + 1))::INTEGER AS i FROM message)""")
def attachment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.with_attachments(table(spark, sf_dir, "message")).select("message_id", "user_email", "position", "filename", "mime_type", "size_bytes")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each message: a message fetched again has other labels only."""
    m = table(spark, sf_dir, "message")
    return m.groupBy("message_id").agg(*[F.max(c).alias(c) for c in ("user_email", "thread_id", "subject", "date_unix", "size_estimate")])


_MSG = "messages AS (SELECT message_id, max(user_email) AS user_email, max(thread_id) AS thread_id, max(subject) AS subject, max(date_unix) AS date_unix, max(size_estimate) AS size_estimate FROM message GROUP BY message_id)"
_THR = f"{_MSG}, threads AS (SELECT user_email, thread_id, first(subject ORDER BY date_unix, message_id) AS subject, sum(coalesce(size_estimate, 0))::BIGINT AS size_bytes, count(*) AS messages FROM messages GROUP BY ALL)"


@query(f"WITH {_THR} SELECT * FROM threads")
def thread_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.threads(_messages(spark, sf_dir))


@query(f"WITH {_MSG} SELECT user_email, thread_id, row_number() OVER (PARTITION BY user_email, thread_id ORDER BY date_unix, message_id) - 1 AS position, message_id FROM messages")
def thread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.thread_messages(_messages(spark, sf_dir))


def _fold(rows: str, order: str, size: str, cap: str, item: str, most: str = "9223372036854775807") -> str:
    """SQL of a fill: a fold over the ordered list, whose state is what is used, how many, and the items taken."""
    state = lambda item, size: f"{{'used': 0::HUGEINT, 'n': 0, 'got': []::VARCHAR[], 'item': {item}, 'size': {size}::HUGEINT, 'cap': ({cap})::HUGEINT}}"
    return f"""list_reduce(list_prepend({state("''", 0)}, list({state(item, size)} ORDER BY {order})), lambda a, x: CASE WHEN a.n < {most} AND a.used + x.size <= a.cap
      THEN {{'used': a.used + x.size, 'n': a.n + 1, 'got': list_append(a.got, x.item), 'item': '', 'size': 0::HUGEINT, 'cap': a.cap}} ELSE a END)"""


_THREAD_CAP = 200_000


@query(f"WITH {_THR}, f AS (SELECT {_fold('threads', 'user_email, thread_id', 'size_bytes', str(_THREAD_CAP), 'thread_id', str(THREADS))} AS r FROM threads) SELECT unnest(r.got) AS thread_id FROM f")
def threads_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.first_threads(rollup.threads(_messages(spark, sf_dir)), THREADS, _THREAD_CAP, ["user_email", "thread_id"]).select("thread_id")


# --- labels


@query(f"WITH {_CLS} SELECT * FROM labels")
def checkpoint_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir)


@query(f"WITH {_LAB} SELECT artifact_id, filename, bucket_number, confidence FROM labelled")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("artifact_id", "filename", "bucket_number", "confidence")


@query(f"WITH {_ART}, {_CLS} SELECT coalesce(artifact_id, row_id) AS artifact_id, filename, bucket_number, CASE WHEN trim(bucket_name) <> '' THEN bucket_name END AS bucket_name, llm_pass FROM artifacts FULL JOIN labels ON row_id = artifact_id")
def merge_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, True)


@query(f"WITH {_ART}, {_CLS} SELECT artifact_id, filename, bucket_number, CASE WHEN trim(bucket_name) <> '' THEN bucket_name END AS bucket_name, llm_pass FROM artifacts LEFT JOIN labels ON row_id = artifact_id")
def merge_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, False)


def _merged(spark: SparkSession, sf_dir: str, orphans: bool) -> DataFrame:
    m = merge.merge_checkpoints(artifacts(spark, sf_dir), labels(spark, sf_dir), orphans=orphans)
    return m.select("artifact_id", "filename", "bucket_number", merge.filled(F.col("bucket_name")).alias("bucket_name"), "llm_pass")


@query("SELECT DISTINCT artifact_id FROM evidence WHERE artifact_id IS NOT NULL AND artifact_id NOT IN (SELECT row_id FROM classifications WHERE row_id IS NOT NULL)")
def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "evidence").select("artifact_id").filter(F.col("artifact_id").isNotNull()).distinct()
    return merge.pending(e, table(spark, sf_dir, "classifications"), "artifact_id", "row_id")


@query("SELECT DISTINCT artifact_id FROM evidence WHERE artifact_id IN (SELECT row_id FROM classifications)")
def resume_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "evidence").select("artifact_id").distinct()
    return merge.resumed(e, table(spark, sf_dir, "classifications"), "artifact_id", "row_id")


@query(f"WITH {_LAB} SELECT artifact_id FROM labelled WHERE lower(trim(confidence)) = 'low' AND coalesce(llm_pass, 1) = 1")
def second_pass_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.second_pass_candidates(labelled(spark, sf_dir)).select("artifact_id")


@query(f"WITH {_LAB} SELECT artifact_id FROM labelled WHERE bucket_number BETWEEN 1 AND 7 AND trim(rationale) <> ''")
def subcategory_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.subcategory_candidates(labelled(spark, sf_dir)).select("artifact_id")


_TAX = "taxonomy AS (SELECT * FROM (VALUES " + ", ".join(f"({b}, {_q(n)}, {i})" for b, names in V.SUBCATEGORIES.items() for i, n in enumerate(names)) + ") t(bucket_number, label, ordinal))"


@query(f"""
    WITH {_CLS}, {_TAX}, raw AS (SELECT row_id, l.bucket_number, CASE WHEN row_id % 2 = 0 THEN concat(' ', upper(t.label)) ELSE 'unknown' END AS raw FROM labels l LEFT JOIN taxonomy t ON t.bucket_number = l.bucket_number AND t.ordinal = row_id % 13),
    fallback AS (SELECT bucket_number, arg_max(label, ordinal) AS label FROM taxonomy GROUP BY bucket_number)
    SELECT row_id, coalesce(t.label, f.label) AS sub_category FROM raw r LEFT JOIN taxonomy t ON t.bucket_number = r.bucket_number AND lower(t.label) = lower(trim(r.raw)) LEFT JOIN fallback f ON f.bucket_number = r.bucket_number""")
def subcategory_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in another case are recognised, unknown ones become the category's last."""
    tax = F.broadcast(merge.taxonomy(table(spark, sf_dir, "classifications")))  # 108 rows
    l = labels(spark, sf_dir).withColumn("ordinal", (F.col("row_id") % 13).cast("int")).join(tax, ["bucket_number", "ordinal"], "left")
    raw = l.withColumn("raw", F.when(F.col("row_id") % 2 == 0, F.concat(F.lit(" "), F.upper("label"))).otherwise("unknown")).drop("label", "ordinal")
    return merge.normalized_subcategory(raw, "bucket_number", "raw", "sub_category").select("row_id", "sub_category")


_SUMS = "list_sum(list_transform(string_split(concat(coalesce(substr(filename, 1, 400) || CASE WHEN length(filename) > 400 THEN '…' ELSE '' END, 'None'), ' ', CASE WHEN length(d) > 1200 THEN substr(d, 1, 1200) || '…' ELSE d END), ''), lambda c: unicode(c)))"


@query(f"""
    WITH {_ART}, x AS (SELECT artifact_id, filename, concat_ws(' | ', content_summary, snippet) AS d FROM artifacts), s AS (SELECT artifact_id, {_SUMS}::BIGINT AS h FROM x)
    SELECT artifact_id AS row_id, (h % 7 + 1)::INTEGER AS bucket_number, ['high', 'medium', 'low'][h % 3 + 1] AS confidence, CASE WHEN h % 3 = 2 THEN 2 ELSE 1 END AS llm_pass FROM s""")
def two_pass_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch protocol with the offline stand-in: unsure rows are asked again and replaced."""
    return C.two_pass(artifacts(spark, sf_dir)).select("row_id", "bucket_number", "confidence", "llm_pass")


# --- roll-ups

_TOP = lambda col, metric, top, src="labelled": f"(SELECT '{metric}' AS Metric, Key, Value FROM (SELECT coalesce(nullif({col}, ''), '(blank)') AS Key, count(*) AS Value FROM {src} GROUP BY 1 ORDER BY Value DESC, Key LIMIT {top}))"


@query(f"""
    WITH {_LAB} SELECT 'bucket_count' AS Metric, coalesce(bucket_number::VARCHAR, '(blank)') AS Key, count(*) AS Value FROM labelled GROUP BY ALL UNION ALL SELECT 'confidence_count', coalesce(nullif(confidence, ''), '(blank)'), count(*) FROM labelled GROUP BY ALL
    UNION ALL {_TOP('source_guess', 'source_guess_top', 40)} UNION ALL {_TOP('lower(extension)', 'extension_top', 40)} UNION ALL {_TOP('modality', 'modality_top', 40)}""")
def overview_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.overview(materialize(labelled(spark, sf_dir).select("bucket_number", "confidence", "source_guess", "extension", "modality"), "labelled"))


_DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {_q(v)})" for k, v in V.BUCKETS.items()) + ") t(bucket_number, bucket_name))"


@query(f"""
    WITH {_CLS}, {_DIM}, per AS (SELECT d.bucket_number, d.bucket_name, count(row_id) AS items, count(*) FILTER (lower(trim(confidence)) = 'high') AS high, count(*) FILTER (lower(trim(confidence)) = 'low') AS low FROM dim d LEFT JOIN labels l ON l.bucket_number = d.bucket_number GROUP BY ALL)
    SELECT * FROM per UNION ALL SELECT 0, 'Total', sum(items)::BIGINT, sum(high)::BIGINT, sum(low)::BIGINT FROM per""")
def bucket_summary_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.bucket_summary(labels(spark, sf_dir))


_PREFIX = "CASE WHEN len(p) >= 4 THEN array_to_string(p[len(p) - 3 : len(p) - 1], '/') ELSE array_to_string(p[1 : len(p) - 1], '/') END"
_TOPK = lambda value, k, name: f"{name} AS (SELECT bucket_number, array_to_string(list(v ORDER BY n DESC, v), ' | ') AS {name} FROM (SELECT bucket_number, {value} AS v, count(*) AS n FROM e WHERE coalesce({value}, '') <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY bucket_number ORDER BY count(*) DESC, v) <= {k}) GROUP BY bucket_number)"
_PROFILE = f"""
    WITH {_LAB}, {_DIM}, e AS (SELECT *, string_split(replace(path, chr(92), '/'), '/') AS p FROM labelled WHERE bucket_number BETWEEN 1 AND 7),
    basic AS (SELECT bucket_number, count(*) AS items, count(*) FILTER (lower(extension) IN ('csv', 'json', 'xlsx')) AS structured, count(*) FILTER (source_guess IN ('Slack', 'Notion', 'Jira', 'GitHub', 'Google Drive')) AS exports, count(*) FILTER (lower(extension) = 'pdf') AS pdfs FROM e GROUP BY 1),
    sources AS (SELECT bucket_number, array_to_string(list(source_guess ORDER BY source_guess), ' | ') AS sources FROM (SELECT DISTINCT bucket_number, source_guess FROM e WHERE trim(source_guess) <> '' QUALIFY dense_rank() OVER (PARTITION BY bucket_number ORDER BY source_guess) <= 20) GROUP BY 1),
    {_TOPK('lower(extension)', 12, 'extensions')}, {_TOPK(_PREFIX, 8, 'places')},
    samples AS (SELECT bucket_number, array_to_string(list(coalesce(filename, '') ORDER BY artifact_id), ' | ') AS samples FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY bucket_number ORDER BY artifact_id) <= 8) GROUP BY 1),
    many AS (SELECT *, pdfs >= greatest(10, items // 3) AS m, structured > 0 OR exports > 0 AS x FROM basic)
    SELECT d.bucket_number, d.bucket_name, coalesce(items, 0) AS items, coalesce(sources, '') AS sources, coalesce(extensions, '') AS extensions, coalesce(places, '') AS places, coalesce(samples, '') AS samples,
      CASE WHEN items IS NULL THEN 'Unknown — no evidence found in dump' WHEN x AND m THEN 'Medium — mix of exports + many document PDFs' WHEN x THEN 'Low — structured exports / system dumps present' WHEN m THEN 'Medium — mostly document artifacts (likely manual cleanup)' ELSE 'Medium — unstructured dump; may require manual interpretation' END AS effort
    FROM dim d LEFT JOIN many USING (bucket_number) LEFT JOIN sources USING (bucket_number) LEFT JOIN extensions USING (bucket_number) LEFT JOIN places USING (bucket_number) LEFT JOIN samples USING (bucket_number)"""


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["artifact_id", "bucket_number", "source_guess", "extension", "path", "filename"]
    return rollup.bucket_profile(materialize(labelled(spark, sf_dir).select(*keep), "labelled"))


@query(_PROFILE)
def bucket_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _profile(spark, sf_dir)
    lists = {c: F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit(""))), " | ") for c in ("sources", "extensions", "places", "samples")}
    return p.withColumns(lists)


@query()
def inventory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.inventory(_profile(spark, sf_dir))


@query(f"WITH {_CLS}, {_DIM}, n AS (SELECT d.bucket_number, count(row_id) AS n FROM dim d LEFT JOIN labels l ON l.bucket_number = d.bucket_number GROUP BY ALL) SELECT bool_and(n >= 50) AS ready, min(n) AS least FROM n")
def stratified_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.ready(labels(spark, sf_dir), 50)


@query(f"WITH {_CLS} SELECT bucket_name, count(*) AS items, count(*) FILTER (trim(rationale) <> '') AS with_reason, count(*) FILTER (llm_pass = 1) AS first_pass, count(*) FILTER (llm_pass = 2) AS second_pass FROM labels GROUP BY bucket_name")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).groupBy("bucket_name").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.trim("rationale") != "").alias("with_reason"), F.count_if(F.col("llm_pass") == 1).alias("first_pass"), F.count_if(F.col("llm_pass") == 2).alias("second_pass"))


@query(f"WITH {_LAB} SELECT artifact_id, bucket_number FROM labelled WHERE bucket_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bucket_number ORDER BY artifact_id) <= 50")
def trim_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("artifact_id", "bucket_number").filter(F.col("bucket_number").isNotNull())
    return recency.first_per_group(rows, ["bucket_number"], [F.asc("artifact_id")], 50)


@query(f"WITH {_LAB} SELECT artifact_id, confidence, pii_flag FROM labelled WHERE lower(trim(confidence)) = 'low' OR lower(trim(pii_flag)) = 'yes'")
def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("artifact_id", "confidence", "pii_flag")
    return rows.filter((F.lower(F.trim("confidence")) == "low") | (F.lower(F.trim("pii_flag")) == "yes"))


@query(f"""WITH {_LAB} SELECT artifact_id, coalesce(filename, '') AS item_name, coalesce(extension, '') AS file_type, coalesce(word_count, 0)::BIGINT AS word_count, coalesce(bucket_number::VARCHAR, '') AS bucket_number, coalesce(path, '') AS place,
    CASE WHEN size_bytes IS NULL OR size_bytes < 0 THEN '' WHEN size_bytes < 1024 THEN concat(size_bytes, ' B') WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024.0) WHEN size_bytes < 1073741824 THEN printf('%.1f MB', size_bytes / 1048576.0) ELSE printf('%.1f GB', size_bytes / 1073741824.0) END AS size FROM labelled""")
def display_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    shown = display(rows.withColumn("llm_pass", F.col("artifact_id")))  # the id rides along in a text column
    return shown.select(F.col("LLM Pass").cast("long").alias("artifact_id"), F.col("Item Name").alias("item_name"), F.col("File Type").alias("file_type"), F.col("Word Count").alias("word_count"), "bucket_number", F.col("Path / Subsection").alias("place"), F.col("Size").alias("size"))


@query(f"""WITH {_LAB}, y AS (SELECT artifact_id, coalesce(token_count, 0) AS t, coalesce(word_count, 0) AS w, list_filter(list_transform(regexp_split_to_array(coalesce(modality, ''), '[;,]'), lambda x: trim(x)), lambda x: x <> '') AS m, lower(coalesce(extension, '')) AS e, confidence,
    {_types_sql("coalesce(rationale, '')", "coalesce(content_summary, '')", "coalesce(snippet, '')", "coalesce(filename, '')", "coalesce(path, '')")} AS types FROM labelled) SELECT artifact_id, array_to_string(types, '; ') AS content_type, {_tier_sql('t', 'w', 'm', 'types', 'e', 'confidence')} AS quality_tier FROM y""")
def enriched_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.enriched(labelled(spark, sf_dir)).select("artifact_id", "content_type", "quality_tier")


@query(f"WITH {_ART} SELECT p AS place, count(*) AS items FROM (SELECT {_PREFIX} AS p FROM (SELECT string_split(path, '/') AS p FROM artifacts WHERE path IS NOT NULL)) WHERE p <> '' GROUP BY p")
def path_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = artifacts(spark, sf_dir).select(signals.path_prefix(F.col("path")).alias("place"))
    return a.filter(F.col("place") != "").groupBy("place").agg(F.count(F.lit(1)).alias("items"))


@query("""WITH d AS (SELECT DISTINCT artifact_id AS id FROM documents WHERE artifact_id IS NOT NULL), e AS (SELECT DISTINCT artifact_id AS id FROM evidence), c AS (SELECT DISTINCT row_id AS id FROM classifications)
    SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM d UNION SELECT * FROM e UNION SELECT * FROM c) UNION ALL SELECT 'union_all', count(*) FROM (SELECT * FROM d UNION ALL SELECT * FROM e UNION ALL SELECT * FROM c)
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM d INTERSECT SELECT * FROM c) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM c)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("id"))
    d, e, c = ids("documents", "artifact_id").filter(F.col("id").isNotNull()).distinct(), ids("evidence", "artifact_id").distinct(), ids("classifications", "row_id").distinct()
    parts = {"union": d.union(e).union(c).distinct(), "union_all": d.unionAll(e).unionAll(c), "intersect": d.intersect(c), "except": e.subtract(c)}
    counted = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n") for k, p in parts.items()]
    return counted[0].unionAll(counted[1]).unionAll(counted[2]).unionAll(counted[3])


@query("SELECT first(trim(owner_email) ORDER BY listed_at, drive_file_id) AS email, lower(trim(owner_email)) AS key FROM scan_rows WHERE trim(owner_email) <> '' GROUP BY 2")
def user_list_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "scan_rows").filter(F.trim("owner_email") != "")
    return s.groupBy(F.lower(F.trim("owner_email")).alias("key")).agg(F.min(F.struct("listed_at", "drive_file_id", F.trim("owner_email").alias("email"))).alias("s")).select("s.email", "key")


@query("SELECT o_orderpriority AS kind, count(*) AS jobs, round(avg(o_totalprice), 6) AS mean_seconds FROM (SELECT * FROM orders WHERE o_totalprice BETWEEN 3 AND 21600 QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) <= 12) GROUP BY 1")
def job_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean duration of the last twelve plausible jobs of each kind; orders stand in for jobs."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_totalprice").between(3, 21600))
    last = recency.first_per_group(o, ["o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 12)
    return last.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("jobs"), F.round(F.avg("o_totalprice"), 6).alias("mean_seconds"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200).select("o_orderkey")


# --- samples

_BIN = f"{_FILES}, binaries AS (SELECT drive_file_id, coalesce(lower(trim(owner_email)), '') AS account, size_bytes, path FROM files WHERE NOT coalesce(is_folder, false) AND NOT coalesce(is_shortcut, false) AND size_bytes > 0 AND coalesce(mime_type, '') NOT IN ({', '.join(map(_q, V.NATIVE))}))"


def binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).filter(~F.coalesce("is_folder", F.lit(False)) & ~F.coalesce("is_shortcut", F.lit(False)))
    f = f.filter(signals.native_kind(F.col("mime_type"), F.col("size_bytes")) == "binary")
    return f.select("drive_file_id", F.coalesce(F.lower(F.trim("owner_email")), F.lit("")).alias("account"), "size_bytes", "path")


_NAT = f"{_FILES}, native AS (SELECT drive_file_id, coalesce(lower(trim(owner_email)), '') AS account, modified_time FROM files WHERE mime_type IN ({', '.join(map(_q, V.NATIVE))}))"


def natives(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).filter(F.col("mime_type").isin(*V.NATIVE))
    return f.select("drive_file_id", F.coalesce(F.lower(F.trim("owner_email")), F.lit("")).alias("account"), "modified_time")


@query(f"WITH {_NAT} SELECT drive_file_id FROM native ORDER BY coalesce(modified_time, '') DESC, drive_file_id LIMIT {OVERALL}")
def recency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recency.most_recent(natives(spark, sf_dir), "modified_time", "drive_file_id", OVERALL).select("drive_file_id")


@query(f"""WITH {_NAT}, r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY coalesce(modified_time, '') DESC, drive_file_id) AS k FROM native), floor AS (SELECT drive_file_id FROM r WHERE k <= {PER_ACCOUNT}),
    rest AS (SELECT drive_file_id, row_number() OVER (ORDER BY coalesce(modified_time, '') DESC, drive_file_id) AS i FROM r WHERE k > {PER_ACCOUNT}) SELECT drive_file_id FROM floor UNION ALL SELECT drive_file_id FROM rest WHERE i <= greatest({OVERALL} - (SELECT count(*) FROM floor), 0)""")
def native_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recency.native_by_account(materialize(natives(spark, sf_dir), "native"), "account", "modified_time", "drive_file_id", PER_ACCOUNT, OVERALL).select("drive_file_id")


@query(f"WITH {_BIN}, f AS (SELECT {_fold('binaries', 'size_bytes DESC, drive_file_id', 'size_bytes', str(CAP), 'drive_file_id')} AS r FROM binaries) SELECT unnest(r.got) AS drive_file_id FROM f")
def greedy_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.greedy_fill(binaries(spark, sf_dir), "size_bytes", CAP, ["drive_file_id"]).select("drive_file_id")


@query(f"WITH {_BIN}, f AS (SELECT {_fold('binaries', 'path, drive_file_id', 'size_bytes', str(CAP), 'drive_file_id')} AS r FROM binaries) SELECT unnest(r.got) AS drive_file_id FROM f")
def as_is_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.as_is_fill(binaries(spark, sf_dir), "size_bytes", CAP, "drive_file_id", ["path", "drive_file_id"]).select("drive_file_id")


@query(f"""WITH {_BIN}, share AS (SELECT {CAP} // count(DISTINCT account) AS s FROM binaries), per AS (SELECT account, {_fold('binaries', 'size_bytes DESC, drive_file_id', 'size_bytes', 's', 'drive_file_id')} AS r FROM binaries, share GROUP BY account, s),
    got AS (SELECT unnest(r.got) AS drive_file_id FROM per), spent AS (SELECT {CAP} - sum(r.used) AS rest_bytes FROM per), rest AS (SELECT {_fold('binaries', 'size_bytes DESC, account, drive_file_id', 'size_bytes', 'rest_bytes', 'drive_file_id')} AS r FROM binaries, spent WHERE drive_file_id NOT IN (SELECT drive_file_id FROM got) GROUP BY rest_bytes)
    SELECT * FROM got UNION ALL SELECT unnest(r.got) FROM rest""")
def equal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.equal_split(materialize(binaries(spark, sf_dir), "binaries"), "account", "size_bytes", CAP, ["drive_file_id"]).select("drive_file_id")


@query()
def binary_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.binary_by_account(materialize(binaries(spark, sf_dir), "binaries"), "account", "size_bytes", "drive_file_id", CAP).select("drive_file_id", "account", "size_bytes")


@query()
def two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = binaries(spark, sf_dir).withColumn("folder", F.substring_index("path", "/", 1))
    return select.two_phase(materialize(rows, "binaries"), "folder", "size_bytes", "path", "drive_file_id", 5, CAP).select("drive_file_id", "folder", "size_bytes")


@query(f"""WITH {_FILES}, k AS (SELECT coalesce(lower(trim(owner_email)), '') AS account, {_CASE("coalesce(mime_type, '')", V.NATIVE.items(), "CASE WHEN size_bytes > 0 THEN 'binary' END")} AS kind, size_bytes FROM files)
    SELECT account, count(*) FILTER (kind = 'gsheets') >= 3 AND count(*) FILTER (kind = 'gdocs') >= 3 AND count(*) FILTER (kind = 'gslides') >= 3 AND coalesce(sum(size_bytes) FILTER (kind = 'binary'), 0) >= 1000000 AS enough FROM k GROUP BY account""")
def enough_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select(F.coalesce(F.lower(F.trim("owner_email")), F.lit("")).alias("account"), signals.native_kind(F.col("mime_type"), F.col("size_bytes")).alias("kind"), "size_bytes")
    return recency.enough_native(f, "account", "kind", "size_bytes", 1, 1_000_000)


@query(f"WITH {_BIN} SELECT account, sum(size_bytes)::BIGINT AS bytes, count(*) AS items FROM binaries GROUP BY account")
def account_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binaries(spark, sf_dir).groupBy("account").agg(F.sum("size_bytes").alias("bytes"), F.count(F.lit(1)).alias("items"))


@query("SELECT drive_file_id, name, path, CASE WHEN coalesce(owner_email, '') = '' THEN 'nobody' ELSE owner_email END AS owner_email, coalesce(size_bytes, 0) AS size_bytes, coalesce(modified_time, '') AS modified_time FROM scan_rows WHERE NOT coalesce(is_folder, false) AND NOT coalesce(is_shortcut, false) AND coalesce(drive_file_id, '') <> ''")
def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.all_files(table(spark, sf_dir, "scan_rows"), "nobody")


@query("SELECT drive_file_id, path, listed_at, array_to_string(list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda p: p NOT IN ('', '.', '..') AND NOT regexp_matches(p, '^[A-Za-z]:$')), '/') AS safe FROM scan_rows")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scan_rows").select("drive_file_id", "path", "listed_at", text.safe_path(F.col("path")).alias("safe"))


_NUM = "row_number() OVER (PARTITION BY lower(name) ORDER BY drive_file_id) - 1"


@query(f"WITH {_FILES}, n AS (SELECT drive_file_id, name, {_NUM} AS k, regexp_extract(name, '.(\\.[^.]+)$', 1) AS suffix FROM files WHERE name IS NOT NULL) SELECT drive_file_id, CASE WHEN k = 0 THEN name ELSE concat(substr(name, 1, length(name) - length(suffix)), ' (', k, ')', suffix) END AS name FROM n")
def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are equal in any case are numbered in order of their ids."""
    named = files(spark, sf_dir).filter(F.col("name").isNotNull()).select("drive_file_id", "name", F.lower("name").alias("key"))
    return select.place_in_groups(named, ["key"], [F.asc("drive_file_id")], "k").select("drive_file_id", text.numbered_name(F.col("name"), F.col("k")).alias("name"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ours, not the inventory's: the windowed counts of the streaming module, over a table."""
    return rounds.running_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@query(f"""
    WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:40] AS lines FROM documents),
    s AS (SELECT doc_id, list_filter(lines, lambda x: NOT (length(x) < 12 OR length(regexp_replace(x, '[^\\pL]', '', 'g')) = 0
      OR (length(regexp_replace(x, '[^\\p{{Lu}}]', '', 'g')) / greatest(length(regexp_replace(x, '[^\\pL]', '', 'g')), 1) > 0.85 AND len(regexp_split_to_array(x, '\\s+')) <= 14))
      AND NOT regexp_matches(x, {_q(GREETING)}) AND NOT (regexp_matches(x, {_q(LETTER_HEAD)}) AND length(x) < 80) AND NOT regexp_matches(lower(x), '^https?://') AND length(x) >= 18)[1] AS line FROM l)
    SELECT doc_id, line FROM s""")
def best_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id").select("doc_id", telling_line(F.col("text")).alias("line"))
