"""One line about an artifact, from an ordered list of rules over its path and text."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import vocab as V
from corpusloom.functions.text import EMOJI, compact

# The rules, in order. Each is a summary and groups of words; a rule holds if every group has a word that occurs.
PATH_TOPICS = [
    ("Legal DD request checklist for M&A review.", ["dd", "due diligence", "diligence", "m&a", "ma ", "acquisition", "merger"], ["checklist", "request", "requests", "list", "question", "q&a", "qa"]),
    ("Cap table showing ownership structure.", ["cap table", "captable", "cap_table", "table de capitalisation", "capitalisation"]),
    ("French company registration extract (KBIS).", ["kbis", "extrait kbis"]),
    ("Commercial registry extract.", ["rcs", "registre du commerce", "commercial registry", "registry extract"]),
    ("No-bankruptcy certificate.", ["no bankruptcy", "non bankruptcy", "non-faillite", "non faillite", "no_bankruptcy"]),
    ("Shareholders unanimous decision agreement.", ["shareholder", "shareholders"], ["unanimous", "decision", "resolution"]),
    ("Corporate regulatory document.", ["statuts", "bylaws", "articles of association"]),
    ("Statement of company indebtedness.", ["indebtedness", "endettement", "debt statement", "dettes"]),
    ("Individual employee payslip.", ["payslip", "bulletin", "bulletin de paie", "fiche de paie", "pay slip"]),
    ("Health insurance (mutuelle) document.", ["mutuelle", "health insurance", "complémentaire santé", "complementaire sante", "assurance sante", "prevoyance"]),
    ("Employee resignation letter.", ["resignation", "démission", "demission", "lettre de demission"]),
    ("Employment/departure document.", ["termination", "departure", "rupture", "solde de tout compte", "pole emploi", "pôle emploi"]),
    ("Employment contract for employee.", ["contract", "contrat"], ["employment", "travail", "cdi", "cdd", "hr", "rh"]),
    ("Loan repayment schedule.", ["loan", "amortization", "amortisation", "repayment", "échéancier", "echeancier", "calendrier de remboursement"]),
    ("Fixed asset depreciation schedule.", ["depreciation", "amortissement", "immobilisation", "fixed asset"]),
    ("R&D tax credit (CIR) calculation worksheet.", ["cir", "credit d'impot recherche", "crédit d'impôt recherche"]),
    ("Assets and liabilities statement.", ["balance sheet", "bilan", "actif", "passif"]),
    ("Professional insurance certificate.", ["insurance", "assurance", "rc pro", "responsabilite"], ["certificate", "attestation"]),
    ("Screenshot / photo.", ["screenshot", "capture", "photo", "image", "img_", "scan"]),
]
TEXT_TOPICS = [
    ("Code security issue tracking and compliance checklists.", ["cve-", "vulnerability", "threat", "security issue", "security", "compliance", "iso 27001", "soc 2"]),
    ("Cluster cost analysis and cloud spending optimization strategies.", ["kubernetes", "k8s", "cluster", "helm", "kubeconfig", "namespace", "deployment"], ["cost", "billing", "finops", "spend", "savings", "optimization", "chargeback"]),
    ("Kubernetes cluster documentation and operational notes.", ["kubernetes", "k8s", "cluster", "helm", "kubeconfig", "namespace", "deployment"]),
    ("Cloud cost analysis and spending optimization strategies.", ["aws", "gcp", "azure", "terraform", "cloudformation"], ["cost", "billing", "spend", "savings", "optimization"]),
    ("Legal due diligence request checklist for M&A review.", ["due diligence", "dd request", "dd checklist", "legal dd", "diligence", "audit", "liste de demandes", "liste des demandes"]),
    ("Cap table showing ownership structure.", ["cap table", "capitalization table", "table de capitalisation", "cap-table"]),
    ("No-bankruptcy certificate.", ["no bankruptcy", "non-bankruptcy", "non faillite", "absence de faillite", "attestation de non faillite", "certificat de non faillite"]),
    ("French company registration extract (KBIS).", ["kbis", "extrait kbis"]),
    ("Commercial registry extract.", ["commercial register", "registry extract", "registre du commerce", "registre du commerce et des societes", "rcs", "r.c.s"]),
    ("Statement of company indebtedness.", ["indebtedness", "statement of indebtedness", "endettement", "dettes"]),
    ("Shareholders unanimous decision agreement.", ["unanimous decision", "décision unanime", "decision unanime", "resolution unanime", "proces verbal"]),
    ("Shareholders register.", ["shareholder register", "registre des actionnaires", "registre actionnaires"]),
    ("Shareholder accounts register.", ["shareholder accounts", "compte courant d'associ"]),
    ("Corporate regulatory document.", ["articles of association", "statuts", "bylaws"]),
    ("Employee resignation letter.", ["resignation", "démission", "demission", "lettre de demission"]),
    ("Health insurance (mutuelle) document.", ["mutuelle", "complémentaire santé", "complementaire sante", "assurance sante", "prevoyance", "assurance maladie"]),
    ("Individual employee payslip.", ["payslip", "pay slip", "bulletin de paie", "fiche de paie"]),
    ("Employment contract for employee.", ["employment contract", "contrat de travail", "cdi", "cdd"]),
    ("Employment/departure document.", ["termination", "departure", "rupture", "solde de tout compte", "attestation pôle emploi", "attestation pole emploi", "pole emploi", "certificat de travail", "attestation employeur"]),
    ("Loan repayment schedule.", ["loan", "repayment schedule", "amortization", "amortisation"]),
    ("Fixed asset depreciation schedule.", ["fixed asset", "depreciation", "immobilisation", "amortissement"]),
    ("Professional insurance certificate.", ["professional insurance", "assurance", "responsibility", "rc pro", "responsabilite"]),
    ("R&D tax credit (CIR) calculation worksheet.", ["r&d tax", "cir", "crédit d'impôt recherche", "credit d'impot recherche"]),
    ("Assets and liabilities statement.", ["assets and liabilities", "actif et passif", "bilan"]),
]
FILE_KINDS = [
    ("Photo / image.", ["png", "jpg", "jpeg", "webp", "gif", "tiff", "bmp", "heic"]), ("Video file.", ["mp4", "mov", "m4v", "avi", "mkv", "webm"]), ("Audio recording.", ["mp3", "wav", "m4a", "aac", "flac", "ogg"]), ("Archive file.", ["zip", "7z", "rar", "tar", "gz", "tgz", "bz2", "xz"]),
    ("Company document.", ["pdf", "doc", "docx", "ppt", "pptx"]), ("Company spreadsheet.", ["xlsx", "xlsm", "xls", "csv", "tsv"]), ("Certificate / key material.", ["key", "pem", "crt", "cer", "p12", "pfx"]), ("Database script / SQL export.", ["sql"]),
    ("Source code file.", ["py", "js", "ts", "tsx", "java", "go", "rb", "php", "c", "cc", "cpp", "h", "hpp", "rs"]), ("Configuration file.", ["yml", "yaml", "toml", "ini", "conf", "config", "env"]), ("JSON data file.", ["json"]), ("Log file.", ["log"]),
]
MONTH = r"((?:(?:0?[1-9]|1[0-2])[-_/](?:20)?\d{2})|(?:(?:20)?\d{2}[-_/](?:0?[1-9]|1[0-2])))"


def fold_text(text: str) -> str:
    decomposed = unicodedata.normalize("NFKD", text)
    return " ".join("".join(c for c in decomposed if not unicodedata.combining(c)).lower().split())


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: " ".join(t.lower().split()) if t is None or t.isascii() else fold_text(t), na_action="ignore")


def folded(text: Column) -> Column:
    """Lower case, no accents, single blanks, pictographs as blanks: computed once for each text."""
    return _folded(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\\x{FE0F}", ""), EMOJI, " "))


def _occurs(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in dict.fromkeys(fold_text(w) for w in words)])


def _topic(text: Column, rules: list) -> Column:
    cases = [(reduce(lambda a, b: a & b, [_occurs(text, g) for g in groups]), label) for label, *groups in rules]
    return reduce(lambda c, case: c.when(*case), cases[1:], F.when(*cases[0]))


def month_year(text: Column) -> Column:
    """The first month and year, else the first year, else null."""
    month = F.nullif(F.regexp_extract(text, MONTH, 1), F.lit(""))
    return F.coalesce(F.translate(month, "_/", "--"), F.nullif(F.regexp_extract(text, r"\b(20\d{2})\b", 1), F.lit("")))


def summary(filename: Column, path: Column, ext: Column, text: Column, folded_path: Column, folded_text: Column) -> Column:
    """The first rule that holds. ``folded_path`` and ``folded_text``: ``folded`` of path and name, and of the text."""
    name, where = F.coalesce(filename, F.lit("")), F.coalesce(path, F.lit(""))
    low, body = F.lower(F.concat_ws("/", where, name)), F.coalesce(text, F.lit(""))
    has = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    e = F.lower(F.trim(F.coalesce(ext, F.lit(""))))
    date = F.coalesce(month_year(name), month_year(where))
    dated = lambda label: F.concat(F.lit(label), F.coalesce(F.concat(F.lit(" ("), date, F.lit(")")), F.lit("")), F.lit("."))
    low_text = F.lower(body)
    contract = has("cdi", "cdd", "contrat de travail", "employment contract") | (has("contrat") & has("hr", "rh")) | (has("contract") & has("hr", "employment")) | low_text.contains("contrat de travail") | low_text.contains("employment contract")
    readable = (F.trim(body) != "") & e.isin("pdf", "doc", "docx", "ppt", "pptx")
    out = (
        F.when(body.rlike(V.PRIVATE_KEY) | has("private key"), "WARNING: Private key material detected. Exclude from licensing.")
        .when(body.rlike(V.KUBECONFIG) | has("kubeconfig"), "WARNING: Kubernetes cluster credentials detected. Exclude from licensing.")
        .otherwise(F.coalesce(
            _topic(folded_path, PATH_TOPICS),
            F.when((_topic(folded_text, TEXT_TOPICS) == "Employment contract for employee.") & body.contains("cdi"), "Employment contract (CDI) for employee.").otherwise(_topic(folded_text, TEXT_TOPICS)),
            F.when((folded_text != "") & (has("photo", "image", "screenshot") | _occurs(folded_text, ["screenshot", "capture d'écran"])), "Screenshot / photo."),
            F.when(has("bulletin", "payslip"), dated("Payslip")).when(has("dsn"), dated("Monthly social declaration (DSN)")).when(has("urssaf"), dated("URSSAF contribution declaration"))
            .when(has("rib", "iban"), "Bank details document.").when(has("cni", "passport", "carte vitale"), "Personal identity document.").when(has("cv", "resume"), "Team member CV / resume.")
            .when(contract & has("avenant", "amend"), "Employment contract amendment.").when(contract & has("stage", "intern"), "Internship agreement.").when(contract, "Employment contract.")
            .when(has("mutuelle", "prevoyance", "insurance"), "Health / insurance documentation.").when(e.isin("xlsx", "xls") & has("bspce", "bsa", "cap"), "Equity / options tracking spreadsheet.")
            .when(readable & has("legal", "contract", "contrat"), "Company legal document.").when(readable & has("hr", "rh"), "HR document.").when(readable, "Company document.")
            .when((e == "eml") & (F.trim(body) != ""), compact(F.concat(F.lit("Email (.eml). Subject: "), F.trim(body)), 200)).when(e == "eml", "Email message (.eml)."),
            reduce(lambda c, kind: c.when(e.isin(kind[1]), kind[0]), FILE_KINDS[1:], F.when(e.isin(FILE_KINDS[0][1]), FILE_KINDS[0][0])),
            F.when(e != "", F.concat(F.upper(e), F.lit(" file."))).otherwise("Company file."),
        ))
    )
    return out


#: Lines that only greet, and how lines of a letter's head begin.
GREETING = r"(?i)^\s*(?:dear\s+(?:sir|madam|sir/madam|madame|monsieur|madam/sir)|to\s+whom\s+it\s+may\s+concern|hello|hi|hey|bonjour|bonsoir|salut|madam|sir)\b[,:]?\s*$"
LETTER_HEAD = r"(?i)^\s*(?:dear\s+|subject\s*:?|re\s*:?|date\s*:?|from\s*:?|to\s*:?|cc\s*:?)"


def title_like(line: Column) -> Column:
    """Short, without letters, or mostly capitals."""
    letters = F.regexp_replace(line, r"[^\p{L}]", "")
    capitals = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", ""))
    return (F.length(line) < 12) | (F.length(letters) == 0) | ((capitals / F.greatest(F.length(letters), F.lit(1)) > 0.85) & (F.size(F.split(line, r"\s+")) <= 14))


def telling_line(text: Column) -> Column:
    """The first of 40 lines that says something: no title, greeting, letter head or address; null without one."""
    lines = F.slice(F.filter(F.transform(F.split(F.regexp_replace(text, "\r", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 40)
    said = F.filter(lines, lambda x: ~title_like(x) & ~x.rlike(GREETING) & ~(x.rlike(LETTER_HEAD) & (F.length(x) < 80)) & ~F.lower(x).rlike("^https?://") & (F.length(x) >= 18))
    return F.try_element_at(said, F.lit(1))


def best_line(text: Column) -> Column:
    return compact(telling_line(text), 160)
