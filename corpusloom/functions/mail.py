"""Mail: headers, dates, bodies and attachments of MIME messages, given as JSON payloads or as raw messages."""

from __future__ import annotations

import base64
import json
import re
from email import message_from_bytes, policy
from email import utils as mail_utils

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTACHMENT = T.StructType([T.StructField(n, T.LongType() if n == "size_bytes" else T.StringType()) for n in ("filename", "mime_type", "size_bytes", "attachment_id", "inline_data")])


def header(headers: Column, name: str) -> Column:
    """The first value of a header, by name in any case, from an array of (name, value)."""
    return F.coalesce(F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(1))["value"], F.lit(""))


@F.pandas_udf(T.DoubleType())
def date_unix(text: pd.Series) -> pd.Series:
    """Seconds of a mail date, in UTC where it names no offset; 0 if unreadable."""

    def one(t: str | None) -> float:
        parsed = mail_utils.parsedate_tz(t) if t else None
        try:
            return float(mail_utils.mktime_tz(parsed)) if parsed else 0.0
        except (ValueError, OverflowError):
            return 0.0

    return text.map(one)


def decoded(data: Column) -> Column:
    """Bytes of URL-safe base64 without its padding."""
    plain = F.translate(data, "-_", "+/")
    return F.unbase64(F.rpad(plain, F.length(plain) + F.pmod(-F.length(plain), F.lit(4)), "="))


def _text(data: str | None) -> str:
    return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace") if data else ""


def _untagged(page: str) -> str:
    return re.sub(r"<[^>]+>", " ", page)


def parts(payload: dict) -> tuple[str, list[dict]]:
    """(body, attachments): plain parts before HTML ones, nested parts in order; named parts are attachments."""
    kind, data = payload.get("mimeType") or "", (payload.get("body") or {}).get("data")
    if not kind.startswith("multipart/"):
        text = _text(data)
        return (re.sub(r"\s+", " ", _untagged(text)) if kind == "text/html" else text).strip(), []
    plain, pages, found = [], [], []
    for part in payload.get("parts") or []:
        body, name, kind = part.get("body") or {}, (part.get("filename") or "").strip(), part.get("mimeType") or ""
        if name and (body.get("attachmentId") or body.get("data")):
            found.append({"filename": name, "mime_type": kind, "size_bytes": int(body.get("size") or 0), "attachment_id": body.get("attachmentId") or "", "inline_data": body.get("data") or ""})
        elif kind == "text/plain" or kind == "text/html":
            if body.get("data"):
                (plain if kind == "text/plain" else pages).append(_text(body["data"]) if kind == "text/plain" else _untagged(_text(body["data"])))
        elif part.get("parts"):
            text, more = parts(part)
            plain += [text] if text else []
            found += more
    return "\n\n".join(plain).strip() or "\n\n".join(pages).strip(), found


@F.pandas_udf(T.StructType([T.StructField("body_text", T.StringType()), T.StructField("attachments", T.ArrayType(ATTACHMENT))]))
def payload_parts(payload: pd.Series) -> pd.DataFrame:
    rows = []
    for p in payload:
        try:
            rows.append(parts(json.loads(p)) if p else ("", []))
        except (ValueError, TypeError, AttributeError):
            rows.append(("", []))
    return pd.DataFrame(rows, columns=["body_text", "attachments"])


@F.pandas_udf(T.StringType())
def raw_subject(raw: pd.Series) -> pd.Series:
    """The decoded subject of a raw message."""
    return raw.map(lambda b: str(message_from_bytes(bytes(b), policy=policy.default).get("subject", "")) if b is not None else None)


def with_attachments(messages):
    """One row for the body of each message (position 0) and one for each of its attachments."""
    rows = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("filename"), F.lit("message/rfc822").alias("mime_type"), F.col("size_estimate").alias("size_bytes"), F.lit(None).cast("string").alias("attachment_id"), F.lit(None).cast("string").alias("inline_data"))), F.coalesce(F.col("attachments").cast(T.ArrayType(ATTACHMENT)), F.array().cast(T.ArrayType(ATTACHMENT))))
    return messages.select("message_id", "thread_id", "user_email", F.posexplode(rows).alias("position", "part")).select("message_id", "thread_id", "user_email", "position", "part.*")
