"""HTML: counts by native expressions, text by one Arrow function."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_IMAGES = [("png", r"\.png$", r"^data:image/png"), ("jpeg", r"\.jpe?g$", r"^data:image/jpe?g"), ("gif", r"\.gif$", r"^data:image/gif"), ("webp", r"\.webp$", r"^data:image/webp"), ("svg", r"\.svg$", r"^data:image/svg"), ("bmp", r"\.(?:bmp|tiff?)$", None)]


def tag_count(html: Column, tag: str) -> Column:
    return F.size(F.regexp_extract_all(html, F.lit(f"(?i)(<{tag}\\b)"), F.lit(1))).cast("long")


def content_counts(html: Column) -> Column:
    """A map of tables, canvases, images (also by format) and drawings; zeros are left out."""
    sources = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?i)(<img\b[^>]*>)"), F.lit(1)),
        lambda t: F.lower(F.substring_index(F.regexp_extract(t, r"(?i)\bsrc\s*=\s*[\"']([^\"']+)[\"']", 1), "?", 1)),
    )

    def kind(s: Column) -> Column:
        out = F.when(s == "", "other_image")
        for name, suffix, _ in _IMAGES:
            out = out.when(s.rlike(suffix), name)
        for name, _, data in _IMAGES:
            out = out.when(s.rlike(data), name) if data else out
        return out.otherwise("other_image")

    kinds = F.transform(sources, kind)
    count = lambda name: F.size(F.filter(kinds, lambda k: k == name)).cast("long")
    counts = [("tables", tag_count(html, "table")), ("canvas", tag_count(html, "canvas")), ("images", F.size(sources).cast("long")), ("other_image", count("other_image"))]
    counts += [(name, count(name) + (tag_count(html, "svg") if name == "svg" else 0)) for name, _, _ in _IMAGES]
    return F.map_filter(F.create_map(*[x for name, c in counts for x in (F.lit(name), c)]), lambda _, n: n > 0)


def counts_cell(counts: Column) -> Column:
    """``a: 1; b: 2``, sorted by name, without zeros."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter(counts, lambda _, n: n > 0))), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), "; ")


def title(html: Column, fallback: Column | str) -> Column:
    found = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1))
    return F.when(found != "", found).otherwise(F.lit(fallback) if isinstance(fallback, str) else fallback)


def best_source(srcset: Column) -> Column:
    """The address of the widest entry of a srcset; the first of equal ones; null without any."""
    entries = F.filter(F.transform(F.split(srcset, r","), lambda p: F.trim(p)), lambda p: p != "")
    wide = F.transform(entries, lambda p, i: F.struct(F.coalesce(F.regexp_extract(p, r"\s(\d+(?:\.\d+)?)[wx]\s*$", 1).try_cast("double"), F.lit(0.0)).alias("w"), (-i).alias("at"), F.regexp_extract(p, r"^(\S+)", 1).alias("url")))
    return F.array_max(wide)["url"]


def has_picture(html: Column, first: int = 500_000) -> Column:
    head = F.lower(F.substring(html, 1, first))
    return head.contains("<img") | head.contains("<picture")


def style_map(style: Column) -> Column:
    """The declarations of an inline style; the last of a property wins."""
    pairs = F.filter(F.split(F.lower(style), ";"), lambda p: p.contains(":"))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.trim(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("v")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))


def rgb_hex(color: Column) -> Column:
    """#RRGGBB of a hex or rgb(a) colour, components clamped; null for others."""
    c = F.lower(F.trim(color))
    short = F.regexp_extract(c, r"^#([0-9a-f]{3})$", 1)
    long_ = F.regexp_extract(c, r"^#([0-9a-f]{6})$", 1)
    part = lambda i: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.regexp_extract(c, r"^rgba?\(\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)", i).try_cast("int")))), 2, "0")
    return F.when(long_ != "", F.concat(F.lit("#"), F.upper(long_))).when(short != "", F.upper(F.regexp_replace(F.concat(F.lit("#"), short), "([0-9a-f])", "$1$1"))).when(c.startswith("rgb"), F.concat(F.lit("#"), part(1), part(2), part(3)))


def font_points(size: Column) -> Column:
    """Points of a font size in px or pt."""
    s = F.lower(F.trim(size))
    return F.coalesce(F.regexp_extract(s, r"^([\d.]+)px$", 1).try_cast("double") * 0.75, F.regexp_extract(s, r"^([\d.]+)pt$", 1).try_cast("double"))


_BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "ul", "ol", "header", "footer", "blockquote", "pre"}


class _Reader(HTMLParser):
    """Text of a page: no scripts or styles; a link around pictures only is named by their descriptions, else by its host."""

    def __init__(self, main: bool):
        super().__init__(convert_charrefs=True)
        self.main, self.out, self.skip, self.head = main, [], 0, 0
        self.link: list | None = None
        self.picture: list | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style", "noscript", "template"):
            self.skip += 1
        elif tag == "head" and self.main:
            self.head += 1
        elif tag == "a":
            self.link = [a.get("href", ""), len(self.out), []]
        elif tag == "img" and self.link is not None:
            self.link[2].append(a.get("alt", "").strip())
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template"):
            self.skip = max(0, self.skip - 1)
        elif tag == "head" and self.main:
            self.head = max(0, self.head - 1)
        elif tag == "a" and self.link is not None:
            href, begin, alts = self.link
            if alts and not "".join(self.out[begin:]).strip():
                label = " · ".join(dict.fromkeys(x for x in alts if x)) or (urlparse(href).netloc if href.startswith("http") else "")
                self.out.append(label[:500])
            self.link = None
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip and not self.head:
            self.out.append(data)


def html_text(page: str | None, main: bool = True) -> str:
    """The text of a page; of its first article, else its body, if ``main``, else of all of it with the title."""
    if not page:
        return ""
    if main:
        found = re.search(r"(?is)<article\b[^>]*>(.*?)</article>", page) or re.search(r"(?is)<body\b[^>]*>(.*)</body>", page)
        page = found.group(1) if found else page
    reader = _Reader(main)
    reader.feed(page)
    reader.close()
    text = re.sub(r"[ \t\f\v\xa0]+", " ", "".join(reader.out).replace("\r", "\n"))
    return re.sub(r"\s*\n\s*", "\n", text).strip()


@F.pandas_udf(T.StringType())
def main_text(page: pd.Series) -> pd.Series:
    return page.map(html_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def whole_text(page: pd.Series) -> pd.Series:
    return page.map(lambda p: html_text(p, main=False), na_action="ignore")
