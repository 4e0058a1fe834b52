"""Document urls, page markup and identifiers in urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import squeeze, strip

#: The parcel formats at the end of a description.
PARCEL = r"([A-Z]{2}-\d{2}-\d{3}\.\d{2}-\d{2}-\d{2}\.\d{2}\.\d{3}|\d{1,2}-\d{2,3}(?:-\d{2})?\.\d+(?:[.\-]\d+)*)\s*$"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape(c: Column) -> Column:
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def percent_decode(c: Column) -> Column:
    """Percent escapes only; a plus sign stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def detail_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?i)[?&]id=(\d+)", 1), F.lit(""))


def detail_url(root: str, row_id: Column) -> Column:
    return F.concat(F.lit(root), row_id.cast("string"))


def document_fields(url: Column) -> Column:
    """Struct of the fields that a document url encodes, null for what is absent."""
    path = percent_decode(F.regexp_extract(unescape(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    short = F.size(parts) < 3
    tail = F.when(short, path).otherwise(F.array_join(F.slice(parts, 3, 1000), "/"))
    take = lambda p: F.when(~short, F.nullif(strip(F.regexp_extract(tail, "(?s)" + p, 1)), F.lit("")))
    dashless = lambda c: F.nullif(strip(F.regexp_replace(strip(c), "^-+|-+$", "")), F.lit(""))
    program, description = take("<R>(.*?)</R>"), take("<G>(.*?)</G>")
    return F.struct(
        dashless(take("<I>(.*?)</I>")).alias("doc_type"),
        F.when(F.regexp_replace(program, "^[- ]+|[- ]+$", "") != "", program).alias("program"),
        take("</R>(.*?)<G>").alias("permit_number"),
        description.alias("description"),
        F.nullif(F.regexp_extract(description, PARCEL, 1), F.lit("")).alias("parcel_id"),
        F.nullif(strip(F.regexp_replace(take(r"</G>\s*(.*?)\s*$"), "^-+", "")), F.lit("")).alias("foia"),
        tail.alias("title_raw"),
    )


def clean_text(html: Column) -> Column:
    """Markup flattened to text."""
    return squeeze(F.regexp_replace(percent_decode(F.regexp_replace(unescape(html), r"<[^>]*>", " ")), r"<[^>]*>", " "))


def links(html: Column) -> Column:
    """Targets of anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"']*)[\"']"), 1)


def fetch_outcome(ok: Column, n_documents: Column, html: Column, host: str) -> Column:
    """Four outcomes, so that a failed fetch is never a page without documents."""
    return F.when(~ok, "FETCH_FAILED").when(n_documents > 0, "PARSED_DOCS").when(F.coalesce(html, F.lit("")).contains(host), "PARSED_ZERO_DOCS").otherwise("GRID_ABSENT")
