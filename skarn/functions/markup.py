"""What can be told of bodies and URLs without parsing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of tags and of references to resources (fixed values).
TAG = r"<[a-zA-Z][^>]*>"
RESOURCE = r":/([0-9a-fA-F]{32})"
#: Prefixes of URLs that may be rendered as links (fixed values). Schemes of a target application of
#: one's own are given to ``is_safe_url`` as ``more``.
SAFE_PREFIXES = ("http://", "https://", "onenote:", ":/")
#: The URL that names a source page (a fixed value).
PAGE_URL = r"^onenote://page/(.+)$"
#: The suffix of titles of dated copies (a fixed value).
DATED_SUFFIX = r"\s*\([^()]*(?:\d{1,4}[./-]\d{1,2}[./-]\d{1,4})[^()]*\)\s*$"
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "pdf": "application/pdf", "txt": "text/plain", "html": "text/html", "csv": "text/csv", "json": "application/json", "zip": "application/zip"}


def content_format(markup_language: Column, body: Column) -> Column:
    """2 is HTML; 1 is Markdown, or mixed if it holds tags; anything else is unknown."""
    tagged = F.coalesce(body.rlike(TAG), F.lit(False))
    return (
        F.when(markup_language == 2, "html")
        .when((markup_language == 1) & tagged, "mixed")
        .when(markup_language == 1, "markdown")
        .otherwise("unknown")
    )


def resource_refs(body: Column) -> Column:
    """Distinct resource ids in order of first occurrence, in lower case."""
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(RESOURCE), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def page_marker(tool: str) -> str:
    """The pattern of the marker that a tool leaves in bodies: its name, a colon and the page's id."""
    return rf"\Q{tool}\E:onenote_page_id=([^\s<>\"']+)"


def embedded_id(url: Column, body: Column, tool: str | None = None, url_pattern: str = PAGE_URL) -> Column:
    """The id that the source URL names, or else the marker of ``tool`` in the body, URL-decoded; or null.

    Markers of other tools are none: they do not link pages and notes. Without a ``tool`` only the URL counts.
    """
    from_url = F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), url_pattern, 1), F.lit(""))
    from_body = F.lit(None).cast("string")
    if tool is not None:
        from_body = F.nullif(F.regexp_extract(F.coalesce(body, F.lit("")), page_marker(tool), 1), F.lit(""))
    return F.try_url_decode(F.coalesce(from_url, from_body))


def quote_url(value: Column) -> Column:
    """Percent-encoding without safe marks besides letters, digits and ``_.-~``."""
    out = F.url_encode(value)
    for mark, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def is_safe_url(value: Column, more: tuple[str, ...] = ()) -> Column:
    plain = F.lower(F.trim(value))
    found = F.lit(False)
    for prefix in (*SAFE_PREFIXES, *more):
        found = found | F.startswith(plain, F.lit(prefix))
    return F.coalesce(found, F.lit(False))


def escape_html(value: Column, attribute: bool = False) -> Column:
    marks = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    marks += [('"', "&quot;"), ("'", "&#x27;")] if attribute else []
    for mark, entity in marks:
        value = F.replace(value, F.lit(mark), F.lit(entity))
    return value


def safe_filename(value: Column) -> Column:
    """The last part of a path with either kind of slash."""
    return F.regexp_extract(F.coalesce(value, F.lit("")), r"([^/\\]*)$", 1)


def safe_extension(value: Column) -> Column:
    """Up to ten letters or digits after the last dot, in lower case, with the dot."""
    found = F.lower(F.regexp_extract(safe_filename(value), r"\.([A-Za-z0-9]{1,10})$", 1))
    return F.when(found == "", "").otherwise(F.concat(F.lit("."), found))


def media_type(value: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(table[F.substring(safe_extension(value), 2, 10)], F.lit("application/octet-stream"))


def logical_title(stem: Column) -> Column:
    """A title without a dated suffix in parentheses; the title itself where nothing else is left."""
    cut = F.rtrim(F.regexp_replace(stem, DATED_SUFFIX, ""))
    return F.coalesce(F.nullif(cut, F.lit("")), stem)
