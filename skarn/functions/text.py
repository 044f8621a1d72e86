"""Text functions of the matching rules, as column expressions.

NFC and case folding have no built-in expression; these two are Arrow-batched Python functions,
everything else stays in the JVM. Null text counts as empty where a rule says so.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

#: Characters that are deleted, and those that become a blank (fixed values).
ZERO_WIDTH = r"[\u200B\u200C\u200D\uFEFF]"
WIDE_BLANKS = r"[\u00A0\u202F\u2007]"
#: White space at the edges of lines, in the wide sense of Unicode strings (fixed values).
EDGE = r"[\t\n\u000B\f\r\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Line ends in the wide sense: also file, group and record separators (fixed values).
LINE_END = r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085\u2028\u2029]"
#: Titles that say nothing (fixed values).
PLACEHOLDER_TITLES = ("", "untitled page", "untitled note", "untitled", "new page", "без названия")

MIN_BLOCKING_LINE = 30
MIN_DISTINCTIVE_LINE = 15
MIN_TEXT_HASH = 20


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else t.casefold())


@pandas_udf(ArrayType(StringType()))
def casefolded(texts: pd.Series) -> pd.Series:
    """Each of an array of texts."""
    return texts.map(lambda a: None if a is None else [t if t is None else t.casefold() for t in a])


def normalize_text(text: Column) -> Column:
    """NFC, one kind of line end and blank, no zero-width characters, no blank lines or edges."""
    out = nfc(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, ZERO_WIDTH, ""), WIDE_BLANKS, " ")
    out = F.regexp_replace(out, "[ \\t\\f\\u000B]+", " ")
    lines = F.transform(F.split(out, "\n"), lambda x: F.regexp_replace(x, f"^{EDGE}+|{EDGE}+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalize_inline(text: Column) -> Column:
    """As ``normalize_text``, on one line."""
    return normalize_text(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))


def normalized_title(text: Column) -> Column:
    return casefold(normalize_inline(text))


def is_placeholder_title(title: Column) -> Column:
    """``title`` as ``normalized_title`` gives it."""
    return title.isin(*PLACEHOLDER_TITLES)


def title_tokens(title: Column) -> Column:
    """Distinct words of three or more letters, digits or underscores."""
    return F.array_distinct(F.regexp_extract_all(title, F.lit(r"(?U)\w{3,}"), F.lit(0)))


def blocking_lines(text: Column) -> Column:
    """Distinct lines long enough to stand for a document."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.array_distinct(F.filter(lines, lambda x: F.length(x) >= MIN_BLOCKING_LINE))


def distinctive_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.array_distinct(F.filter(lines, lambda x: F.length(x) >= MIN_DISTINCTIVE_LINE))


def first_line(text: Column) -> Column:
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)


def document_path(outer: Column, groups: Column, inner: Column) -> Column:
    """Notebook, groups from the root down, section."""
    return F.concat(F.array(outer), F.coalesce(groups, F.array().cast("array<string>")), F.array(inner))
