"""Text functions of the ingestion path (STR-F*).

What needs NFKC, case folding or HTML entities is Python behind an Arrow UDF; all else is built-in expressions.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Python's ``\\s`` in Java's notation.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_TAG = re.compile(r"<[^>]*>")
# Quotation marks that count as straight ones.
_STRAIGHT = str.maketrans({c: '"' for c in "“”„‟«»"} | {c: "'" for c in "‘’‚‛‹›"})


def _mapped(f: Callable[[str], object], returns: str = "string") -> Callable[[Column | str], Column]:
    def column(c: Column | str) -> Column:
        return F.pandas_udf(lambda s: s.map(f, na_action="ignore"), returns)(c)

    return column


def normalized(text: str) -> str:
    """STR-F1: NFKC, runs of white space as one space, none at the ends."""
    return " ".join(unicodedata.normalize("NFKC", text).split())


def comparison(text: str) -> str:
    """STR-F2: STR-F1 without case."""
    return normalized(text).casefold()


def quotable(text: str) -> str:
    """STR-F3: STR-F1 with straight quotation marks."""
    return normalized(unicodedata.normalize("NFKC", text).translate(_STRAIGHT))


def plain(markup: str) -> str:
    """STR-F5: text of a piece of HTML; entities are decoded before and after the tags go."""
    return normalized(html.unescape(_TAG.sub(" ", html.unescape(markup))))


def storable(text: str) -> bool:
    """FLT-06: no lone surrogate."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return False
    return True


normalize_text = _mapped(normalized)
comparison_text = _mapped(comparison)
case_folded = _mapped(str.casefold)
quote_text = _mapped(quotable)
html_plain = _mapped(plain)
is_storable = _mapped(storable, "boolean")


def quote_in_source(quote: Column, source: Column) -> Column:
    """STR-F4: a quotation of at least three characters that stands in the source, both by STR-F3; null for nulls."""

    def run(q: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else len(quotable(a)) >= 3 and quotable(a) in quotable(b) for a, b in zip(q, s, strict=True)], dtype=object)

    return F.pandas_udf(run, "boolean")(quote, source)


def html_escape(c: Column) -> Column:
    """STR-F6."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def first_quoted(c: Column) -> Column:
    """STR-F7: the first span in straight double quotation marks if it is longer than two characters, else null."""
    span = F.regexp_extract(c, '"([^"]*)"', 1)
    return F.when(F.length(span) > 2, span)


def clip(c: Column, n: int) -> Column:
    """STR-F8: the first n code points."""
    return F.substring(c, 1, n)


def digest(*parts: Column, separator: str = "\n", length: int = 64) -> Column:
    """STR-F9 and SET-08: hex SHA-256 of the joined parts, or its first characters."""
    return F.substring(F.sha2(F.concat_ws(separator, *parts), 256), 1, length)


def present(*parts: Column, separator: str = "\n\n") -> Column:
    """STR-F11: the parts that are neither null nor empty, joined."""
    return F.concat_ws(separator, *(F.nullif(p, F.lit("")) for p in parts))


def outer_object(c: Column) -> Column:
    """STR-F12: from the first { to the last }, null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def prompt_json(c: Column) -> Column:
    """STR-F13: a JSON text in which no < can open a tag."""
    return F.replace(c, F.lit("<"), F.lit("\\u003c"))


def bare_length(c: Column) -> Column:
    """FLT-04: code points of a text without links, mentions, tags and tickers, and without space at the ends."""
    bare = F.regexp_replace(c, rf"https?://[^\s\x1c-\x1f\x85\p{{Z}}]+|[@#$][\p{{L}}\p{{N}}_]+", "")
    return F.length(F.regexp_replace(bare, rf"^{_SPACE}+|{_SPACE}+$", "")).cast("long")


def template_fits(c: Column, placeholder: str = "{url}", link: int = 23, most: int = 280) -> Column:
    """FLT-12: exactly one placeholder, and short enough with a link in its place."""
    n = (F.length(c) - F.length(F.replace(c, F.lit(placeholder), F.lit("")))) / len(placeholder)
    return (n == 1) & (F.length(c) - len(placeholder) + link <= most)
