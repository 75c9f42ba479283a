"""Scalar functions over text, as column expressions."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, functions as F

# Characters taken off the end of a text value, articles skipped when sorting.
TRIM_SUFFIX = " ,/.:(["
ARTICLES = ("the", "den", "der", "die", "des", "an", "a")

SPACES = " \t\n\x0b\f\r"
# private-use characters, they survive XML escaping
OPEN_MARK, CLOSE_MARK = "\ue000", "\ue001"


def char_class(chars: str) -> str:
    return "[" + re.sub(r"([\\\[\]^&-])", r"\\\1", chars) + "]"


def trim_suffix(text: Column, suffix: str = TRIM_SUFFIX) -> Column:
    """Leading white space off, then trailing characters of `suffix` off, but never the first one."""
    left = F.ltrim(text, F.lit(SPACES))
    cut = F.rtrim(left, F.lit(suffix))
    return F.when(cut == "", F.substr(left, F.lit(1), F.lit(1))).otherwise(cut)


def trim_generic(text: Column) -> Column:
    """Display form of a text value; anything that looks like a URL stays as it is."""
    return F.when(F.contains(text, F.lit("://")), text).otherwise(trim_suffix(text))


def key_norm(text: Column) -> Column:
    """Lower-case ASCII letters and digits, one space between words."""
    return F.lower(F.trim(F.regexp_replace(text, "[^0-9A-Za-z]+", " ")))


def az_tokens(text: Column) -> Column:
    """Maximal runs of ASCII letters, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)


def az_joined(text: Column) -> Column:
    """The tokens of `az_tokens` joined by a space, without building the array."""
    return F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z]+", " ")))


def skip_article(text: Column) -> Column:
    """Drop the first word if it is an article."""
    return F.regexp_replace(text, f"(?i)^(?:{'|'.join(ARTICLES)})(?= |\\z)", "")


def sort_string(text: Column) -> Column:
    """Sort form: `key_norm` from the first letter on; null when the text has no letter."""
    return F.when(text.rlike("[A-Za-z]"), key_norm(F.regexp_replace(text, "^[^A-Za-z]+", "")))


def xml_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def word_pattern(words: Sequence[str]) -> str:
    """Pattern for one of `words` as a whole run of ASCII letters."""
    return f"(?i)(?<![A-Za-z])(?:{'|'.join(re.escape(w) for w in words)})(?![A-Za-z])"


def snippet(text: Column, terms: Sequence[str]) -> Column:
    """Text with runs of query terms in `<match>`, the rest escaped; null when no term occurs.

    A run starts right after the word before it, so it takes the separators in front of its first word along.
    """
    words = [t for t in dict.fromkeys(terms) if t]
    if not words:
        return F.lit(None).cast("string")
    pattern = word_pattern(words)
    marked = F.regexp_replace(text, f"(?i)[^A-Za-z]*{pattern[4:]}", f"{OPEN_MARK}$0{CLOSE_MARK}")
    joined = F.replace(marked, F.lit(CLOSE_MARK + OPEN_MARK), F.lit(""))
    tagged = F.replace(
        F.replace(xml_escape(joined), F.lit(OPEN_MARK), F.lit("<match>")), F.lit(CLOSE_MARK), F.lit("</match>")
    )
    return F.when(text.rlike(pattern), tagged)
