"""Text expressions: the different folds, slugs, truncation and captions. None of them is interchangeable with another."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def _accents(form: str, ascii_only: bool) -> tuple[str, str]:
    """Characters that decompose to one base character and marks, and those base characters."""
    source, target = [], []
    for code in range(0x80, 0x2000):
        base = [c for c in unicodedata.normalize(form, chr(code)) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != chr(code) and (base[0].isascii() or not ascii_only):
            source.append(chr(code))
            target.append(base[0])
    return "".join(source), "".join(target)


def ascii_lower(c: Column | str) -> Column:
    """A-Z only: what LIKE folds."""
    return F.translate(col(c), UPPER, LOWER)


def like(c: Column | str, pattern: str) -> Column:
    """LIKE with ASCII case folding, `%` and `_` as wildcards and no escape character."""
    return ascii_lower(c).like(pattern.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\"))


def to_ascii(c: Column | str) -> Column:
    """NFKD without what is not ASCII then; d with stroke has no decomposition and is dropped."""
    return F.regexp_replace(F.translate(col(c), *_accents("NFKD", True)), r"[^\x00-\x7F]+", "")


def normalize(c: Column | str) -> Column:
    """Search fold: lower, d for d with stroke, ASCII letters and digits between single spaces."""
    text = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "đ", "d")
    return F.trim(F.regexp_replace(to_ascii(text), "[^a-z0-9]+", " "))


def text_key(c: Column | str) -> Column:
    """Topic fold: accents off, case folded, white space single; d with stroke and punctuation stay."""
    text = F.replace(F.lower(F.translate(F.coalesce(col(c), F.lit("")), *_accents("NFD", False))), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def slugify(c: Column | str, empty: str = "khac") -> Column:
    text = to_ascii(F.translate(F.lower(F.coalesce(col(c), F.lit(""))), "đ", "d"))
    slug = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit(empty)).otherwise(slug)


def clean(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))


def filled(c: Column | str) -> Column:
    """NULL for an empty string; white space is a value."""
    return F.nullif(col(c), F.lit(""))


def blank(c: Column | str) -> Column:
    return F.trim(F.coalesce(col(c), F.lit(""))) == ""


def matches(needle: str, haystack: Column) -> Column:
    """needle is folded; the haystack is a folded column. Up to two characters match whole words only."""
    if not needle:
        return F.lit(True)
    return haystack.rlike(rf"\b{needle}\b") if len(needle) <= 2 else haystack.contains(needle)


def has_alias(text: Column, alias: str) -> Column:
    return text.rlike(rf"\b{alias}\b") if len(alias) <= 2 or " " not in alias else text.contains(alias)


def truncate(c: Column | str, limit: int = 400, end: str = "…", keep: int | None = None) -> Column:
    """Texts over the limit are cut before the last word that begins within `keep` characters (by default the limit less the end), without trailing punctuation."""
    text = clean(c)
    head = F.rtrim(F.substring(text, 1, limit - len(end))) if keep is None else F.substring(text, 1, keep)
    cut = F.regexp_replace(F.regexp_replace(head, " [^ ]*$", ""), "[.,;: ]+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(end)))


def first_sentences(c: Column | str, n: int = 2, limit: int = 450) -> Column:
    text = F.array_join(F.slice(F.split(clean(c), r"(?<=[.!?])\s+"), 1, n), " ")
    return F.substring(F.regexp_replace(text, "^[\"' ]+|[\"' ]+$", ""), 1, limit)


def mask(c: Column | str) -> Column:
    text = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(text == "", F.lit("")).when(F.length(text) <= 10, F.lit("***")).otherwise(F.concat(F.substring(text, 1, 6), F.lit("..."), F.right(text, F.lit(4))))


def html_escape(c: Column | str) -> Column:
    out = F.coalesce(col(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clip(c: Column | str, limit: int) -> Column:
    """Texts over the limit lose their end for three dots, wherever a word is cut."""
    text = clean(c)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, max(0, limit - 3))), F.lit("...")))


def url_quote(c: Column | str) -> Column:
    """Percent encoding of a text as part of a path: a space is %20, letters, digits and -._~ stay."""
    out = F.replace(F.url_encode(F.coalesce(col(c), F.lit(""))), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(out, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def clean_ids(c: Column) -> Column:
    """The whole numbers among an array of texts, each once, in order of first appearance."""
    return F.array_distinct(F.transform(F.filter(c, lambda x: x.rlike("^[0-9]+$")), lambda x: x.try_cast("bigint")))
