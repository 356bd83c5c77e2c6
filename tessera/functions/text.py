"""Text expressions: white space, tokens, HTML and Markdown, hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split sees it (the regex dialect's own class is ASCII only).
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often lambdas in it are called."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(text: Column) -> Column:
    """White space runs as one space each, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def split_words(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, for retrieval."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def count_tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, one at least; 0 for empty or null."""
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).cast("long")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether the text has any of these substrings."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def sample(text: Column, chars: int) -> Column:
    """The first characters, as classifiers take them."""
    return F.substring(text, 1, chars)


def fast_hash(text: Column) -> Column:
    """Non-cryptographic 64-bit content hash."""
    return F.xxhash64(text)


def content_hash(text: Column) -> Column:
    """Content hash that other engines can compute too."""
    return F.md5(text.cast("binary"))


def secure_hash(text: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(text.cast("binary"), 256)


_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def html_to_text(html: Column) -> Column:
    """Text nodes of a page, each trimmed, joined by line breaks; scripts, styles and comments dropped."""
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "\n")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    lines = F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, rf"^{SPACE}|{SPACE}$", ""))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def markdown_to_text(text: Column) -> Column:
    """Markdown without its marks: fences, headings, quotes, lists, emphasis, links and rules."""
    for pattern, into in (
        (r"(?m)^\s*(```|~~~).*$", ""),
        (r"(?m)^\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$", "$1"),
        (r"(?m)^\s{0,3}>\s?", ""),
        (r"(?m)^\s*([-*_]\s*){3,}$", ""),
        (r"(?m)^\s*([-*+]|\d+[.)])\s+", ""),
        (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", "$2"),
        (r"(?<![\w*])[*_](?=\S)([^*_\n]+?)(?<=\S)[*_](?![\w*])", "$1"),
        (r"`([^`\n]+)`", "$1"),
    ):
        text = F.regexp_replace(text, pattern, into)
    return html_to_text(text)
