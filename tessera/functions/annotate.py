"""Annotations of documents and queries: types, languages, keywords, hints, meta queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import lexicons as lex
from tessera.functions.text import contains_any, split_words


def document_type(text: Column, source: Column) -> Column:
    """By file name rules in order; else technical if the text has a code fence, else general.

    A classifier may stand in for the last step: give its answer to ``validated_type``.
    """
    name = F.lower(F.coalesce(source, F.lit("")))
    found = F.when(F.coalesce(text, F.lit("")).contains("```"), "technical").otherwise("general")
    for kind, words in reversed(lex.NAME_RULES.items()):
        found = F.when(contains_any(name, words), kind).otherwise(found)
    return found


def validated_type(answer: Column, text: Column) -> Column:
    """A classifier's answer; if it is none of the types, technical where the text looks like code."""
    clean = F.lower(F.trim(answer))
    code = contains_any(F.coalesce(text, F.lit("")), ["```", "def ", "function"])
    return F.when(clean.isin("meeting", "prd", "technical", "wiki", "general"), clean).when(code, "technical").otherwise("general")


def document_language(text: Column) -> Column:
    """A deterministic stand-in for a language model, by the share of scripts in the first 500 characters."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 500)
    han = F.length(F.regexp_replace(head, r"[^\p{IsHan}]+", ""))
    kana = F.length(F.regexp_replace(head, r"[^\p{IsHiragana}\p{IsKatakana}]+", ""))
    hangul = F.length(F.regexp_replace(head, r"[^\p{IsHangul}]+", ""))
    latin = F.length(F.regexp_replace(head, r"[^\p{IsLatin}]+", ""))
    cjk = han + kana + hangul
    # ASCII has no letters but Latin ones
    ascii_only = F.octet_length(head) == F.length(head)
    return (
        F.when(ascii_only, F.when(head.rlike("[A-Za-z]"), "english").otherwise("unknown"))
        .when(cjk + latin == 0, "unknown")
        .when((cjk * 5 > latin) & (latin * 5 > cjk), "mixed")
        .when(cjk <= latin, "english")
        .when(kana > 0, "japanese")
        .when(hangul > han, "korean")
        .otherwise("chinese")
    )


def keywords(text: Column, most: int = 10) -> Column:
    """The first ``most`` words of more than three characters that begin with a capital, lower-cased."""
    words = split_words(F.substring(text, 1, 2000))
    proper = F.filter(words, lambda w: (F.length(w) > 3) & F.substring(w, 1, 1).rlike(r"^\p{Lu}"))
    return F.slice(F.transform(proper, F.lower), 1, most)


def visual_query(text: Column) -> Column:
    """Whether a message asks about visual content."""
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), lex.VISUAL)


def doc_type_hint(query: Column) -> Column:
    """Type of document that a query asks for; null if none."""
    lowered, hint = F.lower(query), F.lit(None).cast("string")
    for kind, words in reversed(lex.QUERY_HINTS.items()):
        hint = F.when(contains_any(lowered, words), kind).otherwise(hint)
    return hint


def analyze_query(query: Column) -> Column:
    """Struct of ``keywords, search_scope, doc_type_hint, temporal_hint``."""
    lowered, hint = F.lower(query), doc_type_hint(query)
    extra = F.array().cast("array<string>")
    for kind, words in lex.HINT_KEYWORDS.items():
        extra = F.when(hint == kind, F.array(*map(F.lit, words))).otherwise(extra)
    found = F.slice(F.array_distinct(F.concat(keywords(query, 5), extra)), 1, 8)
    focused = (F.size(split_words(query)) > 5) | contains_any(lowered, lex.FOCUSED)
    return F.struct(
        found.alias("keywords"),
        F.when(focused, "focused").otherwise("broad").alias("search_scope"),
        hint.alias("doc_type_hint"),
        F.when(contains_any(lowered, lex.RECENT), "recent").alias("temporal_hint"),
    )


def should_expand(quality: Column, threshold: float = 0.5) -> Column:
    return quality < threshold


def meta_query(query: Column) -> Column:
    """Whether a query asks about the index itself: count, list or stats; else null."""
    lowered = F.lower(F.trim(query))
    found = F.lit(None).cast("string")
    for kind, words in reversed(lex.META_KEYWORDS.items()):
        found = F.when(contains_any(lowered, words), kind).otherwise(found)
    asked = lowered.rlike("|".join(lex.META_PATTERNS))
    own = F.when(contains_any(lowered, lex.META_COUNT), "count").when(contains_any(lowered, lex.META_STATS), "stats").otherwise("list")
    return F.when(lowered.isin(lex.META_WORDS), "list").when(asked, own).otherwise(found)
