"""Query rewriting: spelling, expansion, phrases, variations, follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicons as lex
from tessera.functions.text import bound, contains_any, split_words


def _table(entries: dict[str, list[str]]) -> Column:
    """Lexicon as a map literal (its size is fixed)."""
    return F.create_map(*(x for key, values in entries.items() for x in (F.lit(key), F.array(*map(F.lit, values)))))


def _looked_up(words: Column, table: Column) -> Column:
    found = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.flatten(found)))


def _reverse_abbreviations() -> dict[str, list[str]]:
    """Abbreviations by word of their expansion."""
    out: dict[str, list[str]] = {}
    for short, full in lex.ABBREVIATIONS.items():
        for word in full.split():
            out.setdefault(word, []).append(short)
    return out


def _variation_table() -> dict[str, list[str]]:
    """The other forms of each word: for a base all its forms, for a form the rest."""
    out: dict[str, list[str]] = {}
    for base, forms in lex.VARIATIONS.items():
        for word in [base, *forms]:
            out.setdefault(word, []).extend(f for f in forms if f != word)
    return out


def expand_query(query: Column, substring_compat: bool = False) -> Column:
    """Struct of ``synonyms, related_terms, variations, expanded_terms, combined_query``.

    Lists are sorted, so that the five terms taken into the combined query don't vary. An
    abbreviation is related to the words of its expansion; with ``substring_compat`` to any
    substring of it.
    """
    words = split_words(F.lower(query))
    forward = _looked_up(words, _table({k: [v] for k, v in lex.ABBREVIATIONS.items()}))
    if substring_compat:
        pairs = F.array(*(F.struct(F.lit(a).alias("short"), F.lit(b).alias("full")) for a, b in lex.ABBREVIATIONS.items()))
        hits = F.transform(F.filter(pairs, lambda p: F.exists(words, lambda w: F.contains(p["full"], w))), lambda p: p["short"])
        backward = F.array_distinct(hits)
    else:
        backward = _looked_up(words, _table(_reverse_abbreviations()))
    synonyms, variations = _looked_up(words, _table(lex.SYNONYMS)), _looked_up(words, _table(_variation_table()))
    related = F.array_sort(F.array_union(forward, backward))
    everything = F.array_sort(F.array_union(F.array_union(synonyms, related), variations))
    taken = F.concat(F.array(query), F.slice(everything, 1, 5))
    quoted = F.transform(taken, lambda t: F.when(t.contains(" "), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))
    return F.struct(
        synonyms.alias("synonyms"), related.alias("related_terms"), variations.alias("variations"),
        everything.alias("expanded_terms"), F.array_join(quoted, " OR ").alias("combined_query"),
    )


def key_phrases(query: Column) -> Column:
    """Quoted phrases, then pairs and triples of words whose outer words have three characters or more."""
    quoted = F.regexp_extract_all(query, F.lit('"([^"]*)"'), 1)

    def runs(words: Column) -> Column:
        n = F.size(words)
        at = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))

        def own(i: Column) -> Column:
            first, second, third = F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)
            pair = F.when((F.length(first) > 2) & (F.length(second) > 2), F.concat_ws(" ", first, second))
            triple = F.when((F.length(first) > 2) & (F.length(third) > 2), F.concat_ws(" ", first, second, third))
            return F.array_compact(F.array(pair, triple))

        return F.flatten(F.transform(at, own))

    return F.concat(quoted, bound(split_words(F.lower(query)), runs))


def query_variations(query: Column, most: int = 5) -> Column:
    """The query with question forms, its statement form and search prefixes; the first ``most``, distinct."""
    lowered = F.lower(query)
    asks = query.rlike(r"\?$")
    question = query.rlike("^(what|how|where|when|why|who)")
    statement = F.regexp_replace(lowered, r"^(what|how|where|when|why|who)\s+(is|are|to|does|do)\s+", "")
    seeks = lowered.rlike("^(find|search|get|show)")
    forms = [
        query,
        *(F.when(~asks, F.concat(F.lit(before), query, F.lit("?"))) for before in ("", "What is ", "How to ", "Where is ")),
        F.when(question, statement),
        *(F.when(~seeks, F.concat(F.lit(before), query)) for before in ("find ", "search for ")),
    ]
    return F.slice(F.array_distinct(F.array_compact(F.array(*forms))), 1, most)


def correct_spelling(query: Column) -> Column:
    """Known typos replaced in turn, in any case; null if there is none."""
    lowered, fixed = F.lower(query), query
    for typo, right in lex.TYPOS.items():
        fixed = F.regexp_replace(fixed, f"(?i){typo}", right)
    return F.when(contains_any(lowered, lex.TYPOS), fixed)


def process_query(query: Column) -> Column:
    """Spelling, expansion, phrases and variations in one struct."""
    fixed = F.coalesce(correct_spelling(query), query)
    return F.struct(
        query.alias("original"), fixed.alias("processed"), expand_query(fixed).alias("expansion"),
        key_phrases(fixed).alias("phrases"), query_variations(fixed).alias("variations"),
    )


def optimised_query(query: Column, mode: Column) -> Column:
    """Keyword: three phrases ANDed; vector: three synonyms added; else the combined query."""
    phrases, expansion = key_phrases(query), expand_query(query)
    quoted = F.transform(F.slice(phrases, 1, 3), lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    keyword = F.when(F.size(phrases) > 0, F.array_join(quoted, " AND ")).otherwise(query)
    vector = F.concat(query, F.lit(" "), F.array_join(F.slice(expansion["synonyms"], 1, 3), " "))
    return F.when(mode == "keyword", keyword).when(mode == "vector", vector).otherwise(expansion["combined_query"])


def multi_query(query: Column, n: int = 3) -> Column:
    """``n`` queries: the query, the query with two expansions, its variations, and itself again."""
    extra = expand_query(query)["expanded_terms"]
    expanded = F.when(F.size(extra) > 0, F.array(F.concat(query, F.lit(" "), F.array_join(F.slice(extra, 1, 2), " ")))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(F.array(query), expanded, query_variations(query), F.array_repeat(query, n)), 1, n)


def needs_context(query: Column) -> Column:
    """Whether a question leans on what was said before."""
    lowered = F.lower(query)
    return lowered.rlike(r"\b(" + "|".join(lex.PRONOUNS) + r")\b") | lowered.rlike("|".join(lex.FOLLOW_UPS))


def reformulated(query: Column, last_user_message: Column) -> Column:
    """A follow-up with the topics of the last user message; other questions as they are."""
    lowered = F.lower(query)
    topics = F.slice(F.filter(split_words(last_user_message), lambda w: (F.length(w) > 3) & ~F.lower(w).isin(lex.NOT_TOPICS)), 1, 3)

    def said(found: Column) -> Column:
        context = F.array_join(found, " ")
        how = F.when(contains_any(lowered, ["it", "its"]), " (referring to ").when(contains_any(lowered, ["that", "this"]), " (about ").otherwise(" (in context of ")
        return F.when(needs_context(query) & (F.size(found) > 0), F.concat(query, how, context, F.lit(")"))).otherwise(query)

    return F.when(last_user_message.isNull(), query).otherwise(bound(topics, said))


def reformulate_turns(messages: DataFrame) -> DataFrame:
    """Each user message of ``messages(conv_id, turn, role, text)`` with the one before it in mind."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    return (
        messages.withColumn("_said", said).filter("role = 'user'")
        .select("conv_id", "turn", F.col("text").alias("query"), reformulated(F.col("text"), F.col("_said")).alias("reformulated"))
    )
