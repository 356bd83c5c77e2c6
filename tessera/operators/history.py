"""Conversations: naming, keywords, listing, search, upkeep and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lexicons import STOP_WORDS
from tessera.functions.text import split_words

#: Stripped from the ends of keywords.
MARKS = ".,!?;:\"'()[]{}"


def first_user_message(messages: DataFrame) -> DataFrame:
    """``conv_id, first_message, messages``: the first user message (null if none) and the number of messages."""
    asked = F.when(F.col("role") == "user", F.struct("turn", "text"))
    found = messages.groupBy("conv_id").agg(F.min(asked).alias("m"), F.count("*").alias("messages"))
    return found.select("conv_id", F.trim(F.col("m.text")).alias("first_message"), "messages")


def auto_name(first: Column) -> Column:
    """The first 50 characters of the first user message."""
    cut = F.concat(F.substring(first, 1, 50), F.when(F.length(first) > 50, "...").otherwise(""))
    return F.when(first.isNull(), "Empty Conversation").otherwise(cut)


def summaries(messages: DataFrame) -> DataFrame:
    """``conv_id, name, summary`` of each conversation."""
    n = F.col("messages").cast("string")
    told = F.concat(F.substring("first_message", 1, 100), F.lit("... ("), n, F.lit(" messages)"))
    summary = F.when(F.col("first_message").isNull(), F.concat(F.lit("Conversation with "), n, F.lit(" messages"))).otherwise(told)
    return first_user_message(messages).select("conv_id", auto_name(F.col("first_message")).alias("name"), summary.alias("summary"))


def conversation_keywords(messages: DataFrame, most: int = 20) -> DataFrame:
    """``conv_id, keywords``: the first ``most``, sorted, of what users and assistants say.

    Words of three characters or more that are no stop words, without marks at their ends.
    """
    said = messages.filter(F.col("role").isin("user", "assistant"))
    words = F.filter(split_words(F.lower("text")), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    bare = F.transform(words, lambda w: F.trim(w, F.lit(MARKS)))
    per = said.select("conv_id", F.explode(bare).alias("w")).filter("w <> ''").distinct()
    return per.groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_set("w")), 1, most).alias("keywords"))


def upsert(stored: DataFrame, saved: DataFrame) -> DataFrame:
    """``stored`` conversations with ``saved`` ones merged in by id.

    Creation time, name and flags of a stored conversation stay; its text fields are renewed.
    """
    old, new = stored.alias("o"), saved.alias("n")
    keep = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    renew = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    kept = {"conv_id", "name", "created_at", "pinned", "archived"}
    return old.join(new, F.col("o.conv_id") == F.col("n.conv_id"), "full_outer").select(*(keep(c) if c in kept else renew(c) for c in stored.columns))


def listing(conversations: DataFrame, limit: int | None = None, archived: bool = False) -> DataFrame:
    """Conversations, pinned first, then the last updated; archived ones only if asked for."""
    shown = conversations if archived else conversations.filter(~F.col("archived"))
    ordered = shown.orderBy(F.col("pinned").desc(), F.col("updated_at").desc(), "conv_id")
    return ordered if limit is None else ordered.limit(limit)


def search(messages: DataFrame, conversations: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Conversations by relevance: 10 for the name, 3 for each keyword and 1 for each message with the query.

    ``conversations(conv_id, name, keywords)``; the first five keywords count.
    """
    needle = F.lower(F.lit(query))
    has = lambda text: F.contains(F.lower(F.coalesce(text, F.lit(""))), needle)
    in_messages = messages.groupBy("conv_id").agg(F.count_if(has(F.col("text"))).alias("hits"))
    in_words = F.size(F.filter(F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 5), has))
    score = F.when(has(F.col("name")), 10).otherwise(0) + 3 * in_words + F.coalesce("hits", F.lit(0))
    scored = conversations.join(in_messages, "conv_id", "left").withColumn("relevance_score", score.cast("long")).filter("relevance_score > 0")
    return scored.orderBy(F.col("relevance_score").desc(), "conv_id").limit(limit).drop("hits")


def with_flag(conversations: DataFrame, ids: DataFrame, column: str, value: Column) -> DataFrame:
    """Renames, pins or archives the conversations of ``ids(conv_id)``."""
    marked = conversations.join(ids.select("conv_id").distinct().withColumn("_hit", F.lit(True)), "conv_id", "left")
    return marked.withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).select(*conversations.columns)


def delete(conversations: DataFrame, ids: DataFrame) -> DataFrame:
    return conversations.join(ids.select("conv_id"), "conv_id", "left_anti")


def expired(conversations: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Conversations made more than ``days`` ago that aren't archived."""
    return conversations.filter(~F.col("archived") & (F.col("created_at") < now - F.expr(f"INTERVAL {days} DAYS")))


def recency(updated_at: Column, today: Column) -> Column:
    """Today, Yesterday, Last 7 days, Last 30 days or Older (also for no date)."""
    ago = F.datediff(today, updated_at)
    return (
        F.when(ago == 0, "Today").when(ago == 1, "Yesterday").when((ago > 1) & (ago < 7), "Last 7 days")
        .when((ago > 1) & (ago < 30), "Last 30 days").when(ago < 0, "Last 7 days").otherwise("Older")
    )


def time_label(updated_at: Column, today: Column) -> Column:
    """The time today, the weekday this week, else the day, with the year after a year."""
    ago = F.datediff(today, updated_at)
    return (
        F.when(updated_at.isNull(), "Unknown").when(ago == 0, F.date_format(updated_at, "HH:mm")).when(ago < 7, F.date_format(updated_at, "EEE"))
        .when(ago < 365, F.date_format(updated_at, "MMM dd")).otherwise(F.date_format(updated_at, "yyyy/MM/dd"))
    )


def save_points(messages: DataFrame, every: int = 1) -> DataFrame:
    """Turns at which a conversation is saved: each ``every``-th answer of the assistant."""
    n = F.count_if(F.col("role") == "assistant").over(Window.partitionBy("conv_id").orderBy("turn"))
    return messages.withColumn("_n", n).filter((F.col("role") == "assistant") & (F.col("_n") % every == 0)).drop("_n")


def exported(messages: DataFrame, conversations: DataFrame, form: str = "markdown") -> DataFrame:
    """``conv_id, document``: each conversation as Markdown or JSON."""
    if form not in ("markdown", "json"):
        raise ValueError(form)
    listed = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"), F.count("*").alias("message_count"))
    joined = listed.join(conversations, "conv_id")
    if form == "json":
        fields = [c for c in conversations.columns if c != "conv_id"]
        return joined.select("conv_id", F.to_json(F.struct("conv_id", *fields, "message_count", "messages")).alias("document"))
    title = lambda r: F.when(r == "user", "## 👤 User").when(r == "assistant", "## 🤖 Assistant").otherwise(F.concat(F.lit("## "), F.initcap(r)))
    body = F.transform("messages", lambda m: F.concat(title(m["role"]), F.lit("\n"), m["text"], F.lit("\n")))
    head = [
        F.concat(F.lit("# "), F.col("name")), F.lit(""), F.concat(F.lit("**Created:** "), F.col("created_at").cast("string")),
        F.concat(F.lit("**Updated:** "), F.col("updated_at").cast("string")), F.concat(F.lit("**Messages:** "), F.col("message_count").cast("string")),
        F.lit(""), F.lit("---"), F.lit(""),
    ]
    return joined.select("conv_id", F.array_join(F.concat(F.array(*head), body), "\n").alias("document"))
