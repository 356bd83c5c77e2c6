"""Context accounting and trimming of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import count_tokens

#: Context size, shares at which it is getting full, and the default history budget.
MAX_TOKENS, YELLOW, RED, HISTORY_TOKENS = 128_000, 0.75, 0.85, 4_000


def _level(share: Column, yellow: float, red: float) -> Column:
    return F.when(share >= red, "red").when(share >= yellow, "yellow").otherwise("green")


def usage(messages: DataFrame, document_tokens: int = 0, max_tokens: int = MAX_TOKENS, yellow: float = YELLOW, red: float = RED) -> DataFrame:
    """Per conversation the tokens of system messages, the last message and the rest, and how full that is."""
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    sized = messages.withColumn("tok", count_tokens(F.col("text"))).withColumn("is_last", F.col("turn") == last)
    part = lambda which: F.coalesce(F.sum(F.when(which, F.col("tok"))), F.lit(0)).cast("long")
    system = F.col("role") == "system"
    sums = sized.groupBy("conv_id").agg(
        part(system).alias("system_tokens"), part(~system & F.col("is_last")).alias("current_tokens"), part(~system & ~F.col("is_last")).alias("history_tokens")
    )
    return filled(sums, document_tokens, max_tokens, yellow, red)


def filled(sums: DataFrame, document_tokens: int = 0, max_tokens: int = MAX_TOKENS, yellow: float = YELLOW, red: float = RED) -> DataFrame:
    """Sums of a conversation's parts with the total, what is left, and how full that is."""
    total = F.col("system_tokens") + F.col("current_tokens") + F.col("history_tokens") + document_tokens
    full = sums.withColumn("documents_tokens", F.lit(document_tokens).cast("long")).withColumn("total_tokens", total.cast("long"))
    share = F.col("total_tokens") / F.lit(float(max_tokens))
    return (
        full.withColumn("available_tokens", F.greatest(F.lit(max_tokens).cast("long") - F.col("total_tokens"), F.lit(0).cast("long")))
        .withColumn("usage_percentage", F.round(share, 6)).withColumn("warning_level", _level(share, yellow, red))
    )


def sliding_window(messages: DataFrame, target: Column | int = HISTORY_TOKENS, keep_last: bool = False) -> DataFrame:
    """``messages`` with ``kept``: all system messages, and the longest run of last messages within ``target`` tokens.

    Tokens are never negative, so the sums from the end only grow and the run is a prefix of
    them. ``keep_last`` keeps the last message whatever its size.
    """
    goal = F.lit(target) if isinstance(target, int) else target
    system = F.col("role") == "system"
    own = F.when(system, 0).otherwise(count_tokens(F.col("text")))
    from_end = F.sum(own).over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0))
    kept = system | (from_end <= goal)
    if keep_last:
        kept = kept | (F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id")))
    return messages.withColumn("kept", kept)


def window_info(windowed: DataFrame) -> DataFrame:
    """Per conversation: messages before and after, those removed, and the tokens saved."""
    tokens = count_tokens(F.col("text"))
    return windowed.groupBy("conv_id").agg(
        F.count("*").alias("original_count"), F.count_if("kept").alias("trimmed_count"), F.count_if(~F.col("kept")).alias("messages_removed"),
        F.coalesce(F.sum(F.when(~F.col("kept"), tokens)), F.lit(0)).cast("long").alias("tokens_saved"),
    )


def optimise(messages: DataFrame, document_tokens: int = 0, reserve: int = 2_000, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``messages`` with ``kept``: trimmed only where total and ``reserve`` exceed the context.

    The current message is always kept; what the context leaves after documents, reserve,
    system and current messages is the budget of the history before it.
    """
    sums = usage(messages, document_tokens, max_tokens).select("conv_id", "system_tokens", "current_tokens", "total_tokens")
    room = F.greatest(F.lit(max_tokens - document_tokens - reserve).cast("long") - F.col("system_tokens") - F.col("current_tokens"), F.lit(0).cast("long"))
    joined = messages.join(sums, "conv_id").withColumn("_goal", room + F.col("current_tokens"))
    windowed = sliding_window(joined, F.col("_goal"), keep_last=True)
    return windowed.withColumn("kept", F.when(F.col("total_tokens") + reserve > max_tokens, F.col("kept")).otherwise(True)).select(*messages.columns, "kept")


def build_messages(history: DataFrame, prompts: DataFrame, document_tokens: int = 0, reserve: int = 2_000, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``conv_id, position, role, text, kept``: what is sent for each of ``prompts(conv_id, system_prompt, user_prompt)``.

    The system prompt comes first, then what users and assistants said in ``history``, then
    the user's prompt; ``optimise`` says what is kept of it. A conversation without history has
    two messages.
    """
    first, last = F.lit(-1).cast("long"), F.lit((1 << 62)).cast("long")
    said = history.filter(F.col("role").isin("user", "assistant")).join(prompts.select("conv_id"), "conv_id", "left_semi")
    every = (
        prompts.select("conv_id", first.alias("turn"), F.lit("system").alias("role"), F.col("system_prompt").alias("text"))
        .union(said.select("conv_id", F.col("turn").cast("long"), "role", "text"))
        .union(prompts.select("conv_id", last.alias("turn"), F.lit("user").alias("role"), F.col("user_prompt").alias("text")))
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return optimise(every, document_tokens, reserve, max_tokens).select("conv_id", place.alias("position"), "role", "text", "kept")


def needs_window(share: Column, yellow: float = YELLOW) -> Column:
    return share >= yellow


def recommendations(used: DataFrame) -> DataFrame:
    """``usage`` rows with ``recommendations``: what to do, by how full the context is and of what."""
    level = F.col("warning_level")
    advice = F.array(
        F.when(level == "red", "Context is over 85% full: start a new conversation."),
        F.when(level == "red", "Older messages may be dropped."),
        F.when(level == "red", "Ask more specific questions, so that fewer documents are added."),
        F.when(level == "yellow", "Context is over 75% full: watch it."),
        F.when(level == "yellow", "Start a new conversation if this one loses its focus."),
        F.when(level == "yellow", "Use targeted questions."),
        F.when(level == "green", "Context has room."),
        F.when(F.col("documents_tokens") > 8000, "Much of the context is documents: use more specific terms."),
        F.when(F.col("history_tokens") > 15000, "The history is long: earlier parts may be dropped."),
    )
    return used.withColumn("recommendations", F.array_compact(advice))


def display_usage(used: DataFrame) -> DataFrame:
    """Percentages capped at 100 and counts in thousands, for display."""
    short = lambda n: F.when(n >= 1000, F.concat(F.format_number(n / 1000, 1), F.lit("k"))).otherwise(n.cast("string"))
    return used.select(
        "conv_id", F.least(F.round(F.col("usage_percentage") * 100, 1), F.lit(100.0)).alias("percent"), short(F.col("total_tokens")).alias("used"), "warning_level"
    )


def stream_stats(answers: DataFrame) -> DataFrame:
    """Words and words a second of ``answers(conv_id, turn, text, seconds)``."""
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    return answers.select("conv_id", "turn", words.alias("tokens"), F.when(F.col("seconds") > 0, words / F.col("seconds")).otherwise(0.0).alias("tokens_per_second"))
