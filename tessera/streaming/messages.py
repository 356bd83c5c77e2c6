"""Context accounting of conversations while their messages come in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.text import count_tokens
from tessera.operators import context
from tessera.session import ship

STATE = "messages bigint, system bigint, other bigint, last bigint, current bigint, cut bigint, turns array<bigint>, toks array<bigint>"
OUT = "conv_id {kind}, messages bigint, system_tokens bigint, current_tokens bigint, history_tokens bigint, kept_from bigint, kept_tokens bigint, closed boolean"
#: Before any turn.
NEVER = -(1 << 62)


def read_messages(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A file stream of ``conv_id, turn, role, text``, so many files a batch."""
    return spark.readStream.schema("conv_id bigint, turn bigint, role string, text string").option("maxFilesPerTrigger", files).parquet(folder)


def running_usage(
    messages: DataFrame, document_tokens: int = 0, max_tokens: int = context.MAX_TOKENS, target: int = context.HISTORY_TOKENS, idle_seconds: int | None = None
) -> DataFrame:
    """``context.usage`` of each conversation that a batch changes, and where its sliding window of ``target`` tokens begins.

    ``kept_from`` is the first turn that ``context.sliding_window`` keeps besides system messages (null if it keeps none),
    ``kept_tokens`` the tokens from there. The state of a conversation is its sums and the turns of the window:
    tokens are never negative, so a turn that has once fallen out never comes back. Messages may
    come in any order: a late one counts in the sums, and in the window if it is after what has fallen
    out. Messages without a conversation or turn take no part; each message comes once. With
    ``idle_seconds``, a conversation without messages for so long ends: a last row says ``closed``, its state
    goes, and what comes later begins a conversation anew. That needs a stream that keeps running:
    with timeouts by the clock one over what is there now (``availableNow``) doesn't end.
    """
    ship(messages.sparkSession)
    system = F.coalesce(F.col("role") == "system", F.lit(False))
    sized = messages.filter("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), system.alias("system"), count_tokens(F.col("text")).alias("tok"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        many, first, other, last, current, cut, turns, toks = state.get if state.exists else (0, 0, 0, NEVER, 0, NEVER, [], [])
        turns, toks = np.array(turns, np.int64), np.array(toks, np.int64)
        ended = state.hasTimedOut
        for part in () if ended else parts:
            own, tok, said = part["turn"].to_numpy(), part["tok"].to_numpy(), ~part["system"].to_numpy(dtype=bool)
            many, first, other = many + len(part), first + int(tok[~said].sum()), other + int(tok[said].sum())
            latest = int(own.max())
            current = (current if latest <= last else 0) + (int(tok[said & (own == latest)].sum()) if latest >= last else 0)
            last = max(last, latest)
            fresh = said & (own > cut)
            turns, toks = np.concatenate([turns, own[fresh]]), np.concatenate([toks, tok[fresh]])
            order = np.argsort(turns, kind="stable")
            turns, toks = turns[order], toks[order]
            gone = int((np.cumsum(toks[::-1]) > target).sum())
            if gone:
                cut, turns, toks = int(turns[gone - 1]), turns[gone:], toks[gone:]
        if ended:
            state.remove()
        else:
            state.update((many, first, other, last, current, cut, turns.tolist(), toks.tolist()))
            if idle_seconds:
                state.setTimeoutDuration(idle_seconds * 1000)
        begins = [int(turns[0]) if len(turns) else NEVER]
        row = {"conv_id": [key[0]], "messages": [many], "system_tokens": [first], "current_tokens": [current], "history_tokens": [other - current]}
        yield pd.DataFrame(row | {"kept_from": begins, "kept_tokens": [int(toks.sum())], "closed": [ended]})

    out = OUT.format(kind=messages.schema["conv_id"].dataType.simpleString())
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_seconds else GroupStateTimeout.NoTimeout
    found = sized.groupBy("conv_id").applyInPandasWithState(step, out, STATE, "update", timeout)
    return context.filled(found.withColumn("kept_from", F.nullif("kept_from", F.lit(NEVER))), document_tokens, max_tokens)
