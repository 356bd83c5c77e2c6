"""Chunking: fixed windows, code fences, tokens, sentences, lines, and the sizes they take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.lexicons import CHUNK_PARAMS, LANGUAGE_FACTORS, MODEL_CONTEXTS
from tessera.functions.text import bound, collapse, count_tokens, split_words

FENCE = "```"


def windows(text: Column, size: Column | int, overlap: Column | int) -> Column:
    """Windows of ``size`` characters of the collapsed text, each ``overlap`` into the one before.

    The number of windows is known beforehand, so they are one expression. Empty text: none.
    """
    if isinstance(size, int) and isinstance(overlap, int):
        if not 0 <= overlap < size:
            raise ValueError("overlap must be at least 0 and less than size")
    size = F.lit(size) if isinstance(size, int) else size
    overlap = F.lit(overlap) if isinstance(overlap, int) else overlap

    def cut(t: Column) -> Column:
        n, step = F.length(t), size - overlap
        count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
        pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(t, i * step + 1, size))
        return F.when(n > 0, pieces).otherwise(F.array().cast("array<string>"))

    return bound(collapse(F.coalesce(text, F.lit(""))), cut)


def fenced(text: Column, size: int, overlap: int) -> Column:
    """``windows``, but blocks of code between fences stay whole up to one and a half sizes.

    A longer block is cut into windows, the first with the opening fence and the last with
    the closing one; if it is a single window, it is closed too.
    """

    def code(block: Column) -> Column:
        def marked(pieces: Column) -> Column:
            return F.transform(
                pieces,
                lambda p, i: F.concat(
                    F.when(i == 0, F.lit(FENCE)).otherwise(F.lit("")), p, F.when(i == F.size(pieces) - 1, F.lit(FENCE)).otherwise(F.lit(""))
                ),
            )

        return F.when(F.length(block) <= 1.5 * size, F.array(F.concat(F.lit(FENCE), block, F.lit(FENCE)))).otherwise(bound(windows(block, size, overlap), marked))

    parts = F.transform(
        F.split(F.coalesce(text, F.lit("")), FENCE),
        lambda part, i: F.when(i % 2 == 0, windows(part, size, overlap)).otherwise(code(part)),
    )
    return F.when(F.coalesce(text, F.lit("")).contains(FENCE), F.flatten(parts)).otherwise(windows(text, size, overlap))


def token_windows(text: Column, most: int = 512, overlap: int = 50, least: int = 100) -> Column:
    """Windows of tokens (words here): structs of ``text, start, end``.

    A window below ``least`` tokens is left out while another start follows; the windows end
    with the first that reaches the end. A text of ``most`` tokens or fewer stays as it is.
    """
    step = max(1, most - overlap)

    def cut(words: Column) -> Column:
        n = F.size(words)
        last = F.greatest(F.ceil((n - most) / step).cast("int"), F.lit(0))
        starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
        kept = F.filter(starts, lambda s: (F.least(s + most, n) - s >= least) | (s + step >= n))
        many = F.transform(
            kept,
            lambda s: F.struct(F.array_join(F.slice(words, s + 1, F.lit(most)), " ").alias("text"), s.alias("start"), F.least(s + most, n).alias("end")),
        )
        whole = F.array(F.struct(text.alias("text"), F.lit(0).alias("start"), n.alias("end")))
        none = F.array().cast("array<struct<text:string,start:int,end:int>>")
        return F.when(n == 0, none).when(n <= most, whole).otherwise(many)

    return bound(split_words(text), cut)


def _packed(pieces: Column, cost: Column, most: int, overlap: Column | int, joiner: str) -> Column:
    """Greedy packing of pieces (with these token costs) into chunks of ``most`` tokens.

    A fold over the pieces keeps where the open chunk begins. When the next piece doesn't fit
    the chunk is closed, and the new one begins with those last pieces of the old that have
    ``overlap`` tokens or fewer together. A piece that is too large stands as it comes.
    """
    overlap = F.lit(overlap).cast("long") if isinstance(overlap, int) else overlap.cast("long")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<struct<first:int,end:int,tokens:bigint>>")
    start = F.struct(F.lit(0).alias("first"), zero.alias("tokens"), none.alias("done"))

    def seed(state: Column, i: Column) -> Column:
        """(first piece kept, tokens kept) of the overlap before piece i."""
        back = F.aggregate(
            F.when(i > state["first"], F.sequence(i - 1, state["first"], F.lit(-1))).otherwise(F.array().cast("array<int>")),
            F.struct(i.alias("at"), zero.alias("kept"), F.lit(False).alias("full")),
            lambda s, j: F.when(s["full"] | (s["kept"] + F.get(cost, j) > overlap), F.struct(s["at"].alias("at"), s["kept"].alias("kept"), F.lit(True).alias("full")))
            .otherwise(F.struct(j.alias("at"), (s["kept"] + F.get(cost, j)).alias("kept"), F.lit(False).alias("full"))),
        )
        return back

    def step(state: Column, i: Column) -> Column:
        own = F.get(cost, i)
        full = (state["tokens"] + own > most) & (i > state["first"])
        kept = seed(state, i)
        closed = F.concat(state["done"], F.array(F.struct(state["first"].alias("first"), i.alias("end"), state["tokens"].alias("tokens"))))
        opened = bound(kept, lambda k: F.struct(k["at"].alias("first"), (k["kept"] + own).alias("tokens"), closed.alias("done")))
        return F.when(full, opened).otherwise(F.struct(state["first"].alias("first"), (state["tokens"] + own).alias("tokens"), state["done"].alias("done")))

    def finish(state: Column) -> Column:
        ends = F.concat(state["done"], F.array(F.struct(state["first"].alias("first"), F.size(pieces).alias("end"), state["tokens"].alias("tokens"))))
        return F.transform(
            ends,
            lambda c: F.struct(
                F.array_join(F.slice(pieces, c["first"] + 1, c["end"] - c["first"]), joiner).alias("text"),
                c["first"].alias("first"), c["end"].alias("end"), c["tokens"].alias("tokens"),
            ),
        )

    empty = F.array().cast("array<struct<text:string,first:int,end:int,tokens:bigint>>")
    return F.when(F.size(pieces) > 0, F.aggregate(F.sequence(F.lit(0), F.size(pieces) - 1), start, step, finish)).otherwise(empty)


def sentences(text: Column) -> Column:
    """Sentences, cut after . ! ? and white space."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: s != "")


def sentence_chunks(text: Column, most: int = 512, overlap: Column | int = 50) -> Column:
    """Sentences packed greedily: structs of ``text, first, end`` (sentences) and ``tokens``."""
    return bound(
        sentences(text), lambda s: bound(F.transform(s, count_tokens), lambda cost: _packed(s, cost, most, overlap, " "))
    )


def code_chunks(text: Column, most: int = 512, overlap: Column | int = 100) -> Column:
    """Lines packed greedily; a line costs with its line break: structs of ``text, first, end, tokens``."""
    lines = F.when(F.length(text) > 0, F.split(text, "\n")).otherwise(F.array().cast("array<string>"))
    return bound(
        lines, lambda s: bound(F.transform(s, lambda x: count_tokens(F.concat(x, F.lit("\n")))), lambda cost: _packed(s, cost, most, overlap, "\n"))
    )


def adaptive_chunks(text: Column, doc_type: Column, most: int = 512) -> Column:
    """Code by lines; all else by sentences, with an overlap by document type."""
    overlap = F.when(doc_type == "meeting", 100).when(doc_type == "technical", 75).otherwise(50)
    return F.when(doc_type == "code", code_chunks(text, most, 100)).otherwise(sentence_chunks(text, most, overlap))


def chunk_params(doc_type: Column, language: Column) -> tuple[Column, Column]:
    """Window size and overlap by document type and language; unknown types are general."""
    size, overlap = (F.lit(x) for x in CHUNK_PARAMS["general"])
    for name, (own_size, own_overlap) in CHUNK_PARAMS.items():
        size = F.when(doc_type == name, own_size).otherwise(size)
        overlap = F.when(doc_type == name, own_overlap).otherwise(overlap)
    cjk = language.contains("chinese") | language.contains("japanese") | language.contains("korean")
    (cjk_size, cjk_overlap), (mixed_size, _) = LANGUAGE_FACTORS["cjk"], LANGUAGE_FACTORS["mixed"]
    sized = F.when(cjk, (size * cjk_size).cast("int")).when(language == "mixed", (size * mixed_size).cast("int")).otherwise(size)
    lapped = F.when(cjk, (overlap * cjk_overlap).cast("int")).otherwise(overlap)
    return sized, lapped


def optimal_chunk_tokens(model: Column, prompt: int = 1000, response: int = 1000) -> Column:
    """A quarter of what a model's context leaves, 512 at most."""
    context = F.lit(4096)
    for name, size in MODEL_CONTEXTS.items():
        context = F.when(model == name, size).otherwise(context)
    return F.least(F.lit(512), F.floor((context - prompt - response) / 4).cast("int"))


def oversize(tokens: Column, model: Column) -> Column:
    """Whether a chunk has more tokens than is best for the model."""
    return tokens > optimal_chunk_tokens(model)
