import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import chunk


def looped_windows(text, size, overlap):
    text, out, at = " ".join((text or "").split()), [], 0
    while at < len(text):
        out.append(text[at : at + size])
        if at + size >= len(text):
            break
        at += size - overlap
    return out


def tokens(text):
    return max(1, len(text) // 4) if text else 0


def looped_packing(pieces, costs, most, overlap, joiner):
    """(text, first, end, tokens) by adding pieces one at a time."""
    out, open_, first, total = [], [], 0, 0
    for i, piece in enumerate(pieces):
        if open_ and total + costs[i] > most:
            out.append((joiner.join(pieces[j] for j in open_), first, i, total))
            kept, seed = 0, []
            for j in reversed(open_):
                if kept + costs[j] > overlap:
                    break
                seed.insert(0, j)
                kept += costs[j]
            open_, first, total = [*seed, i], i - len(seed), kept + costs[i]
        else:
            open_.append(i)
            total += costs[i]
    if open_:
        out.append((joiner.join(pieces[j] for j in open_), first, len(pieces), total))
    return out


def texts(n=60):
    draw = random.Random(3)
    made = ["", None, " ", "one", "a b　c  d"]
    for _ in range(n):
        words = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(0, 120))]
        made.append("".join(w + draw.choice([" ", " ", ". ", "! ", "\n", "  "]) for w in words))
    return list(enumerate(made))


def test_windows_equal_a_loop(rows):
    data = texts()
    for size, overlap in ((50, 10), (7, 0), (9, 8)):
        found = {r.i: r.c for r in rows(data, "i int, t string").select("i", chunk.windows(F.col("t"), size, overlap).alias("c")).collect()}
        assert found == {i: looped_windows(t, size, overlap) for i, t in data}


def test_overlap_must_be_less_than_size():
    with pytest.raises(ValueError):
        chunk.windows(F.lit("x"), 5, 5)


def test_packing_equals_a_loop(rows):
    data = texts()
    frame = rows(data, "i int, t string")
    for most, overlap in ((12, 5), (30, 0), (3, 2)):
        made = frame.select("i", chunk.sentence_chunks(F.col("t"), most, overlap).alias("s"), chunk.code_chunks(F.col("t"), most, overlap).alias("c"), chunk.sentences(F.col("t")).alias("p"))
        for r in made.collect():
            costs = [tokens(p) for p in r.p]
            assert [tuple(x) for x in r.s] == looped_packing(r.p, costs, most, overlap, " ")
            lines = (dict(data)[r.i] or "").split("\n") if dict(data)[r.i] else []
            assert [tuple(x) for x in r.c or []] == looped_packing(lines, [tokens(x + "\n") for x in lines], most, overlap, "\n")


def test_long_code_block_is_cut_and_closed(rows):
    block = "x" * 100
    text = f"before ```{block}``` after ```short``` end ```open"
    (found,) = rows([(text,)], "t string").select(chunk.fenced(F.col("t"), 40, 10).alias("c")).first()
    assert found == ["before", "```" + "x" * 40, "x" * 40, "x" * 40 + "```", "after", "```short```", "end", "```open```"]


def test_params_by_type_and_language(rows):
    data = [("general", "chinese"), ("technical", "japanese"), ("prd", "mixed"), ("meeting", "english"), ("odd", "english")]
    size, overlap = chunk.chunk_params(F.col("t"), F.col("l"))
    found = [tuple(r) for r in rows(data, "t string, l string").select(size, overlap).collect()]
    assert found == [(840, 160), (1260, 320), (1275, 300), (800, 100), (1200, 200)]


def test_optimal_tokens(rows):
    found = [r[0] for r in rows([("gpt-4",), ("embeddinggemma:300m",), ("else",)], "m string").select(chunk.optimal_chunk_tokens(F.col("m"))).collect()]
    assert found == [512, 12, 512]
