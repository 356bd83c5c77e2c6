"""Hidden Markov language model: Baum-Welch over partitions, scaled forward scoring."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, coded_words, id_crc, lower_ascii, slices, sums_between
from tessera.session import write_table

#: Latent states, word classes (by crc32 of the word; the end of text is class 0), rounds of Baum-Welch.
STATES, CLASSES, ROUNDS = 8, 1 << 14, 3
#: Words whose counts every task holds; the rest are looked up by a join.
FREQUENT = 100_000
#: Tokens of a piece: pieces of long texts are worked on side by side, with what goes in and out of
#: each computed first. Tokens whose steps are held at once. Least relative gain of a further round.
PIECE, HELD, GAIN = 1024, 1 << 19, 1e-5


def word_classes(words: list[bytes], classes: int) -> np.ndarray:
    return np.fromiter((1 + zlib.crc32(w) % (classes - 1) for w in words), np.uint16, len(words))


@dataclass
class Hmm:
    """Start, transition (from, to) and emission (class, state) probabilities."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray

    @classmethod
    def seeded(cls, counts: np.ndarray, states: int, seed: int = 1) -> Hmm:
        """Class frequencies, perturbed at random for each state; states tend to stay."""
        draw = np.random.default_rng(seed)
        emits = (counts + 1.0)[:, None] * np.exp(draw.normal(0, 0.5, (len(counts), states)))
        moves = np.full((states, states), 0.3 / max(states - 1, 1))
        np.fill_diagonal(moves, 0.7 if states > 1 else 1.0)
        return cls(np.full(states, 1.0 / states), moves, emits / emits.sum(axis=0))


@dataclass
class Pieces:
    """Texts cut into pieces that follow each other: where each begins, its length, and its number in the text.

    ``entry`` is the state distribution after the piece before (for a first piece unused),
    ``exit`` what the pieces behind make of the states at its end, both up to a factor.
    """

    begins: np.ndarray
    lengths: np.ndarray
    number: np.ndarray
    last: np.ndarray
    entry: np.ndarray
    exit: np.ndarray

    @classmethod
    def cut(cls, model: Hmm, codes: np.ndarray, offsets: np.ndarray, longest: int, backward: bool) -> Pieces:
        """Pieces of at most ``longest`` tokens. The recursions are linear in what goes in, so each
        piece's transfer matrix is computed first, for all pieces side by side; then entries (and
        exits, if ``backward``) follow from piece to piece. This is the exact recursion of whole texts."""
        sizes = np.diff(offsets)
        many = -(-sizes // longest)
        number = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        begins = np.repeat(offsets[:-1], many) + number * longest
        lengths = np.minimum(np.repeat(offsets[1:], many) - begins, longest)
        behind = np.repeat(many, many) - 1 - number
        states = len(model.start)
        made = cls(begins, lengths, number, behind == 0, np.zeros((len(number), states)), np.ones((len(number), states)))
        if not behind.any():
            return made
        heads = np.flatnonzero((number == 0) & (behind > 0))
        ends = np.zeros((len(number), states))
        _, ends[heads] = forward(model, codes, begins[heads], lengths[heads], made.entry[heads], np.ones(len(heads), bool))
        inner = np.flatnonzero((number > 0) & (backward | (behind > 0)))
        through = np.zeros((len(number), states, states)) if len(inner) else np.zeros((0, states, states))
        through[inner] = transfer(model, codes, begins[inner], lengths[inner])
        for k, at in _levels(number):
            if k:
                before = ends[at - 1] if k == 1 else np.einsum("ps,pst->pt", made.entry[at - 1], through[at - 1])
                made.entry[at] = before / before.sum(axis=1, keepdims=True)
        if backward:
            for k, at in _levels(behind):
                if k:
                    beyond = np.einsum("pst,pt->ps", through[at + 1], made.exit[at + 1])
                    made.exit[at] = beyond / beyond.sum(axis=1, keepdims=True)
        return made


def _levels(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value from 0 on with the places that have it."""
    order = np.argsort(values, kind="stable")
    edges = np.searchsorted(values[order], np.arange(int(values.max(initial=0)) + 2))
    for k in range(len(edges) - 1):
        yield k, order[edges[k] : edges[k + 1]]


def _alive(lengths: np.ndarray) -> list[int]:
    """How many of the pieces, longest first, have a token at each step."""
    return [int(np.searchsorted(-lengths, -t)) for t in range(int(lengths[0]) if len(lengths) else 0)]


def transfer(model: Hmm, codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each piece's matrix from the states before it to those at its end, up to a factor."""
    order, states = np.argsort(-lengths, kind="stable"), len(model.start)
    begins = begins[order]
    found = np.tile(np.eye(states), (len(order), 1, 1))
    for t, now in enumerate(_alive(lengths[order])):
        step = (found[:now].reshape(-1, states) @ model.moves).reshape(now, states, states) * model.emits[codes[begins[:now] + t]][:, None, :]
        found[:now] = step / step.sum(axis=(1, 2), keepdims=True) if t % 8 == 7 else step
    out = np.empty_like(found)
    out[order] = found / found.sum(axis=(1, 2), keepdims=True)
    return out


def forward(model: Hmm, codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, entry: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 likelihood of each piece after its entry (of a fresh one: from the start), and the states at its end.

    The scaled forward recursion, one step for all pieces that are still going on: they are
    ordered by length, so at each step those are the first so many.
    """
    order = np.argsort(-lengths, kind="stable")
    begins = begins[order]
    alive = _alive(lengths[order])
    total, alpha = np.zeros(len(order)), np.where(fresh[:, None], model.start, entry @ model.moves)[order]
    ends = np.zeros_like(alpha)
    for t, now in enumerate(alive):
        alpha = (alpha[:now] if t == 0 else alpha[:now] @ model.moves) * model.emits[codes[begins[:now] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:now] += np.log10(scale)
        after = alive[t + 1] if t + 1 < len(alive) else 0
        ends[after:now] = alpha[after:]
    likelihood, at_end = np.empty(len(order)), np.empty_like(ends)
    likelihood[order], at_end[order] = total, ends
    return likelihood, at_end


def forward_log10(model: Hmm, codes: np.ndarray, offsets: np.ndarray, longest: int = PIECE) -> np.ndarray:
    """log10 likelihood of each whole sequence codes[offsets[i]:offsets[i + 1]]."""
    pieces = Pieces.cut(model, codes, offsets, longest, backward=False)
    own, _ = forward(model, codes, pieces.begins, pieces.lengths, pieces.entry, pieces.number == 0)
    text = np.cumsum(pieces.number == 0) - 1
    full = np.flatnonzero(np.diff(offsets) > 0)  # a text without tokens has no piece
    out = np.zeros(len(offsets) - 1)
    out[full] = np.bincount(text, own, len(full))
    return out


def chain_counts(model: Hmm, codes: np.ndarray, pieces: Pieces, chosen: np.ndarray, into: dict[str, np.ndarray]) -> None:
    """Add the expected counts (forward-backward) of the ``chosen`` pieces, longest first, to ``into``."""
    begins, entry, fresh = pieces.begins[chosen], pieces.entry[chosen], pieces.number[chosen] == 0
    alive, states = _alive(pieces.lengths[chosen]), len(model.start)
    alphas, scales, seen = [], [], []
    for t, now in enumerate(alive):
        seen.append(codes[begins[:now] + t])
        came = np.where(fresh[:, None], model.start, entry @ model.moves) if t == 0 else alphas[-1][:now] @ model.moves
        alpha = came * model.emits[seen[t]]
        scale = alpha.sum(axis=1, keepdims=True)
        alphas.append(alpha / scale)
        scales.append(scale)
        into["likelihood"] += np.log10(scale).sum()
    beta, held = np.empty((0, states)), []
    for t in range(len(alive) - 1, -1, -1):
        now, going = alive[t], len(beta)
        own = np.empty((now, states))
        if going:
            weight = beta * model.emits[seen[t + 1]] / scales[t + 1]
            into["moves"] += model.moves * (alphas[t][:going].T @ weight)
            own[:going] = weight @ model.moves.T
        out = pieces.exit[chosen[going:now]]
        own[going:] = out / (out * alphas[t][going:]).sum(axis=1, keepdims=True)
        held.append(alphas[t] * own)
        beta = own
    held.reverse()
    # the step into a piece from the one before it
    inner = np.flatnonzero(~fresh)
    weight = beta[inner] * model.emits[seen[0][inner]] / scales[0][inner]
    into["moves"] += model.moves * (entry[inner].T @ weight)
    gammas, classes = np.concatenate(held), len(into["emits"])
    seen = np.concatenate(seen)
    for s in range(states):
        into["emits"][:, s] += np.bincount(seen, gammas[:, s], classes)
    into["start"] += held[0][fresh].sum(axis=0)


def expected_counts(model: Hmm, codes: np.ndarray, offsets: np.ndarray, into: dict[str, np.ndarray], longest: int = PIECE, held: int = HELD) -> None:
    """Add the expected counts of whole sequences to ``into``, about ``held`` tokens at once."""
    pieces = Pieces.cut(model, codes, offsets, longest, backward=True)
    order = np.argsort(-pieces.lengths, kind="stable")
    at = 0
    while at < len(order):
        stop = at + max(1, held // int(pieces.lengths[order[at]]))
        chain_counts(model, codes, pieces, order[at:stop], into)
        at = stop


def no_counts(classes: int, states: int) -> dict[str, np.ndarray]:
    return {"emits": np.zeros((classes, states)), "moves": np.zeros((states, states)), "start": np.zeros(states), "likelihood": np.zeros(1)}


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a batch's texts in a row, and where each text's begin and end."""
    column = batch.column("codes")
    codes = np.frombuffer(b"".join(column.to_pylist()), np.uint16)
    return codes, np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2)])


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, count`` over all texts, with partial counts from each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes, words, _ = coded_words(lower_ascii(batch.column("text")))
            yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(np.bincount(codes, minlength=len(words)))], names=["word", "count"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).transform(bounded).mapInArrow(run, "word binary, count bigint").groupBy("word").agg(F.sum("count").alias("count"))


def frequency_cut(table: DataFrame, most: int) -> int:
    """Least count, as a power of 2**(1/8), that ``most`` words at most reach; from a histogram of a few hundred rows."""
    level = F.ceil(F.log2("count") * 8)
    steps = table.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("count").alias("least")).toPandas()
    steps = steps.sort_values("level", ascending=False)
    fits = steps[steps["words"].cumsum() <= most]
    return int(fits["least"].min()) if len(fits) else 1 << 62


def baum_welch(encoded: DataFrame, counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS, gain: float = GAIN) -> Hmm:
    """Train on ``codes`` of ``encoded``: each round is a job that sums the tasks' expected counts.

    What a task hands on has the size of the model; it is summed by class in a shuffle, and
    the sums (classes x states) come to the driver for the next round. ``rounds`` at most; it
    ends before if the likelihood grew by less than the share ``gain``.
    """
    spark, classes = encoded.sparkSession, len(counts)
    model, best = Hmm.seeded(counts, states), None
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            into = no_counts(classes, states)
            for batch in slices(batches, "codes"):
                expected_counts(shipped.value, *_sequences(batch), into)
            likelihood = np.pad(into["likelihood"], (0, states - 1))
            rows = np.concatenate([into["emits"], into["moves"], into["start"][None], likelihood[None]])
            used = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(rows[used, s]) for s in range(states))], names=["row", *(f"s{s}" for s in range(states))])

        columns = [f"s{s}" for s in range(states)]
        sums = encoded.select("codes").transform(bounded).mapInArrow(run, "row int, " + ", ".join(f"{c} double" for c in columns))
        found = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
        rows = np.zeros((classes + states + 2, states))
        rows[found["row"].to_numpy()] = found[columns].to_numpy()
        # every state keeps a little of the overall frequencies, so nothing has probability 0
        emits = rows[:classes] + 1.0 * (counts + 1.0)[:, None] / (counts + 1.0).sum() * classes * 0.05
        moves, start = rows[classes : classes + states] + 0.1, rows[-2] + 0.1
        model = Hmm(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
        likelihood = float(rows[-1, 0])
        if best is not None and likelihood - best <= gain * abs(best):
            break
        best = likelihood
    return model


def score(docs: DataFrame, held_out: Column, states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the A-Z-lower-cased text and one end.
    Words fall into ``classes`` by hash; a latent state emits a class, and a class emits its
    words in proportion to count + 1, with one place for all words never seen:
    P(word | state) = P(class | state) * (count + 1) / (sum of count + 1 in the class + 1).
    So the likelihood of a text is the exact forward likelihood of its classes times the
    words' shares, and sums to one as the base model does.

    Counts of all words cover all training rows. The ``frequent`` most frequent are
    broadcast (that number bounds them); a text's other words are joined with the full table
    by word. Null texts count as empty: the end alone. Rows that repeat an id are scored each
    on its own; with no training rows every word is unknown. An empty table gives no rows.
    Texts are whole chains in training and in scoring, however long. Other columns, whatever
    their names, aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    table = write_table(word_counts(rows.filter(~F.col("held_out"))), "word-counts")
    texts = rows.filter(~F.col("held_out")).count()

    # the class totals and the most frequent words: both bounded by parameters
    in_class = 1 + F.pmod(F.crc32("word"), F.lit(classes - 1))
    sums = table.groupBy(in_class.alias("c")).agg(F.sum("count").alias("n"), F.count("*").alias("v")).toPandas()
    top = table.filter(F.col("count") >= frequency_cut(table, frequent)).toPandas()
    per_class, kinds = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    per_class[sums["c"].to_numpy(dtype=np.int64)], kinds[sums["c"].to_numpy(dtype=np.int64)] = sums["n"], sums["v"]
    per_class[0], kinds[0] = texts, int(texts > 0)
    all_tokens, all_kinds = int(per_class.sum()), int(kinds.sum())
    shipped = spark.sparkContext.broadcast(dict(zip(map(bytes, top["word"]), top["count"].tolist(), strict=True)))
    room = np.log10(per_class + kinds + 1.0)
    end_share = np.log10(texts + 1.0)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shipped.value
        for batch in slices(batches, "text"):
            codes, words, offsets = coded_words(lower_ascii(batch.column("text")))
            listed = words.cast(pa.binary()).to_pylist()
            own = np.fromiter((counts.get(w, 0) for w in listed), np.int64, len(listed))
            classes_of = word_classes(listed, classes)
            ends = offsets[1:]
            sequence = np.insert(classes_of[codes], ends, 0).astype(np.uint16)
            bounds = offsets + np.arange(len(offsets))
            blobs = [sequence[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            known = own[codes] > 0
            rest = np.flatnonzero(~known)
            cut = np.searchsorted(rest, offsets).astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(cut), words.cast(pa.binary()).take(pa.array(codes[rest])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(blobs, pa.binary()), pa.array(np.diff(bounds)),
                 pa.array(sums_between(known.astype(float), offsets).astype(np.int64) + int(texts > 0)),
                 pa.array(sums_between(np.log10(own[codes] + 1.0), offsets) + end_share),
                 pa.array(sums_between(room[sequence], bounds)), tail],
                names=["doc_id", "held_out", "codes", "n_tokens", "known", "logs", "room", "tail"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, codes binary, n_tokens bigint, known bigint, logs double, room double, tail array<binary>"
    encoded = write_table(rows.transform(bounded).mapInArrow(encode, schema).withColumn("row", F.monotonically_increasing_id()), "encoded", compression="zstd")
    model = spark.sparkContext.broadcast(baum_welch(encoded.filter("not held_out"), per_class.astype(float), states, rounds))

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "codes"):
            codes, offsets = _sequences(batch)
            yield batch.drop_columns(["codes"]).append_column("hmm", pa.array(forward_log10(model.value, codes, offsets)))

    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "known", "logs", "room", "codes").transform(bounded).mapInArrow(
        likelihoods, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, logs double, room double, hmm double"
    )
    tails = (
        encoded.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count("*").alias("tf"))
        .join(table, "word").groupBy("row")
        .agg(F.sum("tf").alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("count") + 1.0)).alias("more_logs"))
    )
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return scored.join(tails, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(all_tokens + all_kinds + 1.0)))).alias("base_score"),
        (F.col("hmm") + logs - F.col("room")).alias("score"),
    )


def held_out() -> Column:
    return id_crc(F.col("doc_id")) % 7 == 2
