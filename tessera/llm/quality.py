"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, coded_words, id_crc, lower_ascii, slices
from tessera.session import write_table

#: Buckets of hashed words, latent factors, labelled rows to learn from, rounds of averaging.
BUCKETS, FACTORS, SAMPLE_ROWS, ROUNDS = 1 << 14, 8, 12_000, 5
#: Shares that examples are dealt to by a hash of their id and text; each makes its own pass of a round.
SHARES = 8
#: Structure statistics and metadata, each a feature after the buckets.
STATISTICS = ("bias", "log_words", "log_chars_given", "mean_word", "distinct", "upper", "digit", "mark", "line", "other", "word_repeat")
_KINDS = np.zeros((256, 5), np.uint8)  # upper-case, digit, mark, line break, beyond ASCII
for _byte in range(256):
    _char = chr(_byte)
    _KINDS[_byte] = [
        "A" <= _char <= "Z",
        "0" <= _char <= "9",
        33 <= _byte < 127 and not _char.isalnum() and _char not in ".,;:'\"-()?",
        _char == "\n",
        _byte >= 128,
    ]


def text_features(texts: pa.Array, given_chars: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the hashed words and their weights (row, bucket, value), and the statistics.

    A word's value is the root of its share of the text's words.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    codes, words, offsets = coded_words(lower_ascii(texts))
    listed = words.cast(pa.binary()).to_pylist()
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in listed), np.int64, len(listed))
    word_size = np.fromiter(map(len, listed), np.int64, len(listed))
    n_words = np.diff(offsets)
    row = np.repeat(np.arange(len(texts)), n_words)
    pairs, counts = np.unique(row * buckets + bucket[codes], return_counts=True)
    rows = pairs // buckets
    values = np.sqrt(counts / np.maximum(n_words, 1)[rows])

    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    ends = np.cumsum(sizes)
    kinds = np.zeros((len(texts), 5))
    for k in range(5):
        running = np.concatenate([[0], np.cumsum(_KINDS[:, k][raw], dtype=np.int64)])
        kinds[:, k] = running[ends] - running[ends - sizes]
    share = kinds / np.maximum(sizes, 1)[:, None]
    lengths = np.concatenate([[0], np.cumsum(word_size[codes])])
    distinct = np.bincount(rows, minlength=len(texts)) / np.maximum(n_words, 1)
    most = np.zeros(len(texts))
    np.maximum.at(most, rows, counts)
    statistics = np.stack(
        [
            np.ones(len(texts)), np.log1p(n_words), np.log1p(np.maximum(given_chars, 0)),
            (lengths[offsets[1:]] - lengths[offsets[:-1]]) / np.maximum(n_words, 1), distinct, *np.sqrt(share).T, most / np.maximum(n_words, 1),
        ], axis=1,
    )
    return rows, pairs % buckets, values, statistics


@dataclass
class FactorisationMachine:
    """score = bias + sum w x + half of (sum v x)^2 - sum v^2 x^2, over the factors."""

    weights: np.ndarray
    factors: np.ndarray
    means: np.ndarray
    spreads: np.ndarray

    @classmethod
    def seeded(cls, buckets: int, factors: int, means: np.ndarray, spreads: np.ndarray, seed: int = 9) -> FactorisationMachine:
        size = buckets + len(means)
        draw = np.random.default_rng(seed).normal(0, 0.05, (size, factors))
        return cls(np.zeros(size), draw, means, spreads)

    def scaled(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.means) / self.spreads, -4, 4)

    def logits(self, rows: np.ndarray, index: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Score of each of ``n`` rows and its sums over the factors, in time linear in the features."""
        linear = np.bincount(rows, self.weights[index] * values, n)
        vx = self.factors[index] * values[:, None]
        sums = np.stack([np.bincount(rows, vx[:, f], n) for f in range(vx.shape[1])], axis=1)
        squares = np.bincount(rows, (vx * vx).sum(axis=1), n)
        return linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def probabilities(self, texts: pa.Array, given_chars: np.ndarray) -> np.ndarray:
        buckets = len(self.weights) - len(STATISTICS)
        rows, index, values, statistics = text_features(texts, given_chars, buckets)
        rows, index, values = with_statistics(rows, index, values, self.scaled(statistics), buckets)
        logits, _ = self.logits(rows, index, values, len(texts))
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def with_statistics(rows, index, values, statistics, buckets):
    """Word features followed by the statistics of each row as features after the buckets."""
    n, m = statistics.shape
    return (
        np.concatenate([rows, np.repeat(np.arange(n), m)]),
        np.concatenate([index, np.tile(buckets + np.arange(m), n)]),
        np.concatenate([values, statistics.ravel()]),
    )


def descend(model: FactorisationMachine, labels: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray]], seed: int, rate: float = 0.1, keep: float = 1e-4) -> None:
    """One pass of AdaGrad in mini-batches over the examples (index, values)."""
    order = np.random.default_rng(seed).permutation(len(labels))
    w, v = model.weights, model.factors
    seen_w, seen_v = np.full(len(w), 1e-2), np.full(v.shape, 1e-2)
    for at in range(0, len(order), 64):
        chosen = order[at : at + 64]
        index = np.concatenate([examples[i][0] for i in chosen])
        values = np.concatenate([examples[i][1] for i in chosen])
        rows = np.repeat(np.arange(len(chosen)), [len(examples[i][0]) for i in chosen])
        logits, sums = model.logits(rows, index, values, len(chosen))
        error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels[chosen]) / len(chosen)
        used, place = np.unique(index, return_inverse=True)
        step = error[rows] * values
        grad_w = np.bincount(place, step, len(used)) + keep * w[used]
        terms = step[:, None] * (sums[rows] - v[index] * values[:, None])
        grad_v = np.stack([np.bincount(place, terms[:, f], len(used)) for f in range(v.shape[1])], axis=1) + keep * v[used]
        seen_w[used] += grad_w**2
        seen_v[used] += grad_v**2
        w[used] -= rate * grad_w / np.sqrt(seen_w[used])
        v[used] -= 0.3 * rate * grad_v / np.sqrt(seen_v[used])


def train(
    docs: DataFrame, labels: DataFrame, trains: Column, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, factors: int = FACTORS, rounds: int = ROUNDS
) -> FactorisationMachine:
    """Learn ``labels.quality`` from labelled rows of ``docs`` for which ``trains`` holds.

    A sample of about ``sample_rows`` labelled rows is taken by hash of id and text (a bounded
    sample is all that a model of this size can use); rows with the same id and text are one
    example, and the mean of an id's labels is its label. The examples are dealt to SHARES by
    the same hash and ordered by it. Each round every share makes a pass from the same weights,
    and the weights are averaged share by share, in a shuffle by index. So the model doesn't
    depend on how the tables are cut into files, partitions or cores.
    """
    spark = docs.sparkSession
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    marked = write_table(marked.filter(trains).withColumn("label", (F.col("label") >= 0.5).cast("double")), "labelled")
    rows = docs.select("doc_id").join(marked, "doc_id").count()
    keyed = docs.select("doc_id", "text", F.coalesce("n_chars", F.lit(0)).cast("double").alias("chars"), F.xxhash64("text").alias("text_key")).join(marked, "doc_id")
    placed = keyed.withColumn("place", F.xxhash64(F.lit(9), "doc_id", "text_key"))
    draw = F.pmod("place", F.lit(1 << 30)) / float(1 << 30)
    sample = placed.filter(draw < min(1.0, sample_rows / max(rows, 1))).groupBy("place", "doc_id", "text_key", "label").agg(F.max("chars").alias("chars"), F.min("text").alias("text"))
    size, stats = buckets + len(STATISTICS), len(STATISTICS)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, index, values, statistics = text_features(batch.column("text"), batch.column("chars").to_numpy(), buckets)
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("share"), batch.column("place"), batch.column("doc_id"), batch.column("label"),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(index)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(values)), pa.array(list(statistics))],
                names=["share", "place", "doc_id", "label", "index", "value", "stats"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"share int, place bigint, doc_id {kind}, label double, index array<bigint>, value array<double>, stats array<double>"
    dealt = sample.select(F.pmod(F.xxhash64("place"), F.lit(SHARES)).cast("int").alias("share"), "place", "doc_id", "text", "chars", "label")
    table = write_table(dealt.transform(bounded).mapInArrow(features, schema), "quality-sample")

    def moments(key: tuple[pa.Scalar, ...], share: pa.Table) -> pa.Table:
        found = np.array(share.sort_by([("place", "ascending"), ("doc_id", "ascending")]).column("stats").to_pylist())
        return pa.table({"share": pa.array([key[0].as_py()], pa.int32()), "n": [len(found)], "sums": [found.sum(axis=0)], "squares": [(found**2).sum(axis=0)]})

    sums = table.groupBy("share").applyInArrow(moments, "share int, n bigint, sums array<double>, squares array<double>").collect()  # SHARES rows
    if not sums:
        return FactorisationMachine.seeded(buckets, factors, np.zeros(stats), np.ones(stats))
    sums.sort()
    n = sum(r["n"] for r in sums)
    means = sum(np.array(r["sums"]) for r in sums) / n
    spreads = np.maximum(np.sqrt(np.maximum(sum(np.array(r["squares"]) for r in sums) / n - means**2, 0)), 1e-6)
    means[0], spreads[0] = 0.0, 1.0  # the bias stays 1
    model = FactorisationMachine.seeded(buckets, factors, means, spreads)
    columns = [f"p{f}" for f in range(factors + 1)]
    for number in range(rounds):
        shipped = spark.sparkContext.broadcast(model)

        def learn(key: tuple[pa.Scalar, ...], share: pa.Table) -> pa.Table:
            """A share's passes: about sample_rows / SHARES examples, in the order of their hash."""
            start = shipped.value
            own = FactorisationMachine(start.weights.copy(), start.factors.copy(), start.means, start.spreads)
            share = share.sort_by([("place", "ascending"), ("doc_id", "ascending")]).combine_chunks()
            statistics = own.scaled(np.array(share.column("stats").to_pylist()))
            bags, values = share.column("index").to_pylist(), share.column("value").to_pylist()
            last = buckets + np.arange(stats)
            examples = [(np.concatenate([np.array(b, np.int64), last]), np.concatenate([v, s])) for b, v, s in zip(bags, values, statistics, strict=True)]
            for again in range(2):
                descend(own, share.column("label").to_numpy(), examples, seed=10 * number + again)
            both = np.concatenate([own.weights[:, None], own.factors], axis=1)
            named = {c: both[:, f] for f, c in enumerate(columns)}
            return pa.table({"share": np.full(size, key[0].as_py(), np.int32), "index": np.arange(size), "rows": np.full(size, float(share.num_rows))} | named)

        passed = table.groupBy("share").applyInArrow(learn, "share int, index bigint, rows double, " + ", ".join(f"{c} double" for c in columns))
        listed = passed.groupBy("index").agg(F.array_sort(F.collect_list(F.struct("share", "rows", *columns))).alias("l"))  # SHARES entries
        total = lambda c: F.aggregate("l", F.lit(0.0), lambda t, x: t + x[c] * x["rows"])
        weight = F.aggregate("l", F.lit(0.0), lambda t, x: t + x["rows"])
        mean = listed.select("index", *((total(c) / weight).alias(c) for c in columns)).toPandas()
        both = mean.sort_values("index")[columns].to_numpy()
        model = FactorisationMachine(both[:, 0].copy(), both[:, 1:].copy(), means, spreads)
    return model


def classify(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """``doc_id, score, predicted`` per row of ``docs``, in one pass without a shuffle.

    Only the text and n_chars (null: 0) are inputs. Null and empty texts have no word and
    score by their statistics. Repeated rows give repeated results, an empty table none; very
    long texts are scored whole, one at a time. Other columns, whatever their names, aren't read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = shipped.value.probabilities(batch.column("text"), batch.column("chars").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", "text", F.coalesce("n_chars", F.lit(0)).cast("double").alias("chars"))
    return given.transform(bounded).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def held_out() -> Column:
    return id_crc(F.col("doc_id")) % 3 == 1


def report(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    return classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
