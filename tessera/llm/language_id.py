"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded, coded_words, id_crc, numbered, slices
from tessera.session import write_table

#: Longest n-gram; marks before and after each word.
ORDER, BEFORE, AFTER = 4, 2, 3
#: A classifier may learn from a bounded sample: about so many characters of each language, yet
#: so many rows where they are few and long; and rows for calibration.
SAMPLE_CHARS, SAMPLE_ROWS, CALIBRATION_ROWS = 6_000_000, 500, 4_000
#: Characters of the sample in all: each language has an equal part of it at most, its rows be few or not.
ALL_CHARS = 64_000_000
#: Text bytes scored at once.
SCORE_BYTES = 4 * 1024 * 1024
#: Cells of places and languages (or words and languages) held at once.
CELLS = 4_000_000
#: Bits by which a text of one character may lie off at least; for longer ones over the root of the length.
SHORT_SLACK = 10.0
UNKNOWN = "und"
_NOT_LETTERS = r"[^\p{L}]+"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return values ^ (values >> np.uint64(29))


def letter_runs(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """Runs of letters of each word, lower-cased, and where each word's runs begin and end."""
    clean = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(words), _NOT_LETTERS, " "), " ")
    lists = pc.split_pattern(clean, " ")
    runs, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    full = pc.not_equal(runs, "")
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return runs.filter(full).to_pylist(), kept[offsets]


def code_points(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the runs, each with ORDER - 1 marks before and one after, and the places to predict."""
    lead = chr(BEFORE) * (ORDER - 1)
    joined = "".join(f"{lead}{r}{chr(AFTER)}" for r in runs)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return points, np.flatnonzero(points != BEFORE)


def gram_keys(points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n-gram that ends at each place."""
    total = np.full(len(at), n, np.uint64)
    for back in range(n):
        total += (points[at - back] + np.uint64(1)) * _ODD[back]
    return _mix(total)


@dataclass
class Sparse:
    """Values by hash and language: sorted hashes, where each one's entries begin, their languages and values."""

    hashes: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, row: np.ndarray, langs: np.ndarray, values: np.ndarray) -> Sparse:
        """From entries in order of ``row``, their place in the sorted ``hashes``."""
        return cls(hashes, np.searchsorted(row, np.arange(len(hashes) + 1)), langs.astype(np.uint16), values.astype(np.float32))

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``keys``, language and value of every entry of these hashes."""
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        place = np.flatnonzero(self.hashes[at] == keys)
        begins = self.starts[at[place]]
        many = self.starts[at[place] + 1] - begins
        own = np.repeat(begins - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.repeat(place, many), self.langs[own], self.values[own]


@dataclass
class KneserNey:
    """Per order the probabilities of the n-grams, and the back-off weights of their contexts, of the
    languages that have them. So the model's size is that of the sample, however many languages there are."""

    languages: list[str]
    probs: list[Sparse]
    weights: list[Sparse]
    base: np.ndarray

    @classmethod
    def fit(cls, languages: list[str], grams: dict[str, np.ndarray]) -> KneserNey:
        """From columns lang, n, key, prefix, suffix, count with one row per language and n-gram."""
        many = len(languages)
        orders = []
        for n in range(1, ORDER + 1):
            rows = np.flatnonzero(grams["n"] == n)
            rows = rows[np.lexsort((grams["lang"][rows], grams["key"][rows]))]
            own = {c: grams[c][rows] for c in ("lang", "key", "prefix", "suffix", "count")}
            own["keys"], own["row"] = np.unique(own["key"], return_inverse=True)
            own["code"] = own["row"] * many + own["lang"]  # ascending: an entry's n-gram and language
            orders.append(own)
        for lower, upper in zip(orders[:-1], orders[1:], strict=True):
            upper["below"] = np.searchsorted(lower["code"], np.searchsorted(lower["keys"], upper["suffix"]) * many + upper["lang"])
            # below the highest order a count is of the different characters that come before
            lower["count"] = np.bincount(upper["below"], minlength=len(lower["code"]))
        even = 1.0 / (len(orders[0]["keys"]) + 1)
        probs, weights, base, lower_probs = [], [], np.full(many, even), None
        for n, own in enumerate(orders, 1):
            counts, lang = own["count"].astype(np.float64), own["lang"]
            contexts, row = np.unique(own["prefix"], return_inverse=True)
            pairs, context = np.unique(row * many + lang, return_inverse=True)
            total, kinds = np.bincount(context, counts), np.bincount(context, counts > 0)
            once, twice = (np.bincount(lang[counts == c], minlength=many) for c in (1, 2))
            discount = np.where(once + twice > 0, np.maximum(once / np.maximum(once + 2 * twice, 1), 0.1), 0.75)
            weight = discount[pairs % many] * kinds / np.maximum(total, 1)
            lower = even if n == 1 else lower_probs[own["below"]]
            lower_probs = np.maximum(counts - discount[lang], 0) / np.maximum(total, 1)[context] + weight[context] * lower
            if n == 1:  # the empty context: what a language hasn't seen at all
                base[pairs % many] *= weight
            probs.append(Sparse.of(own["keys"], own["row"], lang, lower_probs))
            weights.append(Sparse.of(contexts, pairs // many, pairs % many, weight))
        return cls(languages, probs, weights, base)

    def _probs(self, points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Probability of each place after n - 1 characters in each language; what has no n-gram backs off."""
        if n == 0:
            return np.tile(self.base, (len(at), 1))
        out = self._probs(points, at, n - 1)
        if n > 1:
            place, lang, weight = self.weights[n - 1].entries(gram_keys(points, at - 1, n - 1))
            out[place, lang] *= weight
        place, lang, prob = self.probs[n - 1].entries(gram_keys(points, at, n))
        out[place, lang] = prob
        return out

    def log_probs(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log2 probability of each place in each language; each distinct n-gram is looked up once."""
        _, first, inverse = np.unique(gram_keys(points, at, ORDER), return_index=True, return_inverse=True)
        return np.log2(self._probs(points, at[first], ORDER))[inverse]

    def word_scores(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per word the log2 probability of its letter runs in each language, and the places predicted.

        CELLS places and languages are scored at once, so a long word or many languages take no more memory."""
        runs, offsets = letter_runs(words)
        scores = np.zeros((len(words), len(self.languages)))
        if not runs:
            return scores, np.zeros(len(words))
        points, at = code_points(runs)
        size = np.diff(np.concatenate([[0], np.flatnonzero(points[at] == AFTER) + 1]))
        word = np.repeat(np.repeat(np.arange(len(words)), np.diff(offsets)), size)
        step = max(1, CELLS // len(self.languages))
        for start in range(0, len(at), step):
            own = word[start : start + step]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            scores[own[first]] += np.add.reduceat(self.log_probs(points, at[start : start + step]), first, axis=0)
        return scores, np.bincount(word, minlength=len(words)).astype(float)


@dataclass
class LanguageModel:
    """The character models with their calibration."""

    models: KneserNey | None
    scale: float = 1.0
    #: Above this cross-entropy (plus slack over the root of the length) a language is rejected.
    limits: np.ndarray | None = None
    slack: float = 0.0

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character in each language, and the characters, of each text."""
        codes, words, offsets = coded_words(pc.fill_null(texts, ""))
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        total, n = np.zeros((len(texts), len(self.models.languages))), np.zeros(len(texts))
        step = max(1, CELLS // len(self.models.languages))
        if len(words) > step:
            order = np.argsort(codes, kind="stable")
            codes, text = codes[order], text[order]
        for start in range(0, len(words), step):
            own = slice(*np.searchsorted(codes, [start, start + step])) if len(words) > step else slice(None)
            scores, places = self.models.word_scores(words.slice(start, step))
            word, of = codes[own] - start, text[own]
            n += np.bincount(of, places[word], len(texts))
            for lang, column in enumerate(scores.T.copy()):
                total[:, lang] += np.bincount(of, column[word], len(texts))
        return -total / np.maximum(n, 1)[:, None], n

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether it is rejected, of each text."""
        if self.models is None:
            nothing = np.zeros(len(texts))
            return [UNKNOWN] * len(texts), nothing, nothing, np.ones(len(texts), bool)
        bits, n = self.entropies(texts)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(bits)), best]
        gaps = np.exp(np.clip(-(bits - least[:, None]) * self.scale * np.sqrt(n)[:, None], -700, 0))
        empty = n == 0
        score = np.where(empty, 0.0, 1.0 / gaps.sum(axis=1))
        rejected = empty | (least > self.limits[best] + self.slack / np.sqrt(np.maximum(n, 1)))
        names = [UNKNOWN if e else self.models.languages[b] for e, b in zip(empty, best, strict=True)]
        return names, score, np.where(empty, 0.0, least), rejected


def _word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, count`` with partial counts from each batch, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SCORE_BYTES):
            codes, words, offsets = coded_words(pc.fill_null(batch.column("text"), ""))
            langs = batch.column("lang").dictionary_encode()
            lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(offsets))
            pairs, counts = np.unique(lang.astype(np.int64) * max(len(words), 1) + codes, return_counts=True)
            which = pa.array(pairs // max(len(words), 1)), pa.array(pairs % max(len(words), 1))
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(which[0]), words.take(which[1]), pa.array(counts)], names=["lang", "word", "count"]
            )

    return docs.select("text", "lang").transform(bounded).mapInArrow(run, "lang string, word string, count bigint").groupBy("lang", "word").agg(F.sum("count").alias("count"))


def _gram_counts(words: DataFrame) -> DataFrame:
    """``lang, n, key, prefix, suffix, count`` for the n-grams of a table of word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, offsets = letter_runs(batch.column("word"))
            if not runs:
                continue
            points, at = code_points(runs)
            size = np.diff(np.concatenate([[0], np.flatnonzero(points[at] == AFTER) + 1]))
            row = np.repeat(np.repeat(np.arange(batch.num_rows), np.diff(offsets)), size)
            langs = batch.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False)[row]
            count = batch.column("count").to_numpy()[row]
            for n in range(1, ORDER + 1):
                key = gram_keys(points, at, n)
                order = np.lexsort((key, lang))
                cuts = np.flatnonzero(np.concatenate([[True], (np.diff(key[order].view(np.int64)) != 0) | (np.diff(lang[order]) != 0)]))
                first, sums = order[cuts], np.add.reduceat(count[order], cuts)
                prefix = gram_keys(points, at[first] - 1, n - 1) if n > 1 else np.zeros(len(first), np.uint64)
                suffix = gram_keys(points, at[first], n - 1) if n > 1 else np.zeros(len(first), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(lang[first])), pa.array(np.full(len(first), n, np.int32)),
                     *(pa.array(x.view(np.int64)) for x in (key[first], prefix, suffix)), pa.array(sums)],
                    names=["lang", "n", "key", "prefix", "suffix", "count"],
                )

    grams = words.select("lang", "word", "count").transform(bounded).mapInArrow(run, "lang string, n int, key bigint, prefix bigint, suffix bigint, count bigint")
    return grams.groupBy("lang", "n", "key").agg(F.first("prefix").alias("prefix"), F.first("suffix").alias("suffix"), F.sum("count").alias("count"))


def train(docs: DataFrame, trains: Column, sample_chars: int = SAMPLE_CHARS, calibration_rows: int = CALIBRATION_ROWS) -> LanguageModel:
    """Learn from the rows of ``docs`` where ``trains`` holds and text and lang aren't null.

    Of each language a sample is taken by id hash at the rate that gives ``sample_chars``
    characters, or SAMPLE_ROWS rows where that is more, and ALL_CHARS in all, whole texts each; so the n-gram counts that come to the driver and go out
    to the tasks are bounded, also where ``lang`` has thousands of rare values, and only those of
    the languages that have them are kept. A rare value is a language like any other; one whose
    rows fall outside the sample isn't learned. Another sample of about ``calibration_rows`` rows
    sets the scale of the scores and the limits for rejection. Null and empty texts teach
    nothing, repeated rows count repeatedly, very long texts whole; an empty table gives a model
    that knows no language. Other columns aren't read.
    """
    spark = docs.sparkSession
    known = docs.filter(trains & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    totals = known.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("rows"))
    part = ALL_CHARS / F.count("*").over(Window.partitionBy())  # a row a language
    least = SAMPLE_ROWS / F.col("rows") * F.col("chars")
    chars = F.least(part, F.greatest(F.lit(float(sample_chars)), least))
    rates = write_table(
        totals.select("lang", F.least(F.lit(1.0), chars / F.greatest("chars", F.lit(1))).alias("rate"), "rows"),
        "language-rates",
    )
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id", F.length("text")), F.lit(1 << 30)) / float(1 << 30)
    held = F.pmod(F.xxhash64(F.lit(6), "doc_id", F.length("text")), F.lit(10)) == 0
    drawn = known.join(rates, "lang").withColumn("draw", draw).withColumn("held", held)
    grams = _gram_counts(write_table(_word_counts(drawn.filter("draw < rate and not held")), "language-words"))
    found = grams.toPandas()
    languages = sorted(found["lang"].unique())
    if not languages:
        return LanguageModel(None)
    place = {name: i for i, name in enumerate(languages)}
    columns = {c: found[c].to_numpy() for c in ("n", "count")} | {"lang": found["lang"].map(place).to_numpy()}
    columns |= {c: found[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("key", "prefix", "suffix")}
    model = LanguageModel(KneserNey.fit(languages, columns))

    share = F.least(F.lit(1.0), calibration_rows / F.sum("rows").over(Window.partitionBy()) * 10)
    rows = drawn.filter("held").join(rates.select("lang", share.alias("share")), "lang").filter("draw < share")
    shipped = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SCORE_BYTES):
            bits, n = shipped.value.entropies(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(bits)), pa.array(n)], names=["lang", "bits", "n"])

    tried = rows.select("text", "lang").transform(bounded).mapInArrow(measure, "lang string, bits array<double>, n double").filter("n > 0").toPandas()
    return calibrated(model, tried["lang"].map(place), tried["bits"], tried["n"])


def calibrated(model: LanguageModel, truth, bits, n) -> LanguageModel:
    """Set scale, limits and slack from held texts: their language, cross-entropies and lengths."""
    languages = len(model.models.languages)
    model.limits = np.full(languages, np.inf)
    use = truth.notna().to_numpy()
    if not use.any():
        return model
    truth, bits, n = truth[use].to_numpy().astype(int), np.stack(bits[use]), n[use].to_numpy()
    # the scale that makes the scores likeliest
    scales = np.exp(np.linspace(np.log(0.05), np.log(20), 40))
    gaps = -(bits - bits.min(axis=1, keepdims=True)) * np.sqrt(n)[:, None]
    losses = [np.log(np.exp(np.clip(gaps * s, -700, 0)).sum(axis=1)).mean() - (gaps * s)[np.arange(len(n)), truth].mean() for s in scales]
    model.scale = float(scales[int(np.argmin(losses))])
    own = bits[np.arange(len(n)), truth]
    right = bits.argmin(axis=1) == truth
    centre = np.array([np.median(own[right & (truth == i)]) if (right & (truth == i)).any() else np.inf for i in range(languages)])
    near = right & np.isfinite(centre[truth])
    over, n = np.maximum(own - centre[truth], 0)[near], n[near]
    # how far texts lie from their language's centre: long ones by a constant, short ones by
    # more with the root of their length; half as much again, and half a bit, is let pass
    far = lambda values: 1.5 * float(np.quantile(values, 0.999)) if len(values) else 0.0
    usual = far(over[n >= 300])
    model.slack = max(SHORT_SLACK, far(np.maximum(over - usual, 0) * np.sqrt(n)))
    model.limits = centre + usual + 0.5
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, bits, rejected`` added, in one pass without a shuffle.

    Each language predicts every letter run of the text with a mark at its end; the one of
    least cross-entropy a character wins (ties: the first by name). ``score`` is the
    calibrated probability, ``rejected`` says that the text is too unlike every language.
    Null texts and texts without a letter are ``und`` with score 0, and rejected. With no
    language learned all are. Columns of ``docs`` pass through (see ``keep_identified`` for
    any names). Repeated rows give repeated results, an empty table none; a very long text is
    scored whole, over its distinct words.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SCORE_BYTES):
            names, score, bits, rejected = shipped.value.predict(batch.column(text))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)],
                names=[*batch.schema.names, "lang_pred", "score", "bits", "rejected"],
            )

    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "bits": T.DoubleType(), "rejected": T.BooleanType()}
    return docs.transform(bounded).mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in added.items())]))


def held_out() -> Column:
    return id_crc(F.col("doc_id")) % 5 == 0


def report(docs: DataFrame, model: LanguageModel) -> DataFrame:
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits", "rejected")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` without those that the models reject, with their own columns (whatever their names)."""
    own, name = numbered(docs)
    kept = identify(own, model, name["text"]).filter("not rejected")
    return kept.select(*own.columns).toDF(*docs.columns)
