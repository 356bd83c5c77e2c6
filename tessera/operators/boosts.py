"""Cosine with boosts by keywords and type, for many queries at once, where the chunks are."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.vector import QUERY_BLOCK, QUERY_BYTES, scores_of
from tessera.session import bounded, write_table

#: Chunks that meet a block of queries at once.
ROWS = 1024
#: What a keyword adds in the source, in the document's keywords, and in the first 500 characters (fixed values).
IN_SOURCE, IN_KEYWORDS, IN_HEAD, HEAD = 1.5, 1.0, 0.5, 500
#: What a type adds that is asked for (fixed value); meetings have their own.
OF_TYPE = 2.0
#: Bytes that a keyword's byte takes in the automaton, about.
_WORD_BYTES = 32
_HITS = "query_id bigint, id bigint, age bigint, distance double, score double"


class Automaton:
    """All distinct keywords in one Aho-Corasick automaton: each text is read once, however many queries there are."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.empty = [i for i, w in enumerate(words) if not w]  # in every text
        for i, word in enumerate(words):
            if word:
                self.automaton.add_word(word, i)
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows and numbers of the words that they hold, each once; equal texts are read once."""
        coded = texts.dictionary_encode()
        read = len(self.automaton) > 0
        own = [np.array([*{n for _, n in self.automaton.iter(t)}, *self.empty] if read else self.empty, np.int64) for t in coded.dictionary.to_pylist()]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.array([len(x) for x in own], np.int64)[codes] if own else np.zeros(len(codes), np.int64)
        rows = np.repeat(np.arange(len(codes)), sizes)
        return rows, np.concatenate([own[c] for c in codes]) if len(codes) else np.empty(0, np.int64)


class Asked:
    """The queries that go to one cluster."""

    def __init__(self, rows: pa.Table, number: dict[str, int]):
        self.names = rows.column("query_id").to_numpy()
        self.vectors = np.array(rows.column("vector").to_pylist(), np.float64) if "vector" in rows.column_names else None
        self.recent = rows.column("recent").to_numpy(zero_copy_only=False).astype(bool)
        self.hints = rows.column("doc_type_hint").to_pylist()
        self.most = np.ones(len(self.names))
        pairs = sorted((number[w], q) for q, words in enumerate(rows.column("words").to_pylist()) for w in words)
        self.query = np.array([q for _, q in pairs], np.int64)  # a word that a query has twice counts twice
        self.edges = np.searchsorted([w for w, _ in pairs], np.arange(len(number) + 1)) if number else np.zeros(1, np.int64)

    def boosts(self, hits: tuple[np.ndarray, np.ndarray, np.ndarray], types: list[str | None], meeting: np.ndarray) -> np.ndarray:
        """The boost of each chunk for each query, of the words that chunks hold, with what each adds."""
        rows, words, points = hits
        n, many = len(meeting), len(self.names)
        sizes = self.edges[words + 1] - self.edges[words]
        at = np.repeat(self.edges[words] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        cells = np.repeat(rows, sizes) * many + self.query[at]
        out = np.bincount(cells, np.repeat(points, sizes), n * many).astype(float).reshape(n, many)  # whole numbers if there are none
        for hint in {h for h in self.hints if h is not None}:
            own = meeting if hint == "meeting" else OF_TYPE * np.array([t == hint for t in types], float)
            out[:, [h == hint for h in self.hints]] += own[:, None]
        return out


def _hits(batch: pa.RecordBatch, automaton: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [(*automaton.found(batch.column(c)), points) for c, points in (("source", IN_SOURCE), ("doc_keywords", IN_KEYWORDS), ("head", IN_HEAD))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([np.full(len(p[0]), p[2]) for p in parts])


def _model(routes: DataFrame) -> tuple[list[str], dict[int, Asked]]:
    """The distinct keywords of the queries of ``routes``, and the queries of each cluster."""
    own = routes.toArrow()
    words = sorted({w for x in own.column("words").to_pylist() for w in x})
    number = {w: i for i, w in enumerate(words)}
    clusters = own.column("cluster_id").to_numpy()
    return words, {int(c): Asked(own.filter(pa.array(clusters == c)), number) for c in np.unique(clusters)}


def _best(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of parts (query, id, age, distance, score) the ``k`` best of each query; ties to the smaller age, then id."""
    query, ids, age, distance, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, age, -score, query))
    query = query[order]
    keep = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
    return tuple(np.concatenate(x)[keep] for x in zip(*parts, strict=True))


def _part(held: DataFrame, routes: DataFrame, k: int, share: float | None) -> DataFrame:
    """The best of the queries of ``routes``, whose size is bounded, in the clusters that they go to."""
    context = held.sparkSession.sparkContext
    words, clusters = _model(routes)
    met = held.filter(F.col("cluster_id").isin([*clusters]))  # as many as centroids at most
    plain = ["cluster_id", "source", "doc_keywords", "head", "doc_type", "meeting"]

    def parts_of(batches: Iterator[pa.RecordBatch], model) -> Iterator[tuple[pa.RecordBatch, Asked, np.ndarray]]:
        words, clusters = model.value
        automaton = Automaton(words)
        for batch in batches:
            numbers = batch.column("cluster_id").to_numpy(zero_copy_only=False)
            for c in np.unique(numbers):
                if int(c) not in clusters:
                    continue
                rows = np.flatnonzero(numbers == c)
                for at in range(0, len(rows), ROWS):
                    part = batch.take(pa.array(rows[at : at + ROWS]))
                    types, meeting = part.column("doc_type").to_pylist(), part.column("meeting").to_numpy(zero_copy_only=False)
                    yield part, clusters[int(c)], clusters[int(c)].boosts(_hits(part, automaton), types, meeting)

    if share is not None:
        first = context.broadcast((words, clusters))

        def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for _, asked, boosts in parts_of(batches, first):
                own = most.setdefault(id(asked), (asked.names, np.zeros(len(asked.names))))
                np.maximum(own[1], boosts.max(axis=0), out=own[1])
            for names, values in most.values():
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(values)], names=["query_id", "most"])

        tops = bounded(met.select(*plain)).mapInArrow(largest, "query_id bigint, most double").groupBy("query_id").agg(F.max("most").alias("most")).toArrow()  # a row a query of the part
        top = dict(zip(tops.column("query_id").to_pylist(), tops.column("most").to_pylist(), strict=True))
        for asked in clusters.values():
            asked.most = np.array([max(top.get(q, 0.0), 1.0) for q in asked.names.tolist()])
    shipped = context.broadcast((words, clusters))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = []
        for part, asked, boosts in parts_of(batches, shipped):
            ids, ages = (part.column(x).to_numpy(zero_copy_only=False) for x in ("id", "age"))
            vectors = None if share is None else part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            for q in range(0, len(asked.names), QUERY_BLOCK):
                own = slice(q, q + QUERY_BLOCK)
                near = np.zeros((len(asked.names[own]), len(ids))) if share is None else scores_of(asked.vectors[own], vectors, "cosine")
                score = boosts[:, own].T if share is None else np.round(near + share * boosts[:, own].T / asked.most[own, None], 6)
                age = np.where(asked.recent[own, None], ages, 0)
                order = np.lexsort((np.broadcast_to(ids, score.shape), age, -score), axis=1)[:, :k]
                pick = lambda x, order=order: np.take_along_axis(x, order, 1).ravel()
                best.append((np.repeat(asked.names[own], order.shape[1]), ids[order].ravel(), pick(age), np.round(1 - pick(near), 6) + 0.0, pick(score)))
            best = [_best(best, k)]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best[0]], names=["query_id", "id", "age", "distance", "score"])

    return bounded(met.select(*plain, "id", "age", *([] if share is None else ["vector"]))).mapInArrow(compare, _HITS)


def best_boosted(chunks: DataFrame, routes: DataFrame, k: int, share: float | None) -> DataFrame:
    """``query_id, id, distance, score, rank``: the ``k`` best chunks of each query in the clusters that it goes to.

    ``chunks(id, text, source, doc_type, doc_keywords, cluster_id, vector)`` stay where they are, and
    ``routes(cluster_id, query_id, vector, keywords, doc_type_hint, recent)`` go to them in parts of
    QUERY_BYTES. In a task the keywords of all queries of a part are one automaton, which reads
    each chunk once; what it finds is spread over the queries that ask for it. A first pass hands on
    the largest boost of each query, a second one its ``k`` best: cosine plus ``share`` of the
    boost over the largest one (1 at least); without a share the boost alone. Ties go to the newer
    ``file_modified`` where ``recent`` holds, then to the id. Chunks and queries without a
    vector take no part where there is a share; null keywords are none.
    """
    lower = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    text = F.coalesce(F.col("text"), F.lit(""))
    modified = F.unix_micros(F.col("file_modified").cast("timestamp")) if "file_modified" in chunks.columns else F.lit(0)
    age = F.coalesce(-modified, F.lit((1 << 63) - 1)).cast("long")
    in_head = F.lower(F.substring(text, 1, 200)).contains("meeting")
    meeting = F.when(lower("source").contains("meeting"), 5.0).when(F.col("doc_type") == "meeting", 3.0).when(in_head, 1.0).otherwise(0.0)
    vector = [] if share is None else ["vector"]
    fit = chunks if share is None else chunks.filter(F.col("vector").isNotNull())
    held = fit.select("id", F.substring(F.lower(text), 1, HEAD).alias("head"), lower("source").alias("source"), lower("doc_keywords").alias("doc_keywords"), "doc_type", F.col("cluster_id").cast("long").alias("cluster_id"), age.alias("age"), meeting.alias("meeting"), *vector)
    words = F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower), lambda w: w.isNotNull())
    fit = routes if share is None else routes.filter(F.col("vector").isNotNull())
    asked = write_table(fit.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("query_id").cast("long").alias("query_id"), words.alias("words"), "doc_type_hint", F.coalesce("recent", F.lit(False)).alias("recent"), *vector), "routes")
    row = F.length(F.array_join("words", ",")) * _WORD_BYTES + 128
    size = asked.agg(F.sum((row if share is None else row + F.size("vector") * 8).cast("long"))).first()[0] or 0
    parts = max(1, -(-size // QUERY_BYTES))
    found = [_part(held, asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i), k, share) for i in range(parts)]
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "age", "id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).drop("age")
