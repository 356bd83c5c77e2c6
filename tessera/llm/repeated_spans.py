"""Substring dedup: runs of consecutive sentences that repeat anywhere in the corpus."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded, join_by_key, numbered, slices
from tessera.session import write_table

#: Every run of so many consecutive sentences counts, however short they are. For passages of
#: fewer but long sentences, so do two sentences of PAIR_WORDS, and one of LONE_WORDS by itself.
SENTENCES, PAIR_WORDS, LONE_WORDS = 3, 25, 50
_BREAK = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")


def sentence_bounds(text: str) -> list[tuple[int, int]]:
    """Where each sentence begins and ends: after . ! ? and white space, or at a line's end."""
    bounds, at = [], 0
    for found in _BREAK.finditer(text):
        if text[at : found.start()].strip():
            bounds.append((at, found.start()))
        at = found.end()
    if text[at:].strip():
        bounds.append((at, len(text)))
    return bounds


def runs_of(words: np.ndarray, sentences: int, pair_words: int, lone_words: int) -> np.ndarray:
    """Runs (first, end) of sentences with these word counts: every run of ``sentences``, and long pairs and long ones.

    A longer repeated run is covered by its own windows.
    """
    first = np.arange(max(len(words) - sentences + 1, 0))
    pair = np.flatnonzero(words[:-1] + words[1:] >= pair_words) if sentences > 2 else first[:0]
    lone = np.flatnonzero(words >= lone_words)
    return np.concatenate([np.stack([at, at + size], axis=1) for at, size in ((first, sentences), (pair, 2), (lone, 1))])


def sentence_runs(docs: DataFrame, sentences: int = SENTENCES, pair_words: int = PAIR_WORDS, lone_words: int = LONE_WORDS) -> DataFrame:
    """``doc_id, text_key, first, end, h1, h2`` for every run of every document.

    h1 and h2 are 128 bits of hash over the sentences, lower-cased with single spaces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, spans, hashes = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                parts = [text[i:j].lower().split() for i, j in sentence_bounds(text)]
                if not parts:
                    continue
                words = np.fromiter(map(len, parts), np.int64, len(parts))
                found = runs_of(words, sentences, pair_words, lone_words)
                if not len(found):
                    continue
                digests = b"".join(xxhash.xxh3_128_digest(" ".join(p).encode("utf-8", "surrogatepass")) for p in parts)
                hashes += [xxhash.xxh3_128_digest(digests[16 * i : 16 * j]) for i, j in found.tolist()]
                rows.append(np.full(len(found), row))
                spans.append(found)
            if not rows:
                continue
            row, span = np.concatenate(rows), np.concatenate(spans)
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            taken = batch.select(["doc_id", "text_key"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [taken.column("doc_id"), taken.column("text_key"), pa.array(span[:, 0].astype(np.int32)), pa.array(span[:, 1].astype(np.int32)),
                 pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                names=["doc_id", "text_key", "first", "end", "h1", "h2"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.transform(bounded).mapInArrow(run, f"doc_id {kind}, text_key bigint, first int, end int, h1 bigint, h2 bigint")


def repeated_spans(docs: DataFrame, sentences: int = SENTENCES, pair_words: int = PAIR_WORDS, lone_words: int = LONE_WORDS) -> DataFrame:
    """``doc_id, text_key, first, end, first_doc_id``: what each document repeats.

    A run that occurs more than once in the corpus stays where (doc_id, text hash, place) is
    least and goes everywhere else; overlapping and adjacent runs of a document are merged
    into one row of sentences ``first`` to ``end`` (excluded). first_doc_id is the least
    document that holds one of the merged runs.

    The first places are a partial aggregate by hash, joined back to the runs with hot hashes
    broadcast, so a passage in a third of all documents is never gathered in one task. Null
    and empty texts have no runs, and an empty table gives none; of a very long text only its
    runs are held at once. Rows with the same id and text count as one document; a null id is
    less than any. Other columns aren't read.
    """
    runs = write_table(sentence_runs(docs, sentences, pair_words, lone_words), "runs")
    place = F.struct("doc_id", "text_key", "first")
    groups = runs.groupBy("h1", "h2").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.count("*").alias("n"))
    repeated = write_table(groups.filter(~F.col("p").eqNullSafe(F.col("q"))).select("h1", "h2", "p", "n"), "repeated-runs")
    later = join_by_key(runs, repeated, ["h1", "h2"], "n").filter(~place.eqNullSafe(F.col("p")))
    # rows of one document that is in the table many times fall together here
    marked = later.groupBy("doc_id", "text_key", "first", "end").agg(F.min("p.doc_id").alias("holder"))
    own = Window.partitionBy("doc_id", "text_key").orderBy("first", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("first") > reach), 1).otherwise(0)
    grouped = marked.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(own))
    return grouped.groupBy("doc_id", "text_key", "island").agg(
        F.min("first").alias("first"), F.max("end").alias("end"), F.min("holder").alias("first_doc_id")
    ).drop("island")


def _cuts(spans: DataFrame) -> DataFrame:
    """``id, key, cut, holders`` per document: its spans in order and who holds them first."""
    per_doc = spans.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(
        F.sort_array(F.collect_list(F.struct("first", "end"))).alias("cut"), F.array_sort(F.collect_set("first_doc_id")).alias("holders")
    )
    return write_table(per_doc, "cuts")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the sentences of ``spans`` cut out of the text; all else, and columns of any name, as it was.

    Null and empty texts have no spans and stay; rows that repeat a document lose the same
    sentences each; a very long text is cut whole; an empty table stays empty.
    """
    own, name = numbered(docs)
    at = docs.columns.index("text")
    joined = own.join(_cuts(spans), F.col(name["doc_id"]).eqNullSafe(F.col("id")) & (F.xxhash64(name["text"]) == F.col("key")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(at).to_pylist(), batch.column("cut").to_pylist(), strict=True)
            texts = [cut_sentences(text, [(c["first"], c["end"]) for c in cut]) if cut else text for text, cut in pairs]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).drop_columns(["cut"])

    return joined.drop("id", "key", "holders").transform(bounded).mapInArrow(run, own.schema).toDF(*docs.columns)


def cut_sentences(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these runs of sentences and the white space that follows them."""
    bounds = sentence_bounds(text)
    kept, at = [], 0
    for first, end in sorted(spans):
        kept.append(text[at : bounds[first][0]])
        at = bounds[end][0] if end < len(bounds) else len(text)
    return "".join([*kept, text[at:]])


def report(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document that loses sentences: how many, which, who holds them first, and what is left.

    kept_chars and kept_crc32 (of the UTF-8 bytes) are those of the text without the spans.
    Rows that repeat a document give repeated results; documents without spans, so null and
    empty texts too, give no row, and an empty table none.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    joined = keyed.join(_cuts(spans), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("cut").to_pylist(), strict=True)
            left = [cut_sentences(text, [(c["first"], c["end"]) for c in cut]) for text, cut in pairs]
            crcs = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in left]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("cut"), batch.column("holders"), pa.array(map(len, left), pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "spans", "first_doc_ids", "kept_chars", "kept_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<first:int,end:int>>, first_doc_ids array<{kind}>, kept_chars bigint, kept_crc32 bigint"
    done = joined.select("doc_id", "text", "cut", "holders").transform(bounded).mapInArrow(run, schema)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return done.select("doc_id", gone.alias("sentences_removed"), "spans", "first_doc_ids", "kept_chars", "kept_crc32")
