"""Token-ID output: Parquet list columns in document order, with selective reads."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded, slices
from tessera.llm.forced_bpe import ForcedBoundaryEncoder, worker
from tessera.session import write_table

#: Ends each document.
END_ID = 0
#: Text bytes that are encoded at once.
ENCODE_BYTES = 4 * 1024 * 1024
#: Row groups, pages and encodings: small pages with a page index let a reader skip to some rows;
#: ids are dictionary-encoded, and delta-encoded where a dictionary grows too large.
FILE_OPTIONS = {
    "parquet.block.size": str(32 * 1024 * 1024),
    "parquet.page.size": str(256 * 1024),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(512 * 1024),
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "v2",
    "compression": "zstd",
}


class Encoder(ForcedBoundaryEncoder):
    """Whole texts to ids as the tokenizer gives them, with END_ID after each."""

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin and end, END_ID among them."""
        ids, offsets = super().encode(texts)
        offsets = offsets + np.arange(len(offsets))
        kept = np.ones(int(offsets[-1]), bool)
        kept[offsets[1:] - 1] = False
        out = np.full(len(kept), END_ID, np.uint32)
        out[kept] = ids
        return out, offsets


def write_tokens(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Encode ``docs``, write the token files in ascending doc_id order, and read them back.

    Columns: doc_id, part and before (the file's place, and the ids before the document in
    it), n_tokens (with END_ID) and ids. The texts are range-partitioned by id once, before
    they are encoded; ties go by text hash and place, so a repeated id can span files.

    Null and empty texts are END_ID alone; null ids come first; repeated rows are documents
    of their own; other columns are left out. An empty table gives empty files. A very long
    text is encoded whole, in a batch of its own, and is one row of its file.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = worker(Encoder, shipped.value), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", ENCODE_BYTES):
            ids, offsets = encoder.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(before + offsets[:-1]),
                 pa.array(np.diff(offsets)), lists],
                names=["doc_id", "part", "before", "n_tokens", "ids"],
            )
            before += int(offsets[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_k"), F.monotonically_increasing_id().alias("_r"))
    ordered = keyed.repartitionByRange("doc_id", "_k", "_r").sortWithinPartitions("doc_id", "_k", "_r").select("doc_id", "text")
    encoded = ordered.transform(bounded).mapInArrow(run, f"doc_id {kind}, part int, before bigint, n_tokens bigint, ids array<int>")
    return write_table(encoded, "tokens", **FILE_OPTIONS)


def starts(tokens: DataFrame) -> DataFrame:
    """``part, base``: the ids in the files before each file; reads two small columns only."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("own"))  # a row per file
    return totals.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("base"))


def report(tokens: DataFrame) -> DataFrame:
    """Per document of the files: where its ids begin, how many they are, and their crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            edges = ids.offsets.to_numpy()
            crcs = [zlib.crc32(values[i:j]) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("before"), batch.column("n_tokens"), pa.array(crcs, pa.int64())],
                names=["doc_id", "part", "before", "n_tokens", "ids_crc32"],
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    summed = tokens.transform(bounded).mapInArrow(run, f"doc_id {kind}, part int, before bigint, n_tokens bigint, ids_crc32 bigint")
    bases = write_table(starts(tokens), "token-starts")
    return summed.join(bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
