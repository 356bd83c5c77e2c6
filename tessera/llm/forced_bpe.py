"""Byte-level BPE: texts to ids by cuts that no token can span, and ids back to texts."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.common import bounded, gathered, slices

#: Fragments that a worker remembers at most, text bytes that it encodes at once, fragments joined for one call.
REMEMBERED, ENCODE_BYTES, JOINED = 500_000, 4 * 1024 * 1024, 512
#: Classes of characters in the pattern of the pre-tokens.
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Ends of contractions: letters after an apostrophe that belong to it.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def _spec(tokenizer_json: str) -> dict:
    """The vocabulary file, if it is one that this encoder knows."""
    spec = json.loads(tokenizer_json)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("a byte-level BPE without normalizer and with the usual pre-tokens is needed")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens have to be plain strings")
    return spec


def _token_bytes(spec: dict) -> dict[int, bytes]:
    """The bytes of each id."""
    of = {c: b for b, c in enumerate(byte_characters())}
    tokens = {i: bytes(map(of.__getitem__, t)) for t, i in spec["model"]["vocab"].items()}
    return tokens | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def _classes() -> np.ndarray:
    """The class of each code point, as the tokenizer's own pattern engine has it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    def marked(pattern: str, points: np.ndarray) -> np.ndarray:
        split, found = Split(Regex(pattern), "removed", invert=True), np.zeros(len(points), bool)
        for at in range(0, len(points), 4096):  # short strings, or each place in them costs more
            for _, (start, stop) in split.pre_tokenize_str("".join(map(chr, points[at : at + 4096].tolist()))):
                found[at + start : at + stop] = True
        return found

    points, table = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]), np.zeros(0x110000, np.uint8)
    points = points[marked(r"[\p{L}\p{N}\s]+", points)]  # the few that any class has
    for number, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        table[points[marked(pattern, points)]] = number
    return table


class ForcedBoundaryEncoder:
    """Whole texts to ids, fragment by fragment.

    A pair of bytes that stands inside no token of the vocabulary can't be merged across, so
    between the two the text is surely cut, and the merges on either side don't bear on each
    other. Pre-tokens and added tokens end fragments too. The fragments between the cuts are
    encoded by the tokenizer's own merges, each distinct one once, and their ids are put in a
    row. Many fragments go in one call, parted by a byte that forms such a pair with every other.
    """

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        spec = _spec(tokenizer_json)
        empty = dict.fromkeys(("truncation", "padding", "normalizer", "pre_tokenizer", "post_processor", "decoder"))
        self.merger = Tokenizer.from_str(json.dumps(spec | empty | {"added_tokens": []}))
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile(b"|".join(map(re.escape, longest_first))) if self.added else None
        self.inside = inner_pairs(b for i, b in _token_bytes(spec).items() if b not in self.added)
        # bytes that no UTF-8 text holds and no token beside another byte
        parting = [b for b in (*range(0xF5, 0x100), 0xC0, 0xC1) if not (self.inside[b << 8 : (b + 1) << 8].any() or self.inside[b::256].any())]
        if not parting:
            raise ValueError("no byte is apart from all others in this vocabulary")
        characters = byte_characters()
        self.parting, self.parting_id = bytes(parting[:1]), spec["model"]["vocab"][characters[parting[0]]]
        self.shown = dict(enumerate(characters))
        self.classes = _classes()
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64)

    def begins(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each byte; ``starts`` are those where a text does.

        The pattern: contractions, runs of letters, numbers and other characters with a space
        before each, and runs of white space, of which the last one stands apart before a text.
        """
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        point = data[lead].astype(np.int32)
        wide = np.flatnonzero(point >= 0x80)
        at, head = lead[wide], point[wide]
        following = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int32) & 0x3F
        two = (head & 0x1F) << 6 | following(1)
        three = (head & 0x0F) << 12 | following(1) << 6 | following(2)
        four = (head & 0x07) << 18 | following(1) << 12 | following(2) << 6 | following(3)
        point[wide] = np.where(head < 0xE0, two, np.where(head < 0xF0, three, np.minimum(four, 0x10FFFF)))
        kind = self.classes[point]

        first = np.zeros(len(lead) + 1, bool)  # one more for what follows the last character
        first[np.searchsorted(lead, starts)] = True
        first[-1] = True
        space, begin = kind == SPACE, first.copy()
        begin[1:-1] |= kind[1:] != kind[:-1]
        begin[:-2] |= space[:-1] & ~space[1:] & ~first[1:-1]
        begin[1:-1] &= first[1:-1] | space[1:] | (point[:-1] != 0x20)
        quote = np.flatnonzero((point == 0x27) & begin[:-1])
        after = [np.where(quote + k < len(lead), point[np.minimum(quote + k, len(lead) - 1)], -1) for k in (1, 2)]
        within = ~first[np.minimum(quote + 1, len(lead))]
        for letters in CONTRACTIONS:
            size = len(letters)
            own = within & (after[0] == ord(letters[0]))
            if size == 2:
                own = own & (after[1] == ord(letters[1])) & ~first[np.minimum(quote + 2, len(lead))]
            begin[quote[own] + 1] = False
            begin[quote[own] + 1 + size] = True
        out = np.zeros(len(data) + 1, bool)
        out[lead[begin[:-1]]] = True
        out[-1] = True
        return out

    def fragments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Edges of the fragments of texts ``data[offsets[i]:offsets[i + 1]]``, and the ids of added tokens by where they begin."""
        starts, special = offsets[:-1][np.diff(offsets) > 0], {}
        if self.added_pattern is not None and self.added_pattern.search(data):
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for found in self.added_pattern.finditer(data, i, j):
                    special[found.start()] = (found.end(), self.added[found[0]])
            after = [stop for stop, _ in special.values() if stop < len(data)]
            starts = np.union1d(starts, np.array([*special, *after], np.int64))
        cut = self.begins(data, starts)
        cut[1:-1] |= ~self.inside[data[:-1].astype(np.uint16) << 8 | data[1:]]
        for start, (stop, _) in special.items():
            cut[start + 1 : stop] = False
        return np.flatnonzero(cut), {start: i for start, (_, i) in special.items()}

    def numbers(self, fragments: list[bytes]) -> np.ndarray:
        """The number of each of these distinct fragments among the known ones; new ones are encoded."""
        known = self.known
        found = np.fromiter(map(known.get, fragments, repeat(-1)), np.int64, len(fragments))
        fresh = np.flatnonzero(found < 0)
        new = [fragments[i] for i in fresh.tolist()]
        ids, lengths = [self.pool], [self.lengths]
        for at in range(0, len(new), JOINED * 16):
            groups = [new[i : i + JOINED] for i in range(at, min(at + JOINED * 16, len(new)), JOINED)]
            shown = [self.parting.join(g).decode("latin-1").translate(self.shown) for g in groups]
            for group, encoding in zip(groups, self.merger.encode_batch_fast(shown, add_special_tokens=False), strict=True):
                own = np.array(encoding.ids, np.uint32)
                parted = np.flatnonzero(own == self.parting_id)
                sizes = np.diff(np.concatenate([[-1], parted, [len(own)]])) - 1
                if len(sizes) != len(group):
                    raise AssertionError("a fragment was merged with its neighbour")
                ids.append(own[own != self.parting_id])
                lengths.append(sizes)
        found[fresh] = np.arange(len(known), len(known) + len(new))
        known.update(zip(new, found[fresh].tolist(), strict=True))
        self.pool, self.lengths = np.concatenate(ids), np.concatenate(lengths)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin and end."""
        if len(self.known) > REMEMBERED:
            self.forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        edges, special = self.fragments(data, offsets)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        numbers = self.numbers(coded.dictionary.to_pylist())
        order = numbers[coded.indices.to_numpy(zero_copy_only=False)]
        pool, lengths = self.pool, self.lengths
        if special:  # their ids come behind the fragments'
            own = np.unique([*special.values()])
            order[np.searchsorted(edges, [*special])] = len(lengths) + np.searchsorted(own, [*special.values()])
            pool, lengths = np.concatenate([pool, own.astype(np.uint32)]), np.concatenate([lengths, np.ones(len(own), np.int64)])
        ids, ends = gathered(pool, np.cumsum(lengths) - lengths, lengths, order)
        return ids, ends[np.searchsorted(edges, offsets)]


def inner_pairs(tokens: Iterator[bytes]) -> np.ndarray:
    """For each pair of bytes (the first one times 256, and the second) whether it stands inside any token."""
    inside = np.zeros(1 << 16, bool)
    for token in tokens:
        own = np.frombuffer(token, np.uint8).astype(np.int64)
        inside[own[:-1] << 8 | own[1:]] = True
    return inside


class Decoder:
    """Ids back to texts: the tokens' bytes in a row; ids without a token have none."""

    def __init__(self, tokenizer_json: str):
        tokens = _token_bytes(_spec(tokenizer_json))
        self.lengths = np.zeros(max(tokens) + 2, np.int64)  # the last one for ids without a token
        self.lengths[[*tokens]] = [len(b) for b in tokens.values()]
        self.pool = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """One text for each ``ids[offsets[i]:offsets[i + 1]]``; bytes that aren't UTF-8 become U+FFFD."""
        none = len(self.lengths) - 1
        data, edges = gathered(self.pool, self.begins, self.lengths, np.where((ids >= 0) & (ids < none), ids, none))
        own = edges[offsets]
        texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(own), pa.py_buffer(data)])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            texts = pa.array([data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)], pa.large_string())
        return texts


_kept: dict[tuple[str, int], ForcedBoundaryEncoder | Decoder] = {}


def worker(kind: type, tokenizer_json: str) -> ForcedBoundaryEncoder | Decoder:
    """The worker's encoder or decoder, kept between tasks; one of each kind at most."""
    key = (kind.__name__, zlib.crc32(tokenizer_json.encode()))
    if key not in _kept:
        for other in [k for k in _kept if k[0] == key[0]]:
            del _kept[other]
        _kept[key] = kind(tokenizer_json)
    return _kept[key]


def encode(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """``doc_id, ids`` per row of ``docs``: the ids of the whole text, in one pass without a shuffle.

    Null and empty texts have no ids; very long ones are taken whole; repeated rows give
    repeated results; other columns aren't read; an empty table stays empty. A string of an
    added token in a text is that token, as the tokenizer has it by default. The vocabulary
    file is broadcast, whose size is given.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker(ForcedBoundaryEncoder, shipped.value)
        for batch in slices(batches, "text", ENCODE_BYTES):
            ids, offsets = encoder.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(bounded).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def decode(tokens: DataFrame, tokenizer_json: str) -> DataFrame:
    """``doc_id, text`` per row of ``tokens(doc_id, ids)``; null ids are a null text, ids without a token are left out."""
    shipped = tokens.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker(Decoder, shipped.value)
        for batch in batches:
            column = batch.column("ids")
            texts = decoder.decode(*_lists(pc.fill_null(column, pa.scalar([], column.type)) if column.null_count else column))
            texts = pc.if_else(column.is_valid(), texts, None).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").transform(bounded).mapInArrow(run, f"doc_id {kind}, text string")


def report(tokens: DataFrame, tokenizer_json: str) -> DataFrame:
    """Per row of ``encode``: the number of ids, and SHA-256 of the ids and of the text decoded from them."""
    shipped = tokens.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker(Decoder, shipped.value)
        for batch in batches:
            ids, offsets = _lists(batch.column("ids"))
            texts, little = decoder.decode(ids, offsets), ids.astype("<u4")
            spans = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
            own = [hashlib.sha256(little[i:j]).hexdigest() for i, j in spans]
            back = [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts.cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(own, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.transform(bounded).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
