import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import DOCS, odd_documents, with_clashing_columns  # noqa: E402

from tessera.llm import forced_bpe, queries  # noqa: E402

JSON = queries.tokenizer_json()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_str(JSON)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@pytest.fixture(scope="module")
def encoder():
    return forced_bpe.ForcedBoundaryEncoder(JSON)


def odd_texts(seed, n):
    draw = random.Random(seed)
    marks = [" ", " ", "'", "s", "t", "re", "ve", "ll", "d", "m", "\n", "\t", "\r\n", " ", "\x85", "　", " ", "\x1c", "​", "�", "<|endoftext|>", "<|endoftext", "\0"]
    signs = ["a", "b", "Z", "É", "ß", "1", "²", "½", "Ⅷ", ".", "!!", "-", "_", "日本", "🙂", "👩‍👩‍👧", "Ж", "ا", "क्ष", "́", "x", "\U0010ffff", "�", "٣", "᠎"]
    return ["".join(draw.choice(draw.choice((marks, signs))) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def test_ids_equal_the_tokenizer(tokenizer, encoder):
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "'s", "''s", " 's", "x's's'tx", "I'd we'll 'Re", "\n's\n'", "<|endoftext|>", " <|endoftext|> x", "<|endoftext|><|endoftext|>"]
    texts += odd_texts(1, 6000)
    for _ in range(2):  # the second time all fragments are known
        ids, offsets = encoder.encode(pa.array([None, *texts, None]))
        assert offsets[1] == 0
        for i, text in enumerate(texts, 1):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        assert offsets[-1] == offsets[-2] == len(ids)


def test_every_character_between_letters_and_spaces(tokenizer, encoder):
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for shape in ("a{}b", "1 {}  {}"):
        texts = ["".join(shape.replace("{}", chr(c)) for c in points[i : i + 500]) for i in range(0, len(points), 500)]
        ids, offsets = encoder.encode(pa.array(texts))
        wanted = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[i:j].tolist() for i, j in zip(offsets[:-1], offsets[1:], strict=True)] == wanted


def test_cuts_are_where_no_token_reaches(encoder):
    tokens = forced_bpe._token_bytes(forced_bpe._spec(JSON))
    inside = {t[i : i + 2] for n, t in tokens.items() if n != 50256 for i in range(len(t) - 1)}
    assert {bytes(divmod(int(p), 256)) for p in np.flatnonzero(encoder.inside)} == inside
    data = np.frombuffer("qzqzjqxqzk".encode(), np.uint8)  # one pre-token
    edges, _ = encoder.fragments(data, np.array([0, len(data)]))
    assert edges.tolist() == [0, *(i for i in range(1, len(data)) if data[i - 1 : i + 1].tobytes() not in inside), len(data)]


def test_slices_of_an_array_and_forgetting(tokenizer, encoder, monkeypatch):
    texts = pa.array(odd_texts(2, 50))
    monkeypatch.setattr(forced_bpe, "REMEMBERED", 10)
    ids, offsets = encoder.encode(texts.slice(20, 20))
    assert [ids[i:j].tolist() for i, j in zip(offsets[:-1], offsets[1:], strict=True)] == [tokenizer.encode(t.as_py(), add_special_tokens=False).ids for t in texts.slice(20, 20)]


def test_decoding_any_ids(tokenizer):
    decoder, draw = forced_bpe.Decoder(JSON), np.random.default_rng(3)
    lists = [draw.integers(0, 50270, draw.integers(0, 30)) for _ in range(3000)] + [draw.integers(0, 256, 20) for _ in range(2000)] + [np.array([50256, 3, 50256]), np.array([60000])]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    found = decoder.decode(np.concatenate(lists), offsets).to_pylist()
    assert found == [tokenizer.decode(x.tolist(), skip_special_tokens=False) for x in lists]


def plain(tokenizer, rows):
    out = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=str)


def test_documents_round_trip(spark, rows, tokenizer):
    data = odd_documents() + [(2000 + i, t, None, None, 0) for i, t in enumerate(odd_texts(4, 100))]
    docs = with_clashing_columns(rows(data, DOCS)).repartition(3)
    tokens = forced_bpe.encode(docs, JSON)
    assert sorted(map(tuple, forced_bpe.report(tokens, JSON).collect()), key=str) == plain(tokenizer, [d[:2] for d in data])
    assert sorted(map(tuple, forced_bpe.decode(tokens, JSON).collect()), key=str) == sorted(((d[0], d[1] or "") for d in data), key=str)
    assert forced_bpe.report(forced_bpe.encode(rows([], DOCS), JSON), JSON).count() == 0
    odd = rows([(1, None), (2, []), (3, [70000, -1, 64])], "doc_id bigint, ids array<int>")
    assert sorted(map(tuple, forced_bpe.decode(odd, JSON).collect())) == [(1, None), (2, ""), (3, "a")]


def test_registered_query(spark, tokenizer):
    found = queries.QUERIES["op12_bpe_round_trip"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(tokenizer, docs)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        forced_bpe.ForcedBoundaryEncoder(JSON.replace('"add_prefix_space": false', '"add_prefix_space": true').replace('"add_prefix_space":false', '"add_prefix_space":true'))
