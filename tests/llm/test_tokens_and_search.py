import json
import random
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import DOCS, odd_documents, with_clashing_columns  # noqa: E402

from tessera.llm import piece_counts, queries, token_files, topk  # noqa: E402

JSON = queries.tokenizer_json()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(JSON)  # as it is loaded, without a switch


def odd_texts():
    draw = random.Random(4)
    alphabet = [" ", " ", "a", "b", "É", "ß", "1", ".", "'", "\n", "\t", " ", "\x85", "　", "日", "s", "t", "-", "<|endoftext|>", "Ж", "🙂", "\x1c", "×"]
    return ["", " ", "a", " a", "a ", "a  b", "it's we'll I'd", "x<|endoftext|> y"] + ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 40))) for _ in range(1500)]


def test_ids_equal_the_tokenizer(tokenizer):
    texts = odd_texts()
    encoder = token_files.Encoder(JSON)
    for _ in range(2):
        ids, offsets = encoder.encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_words_that_meet_at_marks_and_line_breaks_are_encoded_once(tokenizer):
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ar", "ot", "ing", "est")]
    text = " ".join(f"{v}.\n{w}***" for v in words for w in words)
    encoder = token_files.Encoder(JSON)
    ids, offsets = encoder.encode(pa.array([text, None, text]))
    wanted = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert ids.tolist() == [*wanted, 0, *wanted] and offsets.tolist() == [0, len(wanted), len(wanted) + 1, 2 * len(wanted) + 1]
    assert len(encoder.known) < 5 * len(words)  # not one for each of the 1,600 pairs


def test_files_round_trip(spark, rows, tokenizer):
    data = odd_documents()
    tokens = token_files.write_tokens(with_clashing_columns(rows(data, DOCS)).repartition(3), JSON)
    found = token_files.report(tokens).orderBy("start").collect()
    at = 0
    wanted = {}
    for d in data:
        ids = [*tokenizer.encode(d[1] or "", add_special_tokens=False).ids, 0]
        wanted.setdefault(d[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r.doc_id for r in found] == sorted((d[0] for d in data), key=lambda i: -1 if i is None else i)
    for r in found:
        assert r.start == at
        at += r.n_tokens
        wanted[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(wanted.values())
    files = [f for f in tokens.inputFiles()]
    meta = pq.ParquetFile(files[0].removeprefix("file://")).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    ids = columns["ids.list.element"]
    assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(ids.encodings) and ids.has_offset_index and ids.has_column_index
    read = tokens.select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in read.split("ReadSchema")[1]


def test_no_documents_no_tokens(rows):
    tokens = token_files.write_tokens(rows([], DOCS), JSON)
    assert token_files.report(tokens).count() == 0


PIECES = ["▁", "▁a", "▁ab", "▁abcd", "b", "bc", "bcd", "cde", "d", "e", "▁x", "yyyy", "é"]


def test_counts_equal_trying_all_pieces():
    automaton, known, draw = piece_counts.PieceAutomaton(PIECES), set(PIECES), random.Random(5)
    for _ in range(3000):
        word = "▁" + "".join(draw.choice("abcdexyé漢🙂") for _ in range(draw.randint(0, 12)))
        assert automaton.count(word) == piece_counts.greedy_count(word, known), word


def test_counts_with_the_real_vocabulary(rows):
    pieces = piece_counts.load_pieces(queries.tokenizer_path("piece_bpe_32k.model"))
    known = set(pieces)
    data = [d for d in odd_documents() if d[0] not in (8, 9)] + [(8, "word " * 20000, None, None, 0)]
    found = piece_counts.count_tokens(with_clashing_columns(rows(data, DOCS)), pieces).collect()
    wanted = [(d[0], len((d[1] or "").split()), sum(piece_counts.greedy_count("▁" + w, known) for w in (d[1] or "").split())) for d in data]
    assert sorted(str(tuple(r)) for r in found) == sorted(map(str, wanted))
    assert piece_counts.count_tokens(rows([], DOCS), pieces).count() == 0


def test_one_endless_word(rows):
    automaton = piece_counts.PieceAutomaton(["▁a", "aa", "a"])
    assert automaton.count("▁" + "a" * 200_001) == 1 + 100_000


def plain_top(data, k=5, every=50):
    vectors = []
    for i, v, _ in data:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        vectors.append((i, [int(np.floor(256 * float(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for row, (q, terms) in enumerate(vectors):
        if q % every == 0:
            ranked = sorted((-dot(terms, other), c) for n, (c, other) in enumerate(vectors) if n != row)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(256, 16, 256, 128, 16), (7, 2, 3, 3, 2)])
def test_top_k_by_brute_force(rows, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "PAGE", "SHEET", "CHUNK", "TOGETHER"), sizes, strict=True):
        monkeypatch.setattr(topk, name, value)
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(5, 8))
    data = [(i, [float(np.float32(x)) for x in centres[i % 5] + 0.2 * draw.normal(size=8)], 0) for i in range(400)]
    data += [(1000 + i, data[0][1], 0) for i in range(9)] + [(1050, None, 0), (1100, [1.0, None], 0), (1150, [float("nan")], 0), (1200, [float("inf")], 0), (None, [1.0], 0)]
    data += [(1250, [0.5, -0.5], 0), (1300, [], 0), (7, [9.0] * 8, 0), (50, data[3][1], 0), (50, data[3][1], 0), (7, [9.0] * 8, 0)]
    vectors = rows(data, "vec_id bigint, embedding array<float>, label int").withColumn("score", F.lit("clash")).withColumn("block", F.lit("clash"))
    found = sorted(tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect())
    assert found == plain_top(data)


def test_repeated_ids_as_the_sql_has_them(rows, tmp_path):
    """All rows are candidates, and those that share an id too."""
    data = [(0, [1.0, 2.0], 0), (1, [3.0, 0.5], 0), (1, [1.0, 1.0], 0), (2, [0.25, 4.0], 0), (3, [-1.0, 1.0], 0), (50, [2.0, 2.0], 0), (50, [1.5, 0.0], 0)]
    rows(data, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = queries.QUERIES["op6_top_k"](rows([], "a int").sparkSession, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(connection.sql(topk.ORACLE).fetchall()) == plain_top(data)


def test_few_candidates(rows):
    schema = "vec_id bigint, embedding array<float>, label int"
    few = rows([(0, [1.0], 0), (3, [1.0], 0), (2, [1.0], 0)], schema)
    assert sorted((r.rank, r.vec_id) for r in topk.top_k(few, F.col("vec_id") % 50 == 0).collect()) == [(1, 2), (2, 3)]
    assert topk.top_k(rows([], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(rows([(50, [1.0], 0)], schema), F.col("vec_id") % 50 == 0).count() == 0


def test_large_components_stay_exact(rows):
    data = [(0, [1e7, 3.0], 0), (1, [1e7, 5.0], 0), (2, [-1e7, 7.0], 0)]
    found = [tuple(r) for r in topk.top_k(rows(data, "vec_id bigint, embedding array<double>, label int"), F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert found == plain_top(data)


def test_bounds_hold():
    draw = np.random.default_rng(2)
    queries_, block = draw.integers(-300, 300, (20, 6)), draw.integers(-300, 300, (50, 6))
    limit = topk.bounds(queries_, block.max(axis=0)[None], block.min(axis=0)[None])[:, 0]
    assert (limit >= topk.products(queries_, block).max(axis=1)).all()


def test_pipeline_on_odd_documents(spark, rows, tmp_path):
    import corpus_pipeline

    data = odd_documents() + [(700 + i, "The benchmark passage with seven more words in it goes here now. " + f"Tail {i}.", "en", "s1", 1) for i in range(3)]
    rows(data, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    rows([(1, "benchmark passage with seven more words in it")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = rows(data, DOCS)
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        counts.append(docs.count())
    assert counts[0] < len(data) and counts[1] < counts[0] and not docs.filter("doc_id >= 700").count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == counts[-1]
    assert json.loads(json.dumps(last.columns)) == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_keep_columns_of_any_name(spark, rows, tmp_path):
    import corpus_pipeline

    rows([(1, "benchmark passage with seven more words in it")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = with_clashing_columns(rows(odd_documents(), DOCS))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.filter("__size = 'clash' and __id = 'clash' and c7 = 'clash'").count() == kept.count() > 0, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_added_tokens_are_their_own_ids(spark, rows, tokenizer):
    data = [(1, "a b", "en", "a", 3), (2, "x<|endoftext|> y", "en", "a", 16), (3, "c", "en", "a", 1)]
    found = token_files.report(token_files.write_tokens(rows(data, DOCS), JSON)).orderBy("start").collect()
    wanted = [[*tokenizer.encode(d[1], add_special_tokens=False).ids, 0] for d in data]
    assert wanted[1] == [87, 50256, 331, 0]
    assert [(r.n_tokens, r.ids_crc32) for r in found] == [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in wanted]
    assert [r.start for r in found] == [0, len(wanted[0]), len(wanted[0]) + 4]
