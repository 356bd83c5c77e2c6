"""Stored postings against the search over texts."""

import numpy as np
import pytest

from tessera.operators import bm25, postings
from tessera.sources import tables

SCHEMA = "id bigint, text string, source string"


def made(count, first=0):
    draw = np.random.default_rng(count + first)
    words = [f"w{int(w)}" for w in np.minimum(draw.zipf(1.3, size=400 * count), 300)]
    out, at = [], 0
    for i in range(first, first + count):
        n = int(draw.integers(0, 40)) if i % 50 else 400
        out.append((i, " ".join(words[at : at + n]) if i % 17 else None, f"src{i % 5} w{i % 3}"))
        at += n
    return out


def found(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


@pytest.fixture
def asked(rows):
    return rows([(i, f"w{i} w{i * 7 % 300} w1 w1 src3") for i in range(60)] + [(90, "nothing"), (91, ""), (92, None)], "query_id bigint, query string")


@pytest.mark.parametrize("fields", ["text", ["text", "source"]])
def test_segments_give_what_texts_give(spark, rows, asked, tmp_path, monkeypatch, fields):
    monkeypatch.setattr(postings, "BLOCK", 16)
    docs, path = made(600), str(tmp_path / "p")
    for at in (0, 150, 350):
        postings.append(rows(docs[at : {0: 150, 150: 350, 350: 600}[at]], SCHEMA).repartition(3), path, fields)
    want = found(bm25.search(rows(docs, SCHEMA), asked, 5, fields))
    assert found(postings.search(spark, path, asked, 5)) == want
    frequencies = {(r.field, r.term): (r.df, r.total) for r in postings.term_statistics(spark, path).collect()}
    assert frequencies[(0, "w1")][0] == sum("w1" in (t or "").split() for _, t, _ in docs)
    assert frequencies[(0, "w1")][1] == sum((t or "").split().count("w1") for _, t, _ in docs)
    monkeypatch.setattr(postings, "BLOCK", 64)
    postings.compact(spark, path)
    assert found(postings.search(spark, path, asked, 5)) == want
    assert {(r.field, r.term): (r.df, r.total) for r in postings.term_statistics(spark, path).collect()} == frequencies
    assert len(postings._state(spark, path)["segments"]) == 1
    # parts of a large batch of queries, and few hits at once
    monkeypatch.setattr(bm25, "ASKED", 50)
    monkeypatch.setattr(bm25, "CELLS", 100)
    assert found(postings.search(spark, path, asked, 5)) == want


def test_blocks_below_the_kth_score_are_left_out(monkeypatch):
    lists = [["a", "b", "a"], [], ["b"]]
    import pyarrow as pa

    block = postings._block(pa.array([7, 8, 9]), pa.array(lists, pa.list_(pa.string())), 1, 5).to_pylist()
    assert [(r["term"], r["n"], r["total"], r["max_tf"], r["min_dl"], r["ids"], r["tf"], r["dl"]) for r in block] == [
        ("a", 1, 2, 2, 3, [7], [2], [3]),
        ("b", 2, 2, 1, 1, [7, 9], [1, 1], [3, 1]),
        ("", 3, 4, 0, 0, [], [], []),
    ]
    empty = postings._block(pa.array([7]), pa.array([[]], pa.list_(pa.string())), 0, 5).to_pylist()
    assert [(r["term"], r["n"], r["total"]) for r in empty] == [("", 1, 0)]


def test_replay_other_fields_and_a_break(spark, rows, asked, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    assert postings.search(spark, path, asked).count() == 0
    assert postings.term_statistics(spark, path).count() == 0
    postings.append(rows([], SCHEMA), path)
    assert postings._state(spark, path)["version"] == 0
    postings.append(rows(made(40), SCHEMA), path, batch=("s", 0))
    before = found(postings.search(spark, path, asked))
    postings.append(rows(made(40), SCHEMA), path, batch=("s", 0))
    assert found(postings.search(spark, path, asked)) == before
    with pytest.raises(ValueError):
        postings.append(rows(made(40), SCHEMA), path, "source")

    def broken(*_):
        raise OSError("gone")

    with monkeypatch.context() as patched:
        patched.setattr(tables, "publish", broken)
        with pytest.raises(OSError):
            postings.append(rows(made(40, 40), SCHEMA), path, batch=("s", 1))
    assert found(postings.search(spark, path, asked)) == before
    postings.append(rows(made(40, 40), SCHEMA), path, batch=("s", 1))
    assert found(postings.search(spark, path, asked)) == found(bm25.search(rows(made(40) + made(40, 40), SCHEMA), asked))


def test_ids_that_are_words(spark, rows, tmp_path):
    path = str(tmp_path / "p")
    docs = rows([("b", "cat"), ("a", "cat"), ("c", "dog cat")], "id string, text string")
    postings.append(docs, path)
    queries = rows([("q", "cat dog")], "query_id string, query string")
    assert [r.id for r in postings.search(spark, path, queries).orderBy("rank").collect()] == ["c", "a", "b"]


def test_rows_go_through_the_shuffle_packed(spark, rows, monkeypatch):
    docs = rows(made(600), SCHEMA).repartition(2).persist()
    plain = postings._blocked(docs, ["text", "source"]).persist()
    few = []
    for size in (postings.PACKED_BYTES, 1):
        monkeypatch.setattr(postings, "PACKED_BYTES", size)
        packed = postings._packed(plain).persist()
        back = postings._unpacked(packed, plain)
        assert back.schema.simpleString() == plain.schema.simpleString()
        assert sorted(map(repr, back.collect())) == sorted(map(repr, plain.collect()))
        few.append(packed.count())
    # a row of the shuffle is a task's rows of a bucket, in fewer bytes than its ids alone
    assert few[0] <= 2 * postings.BUCKETS
    monkeypatch.setattr(postings, "PACKED_BYTES", 1 << 20)
    long = postings._blocked(rows([(i, " ".join(f"w{i * j % 5003}" for j in range(1, 400)), None) for i in range(2000)], SCHEMA).coalesce(1), ["text"])
    postings_bytes = sum(8 * r.n for r in long.select("n").collect())
    assert sum(len(r["rows"]) for r in postings._packed(long).collect()) < postings_bytes
    assert postings._unpacked(postings._packed(plain.limit(0)), plain).count() == 0
