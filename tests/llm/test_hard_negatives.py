import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from tessera.llm import hard_negatives, queries  # noqa: E402

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(data, every=50):
    fit = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in data if i is not None and label is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v)]
    out = []
    for row, (a, terms, label) in enumerate(fit):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(terms, t, strict=False)), i, other) for n, (i, t, other) in enumerate(fit) if n != row)
        for minus, positive, _ in [s for s in scored if s[2] == label][:5]:
            fitting = [(-m, i) for m, i, other in scored if other != label and 50 * -minus <= 100 * -m <= 95 * -minus]
            out += [(a, positive, rank + 1, i, -minus, score) for rank, (score, i) in enumerate(fitting[:3])]
    return sorted(out)


def odd_vectors(n=500, width=8, labels=4):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(5, width))
    data = [(i, [float(np.float32(x)) for x in centres[i % 5] * draw.uniform(0.4, 1.2) + 0.3 * draw.normal(size=width)], int(draw.integers(0, labels))) for i in range(n)]
    common = data[3][1]
    data += [(2000 + i, common, i % 3) for i in range(60)]  # many copies, anchors among them
    data += [(3000, None, 1), (3050, [1.0, None], 1), (3100, [float("nan")], 1), (3150, [float("inf")], 1), (None, [1.0], 1), (3200, [1.0] * width, None)]
    data += [(3250, [0.5, -0.5], 2), (3300, [], 2), (3350, [0.0] * width, 0), (3400, [1.0] * width, 77), (7, data[8][1], 1), (50, data[3][1], 2), (50, data[3][1], 2)]
    return data


@pytest.mark.parametrize("sizes", [(256, 8, 256, 128, 16), (9, 2, 3, 4, 2)])
def test_negatives_by_brute_force(rows, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "PAGE", "SHEET", "CHUNK", "TOGETHER"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    data = odd_vectors()
    vectors = rows(data, SCHEMA).repartition(3)
    for name in ("row", "block", "page", "cell", "near", "chunk", "rank", "score", "position", "_id", "low", "terms"):
        vectors = vectors.withColumn(name, F.lit("clash"))
    found = sorted(map(tuple, hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0).collect()))
    assert found == plain(data) and len(found) > 50


def test_query_against_sql(spark, rows, tmp_path):
    data = [d for d in odd_vectors(300, 64, 10)]
    rows(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = sorted(map(tuple, queries.QUERIES["op11_hard_negatives"](spark, str(tmp_path)).collect()))
    assert found == sorted(connection.sql(hard_negatives.ORACLE).fetchall()) == plain([(i, v, (label + 1) % 10 if i is not None and label is not None and i % 7 == 0 else label) for i, v, label in data])


def test_few_rows(rows):
    run = lambda data: sorted(map(tuple, hard_negatives.mine(rows(data, SCHEMA), F.col("vec_id") % 50 == 0).collect()))
    assert run([]) == run([(50, [1.0], 1)]) == run([(1, [1.0], 1), (2, [1.0], 2)]) == []
    data = [(0, [2.0], 1), (1, [2.0], 1), (2, [1.5], 2), (3, [1.5], 3), (4, [1.0], 2), (5, [0.9], 2), (6, [1.9], 2), (7, [1.95], 4)]
    assert run(data) == plain(data)
    negative = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.6], 2), (50, [0.0], 1)]
    assert run(negative) == plain(negative)


@pytest.mark.parametrize("width", [1, 5, 64, 100])
def test_intervals_hold(width):
    draw = np.random.default_rng(width)
    for scale in (1, 300, 2**30):
        block = np.floor(scale * (draw.normal(size=(70, width)) + 2 * draw.normal(size=width))).astype(np.int64)
        block[:3] = block[3]
        asked = np.concatenate([block[:5], np.floor(scale * draw.normal(size=(30, width))).astype(np.int64), np.zeros((1, width), np.int64)])
        turn = hard_negatives.rotation(width)
        codes = hard_negatives.Codes(block, turn)
        codes = hard_negatives.Codes.unpacked(codes.packed(), 70, width)
        anchors = hard_negatives.Asked(asked, turn)
        least, most = anchors.intervals(np.arange(len(asked)), codes)
        exact = asked.astype(object) @ block.T.astype(object)
        assert (least <= exact).all() and (exact <= most).all()
        least, most = anchors.around(codes.centre[None], np.array([codes.norm.max()]))
        assert (least <= exact).all() and (exact <= most).all()


def test_products_beyond_64_bits_are_refused(rows):
    data = [(i, [1e17, 1.0], i % 2) for i in range(0, 200, 25)]
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(rows(data, SCHEMA), F.col("vec_id") % 50 == 0).collect()


def test_shares_are_whole():
    scores = np.array([-1001, -100, -3, 0, 1, 19, 20, 12345])
    assert hard_negatives._share(scores, 95).tolist() == [95 * int(s) // 100 for s in scores]
    assert (-hard_negatives._share(-scores, 50)).tolist() == [-(-50 * int(s) // 100) for s in scores]
