import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup, nearness


def walked(vectors, threshold, anchors=()):
    """Ids that a pass in id order keeps; what can't be compared stays."""
    kept, odd = [], []
    length = lambda v: max(np.linalg.norm(v), 1e-300)
    before = [np.array(v) / length(v) for _, v in anchors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in sorted(vectors, key=lambda row: row[0]):
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            odd.append(i)
            continue
        unit = np.array(v) / length(v)
        if all(unit @ other < threshold for other in before):
            kept.append(i)
            before.append(unit)
    return sorted(kept + odd)


def test_chain_keeps_both_ends(rows):
    angles = [0.0, 0.3, 0.6]
    data = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)]
    kept = dedup.first_by_similarity(rows(data, "id bigint, vector array<double>"), np.cos(0.35))
    assert sorted(r.id for r in kept.collect()) == [0, 2]


def test_greedy_equals_a_walk(rows):
    draw = np.random.default_rng(5)
    data = [(i, [float(x) for x in draw.normal(size=3)]) for i in range(120)]
    data += [(200 + i, data[i][1]) for i in range(10)]
    for threshold in (0.7, 0.9):
        kept = dedup.first_by_similarity(rows(data, "id bigint, vector array<double>"), threshold)
        assert sorted(r.id for r in kept.collect()) == walked(data, threshold)


def test_pairs_over_many_blocks(rows):
    draw = np.random.default_rng(6)
    data = [(i, [float(x) for x in draw.normal(size=3)]) for i in range(60)]
    frame = rows(data, "id bigint, vector array<double>")
    found = {(r.a, r.b) for r in dedup.near_pairs(frame, 0.8, block_rows=7).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in data}
    assert found == {(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.8}


def test_anchors_drop_new_rows(rows):
    anchors = rows([(0, [1.0, 0.0])], "id bigint, vector array<double>")
    new = rows([(5, [2.0, 0.01]), (6, [0.0, 1.0])], "id bigint, vector array<double>")
    assert [r.id for r in dedup.first_by_similarity(new, 0.95, anchors).collect()] == [6]


def test_first_occurrence_stays(rows):
    data = [(3, 0, "x"), (1, 1, "x"), (1, 0, "y"), (2, 0, None), (4, 0, None)]
    kept = dedup.first_by_content(rows(data, "d int, i int, t string"), "t", ["d", "i"])
    assert sorted((r.d, r.i) for r in kept.collect()) == [(1, 0), (1, 1), (2, 0)]


def test_change_status(rows):
    schema = "source string, file_hash string, file_modified timestamp"
    now = rows([("a", "1", None), ("b", "2", None), ("c", "3", None), ("d", None, None)], schema)
    old = rows([("a", "1", None), ("b", "x", None), ("d", "4", None), ("e", "5", None)], schema)
    found = {r.source: r.status for r in dedup.change_status(now, old).collect()}
    assert found == {"a": "unchanged", "b": "changed", "c": "new", "d": "unreadable"}
    assert [r.source for r in dedup.without_sources(old, now.filter(F.col("source") != "a")).collect()] == ["a", "e"]


def test_long_chains_settle(rows):
    """A chain of 1,000 ids, each near only the next: every other one stays."""
    pairs = rows([(i, i + 1) for i in range(999)], "a bigint, b bigint")
    ids = rows([(i,) for i in range(1000)], "id bigint")
    assert sorted(r.id for r in dedup.greedy_kept(ids, pairs).collect()) == list(range(0, 1000, 2))


def test_walks_in_many_tasks_and_ranges(rows):
    draw = np.random.default_rng(9)
    links = {tuple(sorted(p)) for p in draw.integers(0, 60, (70, 2)).tolist() if p[0] != p[1]}
    links |= {(100 + i, 101 + i) for i in range(25)} | {(200, 201), (202, 203), (203, 204)}
    dropped = set()
    for a, b in sorted(links, key=lambda p: (p[1], p[0])):
        if a not in dropped:
            dropped.add(b)
    kept = dedup.greedy_kept(rows([(i,) for i in range(210)], "id bigint"), rows(sorted(links), "a bigint, b bigint"), held=20)
    assert sorted(r.id for r in kept.collect()) == [i for i in range(210) if i not in dropped]


def test_pruned_blocks_lose_no_pair(rows):
    draw = np.random.default_rng(12)
    centres = draw.normal(size=(6, 5))
    data = [(i, [float(x) for x in centres[i % 6] + 0.15 * draw.normal(size=5)]) for i in range(150)] + [(900, [0.0] * 5)]
    frame = rows(data, "id bigint, vector array<double>")
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-9) for i, v in data}
    for threshold in (0.97, 0.5, -0.2):
        found = {(r.a, r.b) for r in dedup.near_pairs(frame, threshold, block_rows=8, sheet_blocks=4).collect()}
        assert found == {(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= threshold}


SCHEMA = "id bigint, vector array<double>"


def odd_vectors(seed, n, width=3):
    draw = np.random.default_rng(seed)
    data = [(i, [float(x) for x in draw.normal(size=width)]) for i in range(n)]
    data += [(300 + i, data[i][1]) for i in range(5)]
    return data + [(401, None), (402, [None, 1.0, 0.0]), (403, [float("nan"), 1.0, 0.0]), (404, [float("inf"), 0.0, 0.0]), (405, [0.0] * width), (406, [0.0] * width), (407, [])]


def test_vectors_that_cannot_be_compared_stay(rows):
    data = [(1, [1.0, 0.0]), (2, [None, 1.0]), (3, [1.0, 0.01]), (4, None), (5, [float("nan"), 1.0]), (6, [0.0, 0.0])]
    kept = dedup.first_by_similarity(rows(data, SCHEMA), 0.95)
    assert sorted(r.id for r in kept.collect()) == [1, 2, 4, 5, 6]
    assert [(r.a, r.b) for r in dedup.near_pairs(rows(data, SCHEMA), 0.95).collect()] == [(1, 3)]
    assert dedup.first_by_similarity(rows([], SCHEMA), 0.95).count() == 0
    assert [r.id for r in dedup.first_by_similarity(rows([(7, None)], SCHEMA), 0.95).collect()] == [7]


def test_lengths_have_to_agree(rows):
    with pytest.raises(ValueError, match="1 to 2 components"):
        dedup.near_pairs(rows([(1, [1.0]), (2, [1.0, 0.0])], SCHEMA), 0.5)


def test_anchors_of_any_id_come_first(rows):
    data = [d for d in odd_vectors(3, 80) if d[0] != 407]
    anchors = [(i, v) for i, v in data if i % 3 == 1 or i in (401, 402)] + [(900, data[0][1]), (901, data[0][1])]
    new = [d for d in data if d not in anchors]
    found = dedup.first_by_similarity(rows(new, SCHEMA), 0.9, rows(anchors, SCHEMA))
    assert sorted(r.id for r in found.collect()) == walked(new, 0.9, anchors)
    assert sorted(r.id for r in dedup.first_by_similarity(rows(new, SCHEMA), 0.9, rows([], SCHEMA)).collect()) == walked(new, 0.9)


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_crowds_settle_without_their_links(rows, rounds):
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(4, 4))
    data = [(int(i), [float(x) for x in centres[i % 4] + (0.02 if i % 3 else 0.4) * draw.normal(size=4)]) for i in draw.permutation(400)]
    found = dedup.first_by_similarity(rows(data, SCHEMA), 0.97, most=50, rounds=rounds)
    assert sorted(r.id for r in found.collect()) == walked(data, 0.97)


def test_blocks_of_keys_and_stored_anchors(rows):
    data = [d for d in odd_vectors(4, 100) if d[0] < 400]
    frame = rows([(i, v, i % 3) for i, v in data], SCHEMA + ", part bigint")
    unit = nearness.unit_vectors(frame, "part")
    blocks = nearness.blocks_of(unit, nearness.pivots_of(unit), 7, ("part",))
    held = [(r.part, np.frombuffer(r.ids, np.int64).tolist()) for r in blocks.table.collect()]
    assert sorted(i for _, ids in held for i in ids) == sorted(i for i, _ in data)
    assert all(i % 3 == part for part, ids in held for i in ids) and all(len(ids) <= 7 for _, ids in held)
    draw = np.random.default_rng(5)
    new = [(1000 + i, [float(x) for x in draw.normal(size=3)]) for i in range(50)]
    assert sorted(r.id for r in dedup.first_by_similarity(rows(new, SCHEMA), 0.9, blocks).collect()) == walked(new, 0.9, data)


def test_normalised_sums_a_vector_once(spark, rows):
    """Unit vectors of 2,000 components: the length is bound once a vector, so the time doesn't grow with the square of the components."""
    import time

    frame = rows([(i,) for i in range(40)], "id bigint").select("id", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda x: (x + F.col("id")).cast("double")).alias("vector")).repartition(1).cache()
    frame.count()
    began = time.monotonic()
    first = frame.select(dedup.normalised(F.col("vector")).alias("v"), "vector").collect()[0]
    assert time.monotonic() - began < 4
    length = math.fsum(x * x for x in first.vector) ** 0.5
    assert all(abs(a - b / length) < 1e-12 for a, b in zip(first.v, first.vector, strict=True))
    assert rows([([0.0, 0.0],), (None,)], "v array<double>").select(dedup.normalised(F.col("v")).alias("v")).collect()[0].v == [0.0, 0.0]


def test_blocks_go_to_tiles_not_to_pairs(spark, rows, monkeypatch):
    """64 blocks that all meet are 2,080 pairs; in tiles of 16 by 16 blocks each goes to its few tiles once."""
    monkeypatch.setattr(nearness, "SIDES", 4, raising=False)
    draw = np.random.default_rng(8)
    frame = rows([(i, draw.normal(size=6).tolist()) for i in range(512)], "id bigint, vector array<double>").repartition(1)
    unit = nearness.unit_vectors(frame)
    blocks = nearness.blocks_of(unit, nearness.pivots_of(unit), block_rows=8)
    assert blocks.table.count() >= 64
    assert nearness._met(blocks, None, 0.0, 512).count() < 600
    found = {(r.a, r.b) for r in nearness.links(blocks, 0.3).collect()}
    v = np.array([r.v for r in unit.orderBy("id").collect()])
    assert found == {(i, j) for i, j in zip(*np.nonzero(np.triu(v @ v.T >= 0.3, 1)), strict=True)}
