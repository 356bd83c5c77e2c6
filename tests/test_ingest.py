import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.jobs import registry
from tessera.operators import dedup, embed
from tessera.sources import tables
from tessera.streaming import ingest

SCHEMA = "source string, text string, file_hash string"


def batch_of(rows, *entries):
    return rows(list(entries), SCHEMA).withColumn("file_modified", F.lit("2024-01-01").cast("timestamp"))


def small(spark, tmp_path):
    """An index of few buckets."""
    path = str(tmp_path / "index")
    tables.create(spark, path, buckets=3)
    return path


def state(spark, path):
    """All rows of the index and of its ledger, and the ids in its blocks."""
    now = tables.snapshot(spark, path)
    rows = sorted(map(str, now.table(spark, "chunks").collect()))
    ids = sorted(i for b in now.anchors(spark).table.select("ids").collect() for i in np.frombuffer(b.ids, np.int64).tolist())
    return rows, sorted(map(str, now.table(spark, "sources").collect())), ids


def files_of(now):
    return {f for held in now.folders.values() for folders in held.values() for f in folders}


def text_of(i, n=12):
    return " ".join(f"word{(i * 31 + j * j) % 997}" for j in range(n))


def test_replayed_batches_leave_the_index_as_it_is(spark, rows, tmp_path):
    path = small(spark, tmp_path)
    batches = [
        batch_of(rows, ("a", "the same text", "1"), ("b", "the same text", "2"), ("c", text_of(1), "3"), ("bad", None, None)),
        batch_of(rows, ("d", "the same text", "4"), ("c", text_of(2), "5"), ("a", "the same text", "1"), ("e", None, "6")),
    ]
    for number, batch in enumerate(batches):
        ingest.index_batch(spark, batch, path, number)
    first = state(spark, path)
    assert [r.source for r in tables.snapshot(spark, path).table(spark, "sources").orderBy("source").collect()] == ["a", "b", "c", "d", "e"]
    assert {r.source: r.chunk for r in tables.chunks(spark, path).collect()} == {"a": "the same text", "c": text_of(2)}
    assert first[2] == sorted(r.id for r in tables.chunks(spark, path).collect())
    for number in (0, 1, 0, 1, None):  # the last one without its number
        ingest.index_batch(spark, batches[number or 0] if number is not None else batches[1], path, number)
    assert state(spark, path) == first
    assert all(r.vector is not None for r in tables.chunks(spark, path).collect())
    measured = [(r.version, r.files, r.unreadable, r.sources, r.chunks, r.kept) for r in tables.runs(spark, path).orderBy("version").collect()]
    assert measured == [(1, 4, 1, 3, 2, 2), (2, 4, 0, 3, 2, 1)]


def test_a_change_writes_the_buckets_of_its_sources(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    ingest.index_batch(spark, batch_of(rows, *((f"s{i}", text_of(i), str(i)) for i in range(300))), path, threshold=None)
    before = tables.snapshot(spark, path)
    reader = before.table(spark, "chunks")
    old = reader.filter("source = 's7'").first().chunk
    after = ingest.index_batch(spark, batch_of(rows, ("s7", "new words", "x")), path)
    new = files_of(after) - files_of(before)
    assert len({f.rsplit("/", 1)[1] for f in new}) == 1 and len(new) == 3  # a bucket of chunks, sources and anchors
    assert reader.count() == 300 and reader.filter("source = 's7'").first().chunk == old  # a reader keeps what it has
    assert tables.chunks(spark, path).filter("source = 's7'").first().chunk == "new words" and tables.chunks(spark, path).count() == 300
    tables.remove_sources(spark, path, rows([("s8",), ("none",)], "source string"))
    assert tables.chunks(spark, path).count() == 299 == tables.snapshot(spark, path).table(spark, "sources").count()
    assert tables.snapshot(spark, path, before.version).table(spark, "chunks").count() == 300
    assert tables.vacuum(spark, path, 1) == 0  # each folder still has buckets that nobody has changed
    tables.clear(spark, path)
    assert tables.vacuum(spark, path, 1) == 3 and tables.chunks(spark, path).count() == 0


def test_a_change_that_breaks_off_loses_nothing(spark, rows, tmp_path, monkeypatch):
    path = small(spark, tmp_path)
    ingest.index_batch(spark, batch_of(rows, ("a", text_of(1), "1"), ("b", text_of(2), "2")), path, 0)
    whole = state(spark, path)
    changed = batch_of(rows, ("a", text_of(3), "9"), ("c", text_of(4), "4"))
    for step in ("_swap", "_write"):
        with monkeypatch.context() as patch:

            def broken(*args):
                raise OSError("killed")

            patch.setattr(tables, step, broken)
            with pytest.raises(OSError):
                ingest.index_batch(spark, changed, path, 1)
        assert state(spark, path) == whole
    ingest.index_batch(spark, changed, path, 1)
    assert {r.source: r.chunk for r in tables.chunks(spark, path).collect()} == {"a": text_of(3), "b": text_of(2), "c": text_of(4)}
    tables.vacuum(spark, path)
    assert tables.chunks(spark, path).count() == 3


def test_two_writers(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    before = tables.create(spark, path)
    tables.change(spark, before, batch=("x", 0))
    with pytest.raises(Exception, match="exists"):
        tables.change(spark, before, batch=("y", 0))
    assert tables.snapshot(spark, path).batches == {"x": 0}


def test_batches_equal_one_walk(spark, rows, tmp_path):
    """Near copies across batches are found; the order is the batches', then the ids'."""
    path = small(spark, tmp_path)
    draw = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(draw.choice(words, 30)) for _ in range(20)]
    entries = [(f"s{i}", texts[i % 20] if i < 40 else texts[i % 20].replace("w1 ", "w2 ", 1), str(i)) for i in range(60)]
    parts = [entries[i::3] for i in range(3)]
    for number, part in enumerate(parts):
        ingest.index_batch(spark, batch_of(rows, *part), path, number, threshold=0.9)
    kept = []
    seen = set()
    for part in parts:
        rank = {r.source: r.id for r in rows([(s,) for s, _, _ in part], "source string").select("source", F.xxhash64("source", F.lit(0)).alias("id")).collect()}
        fresh = []
        for s, t, _ in sorted(part):
            if t not in seen:
                seen.add(t)
                fresh.append((rank[s], s, t))
        vectors = {r.id: np.array(r.vector) for r in embed.hashed_embedding(rows([(i, t) for i, _, t in fresh], "id bigint, text string")).collect()}
        for i, s, _ in sorted(fresh):
            if all(vectors[i] @ v < 0.9 for _, v in kept):
                kept.append((s, vectors[i]))
    assert sorted(r.source for r in tables.chunks(spark, path).collect()) == sorted(s for s, _ in kept) and len(kept) < 40
    assert dedup.indexed_sources(tables.chunks(spark, path)).count() == len(kept)


def test_many_appends_are_gathered(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    monkeypatch.setattr(tables, "MOST_FOLDERS", 2)
    tables.create(spark, path, buckets=2)
    for i in range(4):
        ingest.index_batch(spark, batch_of(rows, (f"s{i}", text_of(i), "1"), (f"t{i}", text_of(i + 50), "1")), path, i)
    now = tables.snapshot(spark, path)
    assert max(len(f) for held in now.folders.values() for f in held.values()) <= 3
    assert now.table(spark, "chunks").count() == 8 == len(state(spark, path)[2])


def test_the_newest_of_a_source_counts(spark, rows, tmp_path):
    path = small(spark, tmp_path)
    both = batch_of(rows, ("a", "old", "1")).unionByName(rows([("a", "new", "0"), (None, "x", "1")], SCHEMA).withColumn("file_modified", F.lit("2024-02-01").cast("timestamp")))
    ingest.index_batch(spark, both, path)
    assert [(r.source, r.chunk) for r in tables.chunks(spark, path).collect()] == [("a", "new")]
    ingest.index_batch(spark, both.limit(0), path, 5)
    assert tables.snapshot(spark, path).batches == {"batches": 5}


def moved(spark):
    """Bytes that the stages so far have written to shuffles, and to files."""
    gateway, context = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    empty = gateway.jvm.java.util.ArrayList()
    stages = context.statusStore().stageList(empty, False, False, gateway.new_array(gateway.jvm.double, 0), empty)
    found = [stages.apply(i) for i in range(stages.size())]
    return np.array([sum(s.shuffleWriteBytes() for s in found), sum(s.outputBytes() for s in found)])


def test_texts_are_written_and_gathered_once(spark, rows, tmp_path, monkeypatch):
    """What a batch and a removal move is bounded by the texts, and the parts of a bucket give the same index."""
    monkeypatch.setattr(ingest, "GATHERED_BYTES", 1000, raising=False)
    draw = np.random.default_rng(5)
    texts = [" ".join(f"{x:x}" for x in draw.integers(0, 2**62, 6000)) for _ in range(20)]
    size = sum(map(len, texts))
    path = small(spark, tmp_path)
    batch = batch_of(rows, *((f"s{i}", t, str(i)) for i, t in enumerate(texts)), ("again", texts[3], "3"), ("none", None, "x"))
    start = moved(spark)
    ingest.index_batch(spark, batch, path, 0, threshold=None, window=(1200, 200))
    indexed = moved(spark)
    assert indexed[0] - start[0] < 1.5 * size and indexed[1] - start[1] < 2.5 * size
    stored = sorted((r.source, r.chunk_index, r.total_chunks, r.chunk) for r in tables.chunks(spark, path).collect())
    count = lambda t: -(-(len(t) - 1200) // 1000) + 1
    name = lambda i: "again" if i == 3 else f"s{i}"
    assert stored == sorted((name(i), k, count(t), t[k * 1000 : k * 1000 + 1200]) for i, t in enumerate(texts) for k in range(count(t)))
    made = embed.hashed_embedding(tables.chunks(spark, path).select("id", F.col("chunk").alias("text"))).withColumn("made", F.col("vector").cast("array<float>"))
    assert tables.chunks(spark, path).join(made.select("id", "made"), "id").filter("vector = made").count() == len(stored)
    indexed = moved(spark)
    tables.remove_sources(spark, path, rows([("s1",), ("s2",)], "source string"))
    assert moved(spark)[0] - indexed[0] < 0.5 * size  # chunks that stay are written by the tasks that read them
    assert sorted((r.source, r.chunk_index, r.total_chunks, r.chunk) for r in tables.chunks(spark, path).collect()) == [r for r in stored if r[0] not in ("s1", "s2")]


def test_rows_by_bitmap(spark, rows):
    batch = batch_of(rows, *((f"s{i % 700}", f"t{i}", f"{i:04d}") for i in range(1000)), ("bad", "t", None), (None, "t", "1")).repartition(3)
    numbered = ingest.numbered_rows(batch)
    last = ingest.last_of_each(numbered)
    assert {r.source: r.file_hash for r in last.collect()} == {f"s{i % 700}": f"{i:04d}" for i in range(1000)}
    for asked in (last, last.filter("file_hash % 3 = 0"), last.limit(0), numbered):
        wanted = sorted(r.text for r in numbered.join(asked.select("row"), "row", "left_semi").collect())
        assert sorted(r.text for r in ingest.rows_of(numbered, asked).collect()) == wanted


def test_sources_go_in_parts_and_small_files_are_gathered(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "GONE_SOURCES", 2, raising=False)
    monkeypatch.setattr(tables, "MOST_FOLDERS", 2)
    path = small(spark, tmp_path)
    ingest.index_batch(spark, batch_of(rows, *((f"s{i}", text_of(i), "1") for i in range(40))), path, threshold=None)
    for some in (range(5), range(5, 30)):  # fewer and more than two a bucket
        tables.remove_sources(spark, path, rows([(f"s{i}",) for i in some], "source string"))
    now = tables.snapshot(spark, path)
    assert {r.source for r in now.table(spark, "chunks").collect()} == {r.source for r in now.table(spark, "sources").collect()} == {f"s{i}" for i in range(30, 40)}
    for i in range(3):
        tables.append(spark, path, now.table(spark, "chunks").filter("source = 's30'"))
        tables.remove_sources(spark, path, rows([(f"s{31 + i}",)], "source string"))
    now = tables.snapshot(spark, path)
    assert now.table(spark, "chunks").filter("source = 's30'").count() == 4 and now.table(spark, "chunks").count() == 10
    assert len(now.table(spark, "chunks").inputFiles()) <= 3 * now.buckets


def test_files_of_the_changed_index_are_made_in_place(spark, monkeypatch):
    """The documents aren't joined with themselves, so their texts go through no shuffle on the way to the index."""
    plans = []
    monkeypatch.setattr(ingest, "index_batch", lambda spark, batch, *args, **how: plans.append(batch._jdf.queryExecution().optimizedPlan().toString()))
    registry._changed_index(spark, "/root/testdata/sf0.001")
    assert len(plans) == 5 and not any("Join" in p for p in plans)


def test_runs_count_a_batch_without_its_texts(spark, rows, tmp_path, monkeypatch):
    """What a batch counted is known from hashes and places; an unchanged, a repeated and an unreadable file count as files only."""
    path = small(spark, tmp_path)
    texts = [" ".join(f"{x:x}" for x in np.random.default_rng(i).integers(0, 2**62, 300)) for i in range(6)]
    ingest.index_batch(spark, batch_of(rows, *((f"s{i}", t, str(i)) for i, t in enumerate(texts))), path, 0, threshold=None, window=(1200, 200))
    start = moved(spark)
    later = batch_of(rows, *((f"s{i}", t, str(i)) for i, t in enumerate(texts)), ("s0", texts[1], "9"), ("new", texts[2], "n"), ("bad", None, None))
    ingest.index_batch(spark, later, path, 1, threshold=None, window=(1200, 200))
    measured = [(r.version, r.files, r.unreadable, r.sources, r.chunks, r.kept) for r in tables.runs(spark, path).orderBy("version").collect()]
    k = lambda *which: sum(-(-(len(texts[i]) - 1200) // 1000) + 1 for i in which)
    assert measured == [(1, 6, 0, 6, k(*range(6)), k(*range(6))), (2, 9, 1, 2, k(1, 2), 0)]
    assert moved(spark)[0] - start[0] < sum(map(len, texts))  # the texts of unchanged files stay where they are
    assert "size" not in tables.snapshot(spark, path).measured
