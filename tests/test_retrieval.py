import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.jobs import registry
from tessera.operators import bm25, boosts, cluster, context, embed, fuse, history, meta, rerank, search, smart, vector
from tessera.operators.embed import embed_with_cache, hashed_embedding


def test_bm25_by_hand(rows):
    chunks = rows([(1, "Python is good"), (2, "python python snake"), (3, "other words here")], "id bigint, text string")
    queries = rows([(7, "Python"), (8, "nothing")], "query_id bigint, query string")
    found = bm25.search(chunks, queries, 10).orderBy("rank").collect()
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    want = {2: idf * 2 * 2.2 / (2 + 1.2), 1: idf * 2.2 / (1 + 1.2)}
    assert [(r.query_id, r.id) for r in found] == [(7, 2), (7, 1)]
    assert all(abs(r.score - want[r.id]) < 1e-6 for r in found)
    assert bm25.postings(chunks).filter("term = 'python'").count() == 2


def test_bm25_fields_add_up(rows):
    chunks = rows([(1, "cat", "dog"), (2, "dog", "dog")], "id bigint, content string, source string")
    queries = rows([(1, "dog")], "query_id bigint, query string")
    assert [r.id for r in bm25.search_fields(chunks, queries, ["content", "source"]).orderBy("rank").collect()] == [2, 1]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_nearest(rows, metric):
    draw = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in draw.normal(size=4)]) for i in range(50)] + [(99, None)]
    queries = [(i, [float(x) for x in draw.normal(size=4)]) for i in range(5)]
    found = vector.nearest(rows(vectors, "id bigint, vector array<double>"), rows(queries, "query_id bigint, vector array<double>"), 3, metric).collect()
    for q, v in queries:
        a = np.array(v)
        score = {"cosine": lambda b: a @ b / np.linalg.norm(a) / np.linalg.norm(b), "dot": lambda b: a @ b, "l2": lambda b: -np.linalg.norm(a - b)}[metric]
        want = sorted(((-round(score(np.array(b)), 6), i) for i, b in vectors if b), key=lambda x: x)[:3]
        assert [r.id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == [i for _, i in want]


def test_fusion_golden(rows):
    keyword = rows([(1, 10, 1), (1, 11, 2)], "query_id int, id int, rank int")
    near = rows([(1, 11, 1), (1, 12, 2)], "query_id int, id int, rank int")
    found = fuse.reciprocal_ranks(keyword, near).orderBy("rank").collect()
    assert [r.id for r in found] == [11, 10, 12]
    assert abs(found[0].score - (0.5 / 62 + 0.5 / 61)) < 1e-9


def test_filters_apply_before_the_cut(rows):
    chunks = rows([(i, f"word {'cat ' * (9 - i)}") for i in range(8)], "id bigint, text string")
    vectors = rows([(i, [1.0, float(i)]) for i in range(8)], "id bigint, vector array<double>")
    queries = rows([(1, "cat", [1.0, 0.0])], "query_id bigint, query string, vector array<double>")
    ids = rows([(6,), (7,)], "id bigint")
    for mode in ("keyword", "vector", "hybrid"):
        assert {r.id for r in search.hybrid_search(chunks, vectors, queries, 2, mode=mode, ids=ids).collect()} == {6, 7}
    with pytest.raises(ValueError):
        search.hybrid_search(chunks, vectors, queries, mode="odd")


def test_by_ids_keeps_rank_order(rows):
    hits = rows([(1, 5, 1), (1, 3, 2), (1, 99, 3)], "query_id int, id int, rank int")
    assert [r.id for r in search.by_ids(rows([(3, "x"), (5, "y")], "id int, text string"), hits).collect()] == [5, 3]


def test_combined_scores(rows):
    data = [(1, 1, "cat dog", "cat", 5.0), (1, 2, "cat dog", "cat dog", None), (1, 3, "cat dog", "x", 2.0)]
    found = rerank.combined(rows(data, "query_id int, id int, query string, text string, score double")).orderBy("rank").collect()
    assert [(r.id, r.final_score) for r in found] == [(2, 0.7), (1, 0.65), (3, 0.12)]
    same = rows([(1, 4.0), (1, 4.0)], "query_id int, s double").select(fuse.min_max(F.col("s"), "query_id").alias("m")).collect()
    assert [r.m for r in same] == [0.5, 0.5]


def test_cache_embeds_each_text_once(rows):
    texts = rows([(1, "a b"), (2, "a b"), (3, "c")], "id bigint, text string")
    empty = rows([], "model string, text_hash string, vector array<double>")
    vectors, fresh = embed_with_cache(texts, empty, "m", hashed_embedding)
    assert vectors.count() == 3 and fresh.count() == 2
    again, none = embed_with_cache(texts, fresh, "m", hashed_embedding)
    assert again.count() == 3 and none.count() == 0
    other, _ = embed.split_by_cache(texts, fresh, "other")
    assert other.count() == 0
    stats = embed.cache_stats(rows([(True,), (True,), (False,)], "hit boolean")).first()
    assert (stats.hits, stats.misses) == (2, 1)


def test_clusters(rows):
    data = [(i, [float(i % 2), float(i % 2) + i / 1000]) for i in range(30)]
    vectors = rows(data, "id bigint, vector array<double>")
    centroids = cluster.fit(vectors, 2)
    assert {r.size for r in cluster.cluster_stats(cluster.assign(vectors, centroids)).collect()} == {15}
    assert cluster.optimal_clusters(vectors) == 5
    assert cluster.fit(vectors.limit(1), 3).count() == 0
    assert cluster.optimal_clusters(vectors.limit(3)) == 2


def test_context_window_keeps_the_last(rows):
    data = [(1, 0, "system", "s" * 40), (1, 1, "user", "u" * 400), (1, 2, "assistant", "a" * 40), (1, 3, "user", "q" * 400)]
    talk = rows(data, "conv_id int, turn int, role string, text string")
    kept = {r.turn for r in context.sliding_window(talk, 50, keep_last=True).filter("kept").collect()}
    assert kept == {0, 3}
    assert {r.turn for r in context.sliding_window(talk, 50).filter("kept").collect()} == {0}
    assert context.window_info(context.sliding_window(talk, 50)).first().tokens_saved == 210
    used = context.recommendations(context.usage(talk, 9000, 10000)).first()
    assert used.warning_level == "red" and len(used.recommendations) == 4
    assert context.display_usage(context.usage(talk, 9000, 9000)).first().percent == 100.0
    assert context.optimise(talk, 0, 10, 100_000).filter("kept").count() == 4


def test_history(rows):
    schema = "conv_id int, name string, created_at timestamp, updated_at timestamp, pinned boolean, archived boolean, keywords array<string>"
    import datetime as d

    day = lambda n: d.datetime(2024, 3, n, 9, 5)
    stored = rows([(1, "one", day(1), day(2), False, False, ["x"]), (2, "two", day(1), day(1), True, False, []), (3, "three", day(1), day(9), False, True, [])], schema)
    saved = rows([(1, "renamed", day(5), day(6), False, False, ["y"]), (4, "four", day(6), day(6), False, False, [])], schema)
    merged = {r.conv_id: r for r in history.upsert(stored, saved).collect()}
    assert merged[1].name == "one" and merged[1].keywords == ["y"] and merged[1].updated_at == day(6) and len(merged) == 4
    assert [r.conv_id for r in history.listing(stored).collect()] == [2, 1]
    assert [r.conv_id for r in history.listing(stored, 1, archived=True).collect()] == [2]
    ids = rows([(1,)], "conv_id int")
    assert history.with_flag(stored, ids, "pinned", F.lit(True)).filter("conv_id = 1").first().pinned
    assert history.delete(stored, ids).count() == 2
    labels = stored.orderBy("conv_id").select(history.time_label(F.col("updated_at"), F.lit("2024-03-09").cast("date")).alias("l"), history.recency(F.col("updated_at"), F.lit("2024-03-09").cast("date")).alias("r")).collect()
    assert [(x.l, x.r) for x in labels] == [("Mar 02", "Last 30 days"), ("Mar 01", "Last 30 days"), ("09:05", "Today")]
    talk = rows([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "assistant", "more")], "conv_id int, turn int, role string, text string")
    assert history.exported(talk, stored.select("conv_id", "name", "created_at", "updated_at"), "json").first().document.startswith('{"conv_id":1')
    assert [r.turn for r in history.save_points(talk, 2).collect()] == [2]
    with pytest.raises(ValueError):
        history.exported(talk, stored, "pdf")


def test_meta_of_an_empty_index(rows):
    empty = rows([], "source string, chunk_index int, timestamp timestamp, doc_type string, file_modified timestamp")
    assert tuple(meta.counts(empty).first()) == (0, 0, 0)
    assert meta.total_chunks(meta.documents(empty)).first().total_chunks == 0
    done = meta.throughput(rows([("a", True, 1.0), ("b", False, 3.0)], "source string, ok boolean, seconds double")).first()
    assert (done.files, done.failed, done.per_minute) == (2, 1, 30.0)


def test_boosted_nearest_takes_all_documents(rows):
    draw = np.random.default_rng(3)
    docs = [(i, [float(x) for x in draw.normal(size=4)], f"s{i % 3} cat" if i % 5 == 0 else "s", "en" if i % 4 else "de", "a dog" if i % 7 == 0 else None) for i in range(90)] + [(99, None, "cat", "en", "dog")]
    queries = [(i, [float(x) for x in draw.normal(size=4)], ["Cat", "dog"] if i % 2 else None, ["en", "de", None][i % 3]) for i in range(7)]
    docs_frame = rows(docs, "id bigint, vector array<double>, source string, doc_type string, text string").withColumn("doc_keywords", F.lit(None).cast("string")).repartition(3)
    asked = rows(queries, "query_id bigint, vector array<double>, keywords array<string>, hint string")
    found = search.boosted_nearest(docs_frame, asked, 4).collect()
    for q, a, words, hint in queries:
        own = {i: sum(1.5 * (w.lower() in source) + 0.5 * (w.lower() in (text or "")) for w in words or []) + 2.0 * (lang == hint) for i, v, source, lang, text in docs if v}
        cos = {i: np.dot(a, v) / np.linalg.norm(a) / np.linalg.norm(v) for i, v, *_ in docs if v}
        want = sorted((-round(cos[i] + 0.3 * own[i] / max(max(own.values()), 1), 6), i) for i in own)[:4]
        got = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.id for r in got] == [i for _, i in want]
        assert all(abs(r.distance - (1 - cos[r.id])) < 1e-6 for r in got)


def test_boosts_equal_the_expressions(rows):
    """The automaton finds what looking for each keyword finds: parts of words, repeats, empty and null keywords."""
    draw = np.random.default_rng(4)
    letters = list("aAbB ÄäéİßΣ")
    word = lambda n: "".join(draw.choice(letters, n))
    docs = [(i, word(900) if i % 4 else None, word(6) if i % 3 else None, ["prd", "meeting", None][i % 3], word(5) if i % 5 else None) for i in range(60)] + [(90, "a meeting", "Meeting", "prd", "")]
    queries = [(q, [word(int(draw.integers(1, 4))) for _ in range(q % 5)] + ([""] if q % 7 == 0 else []) + ([None, "a", "a"] if q % 6 == 0 else []), ["prd", "meeting", None][q % 3]) for q in range(40)] + [(50, None, "meeting")]
    frame = rows(docs, "id bigint, text string, source string, doc_type string, doc_keywords string").repartition(3)
    asked = rows(queries, "query_id bigint, keywords array<string>, hint string")
    found = sorted(map(tuple, search.most_boosted(frame, asked, 5).collect()))
    own = search.keyword_boost(F.col("keywords"), F.col("source"), F.col("doc_keywords"), F.col("text")) + search.type_boost(F.col("hint"), F.col("source"), F.col("doc_type"), F.col("text"))
    every = {}
    for r in frame.crossJoin(asked).select("query_id", "id", own.alias("boost")).collect():
        every.setdefault(r.query_id, []).append((-r.boost, r.id))
    assert found == sorted((q, i, -b, n) for q, hits in every.items() for n, (b, i) in enumerate(sorted(hits)[:5], 1))


def test_many_keyword_profiles(rows):
    """3,000 profiles of their own: no rows of chunks times queries anywhere in the plan."""
    docs = rows([(i, f"text {i} about t{i % 50}", f"s{i % 7}", "prd", "k") for i in range(500)], "id bigint, text string, source string, doc_type string, doc_keywords string")
    asked = rows([(q, [f"t{q % 50}", f"word{q}", f"s{q % 7}"], None) for q in range(3000)], "query_id bigint, keywords array<string>, hint string")
    found = search.most_boosted(docs, asked, 1)
    assert "Cartesian" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    got = {r.query_id: r.boost for r in found.collect()}
    assert len(got) == 3000 and min(got.values()) >= 1.5


def test_focused_search_by_hand(rows, monkeypatch):
    draw = np.random.default_rng(5)
    point = lambda: [float(x) for x in draw.normal(size=3)]
    middles = {c: point() for c in range(5)}
    near = lambda v: sorted(middles, key=lambda c: (round(float(np.linalg.norm(np.subtract(v, middles[c]))), 6), c))
    twin = point()
    docs = []
    for i in range(80):
        v = twin if i % 10 == 0 else point()
        docs.append((i, None if i == 7 else "a cat" if i % 3 else "Dog " * 200, f"s{i} plan" if i % 9 == 0 else None, "prd" if i % 4 == 0 else None, "dog" if i % 6 == 0 else None, v, near(v)[0], f"2024-01-{1 + i % 28:02d}"))
    docs.append((99, "dog", "dog", "prd", "dog", None, 0, None))
    queries = [(0, twin, None, None, "recent"), (1, twin, [], None, None), (2, point(), ["Dog", "plan"], "prd", None), (3, point(), ["cat"], "meeting", "recent"), (4, None, ["cat"], None, None)]
    chunks = rows(docs, "id bigint, text string, source string, doc_type string, doc_keywords string, vector array<double>, cluster_id int, file_modified string").repartition(3)
    asked = rows(queries, "query_id bigint, vector array<double>, keywords array<string>, doc_type_hint string, temporal_hint string")
    centroids = rows(list(middles.items()), "cluster_id int, centroid array<double>")

    def wanted(pruned):
        for q, a, words, hint, recent in queries[:4]:
            held = [d for d in docs if d[5] and (not pruned or d[6] in near(a)[:2])]
            boost = {}
            for i, body, source, kind, tags, *_ in held:
                low = (body or "").lower()[:500]
                boost[i] = sum(1.5 * (w.lower() in (source or "")) + 1.0 * (w.lower() in (tags or "")) + 0.5 * (w.lower() in low) for w in words or []) + 2.0 * (hint is not None and kind == hint)
            top = max(1.0, *boost.values())
            score = {d[0]: round(float(np.dot(a, d[5]) / np.linalg.norm(a) / np.linalg.norm(d[5])) + 0.3 * boost[d[0]] / top, 6) for d in held}
            order = sorted(held, key=lambda d: (-score[d[0]], -int(d[7][-2:]) if recent else 0, d[0]))[:6]
            yield from ((q, d[0], n) for n, d in enumerate(order, 1))

    run = lambda model: sorted((r.query_id, r.id, r.rank) for r in smart.focused_search(chunks, model, asked, 6).collect())
    assert run(centroids) == sorted(wanted(True))
    monkeypatch.setattr(boosts, "QUERY_BYTES", 200)  # several parts
    monkeypatch.setattr(boosts, "ROWS", 4)
    monkeypatch.setattr(boosts, "QUERY_BLOCK", 1)
    assert run(centroids) == sorted(wanted(True))
    assert run(centroids.limit(0)) == sorted(wanted(False))
    assert smart.focused_search(chunks.limit(0), centroids, asked).count() == 0 and smart.focused_search(chunks, centroids, asked.limit(0)).count() == 0


def test_two_stages_filter_before_the_search(rows):
    chunks = rows([(i, "cat " * (20 - i) + "word " * i) for i in range(12)] + [(20, "bird")], "id bigint, text string")
    vectors = rows([(i, [1.0, 0.0]) for i in range(3)], "id bigint, vector array<double>")
    queries = rows([(1, "cat", [1.0, 0.0]), (2, "bird", [1.0, 0.0]), (3, "cat", [0.0, 1.0])], "query_id bigint, query string, vector array<double>")
    english = rows([(i,) for i in (1, 6, 8, 9, 10, 11)], "id bigint")
    found = search.two_stage(chunks, vectors, queries, english, 3, 0.5).orderBy("rank").collect()
    hits = {q: [(r.id, r.stage) for r in found if r.query_id == q] for q in (1, 2, 3)}
    assert hits[1] == [(1, "focused"), (6, "focused"), (8, "focused")]
    assert hits[2] == [(20, "broad")]
    assert hits[3] == [(0, "broad"), (1, "broad"), (2, "broad")]


def test_both_ways_of_search_agree(rows, monkeypatch):
    """Query batches that are too large for every task take joins instead; the results are the same."""
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(draw.choice(words, n))
    chunks = rows([(i, text(int(draw.integers(0, 20))), text(3)) for i in range(60)] + [(99, None, None)], "id bigint, text string, title string")
    queries = rows([(q, text(4) + " unknown") for q in range(7)] + [(8, "unknown"), (9, None)], "query_id bigint, query string")
    for fields in ("text", ["text", "title"]):
        packed = sorted(map(tuple, bm25.search(chunks, queries, 5, fields).collect()))
        with monkeypatch.context() as patch:
            patch.setattr(bm25, "ASKED", 0)
            joined = sorted(map(tuple, bm25.search(chunks, queries, 5, fields).collect()))
        assert [r[:2] + r[3:] for r in packed] == [r[:2] + r[3:] for r in joined] and len(packed) == 35
        assert np.allclose([r[2] for r in packed], [r[2] for r in joined])
    assert bm25.search(chunks.limit(0), queries).count() == 0 and bm25.search(chunks, queries.limit(0)).count() == 0
    points = rows([(i, [float(x) for x in draw.normal(size=4)]) for i in range(50)] + [(77, None)], "id bigint, vector array<float>")
    asked = points.limit(9).withColumnRenamed("id", "query_id")
    for metric in ("cosine", "dot", "l2"):
        one = sorted(map(tuple, vector.nearest(points, asked, 3, metric).collect()))
        with monkeypatch.context() as patch:
            patch.setattr(vector, "QUERY_BYTES", 0)
            assert one == sorted(map(tuple, vector.nearest(points, asked, 3, metric).collect())) and len(one) == 27
    assert vector.nearest(points, asked.limit(0)).count() == 0 and vector.nearest(points.limit(0), asked).count() == 0


def test_pair_boosts_has_every_document_for_every_query(rows):
    docs = rows([(i, "the Meeting" if i % 2 else None, f"src{i}", "en" if i % 3 else None, "x") for i in range(30)], "id bigint, text string, source string, doc_type string, doc_keywords string")
    asked = rows([(1, ["SRC1", "the"], "meeting"), (2, ["SRC1", "the"], "meeting"), (3, None, "en"), (4, ["X", "x"], None)], "query_id bigint, keywords array<string>, hint string")
    found = {(r.query_id, r.id): (r.by_word, r.by_type) for r in search.pair_boosts(docs, asked).collect()}
    assert len(found) == 4 * 30
    for i in range(30):
        assert found[1, i] == found[2, i] == (1.5 * (str(i)[0] == "1") + 0.5 * (i % 2), 1.0 * (i % 2))
        assert found[3, i] == (0.0, 2.0 if i % 3 else 0.0)
        assert found[4, i] == (2.0, 0.0)


def test_boost_query_has_every_pair(spark):
    sf_dir = "/root/testdata/sf0.001"
    pairs = spark.read.parquet(f"{sf_dir}/documents.parquet").count() * spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    assert registry.QUERIES["keyword_and_type_boost"](spark, sf_dir).count() == pairs


@pytest.mark.parametrize("job", ["embed", "bm25", "nearest"])
def test_python_batches_are_bounded_in_any_session(spark, rows, job):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(256 * 1024 * 1024))
    try:
        chunks, queries = rows([(1, "a cat"), (2, "dog")], "id bigint, text string"), rows([(7, "cat")], "query_id bigint, query string")
        vectors, asked = rows([(1, [1.0, 0.0])], "id bigint, vector array<double>"), rows([(7, [1.0, 0.5])], "query_id bigint, vector array<double>")
        {"embed": lambda: hashed_embedding(chunks), "bm25": lambda: bm25.search(chunks, queries, 3), "nearest": lambda: vector.nearest(vectors, asked, 3)}[job]().collect()
        assert int(spark.conf.get(key).rstrip("b")) <= 8 * 1024 * 1024
    finally:
        spark.conf.set(key, before)
