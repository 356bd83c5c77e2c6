import random
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import DOCS, odd_documents, with_clashing_columns  # noqa: E402

from tessera.llm import components, decontaminate, mixing, queries, repeated_spans, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def merged(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def plain_components(data):
    prints = [plain_fingerprint(d[1]) for d in data]
    n = len(data)
    roots = merged(n, [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for r, d in zip(roots, data, strict=True):
        if d[0] is not None:
            least[r] = min(least.get(r, d[0]), d[0])
    return prints, [least.get(r) for r in roots]


@pytest.mark.parametrize("blocks,heavy", [(None, 4096), (5, 3), (6, 1)])
def test_components_by_brute_force(rows, blocks, heavy):
    data = odd_documents() + [(500 + i, "same long text " * 30 + "tail" * (i % 5), "en", "s", 1) for i in range(40)]
    prints, wanted = plain_components(data)
    found = simhash.report(simhash.near_duplicates(with_clashing_columns(rows(data, DOCS)), blocks, heavy)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((d[0], f"{p:016x}", c)) for d, p, c in zip(data, prints, wanted, strict=True))


@pytest.mark.parametrize("heavy", [1, 50, 4096])
def test_links_of_random_fingerprints(rows, heavy):
    draw = random.Random(1)
    seeds = [draw.getrandbits(64) for _ in range(20)]
    prints = list({s ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(4))) & (1 << 64) - 1 for s in seeds for _ in range(15)})
    wanted = merged(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.near_links(rows([(s,) for s in signed], "fp bigint"), 4, heavy).collect()
    place = {s: i for i, s in enumerate(signed)}
    assert merged(len(prints), [(place[r.a], place[r.b]) for r in found]) == wanted


def test_one_of_each_group_stays(rows):
    data = odd_documents()
    docs = rows(data, DOCS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = [plain_fingerprint(d[1]) for d in data]
    groups = set(merged(len(data), [(i, j) for i in range(len(data)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]))
    assert kept.count() == len(groups)
    assert simhash.keep_one(rows([], DOCS)).count() == 0


def test_the_least_of_differing_repeated_rows_stays(rows):
    data = [(5, "same text here", lang, source, 1) for lang, source in (("en", "b"), ("en", "a"), ("de", "z"))] + [(5, "other words over there", "en", "a", 1)]
    for order in (data, data[::-1]):
        kept = sorted(tuple(r) for r in simhash.keep_one(rows(order, DOCS).repartition(3)).collect())
        assert kept == [(5, "other words over there", "en", "a", 1), (5, "same text here", "de", "z", 1)]


def test_fingerprints_of_texts_in_parts():
    draw = random.Random(3)
    for _ in range(50):
        text = "".join(draw.choice("ab \n\t") for _ in range(draw.randint(0, 200)))
        for size in (1, 7, 64):
            assert simhash.fingerprint(text.encode(), part_bytes=size) == plain_fingerprint(text)


def test_hot_keys_are_joined_whole(rows, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    data = [(i % 4 if i % 3 else 0, i) for i in range(60)]
    frame = rows(data, "k int, v int")
    counts = frame.groupBy("k").agg(F.count("*").alias("rows"), F.max("v").alias("top"))
    found = sorted(tuple(r) for r in common.join_by_key(frame, counts.filter("k < 3"), ["k"], "rows").collect())
    assert found == sorted((k, v, max(x for j, x in data if j == k)) for k, v in data if k < 3)


def test_star_components(rows):
    draw = random.Random(7)
    pairs = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(400, 401 + i) for i in range(60)]
    found = {r.a: r.root for r in components.connected_components(rows(pairs, "a bigint, b bigint")).collect()}
    wanted = merged(500, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == {x: wanted[x] for x in linked}


def words_of(text):
    import re

    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(words, width):
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


def test_short_items_in_long_documents(rows):
    docs = rows([(1, "The capital of France: Paris."), (2, "Everyone knows that the capital of France, Paris, lies on a river " * 50), (3, "Paris is not the capital of Spain")], "doc_id bigint, text string")
    items = rows([(7, "capital of France: Paris"), (8, "river"), (9, "one two three four five six")], "item_id bigint, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items).collect())
    assert found == [(1, 7), (2, 7), (2, 8)]


def test_a_document_that_holds_very_many_items(rows):
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(draw.choice([1, 4, 7, 12]))) for _ in range(400)]
    hub = " and ".join(texts[:300])
    docs = rows([(1, hub), (1, hub), (2, " ".join(texts[300:310])), *((10 + i, f"it says {t} here") for i, t in enumerate(texts))], "doc_id bigint, text string")
    items = rows([*enumerate(texts), (None, texts[0]), (7, texts[8])], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): (r.shared, r.n_shingles) for r in decontaminate.report(decontaminate.contained_items(docs, items)).collect()}
    wanted = {}
    for d, text in docs.distinct().collect():
        for i, t in items.collect():
            width = min(5, len(t.split()))
            s = shingles(t.split(), width)
            n = len(s & shingles(words_of(text), width))
            if n >= 0.8 * len(s) - 1e-9:
                wanted[d, i] = max(wanted.get((d, i), (0, 0, 0)), (n / len(s), n, len(s)))
    assert found == {k: v[1:] for k, v in wanted.items()} and {i for d, i in found if d == 1} >= {*range(300), None}


def test_containment_by_brute_force(rows):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdef") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(draw.randint(1, 40)))) for i in range(40)] + [(90, None), (91, ""), (92, "!!"), (1, "another text under the same id here")]
    data = odd_documents()
    for n, (_, item) in enumerate(items):
        words = (item or "").split()
        for cut in (0, 1, 3, 6):
            part = words[: max(1, len(words) - cut)]
            data.append((1000 + 10 * n + cut, " ".join([word() for _ in range(200)] + part + [word() for _ in range(50)]).upper() + "!", "en", "s", 1))
        data.append((1005 + 10 * n, (item or "").title() + ".", "en", "s", 1))
    docs, benchmark = with_clashing_columns(rows(data, DOCS)), rows(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): (r.shared, r.n_shingles) for r in decontaminate.report(decontaminate.contained_items(docs, benchmark)).collect()}
    wanted = {}
    for d in data:
        own = {w: shingles(words_of(d[1]), w) for w in range(6)}
        for i, t in items:
            width = min(5, len(words_of(t)))
            s, own_w = shingles(words_of(t), width), own[width]
            if s and len(s & own_w) >= 0.8 * len(s) - 1e-9:
                wanted[d[0], i] = max(wanted.get((d[0], i), (0, 0, 0)), (len(s & own_w) / len(s), len(s & own_w), len(s)))
    assert found == {k: v[1:] for k, v in wanted.items()} and len(found) > 80
    clean = decontaminate.drop_contaminated(docs, benchmark)
    bad = {k[0] for k in wanted}
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d[0]) for d in data if d[0] not in bad)


def test_empty_tables(rows):
    none = rows([], "item_id bigint, text string")
    docs = rows(odd_documents(), DOCS)
    assert decontaminate.contained_items(docs, none).count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == len(odd_documents())
    assert decontaminate.contained_items(rows([], DOCS), rows([(1, "a b c d e f")], "item_id bigint, text string")).count() == 0
    assert repeated_spans.repeated_spans(rows([], DOCS)).count() == 0
    assert mixing.mix(rows([], DOCS)).report().count() == 0


def test_mix_of_odd_documents(rows):
    data = odd_documents()
    docs = with_clashing_columns(rows(data, DOCS))
    mixed = mixing.mix(docs)
    found = mixed.report().collect()
    assert len(found) == len(data) and sorted(map(str, found)) == sorted(map(str, mixing.mix(docs).report().collect()))
    sizes = {}
    for d in data:
        sizes[d[3]] = sizes.get(d[3], 0) + len((d[1] or "").split())
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, (s or "").encode())), [3, 1, 2] * 9, strict=False))
    open_, left, target = set(sizes), 1.5 * sum(sizes.values()), {}
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
        open_ -= above
    wanted = sorted((str(d[0]), len((d[1] or "").split()), sizes[d[3]], round(target[d[3]], 6)) for d in data)
    assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6)) for r in found) == wanted
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    copies = mixed.emit_copies()
    assert copies.columns == docs.columns
    taken = mixed.rows.agg(F.sum("copies")).first()[0]
    assert copies.count() == taken


def test_targets_are_met(rows):
    data = [(i, "w " * (1 + i % 7), "en", "abc"[i % 3], 1) for i in range(6000)]
    found = mixing.mix(rows(data, DOCS)).report().groupBy("target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t / r.target - 1) < 0.05 for r in found)


def passage(n, seed):
    draw = random.Random(seed)
    return [" ".join("".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(draw.randint(4, 12))).capitalize() + "." for _ in range(n)]


def plain_spans(data):
    """Removed sentences of each document by comparing all runs."""
    docs = {}
    for i, t in data:
        parts = [(t or "")[a:b].lower().split() for a, b in repeated_spans.sentence_bounds(t or "")]
        docs[i] = parts
    places = {}
    for i, parts in docs.items():
        words = [len(p) for p in parts]
        runs = set()
        for a in range(len(parts)):
            if a + 3 <= len(parts):
                runs.add((a, a + 3))
            if a + 2 <= len(parts) and words[a] + words[a + 1] >= 25:
                runs.add((a, a + 2))
            if words[a] >= 50:
                runs.add((a, a + 1))
        for a, b in runs:
            places.setdefault(tuple(map(tuple, parts[a:b])), []).append((i, a, b))
    gone = {}
    for found in places.values():
        for i, a, b in sorted(found)[1:]:
            gone.setdefault(i, set()).update(range(a, b))
    return gone


def test_repeated_spans_by_brute_force(rows):
    shared, lone = passage(6, 1), "word " + " ".join(f"u{i}" for i in range(60)) + "."
    data = [(i, " ".join(passage(5, 10 + i))) for i in range(8)]
    data += [(20, " ".join(passage(3, 50) + shared + passage(2, 51))), (21, " ".join(shared)), (22, "\n".join(passage(4, 52) + shared).upper())]
    data += [(30, f"Start here. {lone} End."), (31, f"{lone}  Other words."), (40, " ".join(shared[:3] * 4)), (50, None), (51, ""), (52, "x" * 9000)]
    data += [(60, "He came. She saw it all. They both went home again."), (61, "Before that. He came. She saw it all. They both went home again. And after.")]
    docs = with_clashing_columns(rows(data, "doc_id bigint, text string"))
    spans = repeated_spans.repeated_spans(docs)
    found = {}
    for r in spans.collect():
        found.setdefault(r.doc_id, set()).update(range(r.first, r.end))
    assert found == plain_spans(data) and {21, 22, 31, 40, 61} <= set(found) and 0 not in found
    cut = {r.doc_id: r.text for r in repeated_spans.remove_spans(docs, spans).collect()}
    assert cut[21] == "" and cut[20] == dict(data)[20] and cut[31] == "Other words." and cut[50] is None
    assert cut[61] == "Before that. And after."
    assert repeated_spans.remove_spans(docs, spans).columns == docs.columns
    for r in repeated_spans.report(docs, spans).collect():
        left = cut.pop(r.doc_id)
        assert (r.sentences_removed, r.kept_chars, r.kept_crc32) == (len(found[r.doc_id]), len(left), zlib.crc32(left.encode()))
        assert {x for s in r.spans for x in range(s.first, s.end)} == found.pop(r.doc_id)
    assert not found and cut == {i: t for i, t in data if i in cut}


def test_repeated_rows_are_one_document(rows):
    text = " ".join(passage(5, 3))
    assert repeated_spans.repeated_spans(rows([(1, text), (1, text)], "doc_id bigint, text string")).count() == 0
    docs = rows([(None, text), (2, text), (2, text)], "doc_id bigint, text string")
    spans = repeated_spans.repeated_spans(docs)
    assert spans.count() == 1 and [r.doc_id for r in repeated_spans.report(docs, spans).collect()] == [2, 2]


def test_runs_cover_a_passage():
    draw = np.random.default_rng(1)
    for _ in range(200):
        words = draw.integers(1, 60, draw.integers(0, 9))
        runs = set(map(tuple, repeated_spans.runs_of(words, 3, 25, 50).tolist()))
        pairs = {(i, i + 2) for i in range(len(words) - 1) if words[i] + words[i + 1] >= 25}
        assert runs == {(i, i + 3) for i in range(len(words) - 2)} | pairs | {(i, i + 1) for i in range(len(words)) if words[i] >= 50}
        if words.sum() >= 50:  # a passage of 50 words is covered, however it is cut into sentences
            assert set().union(*(range(a, b) for a, b in runs)) == set(range(len(words)))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "conversations"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found, wanted = queries.QUERIES[name](spark, SF), connection.sql(queries.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, wanted.project(", ".join(columns)).fetchall()))
