import itertools
import sys
import zlib
from collections import Counter
from math import log10
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))
from helpers import DOCS, crc, odd_documents, with_clashing_columns  # noqa: E402

from tessera.llm import hmm, language_id, quality  # noqa: E402


def paths_likelihood(model, codes):
    """Sum over all paths of states."""
    states = range(len(model.start))
    total = 0.0
    for path in itertools.product(states, repeat=len(codes)):
        p = model.start[path[0]] * model.emits[codes[0], path[0]]
        for t in range(1, len(codes)):
            p *= model.moves[path[t - 1], path[t]] * model.emits[codes[t], path[t]]
        total += p
    return total


def small_model(states=3, classes=5, seed=2):
    draw = np.random.default_rng(seed)
    one = lambda *shape: draw.random(shape) + 0.1
    start, moves, emits = one(states), one(states, states), one(classes, states)
    return hmm.Hmm(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def test_forward_is_the_sum_over_paths():
    model = small_model()
    sequences = [[0], [1, 2], [4, 3, 2, 1, 0], [], [2, 2, 2]]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    for longest in (1, 2, 3, 1024):
        found = hmm.forward_log10(model, np.array(sum(sequences, [])), offsets, longest)
        for got, codes in zip(found, sequences, strict=True):
            assert abs(got - (log10(paths_likelihood(model, codes)) if codes else 0.0)) < 1e-9


def test_expected_counts_are_those_of_all_paths():
    model, codes = small_model(), np.array([0, 3, 1, 4, 2, 2, 1, 0, 3])
    emits, moves, start = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
    for part in (codes[:7], codes[7:]):
        whole = paths_likelihood(model, part)
        for path in itertools.product(range(3), repeat=len(part)):
            p = model.start[path[0]] * model.emits[part[0], path[0]]
            for t in range(1, len(part)):
                p *= model.moves[path[t - 1], path[t]] * model.emits[part[t], path[t]]
            start[path[0]] += p / whole
            for t, s in enumerate(path):
                emits[part[t], s] += p / whole
                if t:
                    moves[path[t - 1], s] += p / whole
    for longest, held in ((1, 1), (2, 3), (3, 100), (1024, 1024)):  # cut anywhere, the chains stay whole
        into = hmm.no_counts(5, 3)
        hmm.expected_counts(model, codes, np.array([0, 7, 7, 9]), into, longest, held)
        assert np.allclose(into["emits"], emits) and np.allclose(into["moves"], moves) and np.allclose(into["start"], start)
        assert np.isclose(into["likelihood"][0], log10(paths_likelihood(model, codes[:7]) * paths_likelihood(model, codes[7:])))


def test_scores_by_a_plain_loop(rows):
    """The score of each text, recomputed word by word with the model before any round."""
    data, states, classes = odd_documents()[:8], 3, 16
    found = sorted((str(r.doc_id), r.score) for r in hmm.score(rows(data, DOCS), hmm.held_out(), states, classes, rounds=0).collect())
    texts = [((t or "").encode().lower().split()) for _, t, *_ in data]
    count = Counter(w for d, ws in zip(data, texts, strict=True) if crc(d[0]) % 7 != 2 for w in ws)
    ends = sum(crc(d[0]) % 7 != 2 for d in data)
    place = lambda w: 1 + zlib.crc32(w) % (classes - 1)
    totals, kinds = np.zeros(classes), np.zeros(classes)
    for w, n in count.items():
        totals[place(w)] += n
        kinds[place(w)] += 1
    totals[0], kinds[0] = ends, 1
    model = hmm.Hmm.seeded(totals, states)
    wanted = []
    for d, ws in zip(data, texts, strict=True):
        alpha, score = model.start, 0.0
        for t, (c, n) in enumerate([(place(w), count[w]) for w in ws] + [(0, ends)]):
            alpha = (alpha if t == 0 else alpha @ model.moves) * model.emits[c]
            score += log10(alpha.sum()) + log10((n + 1) / (totals[c] + kinds[c] + 1))
            alpha = alpha / alpha.sum()
        wanted.append((str(d[0]), score))
    assert [i for i, _ in found] == [i for i, _ in sorted(wanted)]
    assert all(abs(a[1] - b[1]) < 1e-8 * abs(b[1]) for a, b in zip(found, sorted(wanted), strict=True))


def test_training_raises_the_likelihood(spark, rows):
    draw = np.random.default_rng(4)
    blobs = [(bytes(np.where(draw.random(200) < 0.9, 1 + i % 2, 3 + draw.integers(0, 3, 200)).astype(np.uint16).tobytes()),) for i in range(20)]
    encoded = rows([(bytearray(b[0]),) for b in blobs], "codes binary")
    counts = np.bincount(np.concatenate([np.frombuffer(b[0], np.uint16) for b in blobs]), minlength=8).astype(float)
    codes = np.concatenate([np.frombuffer(b[0], np.uint16) for b in blobs])
    offsets = np.arange(0, len(codes) + 1, 200)
    before = hmm.forward_log10(hmm.Hmm.seeded(counts, 2), codes, offsets).sum()
    after = [hmm.forward_log10(hmm.baum_welch(encoded, counts, 2, n), codes, offsets).sum() for n in (1, 4)]
    assert before < after[0] < after[1]


def test_scores_of_odd_documents(rows):
    data = odd_documents()
    frame = rows(data, DOCS)
    for docs, frequent in ((frame, 100), (with_clashing_columns(frame), 0)):
        found = sorted((tuple(r) for r in hmm.score(docs, hmm.held_out(), states=3, classes=64, rounds=2, frequent=frequent).collect()), key=str)
        words = [((t or "").encode().lower().split()) + ["END"] for _, t, *_ in data]
        held = [crc(d[0]) % 7 == 2 for d in data]
        count = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
        n, v = sum(count.values()), len(count)
        want = sorted(
            ((d[0], h, len(ws), sum(count[w] > 0 for w in ws), n, sum(log10((count[w] + 1) / (n + v + 1)) for w in ws)) for d, ws, h in zip(data, words, held, strict=True)), key=str
        )
        assert [f[:5] for f in found] == [w[:5] for w in want]
        assert all(abs(f[5] - w[5]) < 1e-6 * max(1, abs(w[5])) for f, w in zip(found, want, strict=True))
        assert all(np.isfinite(f[6]) and f[6] < 0 for f in found)


def test_scores_without_training_rows(rows):
    assert hmm.score(rows([], DOCS), hmm.held_out(), states=2, classes=16, rounds=1).count() == 0
    alone = next(i for i in range(100) if crc(i) % 7 == 2)
    found = hmm.score(rows([(alone, "a b", "en", "s", 1)], DOCS), hmm.held_out(), states=2, classes=16, rounds=1).first()
    assert (found.n_known, found.train_tokens, found.base_score) == (0, 0, 0.0)


WORDS = {"en": "the and of with this that other water people".split(), "de": "der und die nicht eine straße wasser größer".split()}


def spoken(n=120):
    draw = np.random.default_rng(8)
    data = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        data.append((i, " ".join(draw.choice(WORDS[lang], 12)), lang, "s", 1))
    return data


def test_languages(rows):
    data = spoken() + [(900, None, "en", "s", 1), (901, "12 !?", "de", "s", 1), (902, "", None, "s", 1), (903, "漢字 " * 40, None, "s", 1), (904, "the water " * 20000, "en", "s", 1)]
    docs = with_clashing_columns(rows(data, DOCS))
    model = language_id.train(docs, ~language_id.held_out(), sample_chars=4000)
    found = {r.doc_id: r for r in language_id.report(docs, model).collect()}
    assert all(found[d[0]].lang_pred == d[2] and 0.5 < found[d[0]].score <= 1 for d in data[:120])
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and found[i].rejected for i in (900, 901, 902))
    assert found[903].lang_pred in WORDS and found[903].rejected and found[904].lang_pred == "en"
    assert all(r.held_out == (crc(i) % 5 == 0) for i, r in found.items())
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(120), 904}


def test_many_languages_in_few_cells(rows, monkeypatch):
    draw = np.random.default_rng(12)
    words = {f"l{i:02d}": ["".join(chr(0x4E00 + 20 * i + c) for c in draw.integers(0, 20, draw.integers(2, 6))) for _ in range(8)] for i in range(60)}
    data = [(i, " ".join(draw.choice(words[lang], 6)), lang, "s", 1) for i, lang in enumerate(sorted(words) * 8)]
    data += [(1000 + i, f"odd{i} text", f"junk{i}", "s", 1) for i in range(40)]
    docs = rows(data, DOCS)
    model = language_id.train(docs, ~language_id.held_out())
    assert len(model.models.languages) > 80
    found = {r.doc_id: r.lang_pred for r in language_id.report(docs, model).collect()}
    assert all(found[d[0]] == d[2] for d in data[:480])
    texts = pa.array([d[1] for d in data] + [None, "", "".join(words["l03"]) * 50, " ".join(words["l07"] * 30)])
    whole = model.entropies(texts)
    for cells in (1, 300, 7000):
        monkeypatch.setattr(language_id, "CELLS", cells)
        parts = model.entropies(texts)
        assert np.allclose(whole[0], parts[0], rtol=1e-9) and (whole[1] == parts[1]).all()


def test_the_sample_is_bounded_with_thousands_of_languages(rows, monkeypatch):
    monkeypatch.setattr(language_id, "ALL_CHARS", 20_000)
    data = [(i, "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(50)), f"j{i % 500}", "s", 1) for i in range(2000)]
    counted = []
    count = language_id._word_counts
    monkeypatch.setattr(language_id, "_word_counts", lambda sample: counted.append(sum(len(r.text) for r in sample.collect())) or count(sample))
    model = language_id.train(rows(data, DOCS), ~language_id.held_out())
    assert 0 < counted[0] < 25_000 and 0 < len(model.models.languages) < 500


def test_no_language_to_learn(rows):
    docs = rows([(1, "some text", None, "s", 1)], DOCS)
    model = language_id.train(docs, ~language_id.held_out())
    assert language_id.report(docs, model).first().lang_pred == "und"
    assert language_id.report(rows([], DOCS), model).count() == 0


def test_character_models_sum_to_one(rows):
    docs = rows(spoken(), DOCS)
    models = language_id.train(docs, ~language_id.held_out()).models
    letters = sorted({c for words in WORDS.values() for w in words for c in w}) + [chr(language_id.AFTER)]
    lead = chr(language_id.BEFORE) * (language_id.ORDER - 1)
    for context in ("", "t", "th", "was", "zzz"):
        at = [np.frombuffer((lead + context + c).encode("utf-32-le"), np.uint32).astype(np.uint64) for c in letters]
        total = sum(2 ** models.log_probs(p, np.array([len(p) - 1]))[0] for p in at) + models._probs(*_unseen(lead + context), language_id.ORDER)[0]
        assert np.allclose(total, 1, atol=1e-4)


def test_character_probabilities_by_a_plain_loop(rows):
    """Interpolated Kneser-Ney from the texts, n-gram by n-gram, against the fitted arrays."""
    order, (before, after) = language_id.ORDER, (chr(language_id.BEFORE), chr(language_id.AFTER))
    texts = {"en": "the water the then hat that hat", "de": "der das dass hat wasser"}
    grams = {"lang": [], "n": [], "key": [], "prefix": [], "suffix": [], "count": []}
    raw = {}
    for place, lang in enumerate(sorted(texts)):
        seen = [Counter() for _ in range(order + 1)]
        for word in texts[lang].split():
            padded = before * (order - 1) + word + after
            for i in range(order - 1, len(padded)):
                for n in range(1, order + 1):
                    seen[n][padded[i - n + 1 : i + 1]] += 1
        raw[lang] = seen
        code = lambda g: language_id.gram_keys(np.array([ord(c) for c in g], np.uint64), np.array([len(g) - 1]), len(g))[0] if g else np.uint64(0)
        for n in range(1, order + 1):
            for g, count in seen[n].items():
                for name, value in zip(grams, (place, n, code(g), code(g[:-1]), code(g[1:]), count), strict=True):
                    grams[name].append(value)
    columns = {k: np.array(v, np.uint64 if k in ("key", "prefix", "suffix") else np.int64) for k, v in grams.items()}
    model = language_id.KneserNey.fit(sorted(texts), columns)
    letters = {g for seen in raw.values() for g in seen[1]}

    def plain(lang, gram, n):
        if n == 0:
            return 1 / (len(letters) + 1)
        counts = raw[lang][n] if n == order else Counter(g[1:] for g in raw[lang][n + 1])
        once, twice = (sum(v == c for v in counts.values()) for c in (1, 2))
        discount = max(once / max(once + 2 * twice, 1), 0.1) if once + twice else 0.75
        same = [v for g, v in counts.items() if g[:-1] == gram[:-1]]
        lower = plain(lang, gram[1:], n - 1)
        return max(counts[gram] - discount, 0) / sum(same) + discount * len(same) / sum(same) * lower if same else lower

    for gram in {g for seen in raw.values() for g in seen[order]} | {"hatx", "xxxx", "asse", "zzta"}:
        got = model.log_probs(np.array([ord(c) for c in gram], np.uint64), np.array([order - 1]))[0]
        assert np.allclose(2**got, [plain(lang, gram, order) for lang in sorted(texts)], rtol=1e-5)


def _unseen(context):
    points = np.frombuffer((context + "☃").encode("utf-32-le"), np.uint32).astype(np.uint64)
    return points, np.array([len(points) - 1])


def test_linear_time_form_equals_all_pairs():
    draw = np.random.default_rng(3)
    model = quality.FactorisationMachine(draw.normal(size=20), draw.normal(size=(20, 4)), np.zeros(1), np.ones(1))
    index, values = np.array([1, 5, 7, 19]), draw.normal(size=4)
    got, _ = model.logits(np.zeros(4, int), index, values, 1)
    pairs = sum(model.factors[index[i]] @ model.factors[index[j]] * values[i] * values[j] for i in range(4) for j in range(i))
    assert abs(got[0] - (model.weights[index] @ values + pairs)) < 1e-9


def test_gradient_lowers_the_loss():
    draw = np.random.default_rng(5)
    labels = draw.integers(0, 2, 200).astype(float)
    examples = [(np.array([0, 1 + int(y)]), np.array([1.0, 1.0])) for y in labels]
    model = quality.FactorisationMachine.seeded(4, 2, np.zeros(0), np.ones(0))
    for i in range(5):
        quality.descend(model, labels, examples, seed=i)
    scores = [model.logits(np.zeros(2, int), i, v, 1)[0][0] for i, v in examples]
    assert all((s > 0) == bool(y) for s, y in zip(scores, labels, strict=True))


def test_quality_on_held_out_rows(rows):
    draw = np.random.default_rng(6)
    good = lambda: " ".join(draw.choice("clear plain useful sentence about water".split(), 20)) + "."
    bad = lambda: " ".join(draw.choice("###x $$$y %%%z !!W".split(), 20))
    data = [(i, good() if i % 2 else bad(), "en", "s", 100) for i in range(300)] + [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "x " * 50000, "en", "s", 1)]
    docs = with_clashing_columns(rows(data, DOCS))
    labels = rows([(i, i % 2, 0) for i in range(300)] + [(0, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels, ~quality.held_out(), buckets=256, rounds=3)
    found = {r.doc_id: r for r in quality.report(docs, model).collect()}
    held = [i for i in range(300) if found[i].held_out]
    assert len(held) > 50 and all(found[i].held_out == (crc(i) % 3 == 1) for i in found)
    assert np.mean([found[i].predicted == i % 2 for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values()) and len(found) == len(data)


def test_quality_does_not_depend_on_partitions(spark):
    """The same scores from one file as from many small splits, shuffled over more partitions."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    conf, scores = spark.conf, []
    before = {k: conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")}
    try:
        for size, parts in (("134217728b", "1"), ("20000b", "7")):
            conf.set("spark.sql.files.maxPartitionBytes", size)
            conf.set("spark.sql.shuffle.partitions", parts)
            docs = read("documents").repartition(int(parts))
            model = quality.train(docs, read("labels"), ~quality.held_out(), buckets=512, rounds=2)
            scores.append({r.doc_id: r.score for r in quality.report(docs, model).collect()})
    finally:
        for key, value in before.items():
            conf.set(key, value)
    assert scores[0] == scores[1] and len(set(scores[0].values())) > 20


def test_quality_by_a_plain_loop(rows):
    """Scores recomputed word by word and pair by pair from the learned weights."""
    data = [(i, ("Plain words 7 here. " if i % 2 else "##x %%y ") * (1 + i % 5), "en", "s", 50) for i in range(40)]
    docs = rows(data, DOCS)
    labels = rows([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    buckets = 32
    model = quality.train(docs, labels, ~quality.held_out(), buckets=buckets, factors=2, rounds=2)
    found = {r.doc_id: r.score for r in quality.report(docs, model).collect()}
    for i, text, *_ in data[:6]:
        words = text.encode().lower().split()
        own = Counter(zlib.crc32(w) % buckets for w in words)
        size = len(text.encode())
        share = lambda test, text=text, size=size: (sum(map(test, text)) / size) ** 0.5
        stats = [
            1.0, np.log1p(len(words)), np.log1p(50), sum(map(len, words)) / len(words), len(own) / len(words), share(str.isupper), share(str.isdigit),
            share(lambda c: not c.isalnum() and c not in " .,;:'\"-()?"), share(lambda c: c == "\n"), share(lambda c: ord(c) > 127), max(own.values()) / len(words),
        ]
        x = [(b, (n / len(words)) ** 0.5) for b, n in own.items()]
        x += [(buckets + k, float(np.clip((v - model.means[k]) / model.spreads[k], -4, 4))) for k, v in enumerate(stats)]
        logit = sum(model.weights[a] * v for a, v in x)
        logit += sum(model.factors[a] @ model.factors[b] * v * u for n, (a, v) in enumerate(x) for b, u in x[:n])
        assert abs(found[i] - 1 / (1 + np.exp(-logit))) < 1e-9


def test_quality_without_labels(rows):
    docs = rows(odd_documents(), DOCS)
    model = quality.train(docs, rows([], "doc_id bigint, quality int, toxic int"), ~quality.held_out(), buckets=64)
    assert quality.report(docs, model).count() == len(odd_documents())
    assert quality.report(rows([], DOCS), model).count() == 0


def test_features_of_empty_texts():
    rows_, index, values, statistics = quality.text_features(pa.array(["", None, "Ab 1\n"]), np.zeros(3), 16)
    assert statistics.shape == (3, len(quality.STATISTICS)) and np.isfinite(statistics).all() and set(rows_) == {2}
