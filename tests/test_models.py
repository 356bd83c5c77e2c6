"""Models loaded once a worker, batches, and rows that fail."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import models, rerank


def test_each_worker_loads_once_and_gets_batches(spark, tmp_path):
    loads, calls = str(tmp_path / "loads"), str(tmp_path / "calls")
    os.mkdir(loads), os.mkdir(calls)

    def load():
        open(f"{loads}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            with open(f"{calls}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(len(texts)))
            return [[float(len(t)), 1.0] for t in texts]

        return model

    rows = spark.range(1000).select("id", F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text")).repartition(12)
    found = models.embed(rows, load, batch=50).collect()
    assert len(found) == 1000 and all(r.vector == [float(r.id % 7), 1.0] and r.error is None for r in found)
    pids = [n.split("-")[0] for n in os.listdir(loads)]
    assert len(pids) == len(set(pids)) < 12
    sizes = [int(open(f"{calls}/{n}").read()) for n in os.listdir(calls)]
    assert sum(sizes) == 1000 and max(sizes) == 50  # each row once


def test_only_rows_that_fail_are_lost(rows):
    def failing():
        def model(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("can't")
            return [[float(len(t))] if t != "nan" else [float("nan")] for t in texts if t != "lost"]

        return model

    data = [(1, "good"), (2, "bad"), (3, None), (4, ""), (5, "lost"), (6, "nan"), (7, "also good")]
    found = {r.id: (r.vector, r.error) for r in models.embed(rows(data, "id bigint, text string").coalesce(1), failing).collect()}
    assert found[1] == ([4.0], None) and found[4] == ([0.0], None) and found[7] == ([9.0], None)
    assert found[2] == (None, "RuntimeError: can't")
    assert found[3] == (None, None)
    assert found[5] == (None, "ValueError: 0 values for 1 rows")
    assert found[6] == (None, "ValueError: a value is not finite")
    assert models.embed(rows([], "id bigint, text string"), failing).count() == 0


def test_pairs_and_labels(rows):
    def pairs():
        def model(queries, texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return [float(len(set(q) & set(t))) for q, t in zip(queries, texts, strict=True)]

        return model

    data = [(1, 1, "abc", "ab"), (1, 2, "abc", "bad"), (1, 3, "abc", "abc"), (1, 4, "abc", None)]
    candidates = rows(data, "query_id bigint, id bigint, query string, text string")
    found = rerank.rerank(candidates, 4, models.scorer(candidates, pairs)).orderBy("rank").collect()
    assert [(r.id, r.rerank_score) for r in found] == [(3, 3.0), (1, 2.0), (2, None), (4, None)]

    def labels():
        return lambda texts: ["long" if len(t) > 2 else 1 / (len(t) - 1) and "short" for t in texts]

    named = models.classify(candidates.select("id", "text"), labels, "none")
    assert {r.id: r.label for r in named.collect()} == {1: "short", 2: "long", 3: "long", 4: "none"}
    with pytest.raises(ValueError):
        models.predictor(pairs, "score", 2)(F.col("text"))
