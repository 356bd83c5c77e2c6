"""Models of the caller's own over columns: loaded once a worker, called with batches, and failures kept to their rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import bounded, ship

#: A loaded model: lists of equal length, one an input, to a value for each.
Model = Callable[..., Sequence[Any]]
#: What stands for a missing value of each kind on its way out of the worker.
KINDS: dict[str, tuple[T.DataType, Callable[[Any], Any], Any]] = {
    "vector": (T.ArrayType(T.DoubleType()), lambda x: np.asarray(x, np.float64).ravel(), np.zeros(0)),
    "score": (T.DoubleType(), float, 0.0),
    "label": (T.StringType(), str, ""),
}


def predictor(load: Callable[[], Model], kind: str = "vector", inputs: int = 1, batch: int = 64) -> Callable[..., Column]:
    """A function of ``inputs`` columns of text (one or two) that gives a struct of ``value`` and ``error``.

    ``load`` makes the model, once in each worker; if that fails, so does the task. The model gets ``batch`` rows at
    once. A batch that raises, or gives another number of values, is called again row by row, so that only
    rows that fail by themselves have a null value and what was raised as ``error``. A row with a null input isn't
    sent: value and error are null. Kinds: vector, score (neither may hold NaN or infinity, which is an error), label.
    """
    own, typed, missing = KINDS[kind]
    returned = T.StructType([T.StructField("value", own), T.StructField("error", T.StringType())])

    def made() -> Callable[..., list[dict[str, Any]]]:
        model = load()

        def called(rows: list[tuple]) -> list[Any]:
            values = [typed(v) for v in model(*(list(column) for column in zip(*rows, strict=True)))]
            if len(values) != len(rows):
                raise ValueError(f"{len(values)} values for {len(rows)} rows")
            if kind != "label" and not all(np.isfinite(v).all() for v in values):
                raise ValueError("a value is not finite")
            return values

        def each(rows: list[tuple]) -> list[tuple[Any, str]]:
            try:
                return [(v, "") for v in called(rows)]
            except Exception as raised:  # noqa: BLE001  what a model raises is the row's error
                if len(rows) == 1:
                    return [(missing, f"{type(raised).__name__}: {raised}")]
                return [pair for row in rows for pair in each([row])]

        def predict(columns: tuple[np.ndarray, ...]) -> list[dict[str, Any]]:
            rows = list(zip(*columns, strict=True))
            sent = [i for i, row in enumerate(rows) if all(x is not None for x in row)]
            out = [(missing, "")] * len(rows)
            for i, pair in zip(sent, each([rows[i] for i in sent]) if sent else [], strict=True):
                out[i] = pair
            return [{"value": v, "error": e} for v, e in out]

        return (lambda one: predict((one,))) if inputs == 1 else (lambda one, two: predict((one, two)))

    call = predict_batch_udf(made, return_type=returned, batch_size=batch)

    def column(*texts: Column) -> Column:
        if len(texts) != inputs:
            raise ValueError(f"{inputs} columns, not {len(texts)}")
        got, null = call(*texts), F.lit(False)
        for text in texts:
            null = null | text.isNull()
        value = F.when((got["error"] == "") & ~null, got["value"])
        return F.struct(value.alias("value"), F.nullif(got["error"], F.lit("")).alias("error"))

    return column


def embed(rows: DataFrame, load: Callable[[], Model], text: str = "text", batch: int = 64) -> DataFrame:
    """``id, vector, error`` of each row of ``rows(id, text)``, by a model of texts to vectors."""
    made = bounded(rows).select("id", predictor(load, "vector", 1, batch)(F.col(text)).alias("_made"))
    return made.select("id", F.col("_made.value").alias("vector"), "_made.error")


def scorer(spark_frame: DataFrame, load: Callable[[], Model], batch: int = 64) -> Callable[[Column, Column], Column]:
    """A scorer of pairs for ``rerank.rerank`` and ``rerank.combined``; a pair that fails has no score and comes last."""
    ship(spark_frame.sparkSession)
    call = predictor(load, "score", 2, batch)
    return lambda query, text: call(query, text)["value"]


def classify(rows: DataFrame, load: Callable[[], Model], otherwise: str, text: str = "text", batch: int = 64) -> DataFrame:
    """``id, label, error`` by a model of texts to labels; ``otherwise`` where there is no text, or the model fails."""
    made = bounded(rows).select("id", predictor(load, "label", 1, batch)(F.col(text)).alias("_made"))
    return made.select("id", F.coalesce("_made.value", F.lit(otherwise)).alias("label"), "_made.error")
