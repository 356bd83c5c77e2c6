"""K-means of several starts and several k at once: each step is one pass that carries the centroids of all runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import bounded, write_table

#: Distances (vector and centroid) that a task holds at once.
CELLS = 2_000_000
#: Passes that draw candidates for the starts, and candidates a pass and cluster.
ROUNDS, DRAWN = 2, 2
#: A run ends when none of its centroids moves further.
MOVED = 1e-4


@dataclass
class Run:
    """One start: its number of clusters, seed, centroids, and sum of squared distances."""

    k: int
    seed: int
    centroids: np.ndarray
    cost: float = np.inf


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """``h, w, v``: each distinct vector, how many rows have it, and a hash to draw by.

    A group of copies is one row, however large. Vectors that are null, or hold a null, NaN or
    infinite component, take no part.
    """
    typed = vectors.select(F.transform("vector", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    counted = typed.filter(F.col("v").isNotNull() & finite).groupBy("v").agg(F.count("*").alias("w"))
    return write_table(counted.select(F.xxhash64("v").alias("h"), "w", "v"), "distinct")


def _parts(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        step = max(1, CELLS // max(columns, 1))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            x = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
            yield part.column("h").to_numpy(), part.column("w").to_numpy().astype(np.float64), x


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)[None] - 2 * x @ centroids.T, 0)


def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes and a seed, the same in any partition."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64(seed % 2**32 + 1) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # a mix of all bits
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54


def _edges(runs: list[Run]) -> np.ndarray:
    return np.cumsum([0, *(len(r.centroids) for r in runs)])


def _summed(table: DataFrame, runs: list[Run], extra: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass: the weight, the sum and the cost of the vectors next to each centroid of each run, or of what ``extra`` gives.

    Tasks hand on a row a centroid; those are added up by centroid.
    """
    edges, width = _edges(runs), runs[0].centroids.shape[1]
    model = table.sparkSession.sparkContext.broadcast((np.concatenate([r.centroids for r in runs]), edges))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, edges = model.value
        n, total, cost = np.zeros(len(centroids)), np.zeros((len(centroids), width)), np.zeros(len(centroids))
        for _, w, x in _parts(batches, len(centroids)):
            d = _distances(x, centroids)
            for lo, hi in zip(edges, edges[1:], strict=False):
                own = d[:, lo:hi].argmin(axis=1) + lo
                added = d[np.arange(len(x)), own] if extra is None else extra(x, own, lo, hi)
                n += np.bincount(own, w, len(n))
                cost += np.bincount(own, w * added, len(n))
                mine = np.zeros((hi - lo, len(x)))
                mine[own - lo, np.arange(len(x))] = w
                total[lo:hi] += mine @ x  # the sums as a product: no row is sorted or copied
        keep = np.flatnonzero(n)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[keep].ravel()), width).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(n[keep]), sums, pa.array(cost[keep])], names=["cell", "n", "total", "cost"])

    def add(cell: pa.Table) -> pa.Table:
        rows = np.stack(cell.column("total").combine_chunks().flatten().to_numpy().reshape(cell.num_rows, -1)).sum(axis=0)
        return pa.table({"cell": cell.column("cell")[:1], "n": [cell.column("n").to_numpy().sum()], "total": [rows.tolist()], "cost": [cell.column("cost").to_numpy().sum()]})

    schema = "cell bigint, n double, total array<double>, cost double"
    found = bounded(table).mapInArrow(step, schema).groupBy("cell").applyInArrow(add, schema).toArrow()  # a row a centroid
    model.unpersist()
    n, total, cost = np.zeros(edges[-1]), np.zeros((edges[-1], width)), np.zeros(edges[-1])
    cells = found.column("cell").to_numpy()
    n[cells], cost[cells] = found.column("n").to_numpy(), found.column("cost").to_numpy()
    if len(cells):
        total[cells] = found.column("total").combine_chunks().flatten().to_numpy().reshape(len(cells), -1)
    return n, total, cost


def _starts(table: DataFrame, wanted: list[tuple[int, int]]) -> list[Run]:
    """Candidates drawn in a few passes by their distance from those before, then k of them for each run, by weight."""
    spark = table.sparkSession
    schema, seeds = "run int, v array<double>", [seed for _, seed in wanted]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[float, list[float]] | None] = [None] * len(seeds)
        for h, w, x in _parts(batches, 1):
            for i, seed in enumerate(seeds):
                key = -np.log(_uniform(h, seed * 8)) / w
                at = int(key.argmin())
                if best[i] is None or key[at] < best[i][0]:
                    best[i] = (float(key[at]), x[at].tolist())
        some = [(i, *b) for i, b in enumerate(best) if b]
        yield pa.RecordBatch.from_pydict({"run": pa.array([s[0] for s in some], pa.int32()), "key": [s[1] for s in some], "v": pa.array([s[2] for s in some], pa.list_(pa.float64()))})

    least = bounded(table).mapInArrow(first, "run int, key double, v array<double>").groupBy("run").agg(F.min(F.struct("key", "v"))["v"].alias("v")).collect()  # a row a run
    runs = [Run(k, seed, np.array([r.v])) for r in sorted(least, key=lambda r: r.run) for k, seed in [wanted[r.run]]]
    for i in range(ROUNDS):
        _, _, cost = _summed(table, runs)
        costs = np.add.reduceat(cost, _edges(runs)[:-1])
        model = spark.sparkContext.broadcast((np.concatenate([r.centroids for r in runs]), _edges(runs), costs, [(r.k, r.seed) for r in runs]))

        def draw(batches: Iterator[pa.RecordBatch], i: int = i, model=model) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            centroids, edges, costs, wanted = model.value
            for h, w, x in _parts(batches, len(centroids)):
                d = _distances(x, centroids)
                for r, (k, seed) in enumerate(wanted):
                    chance = DRAWN * k * w * d[:, edges[r] : edges[r + 1]].min(axis=1) / max(costs[r], 1e-300)
                    taken = x[_uniform(h, seed * 8 + i + 1) < chance]
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(taken.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(taken), r, np.int32)), lists], names=["run", "v"])

        drawn = bounded(table).mapInArrow(draw, schema).orderBy("run", "v").collect()  # about DRAWN * k a run
        for r, run in enumerate(runs):
            run.centroids = np.concatenate([run.centroids, *(np.array([d.v]) for d in drawn if d.run == r)])
    weights, _, _ = _summed(table, runs)
    edges = _edges(runs)
    for r, run in enumerate(runs):
        run.centroids = _chosen(run.centroids, weights[edges[r] : edges[r + 1]], run.k, np.random.default_rng(run.seed))
    return runs


def _chosen(candidates: np.ndarray, weights: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """``k`` of the candidates, each drawn by weight and squared distance from those before."""
    taken = [int(draw.choice(len(candidates), p=weights / weights.sum()))]
    while len(taken) < k:
        chance = weights * _distances(candidates, candidates[taken]).min(axis=1)
        chance[taken] = 0
        if chance.sum() <= 0:
            break
        taken.append(int(draw.choice(len(candidates), p=chance / chance.sum())))
    return candidates[taken]


def fit_runs(table: DataFrame, wanted: list[tuple[int, int]], iterations: int = 300) -> list[Run]:
    """The runs ``wanted`` (k, seed) over ``distinct_vectors``, with their costs.

    The number of passes is that of the longest run, not the sum over the runs: a pass moves the
    centroids of all that haven't ended. What comes to the driver are centroids and their sums.
    A run has fewer centroids than its k where there are fewer distinct vectors.
    """
    runs = _starts(table, wanted)
    open_runs = list(runs)
    for _ in range(iterations):
        if not open_runs:
            break
        n, total, _ = _summed(table, open_runs)
        edges, still = _edges(open_runs), []
        for r, run in enumerate(open_runs):
            own = slice(edges[r], edges[r + 1])
            moved = np.where(n[own, None] > 0, total[own] / np.maximum(n[own, None], 1), run.centroids)  # an empty one stays
            if np.sqrt(((moved - run.centroids) ** 2).sum(axis=1)).max() > MOVED:
                still.append(run)
            run.centroids = moved
        open_runs = still
    _, _, cost = _summed(table, runs)
    for run, c in zip(runs, np.add.reduceat(cost, _edges(runs)[:-1]), strict=True):
        run.cost = float(c)
    return runs


def silhouettes(table: DataFrame, runs: list[Run]) -> list[float]:
    """Each run's mean silhouette by squared distance, from the sums of its clusters: two passes for all runs."""
    squares = lambda x, own, lo, hi: (x * x).sum(axis=1)
    n, total, square = _summed(table, runs, squares)
    many, mean, spread = np.maximum(n, 1), total / np.maximum(n, 1)[:, None], square / np.maximum(n, 1)

    def value(x: np.ndarray, own: np.ndarray, lo: int, hi: int) -> np.ndarray:
        to = np.maximum((x * x).sum(axis=1)[:, None] + spread[lo:hi] - 2 * x @ mean[lo:hi].T, 0)
        to[:, n[lo:hi] == 0] = np.inf
        at = np.arange(len(x)), own - lo
        inner = to[at] * many[own] / np.maximum(many[own] - 1, 1)
        to[at] = np.inf
        outer = to.min(axis=1)
        alone = (many[own] == 1) | ~np.isfinite(outer)
        return np.where(alone, 0.0, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300)) if hi - lo > 1 else np.zeros(len(x))

    _, _, silhouette = _summed(table, runs, value)
    return [float(s / n[: _edges(runs)[1]].sum()) for s in np.add.reduceat(silhouette, _edges(runs)[:-1])]
